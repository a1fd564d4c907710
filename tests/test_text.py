from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from topicloom.functions import text as T
from topicloom.functions.stopwords import ENGLISH
from topicloom.functions.vectors import cosine, l2_normalize


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v"))).first()[0]


def test_stop_words_are_sparks(spark):
    assert list(ENGLISH) == StopWordsRemover.loadDefaultStopWords("english")


def test_tokenize_drops_short_and_stop_words(spark):
    got = one(spark, T.tokenize, "The élan of a T-Shirt, x 42 foo_bar")
    assert got == ["élan", "shirt", "42", "foo_bar"]


def test_ngrams_cross_removed_stop_words(spark):
    got = one(spark, lambda c: T.ngrams(T.tokenize(c), 1, 3), "pool and chairs")
    assert got == ["pool", "chairs", "pool chairs"]
    assert one(spark, lambda c: T.ngrams(T.tokenize(c), 1, 3), "") == []


def test_distinct_words(spark):
    assert one(spark, T.distinct_words, "google ads google") == "google ads"


def test_remove_terms(spark):
    brands = ["Acme", "big store"]
    assert one(spark, lambda c: T.remove_terms(c, brands), "ACME big store chairs") == "big store chairs"
    assert one(spark, lambda c: T.remove_terms(c, brands, True), "acme Big Store chairs") == "chairs"
    assert one(spark, lambda c: T.remove_terms(c, []), "as is") == "as is"


def test_strip_spaces_takes_any_white_space(spark):
    assert one(spark, T.strip_spaces, " \t a b \n ") == "a b"


def test_outline_paths(spark):
    text = "- Top\n  - Mid-dle\n      - Deep\n    - Skipped back\n\n- Other\n\t- Tabbed"
    # the indents are 0, 1, 2, 4 and 6; an entry keeps as much of the path as its level allows
    got = one(spark, T.outline_paths, text)
    assert got == [
        "Top > Middle",
        "Top > Middle > Deep",
        "Top > Middle > Deep > Skipped back",
        "Other > Tabbed",
    ]
    assert one(spark, T.outline_paths, "A\nB") == []


def test_outline_skipped_levels(spark):
    got = one(spark, T.outline_paths, "A\n    B\n  C\n  D")
    assert got == ["A > B", "A > C", "A > D"]
    text = "A\n      B\n    C\n  D\n"  # B leaves two levels out, so C stays below it
    assert one(spark, T.outline_paths, text) == ["A > B", "A > B > C", "A > D"]


def test_parse_sections(spark):
    text = "before\n%%a%%: one: two\n\n\nmore \nx: %%b%%: v\n%%a%%:again"
    assert one(spark, T.parse_sections, text) == {"b": "%%b%%: v", "a": "again"}
    assert one(spark, T.parse_sections, "%%a%%: one\n\n two ") == {"a": "one\n\ntwo"}


def test_parse_request(spark):
    assert one(spark, T.parse_request, "sc-domain:x.com, 30 days!").days is None
    good = one(spark, T.parse_request, " sc-domain:x.com , 30")
    assert (good.property, good.days, good.error) == ("sc-domain:x.com", 30, None)
    assert one(spark, T.parse_request, "only one").error


def test_split_response(spark):
    assert one(spark, T.split_response, " Google News,Bing ") == ["Google News", "Bing"]


def test_zero_vector_has_no_direction(spark):
    row = spark.createDataFrame([([0.0, 0.0], [3.0, 4.0])], "a array<double>, b array<double>")
    got = row.select(l2_normalize(F.col("a")), l2_normalize(F.col("b")), cosine(F.col("a"), F.col("b"))).first()
    assert got[0] == [None, None] and got[1] == [0.6, 0.8] and got[2] is None
