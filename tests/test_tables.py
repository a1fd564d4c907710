import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from topicloom.operators import containment, ngrams
from topicloom.operators.clean import integer_volume
from topicloom.operators.clean import clean_queries, top_n_per_group
from topicloom.operators.containment import containment_join, ngram_volume
from topicloom.operators.ctfidf import class_tfidf
from topicloom.operators.lookup import cross_pairs, lookup_code, name_dimension
from topicloom.operators.ngrams import merge_ngrams, ngram_frequency
from topicloom.operators.scoring import max_scale, row_mean
from topicloom.plans.topics import score_topics
from topicloom.sources import read_queries, rename_url_column, write_table
from topicloom.sources.readers import source_kind


def test_clean_provided(spark):
    rows = [
        (None, "p", "5"), ("ab", "p", "5"), ("T-Shirt!", "p", "1.9"), (" chair ", "p", "x"),
        ("acme", "p", "9"), ("acme chair", "q", None), ("big store", "q", "2"),
    ]
    df = spark.createDataFrame(rows, "query string, page string, search_volume string")
    got = clean_queries(df, brand_terms=["Acme", "big store"]).collect()
    assert {(r["query"], r["search_volume"]) for r in got} == {
        ("TShirt", 1), ("chair", 0), ("big store", 2),
    }
    plain = clean_queries(df, strip=False).collect()
    assert ("T-Shirt!", 1) in {(r["query"], r["search_volume"]) for r in plain}


def test_clean_performance_removes_brands_last(spark):
    df = spark.createDataFrame(
        [("ACME", "p", 1, 10), ("Acme Chair", "p", 3, 5)],
        "query string, page string, clicks long, impressions long",
    )
    got = clean_queries(df, "performance", ["acme"]).collect()
    assert {(r["query"], r["search_volume"], r["original_query"]) for r in got} == {
        ("", 10, "ACME"), ("chair", 5, "Acme Chair"),
    }


def test_top_n_ties_and_null_groups(spark):
    df = spark.createDataFrame(
        [("p", "b", 1), ("p", "a", 1), ("p", "c", 2), (None, "d", 9)], "page string, query string, v int"
    )
    got = top_n_per_group(df, "page", 2, [F.desc("v"), F.asc("query")]).collect()
    assert {r["query"] for r in got} == {"c", "a"}


@pytest.mark.parametrize("by_level", [True, False])
def test_ngram_frequency(spark, by_level):
    texts = ["google google ads", "google ads", "ads on google", "ad x", "ad", ""]
    df = spark.createDataFrame([(t,) for t in texts], "query string")
    got = {r["feature"]: r["frequency"] for r in ngram_frequency(df, min_df=2, by_level=by_level).collect()}
    # "google google" is in one text only; "ad" is too short
    assert got == {"google": 4, "ads": 3, "google ads": 2}
    share = ngram_frequency(df, min_df=0.5, by_level=by_level).collect()
    assert {r["feature"] for r in share} == {"google", "ads"}


def test_pruned_counts_equal_plain_counts(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice("red blue green cat dog the of bird".split()) for _ in range(rng.randrange(9)))
             for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "query string")
    a = sorted(ngram_frequency(df, min_df=3, by_level=True).collect())
    assert a == sorted(ngram_frequency(df, min_df=3, by_level=False).collect()) and a


@pytest.mark.parametrize("at_once", [1, 40, 1 << 20])
def test_counted_runs_by_force(spark, monkeypatch, at_once):
    monkeypatch.setattr(ngrams, "TOKENS_AT_ONCE", at_once)
    rng = random.Random(at_once)
    rows = [[rng.choice("ab bc cd é 中文 x1".split()) for _ in range(rng.randrange(12))] for _ in range(120)] + [None, [], ["ab"] * 50]
    tokens = spark.createDataFrame([(r,) for r in rows], "tokens array<string>").repartition(3)
    times, docs = Counter(), Counter()
    for r in rows:
        runs = [" ".join(r[i : i + n]) for n in range(1, 5) for i in range(len(r) - n + 1)] if r else []
        times.update(runs)
        docs.update(set(runs))
    got = {r["feature"]: (r["frequency"], r["doc_frequency"]) for r in ngrams.count_runs(tokens, range(1, 5)).collect()}
    assert got == {f: (times[f], docs[f]) for f in times}
    words = spark.createDataFrame([("ab",), ("cd",), ("é",)], "feature string")
    pairs = spark.createDataFrame([("ab cd",), ("cd ab",), ("é é",)], "feature string")
    got = {r["feature"]: r["frequency"] for r in ngrams.count_runs(tokens, range(3, 5), ngrams.Seen.of(words), ngrams.Seen.of(pairs)).collect()}
    known = {r[0] for r in pairs.collect()}
    assert got == {f: n for f, n in times.items() if f.count(" ") >= 2 and all(" ".join(f.split()[i : i + 2]) in known for i in range(f.count(" ")))}


@pytest.mark.parametrize("marks", [1, 1 << 25])
def test_containment_hits_by_force(spark, monkeypatch, marks):
    monkeypatch.setattr(containment, "MARKS_AT_ONCE", marks)
    monkeypatch.setattr(containment, "CANDIDATES_AT_ONCE", marks)
    monkeypatch.setattr(containment, "ROWS_AT_ONCE", 7)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)] + ["", "É"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 12))) for _ in range(200)] + [None, "W1 w2", "w1 " * 500]
    names = sorted({" ".join(rng.sample(words[:30], rng.randrange(1, 4))) for _ in range(60)} | {"é w3"})
    queries = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, query string, _text string")
    features = spark.createDataFrame([(n,) for n in names], "feature string")
    got = sorted((r["feature"], r["id"], r["_text"]) for r in containment_join(features, queries).collect())
    assert got == sorted((n, i, "x") for n in names for i, t in enumerate(texts) if t is not None and set(n.split(" ")) <= set(t.lower().split(" ")))


def test_merge_ngrams_against_subtract_and_clamp(spark):
    rng = random.Random(1)
    words = "a1 b2 c3 d4 e5".split()
    counts = Counter()
    for _ in range(120):
        n = rng.randrange(1, 5)
        counts[" ".join(rng.sample(words, n))] += rng.randrange(1, 6)
    merged = {}
    for g, f in counts.items():
        left = f
        for h, fh in counts.items():
            inside = f" {g} " in f" {h} " and len(h.split()) == len(g.split()) + 1
            if inside and fh <= f:
                left = max(0, left - fh)
        if left:
            merged[g] = left
    top, top_f = max(merged.values()), max(counts[g] for g in merged)
    df = spark.createDataFrame(list(counts.items()), "feature string, frequency long")
    got = {r["feature"]: (r["merged_frequency"], r["frequency"]) for r in merge_ngrams(df).collect()}
    assert got == {g: (m / top, counts[g] / top_f) for g, m in merged.items()}
    assert merge_ngrams(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(3)
    words = "pool chair table red blue big".split()
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 6))), rng.randrange(50)) for _ in range(400)]
    rows += [("pool chair", 7)] * 300 + [("Chair, pool", 1), ("", 3)]  # a third are copies
    return rows


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_ngram_volume_both_plans(spark, log, limit):
    features = ["pool", "chair pool", "red blue big", "missing", "pool missing"]
    want = {
        f: sum(v for q, v in log if set(f.split()) <= set(q.lower().split(" "))) for f in features
    }
    df = spark.createDataFrame(log, "query string, search_volume long")
    names = spark.createDataFrame([(f,) for f in features], "feature string")
    got = ngram_volume(names, df, broadcast_bytes=limit)
    assert {r["feature"]: r["search_volume"] for r in got.collect()} == want
    pairs = containment_join(names, df, broadcast_bytes=limit).groupBy("feature").count()
    assert {r["feature"]: r["count"] for r in pairs.collect()} == {
        f: n for f in features
        if (n := sum(set(f.split()) <= set(q.lower().split(" ")) for q, _ in log))
    }


def test_containment_plan_has_no_cartesian_product(spark, log):
    df = spark.createDataFrame(log, "query string, search_volume long")
    names = spark.createDataFrame([("pool chair",)], "feature string")
    for limit in (1 << 26, 0):
        plan = containment_join(names, df, broadcast_bytes=limit)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_score_topics_end_to_end(spark, log):
    df = spark.createDataFrame(log, "query string, search_volume long")
    got = score_topics(df, (1, 2), 5).collect()
    assert [r["score"] for r in got] == sorted((r["score"] for r in got), reverse=True)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert max(r["merged_frequency"] for r in got) == 1.0


def test_max_scale_of_zeros_and_row_mean(spark):
    df = spark.createDataFrame([(0, 2.0), (0, None)], "a long, b double")
    assert {r["a"] for r in max_scale(df, "a").collect()} == {None}
    got = max_scale(df, "a").select(row_mean("a", "b").alias("m")).collect()
    assert {r["m"] for r in got} == {2.0, None}


def test_class_tfidf_formula(spark):
    import math

    rows = [("x", "a", 3), ("x", "b", 1), ("y", "a", 2), ("y", "c", 5)]
    df = spark.createDataFrame(rows, "class string, term string, count long")
    got = {(r["class"], r["term"]): r["tfidf"] for r in class_tfidf(df, bm25=True, reduce_frequent=True).collect()}
    a = math.floor((4 + 7) / 2)
    f = {"a": 5, "b": 1, "c": 5}
    for c, t, n in rows:
        total = 4 if c == "x" else 7
        idf = math.log(1 + (a - f[t] + 0.5) / (f[t] + 0.5))
        assert got[(c, t)] == pytest.approx(math.sqrt(n / total) * idf)


def test_lookup_code(spark):
    raw = spark.createDataFrame(
        [(1, "Guinea-Bissau", "GW"), (2, "Guinea (Republic)", "GN"), (3, "Niger", "NE"), (4, "Nigeria", "NG")],
        "position int, name string, code string",
    )
    dim = name_dimension(raw, "(")
    asked = spark.createDataFrame([("GUINEA",), ("nige",), ("bissau",), ("atlantis",), (None,)], "who string")
    got = {r["who"]: r["code"] for r in lookup_code(asked, "who", dim, contains=True).collect()}
    assert got == {"GUINEA": "GN", "nige": "NE", "bissau": "GW", "atlantis": None, None: None}
    exact = {r["who"]: r["code"] for r in lookup_code(asked, "who", dim).collect()}
    assert exact == {"GUINEA": "GN", "nige": None, "bissau": None, "atlantis": None, None: None}


def test_cross_pairs(spark):
    a = spark.createDataFrame([("x",), ("y",)], "a string")
    got = cross_pairs(a, a.withColumnRenamed("a", "b"), "a", "b").collect()
    assert {(r["item1"], r["item2"]) for r in got} == {("x", "y"), ("y", "x")}


def test_sources(spark, tmp_path):
    assert source_kind("https://x.com/a.csv") == "performance"
    assert source_kind("a.csv") == "file"
    with pytest.raises(ValueError):
        source_kind("a.parquet")
    df = spark.createDataFrame(
        [('say "hi", now', "https://a.b/c", 3), ("two", None, 4)], "keyword string, landing string, n int"
    )
    path = str(tmp_path / "log.csv")
    write_table(df, path)
    back = read_queries(spark, path, "keyword", "n")
    renamed, found = rename_url_column(back)
    assert found and {(r["query"], r["page"], r["search_volume"]) for r in renamed.collect()} == {
        ('say "hi", now', "https://a.b/c", "3"), ("two", None, "4"),
    }
    assert rename_url_column(df.select("keyword", "n"))[1] is False
    assert rename_url_column(df.select("landing", F.col("landing").alias("other")))[1] is False


def test_row_operators_take_a_stream(spark, tmp_path):
    write_table(
        spark.createDataFrame([("The Pool chairs", 2.5), ("ab", 1.0)], "query string, search_volume double"),
        str(tmp_path / "in"), "parquet",
    )
    stream = spark.readStream.schema("query string, search_volume double").parquet(str(tmp_path / "in"))
    out = clean_queries(stream).writeStream.format("memory").queryName("cleaned").start()
    out.processAllAvailable()
    out.stop()
    assert [r["query"] for r in spark.table("cleaned").collect()] == ["The Pool chairs"]


@pytest.mark.parametrize("kind", ["double", "decimal(10,2)", "string", "int"])
def test_volumes_do_not_depend_on_the_plan(spark, kind):
    """Null, NaN and text that is no number count as 0, whether the n-grams are broadcast or shuffled."""
    rows = [("red chair", "1.5"), ("chair red lamp", "2"), ("red", None), ("lamp", "NaN"), (None, "4"), ("chair", "x")]
    queries = spark.createDataFrame(rows, "query string, v string")
    queries = queries.select("query", F.col("v").try_cast(kind).alias("search_volume"))
    features = spark.createDataFrame([("red chair",), ("lamp",), ("red",), ("none",)], "feature string")
    plans = [ngram_volume(features, queries, broadcast_bytes=b) for b in (1 << 26, -1)]
    assert plans[0].schema == plans[1].schema
    got = [{r["feature"]: r["search_volume"] for r in p.collect()} for p in plans]
    first = 0 if kind == "int" else 1.5
    assert got[0] == got[1] == {"red chair": 2 + first, "lamp": 2, "red": 2 + first, "none": 0}


def test_large_volumes_do_not_stop_a_job(spark):
    df = spark.createDataFrame([("1e20",), ("Infinity",), ("7.9",), (None,), ("x",)], "v string")
    assert [r[0] for r in df.select(integer_volume(F.col("v"))).collect()] == [0, 0, 7, 0, 0]


def test_cluster_terms_number_the_names(spark):
    """Each part has the vector of its key and its name's number: all parts, and more vectors than there are names."""
    from topicloom.catalog.spark_queries import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    vectors = {r["id"]: r["embedding"] for r in t.vectors().collect()}
    parts = [(r["p_partkey"], r["p_name"].lower()) for r in t.read("part").collect()]
    number = {name: i for i, name in enumerate(sorted({name for _, name in parts}))}
    got = {r["id"]: (r["query"], r["embedding"]) for r in t.named_vectors().collect()}
    assert got == {key: (name, vectors[(key + number[name]) % len(vectors)]) for key, name in parts}


def test_volumes_in_passes_shuffle_no_queries(spark):
    """A table of n-grams above the limit goes out in blocks; the result is that of one block."""
    from topicloom.operators.containment import ngram_volume

    texts = [(f"w{i % 7} w{i % 11} w{i % 13} x{i}", i) for i in range(300)]
    queries = spark.createDataFrame(texts, "query string, search_volume long")
    names = [f"w{i} w{j}" for i in range(13) for j in range(13)] + [f"x{i}" for i in range(0, 400, 5)]
    features = spark.createDataFrame([(n,) for n in names], "feature string")
    whole, blocks = (ngram_volume(features, queries, broadcast_bytes=b) for b in (1 << 26, 5000))
    assert sorted(blocks.collect()) == sorted(whole.collect())
    assert "search_volume" in blocks.columns and "_doc" not in blocks._jdf.queryExecution().toString()
    assert blocks._jdf.queryExecution().toString().count("block-volumes") > 1  # candidates were joined by shuffle before
