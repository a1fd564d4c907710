"""Ways in: texts without vectors, a path or a property as the source, ids that are no numbers."""

import numpy as np
import pytest

from topicloom.plans.clustering import cluster_topics
from topicloom.plans.pipeline import build_categories
from topicloom.plans.tagging import add_categories
from topicloom.sources.readers import read_queries, write_table

OUTLINE = "- Home\n  - Red\n  - Blue"


def encoder():
    return lambda texts: np.array([[x.lower().count("red"), x.lower().count("blue")] for x in texts], np.float32)


def test_add_categories_from_texts(spark):
    rows = spark.createDataFrame([(1, "red cup"), (2, "blue cup"), (3, None), (4, "cup")], "id int, query string")
    got = {r["id"]: r["category_path"] for r in add_categories(rows, OUTLINE, encoder=encoder).collect()}
    assert got == {1: "Home > Red", 2: "Home > Blue", 3: "Miscellaneous", 4: "Miscellaneous"}


def test_cluster_topics_from_texts_with_text_ids(spark):
    rows = [(f"k{i}", "red cup" if i % 2 else "blue cup") for i in range(12)] + [("none", None)]
    df = spark.createDataFrame(rows, "id string, query string")
    got = cluster_topics(df, min_cluster_size=4, use_elbow=False, keep_outliers=True, encoder=encoder)
    assert got.columns == ["id", "query", "label", "text_label"]
    found = {r["id"]: r["label"] for r in got.collect()}
    assert len(found) == 13 and found["none"] == -1
    assert len({found[f"k{i}"] for i in range(1, 12, 2)}) == len({found[f"k{i}"] for i in range(0, 12, 2)}) == 1
    assert found["k0"] != found["k1"] and -1 not in (found["k0"], found["k1"])


def test_build_from_a_path_with_review(spark, tmp_path):
    path = str(tmp_path / "log.csv")
    log = spark.createDataFrame([("red cup", 5), ("red mug", 3), ("blue cup", 2), ("blue mug", 1)], "keyword string, n int")
    write_table(log, path)
    built = build_categories(
        path, write_outline=lambda table: "- Draft", review_outline=lambda draft: OUTLINE if draft == "- Draft" else "- No",
        min_df=2, encoder=encoder, spark=spark, reading={"text_col": "keyword", "volume_col": "n"}, max_samples=2, min_length=3,
    )
    assert {r["path"] for r in built.categories.collect()} == {"Home > Red", "Home > Blue"}
    assert {(r["query"], r["category_path"]) for r in built.tagged.collect()} == {
        (q, f"Home > {q.split()[0].title()}") for q in ("red cup", "red mug", "blue cup", "blue mug")
    }
    assert built.topics.count() == 3 and built.scored.count() == 4


def test_property_search(spark):
    daily = spark.createDataFrame(
        [("sc-domain:a.example", "q", "p", 1, 2), ("sc-domain:ab.example", "q", "p", 3, 4), ("sc-domain:c.example", "q", "p", 5, 6)],
        "property string, query string, page string, clicks int, impressions int",
    ).selectExpr("*", "DATE'2024-01-30' AS date")
    read = lambda name: read_queries(spark, name, performance=daily, end_date="2024-01-30").collect()
    assert [r["clicks"] for r in read("sc-domain:a.example")] == [1]
    assert [r["clicks"] for r in read("sc-domain:c")] == [5]
    for name in ("sc-domain:a", "sc-domain:z"):
        with pytest.raises(ValueError):
            read(name)
