import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.operators.percentile import exact_percentile
from topicloom.operators.rank import (
    SWEEP, global_rank, knee_filter, knee_points, knee_sweep, select_topics, topics_markdown,
)


def walk(scores, s):
    """The knee by a plain walk over the sorted scores."""
    n, lo, hi = len(scores), min(scores), max(scores)
    if n < 3 or lo == hi:
        return None
    d = [(1.0 - (y - lo) / (hi - lo)) - i / (n - 1) for i, y in enumerate(scores)]
    knee = limit = None
    for i in range(n - 1):
        left, right = d[max(i - 1, 0)], d[i + 1]
        if d[i] >= left and d[i] >= right:
            knee, limit = i, d[i] - s * (1.0 / (n - 1))
        if knee is not None and d[i] <= left and d[i] <= right:
            limit = 0.0
        if knee is not None and d[i + 1] < limit:
            return knee + 1
    return None


def curves():
    rng = random.Random(5)
    yield [1.0 / (i + 1) for i in range(60)]
    yield [5.0] * 10
    yield [3.0, 1.0]
    yield [9.0, 2.0, 1.0]
    yield [4.0] * 5 + [1.0] * 5
    for _ in range(5):
        yield sorted((rng.choice([rng.random() ** 4, 0.25, 0.5]) for _ in range(rng.randrange(3, 90))), reverse=True)


@pytest.mark.parametrize("scores", list(curves()))
def test_knee_points_equal_the_walk(spark, scores):
    df = spark.createDataFrame([(f"q{i:04d}", y) for i, y in enumerate(scores)], "query string, score double")
    values = [1000.0, 40.0, 5.0, 1.0, 0.0]
    got = {r["s"]: r["knee"] for r in knee_points(df.repartition(5), "score", values).collect()}
    want = {s: walk(scores, s) for s in values}
    assert {s: got.get(s) for s in values} == want


def test_global_rank_needs_no_single_partition(spark):
    rows = [(i, float(i % 7)) for i in range(5000)]
    df = spark.createDataFrame(rows, "query long, score double").repartition(16)
    ranked = global_rank(df, [F.desc("score"), F.asc("query")])
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan.split("BroadcastExchange")[0]
    want = {q: i + 1 for i, (q, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert {r["query"]: r["rank"] for r in ranked.collect()} == want


def test_select_topics(spark):
    scores = sorted((1000.0 / (i + 1) for i in range(1500)), reverse=True)
    df = spark.createDataFrame([(f"q{i:05d}", y) for i, y in enumerate(scores)], "query string, score double")
    want = next((k for s in SWEEP if (k := walk(scores, s)) and k <= 1000), 1000)
    assert knee_sweep(df).first()["knee"] == want
    assert select_topics(df).count() == want
    assert select_topics(df, min_length=1200).count() == max(want, 1200)
    assert select_topics(df.limit(40)).count() == 40
    assert knee_filter(df.limit(2)).count() == 2


def test_select_topics_without_a_knee_takes_the_top(spark):
    df = spark.createDataFrame([(f"q{i:05d}", float(-i)) for i in range(1100)], "query string, score double")
    if all(walk([float(-i) for i in range(1100)], s) is None for s in SWEEP):
        assert select_topics(df).count() == 1000


def test_topics_markdown_order(spark):
    df = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", 1.0)], "query string, score double")
    lines = topics_markdown(df).first()["markdown"].split("\n")
    assert lines[2:] == ["| c | 1.000000 |", "| a | 0.500000 |", "| b | 0.500000 |"]


def test_exact_percentile(spark):
    df = spark.createDataFrame([(float(v),) for v in (5, 1, 3, 2)], "v double")
    assert exact_percentile(df, "v", 50).first()["value"] == 2.5
    assert exact_percentile(df, "v", 100).first()["value"] == 5.0


@pytest.mark.parametrize("percent", [0, 12.5, 98.9, 99.1, 100])
def test_percentile_of_mostly_one_value(spark, percent):
    """99 % of the rows hold one value; they are one row before anything is sorted."""
    values = [0.0] * 1980 + [float(v) for v in range(1, 21)]
    df = spark.createDataFrame([(v,) for v in values], "x double").union(spark.createDataFrame([(None,)], "x double"))
    assert exact_percentile(df, "x", percent).first()["value"] == pytest.approx(np.percentile(values, percent))
