"""Contraction against union-find, its growth, and hubs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.operators import components
from topicloom.operators.components import connected_components


def by_force(edges):
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            top[b] = a
    return {x: find(x) for x in list(top)}


def found(spark, edges):
    rows = connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    got = {r["node"]: r["component"] for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.fixture
def written(monkeypatch):
    """Labels and rows of the scratch tables."""
    out = []

    def noted(df, label, write=components.materialize):
        df = write(df, label)
        out.append((label, df.count()))
        return df

    monkeypatch.setattr(components, "materialize", noted)
    return out


@pytest.fixture
def shuffled(spark):
    """No join is broadcast unless asked for; partitions stay apart."""
    kept = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in kept}
    for k, v in kept.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_rows_written_stay_near_the_links(spark, written):
    """Orders of four parts each: links get fewer by the round."""
    rng = np.random.default_rng(7)
    edges = [(o, int(-1 - p)) for o in range(6000) for p in rng.integers(0, 800, 4)]
    assert found(spark, edges) == by_force(edges)
    assert sum(n for _, n in written) < 4 * len(edges)


def test_long_path_takes_few_rounds(spark, written):
    edges = [(i, i + 1) for i in range(3000)]
    assert set(found(spark, edges).values()) == {0}
    assert sum(label == "links" for label, _ in written) <= 20


def test_odd_links(spark):
    low, high = -(2**63), 2**63 - 1
    edges = [(low, high), (high, low), (high, 0), (3, 3), (None, 4), (5, None), (7, 8), (8, 7), (8, 7)]
    assert found(spark, edges) == by_force(edges) == {low: low, high: low, 0: low, 7: 7, 8: 7}
    assert found(spark, [(1, 1), (None, 2)]) == found(spark, []) == {}


@pytest.mark.parametrize("sign", [1, -1])
def test_hubs(spark, shuffled, monkeypatch, sign):
    monkeypatch.setattr(components, "HOT_FROM", 0)
    monkeypatch.setattr(components, "HOT_NODES", 20)
    hubs = [(sign * h * 10_000, sign * (h * 10_000 + i)) for h in range(1, 5) for i in range(1, 1500)]
    ties = [(sign * 10_000, sign * 20_003), (sign * 30_007, sign * 39_000), (sign * 39_000, sign * 39_001)]
    pairs = [(sign * (100_000 + 2 * i), sign * (100_001 + 2 * i)) for i in range(800)]
    edges = hubs + ties + pairs
    assert found(spark, edges) == by_force(edges)


def test_rows_of_a_hub_are_spread(spark, shuffled):
    rows = spark.range(20_000).select(F.col("id").alias("u"), F.when(F.col("id") < 15_000, -1).otherwise(F.col("id")).cast("long").alias("to"))
    moves = spark.range(-1, 20_000).select(F.col("id").alias("u"), (F.col("id") + 100_000).alias("to"))
    busy = spark.range(-1, 0).select(F.col("id").alias("u"))
    for table, goes in ((moves, 99_999), (moves.where("u >= 0"), -1)):
        named = components._renamed(rows, "to", table, busy).withColumn("part", F.spark_partition_id())
        assert named.where(F.col("to") == goes).count() == 15_000 and named.count() == 20_000
        assert named.where(F.col("u") >= 15_000).where("to <> u + 100000").count() == 0
        assert named.groupBy("part").count().agg(F.max("count")).first()[0] < 6_000
