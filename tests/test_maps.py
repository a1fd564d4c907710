"""The map of frequent n-grams comes to the driver packed."""

import numpy as np
from pyspark.sql import DataFrame

from topicloom.operators.ngrams import Seen


def test_map_comes_in_packed_blocks(spark, monkeypatch):
    names = [f"w{i} w{i * i % 977}" for i in range(9000)]
    monkeypatch.setattr(DataFrame, "toPandas", None)  # a row for every 64 bits came to the driver before
    seen = Seen.of(spark.createDataFrame([(n,) for n in names], "feature string"))
    slots = np.unique(Seen.slots(names, 64 * len(seen.words)))
    bits = np.unpackbits(seen.words.view(np.uint8), bitorder="little")
    assert (np.flatnonzero(bits) == slots).all() and len(seen.words) * 64 >= 9000 * 16


def test_volumes_take_numbers_not_texts(spark):
    """Long n-grams cost a pass no more than short ones."""
    from topicloom.operators import containment

    long = lambda i: f"{'a' * 40}{i % 9} {'b' * 40}{i % 7}"
    queries = spark.createDataFrame([(long(i) + f" c{i}", i) for i in range(200)], "query string, search_volume long")
    features = spark.createDataFrame([(long(i),) for i in range(63)], "feature string")
    sums, plain, passes = {}, containment._map_side_volumes, []
    for i in range(200):
        sums[long(i)] = sums.get(long(i), 0) + i
    containment._map_side_volumes = lambda *a: (passes.append(a[-1]), plain(*a))[1]
    try:
        got = containment.ngram_volume(features, queries, broadcast_bytes=2000)
    finally:
        containment._map_side_volumes = plain
    assert passes == [1]  # nine passes before
    assert {r["feature"]: r["search_volume"] for r in got.collect()} == sums


def test_ngrams_that_begin_alike_are_looked_at_once(monkeypatch):
    """A query without the second word meets one node, not every n-gram of the first one."""
    import pyarrow as pa

    from topicloom.operators import containment

    words = pa.array(["a", "b", *(f"x{i}" for i in range(50))])
    rest = np.array([[1, i + 2] for i in range(50)], dtype=np.int32)
    order, tree = containment._tree(np.zeros(50, dtype=np.int64), rest, 52)
    index, seen, plain = {"words": words, **tree}, [], containment._spans

    def spans(*a):
        for own, place in plain(*a):
            seen.append(len(own))
            yield own, place

    monkeypatch.setattr(containment, "_spans", spans)
    found = [(q, order[f]) for qs, fs in containment.hits(index, pa.array(["a x1", "a b x1 x7", None, "b"])) for q, f in zip(qs, fs)]
    assert sorted(found) == [(1, 1), (1, 7)]
    assert sum(seen) == 2 + 50 + 2  # 100 candidates and two words each before
