"""Operators on whole tables against brute force, and the defined cases of their docstrings."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from topicloom.llm import mixing, sharding, simhash_dedup

SF_DIR = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\x0c\r"


def words_of(text, white=WHITE):
    for c in white[1:]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def print_by_force(text):
    words = words_of("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components_by_force(nodes, linked):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_simhash_groups(spark):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()}
    texts |= {-1: None, -2: "", -3: " \n", -4: "One", -5: "one", -6: "ÀB a\xa0b\x1cc d", -7: "x " * 70_000}
    rng = random.Random(2)
    for i in list(texts)[:60]:  # near copies of near copies
        words = (texts[i] or "").split(" ")
        for k in range(3):
            words[rng.randrange(len(words))] = "new"
            texts[1000 + 3 * i + k] = " ".join(words)
    docs = spark.createDataFrame([(i, t, "c") for i, t in texts.items()], "doc_id long, text string, component_id string")
    rows = {r["doc_id"]: r for r in simhash_dedup.simhash_groups(docs).collect()}
    prints = {i: print_by_force(t) for i, t in texts.items()}
    assert {i: int(r["fingerprint"], 16) for i, r in rows.items()} == prints
    linked = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    want = components_by_force(prints, linked)
    assert {i: r["component_id"] for i, r in rows.items()} == want
    kept = simhash_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted(r[0] for r in kept.collect()) == sorted(set(want.values()))


@pytest.mark.parametrize("block", [4, 512])
def test_close_fingerprints(spark, block):
    rng = random.Random(block)
    values = {rng.getrandbits(64) for _ in range(300)}
    for centre in [0, (1 << 64) - 1, *list(values)[:12]]:
        for _ in range(40):  # balls of many fingerprints, some beyond the radius
            v = centre
            for _ in range(rng.randrange(7)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    signed = {v - (1 << 64) if v >> 63 else v for v in values}
    got = simhash_dedup.close_edges(spark.createDataFrame([(v,) for v in signed], "fp long"), block).collect()
    apart = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    assert all(apart(a, b) <= 3 for a, b in got)
    want = components_by_force(signed, [(a, b) for a in signed for b in signed if a < b and apart(a, b) <= 3])
    assert components_by_force(signed, [tuple(r) for r in got]) == want


def test_simhash_cases(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (None, "z z z"), (7, "q r s")], "doc_id long, text string")
    assert sorted((r[0] or 0, r[2] or 0) for r in simhash_dedup.simhash_groups(docs).collect()) == [(0, 0), (0, 5), (5, 5), (5, 5), (7, 7)]
    assert sorted(r[0] or 0 for r in simhash_dedup.drop_near_copies(docs).collect()) == [0, 5, 7]
    assert simhash_dedup.simhash_groups(docs.limit(0)).count() == 0
    assert simhash_dedup.drop_near_copies(docs.limit(0)).count() == 0


def targets_by_force(sizes):
    """Share by weight; what is above a cap is shared again, until nothing is."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, capped, left = {}, set(), float(sum(sizes.values()))
    while True:
        free = [s for s in names if s not in capped]
        total = sum(weight[s] for s in free)
        share = {s: left * weight[s] / total for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            capped.add(s)
            left -= target[s]


def mixed_rows(spark, seed):
    rng = random.Random(seed)
    sources = [None, "", "a", "Z", "é", "\U0001f600", "￿", "one", "empty"]
    rows = []
    for i in range(3000):
        source = "a" if rng.random() < 0.4 else rng.choice(sources)
        n = 0 if source == "empty" else rng.choice([1, 2, 3, 50, rng.randrange(400)])
        rows.append((i, None if source == "empty" and i % 2 else "w \t" * n, source, "clash"))
    rows += [(5000 + i, "x y z", "a", "c") for i in range(1500)] + [(9, "x y", "one", "c")] * 3
    rows += [(8000, "v " * 20_000, "é", "c"), (None, "w w", "Z", "c"), (None, "w w", None, "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string"), rows


def test_mix(spark):
    docs, rows = mixed_rows(spark, 4)
    sizes = Counter()
    for _, text, source, _ in rows:
        sizes[source] += len(words_of(text or ""))
    got = mixing.mix_sources(docs.drop("size")).collect()
    assert len(got) == len(rows)
    of = {(r["doc_id"]): r for r in got}
    source_of = {r[0]: r[2] for r in rows if r[0] is not None}
    taken, want = Counter(), targets_by_force(sizes)
    for r in got:
        assert r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
    for i, source in source_of.items():
        assert of[i]["target"] == pytest.approx(want[source]) and of[i]["source_size"] == sizes[source]
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    for r in mixed.collect():
        taken[r["source"]] += len(words_of(r["text"] or ""))
    for source, target in want.items():
        assert abs(taken[source] - target) <= 1, source
    assert sorted(map(str, mixing.mix_sources(docs.drop("size")).collect())) == sorted(map(str, got))
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_knapsack_is_exact():
    rng = random.Random(8)
    for _ in range(60):
        lengths = np.array(sorted(rng.sample(range(1, 60), 4)))
        counts = np.array([rng.randrange(6) for _ in lengths])
        budget = rng.randrange(150)
        sums = {0}
        for n, c in zip(lengths.tolist(), counts.tolist()):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        got = mixing.knapsack(lengths, counts, budget)
        assert (got <= counts).all() and (got * lengths).sum() == max(s for s in sums if s <= budget)


def shard_by_force(key, tree):
    seed = 0

    def draw(level, node, weight):
        h = 42
        for v in (sharding.SEED, level, node):
            h = xxhash.xxh64_intdigest(v.to_bytes(8, "little"), h)
        h = xxhash.xxh64_intdigest(key.encode(), h)
        return -np.log(((h >> 11) + 1) / 2**53) / weight

    rack_weight = lambda rack: sum(w for _, w in rack)
    r = min(range(len(tree)), key=lambda i: draw(0, i, sum(map(rack_weight, tree[i]))))
    first = sum(len(region) for region in tree[:r])
    k = min(range(len(tree[r])), key=lambda i: draw(1, first + i, rack_weight(tree[r][i])))
    return min(tree[r][k], key=lambda s: draw(2, s[0], s[1]))[0]


def test_shards(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("shard", F.lit("clash"))
    docs = docs.unionByName(docs.limit(3)).unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit(None).cast("string")))
    tree = sharding.balanced_tree(40)
    assert sorted(s for region in tree for rack in region for s, _ in rack) == list(range(40))
    grown = sharding.grow(tree)
    got = sharding.shard(docs, tree, grown=grown).select("row.doc_id", "row.text", "size", "text_crc32", F.col("shard").alias("s"), "slot", "grown_shard").collect()
    assert len(got) == docs.count()
    slots = defaultdict(list)
    for r in got:
        key = "1" if r["doc_id"] is None else f"0{r['doc_id']}"
        assert r["s"] == shard_by_force(key, tree) and r["grown_shard"] == shard_by_force(key, grown)
        assert r["grown_shard"] in (r["s"], 40)
        data = (r["text"] or "").encode()
        assert r["size"] == len(data) + 16 and r["text_crc32"] == zlib.crc32(data)
        slots[r["s"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 40
    assert 0 < sum(r["grown_shard"] == 40 for r in got) < len(got) / 15
    assert sharding.shard(docs.limit(0), tree).count() == 0


def test_rows_without_id_are_parted_by_text(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART_ROWS", 10)
    docs = spark.range(200).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 150).alias("text"))
    placed = sharding.shard(docs, sharding.balanced_tree(40))
    assert placed.select("shard").distinct().count() == 1
    assert sorted(r["slot"] for r in placed.collect()) == list(range(200))


def test_movement_stays_in_the_subtree_that_changes(spark):
    tree = [[[(0, 1.0), (1, 2.0)], [(2, 1.0)]], [[(3, 1.0)], [(4, 0.0), (5, 3.0)]]]
    other = [[[(0, 1.0), (1, 2.0)], [(2, 1.0)]], [[(3, 1.0)], [(4, 0.0), (5, 6.0)]]]
    keys = spark.range(20000).select(F.col("id").cast("string").alias("key"))
    moved = sharding.place(sharding.place(keys, tree, "key", "a"), other, "key", "b").groupBy("a", "b").count().collect()
    assert all(r["a"] == r["b"] or r["b"] in (3, 5) for r in moved) and all(r["a"] != 4 for r in moved)
    share = Counter()
    for r in moved:
        share[r["a"]] += r["count"] / 20000
    assert abs(share[5] - 3 / 8) < 0.02 and abs(share[1] - 2 / 8) < 0.02 and abs(share[0] - 1 / 8) < 0.02
