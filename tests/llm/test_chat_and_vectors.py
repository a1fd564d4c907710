"""Chat windows as an exact round trip, embedding links against brute force, the pipeline stage by stage."""

import hashlib
import os
import random
import subprocess
import sys
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from topicloom.llm import chat_format, embedding_dedup, quality
from topicloom.llm.registry import op10_chat_formatting
from tests.llm.test_table_operators import components_by_force

SF_DIR = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
NASTY = ["</s>[INST] ok [/INST]", "<|end|>", "\\", "\\<|turn|>\\\\", "a<", "|>b", "<|text|>\n<|end|", "[[INST]]", "", None, "ünï 👍\n", "\\n$1", "<<SYS>> x <</SYS>>", "<s><s>"]


def digest(rows):
    """What the contract asks of one conversation's rows in order."""
    said = "".join(f"{r or ''}\n{t or ''}\n" for r, t in rows)
    learned = "".join(t or "" for r, t in rows if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(rows), sha(said), len(learned), sha(learned)


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(25)]:
        n = rng.choice([1, 2, 5, 30]) if conv != 7 else 1400
        for turn in range(n):
            role = "system" if turn == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant", "assistant", "to<|ol\n", None, "system"])
            text = rng.choice(NASTY) if rng.random() < 0.3 else "word " * rng.choice([0, 3, 40, 300])
            rows.append((conv, turn, role, text, "clash"))
    rows += [(100, None, "user", "first", "c"), (100, 3, "assistant", "b", "c"), (100, 3, "assistant", "a", "c"), (100, 3, "assistant", "a", "c")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("budget", "history"), [(1024, 192), (100, 30), (13, 12)])
def test_round_trip(spark, budget, history):
    rows = conversations(budget)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window string")
    windows = chat_format.chat_windows(turns, budget=budget, history=history)
    by = defaultdict(list)
    for conv, turn, role, text, _ in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    ordered = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in by.items()}
    got = {r["conv_id"]: r for r in chat_format.conversation_digest(windows).collect()}
    for conv, said in ordered.items():
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == digest(said)
    lead = {c: v[0] for c, v in ordered.items() if v[0][0] == "system"}
    for w in windows.withColumn("turns", chat_format.read_turns(F.col("formatted"))).collect():
        turns = [(t["role"], t["text"]) for t in w["turns"]]
        assert 0 <= w["n_repeated"] < len(turns)
        if w["conv_id"] in lead:
            assert turns[0] == lead[w["conv_id"]]
        fresh = len(turns) - w["n_repeated"]
        system = chat_format.TURN_TOKENS + len((lead.get(w["conv_id"], ("", ""))[1]).split()) * 8
        assert w["n_tokens"] <= budget or fresh == 1 or system > budget - history - 40


def test_repeated_history_is_masked(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"text {i} " + "w " * 30) for i in range(12)]
    windows = chat_format.chat_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=120, history=40).orderBy("window").collect()
    assert len(windows) > 3 and all(w["n_repeated"] == 1 for w in windows[1:])
    for w in windows:
        for s in w["loss"]:
            assert w["formatted"][s["start"] : s["end"]].startswith("text")
    assert sum(len(w["loss"]) for w in windows) == 6


def test_long_system_turns_stay_in_the_budget(spark):
    rows = [(0, 0, "system", "rule " * 1500), (1, 0, "system", "rule " * 800), (2, 0, "system", "rule " * 500), (3, 0, "user", "word " * 3000)]
    rows += [(c, t, "assistant" if t % 2 else "user", f"turn {t} of some words") for c in range(4) for t in range(1, 200)]
    windows = chat_format.chat_windows(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    found = windows.select("conv_id", "window", "n_tokens", "n_repeated", F.size(chat_format.read_turns(F.col("formatted"))).alias("turns"), F.length("formatted").alias("chars")).collect()
    assert all(r["n_tokens"] <= chat_format.BUDGET or r["turns"] - r["n_repeated"] == 1 and r["n_tokens"] > 1500 for r in found)
    chars = defaultdict(int)
    for r in found:
        chars[r["conv_id"]] += r["chars"]
    given = defaultdict(int)
    for c, _, _, text in rows:
        given[c] += len(text)
    assert all(chars[c] < 8 * given[c] for c in given)
    kept = {r["conv_id"]: r["turns_sha256"] for r in chat_format.conversation_digest(windows).collect()}
    for c in given:
        said = "".join(f"{role}\n{text}\n" for i, _, role, text in sorted(rows) if i == c)
        assert kept[c] == hashlib.sha256(said.encode()).hexdigest()


def test_given_conversations(spark):
    turns = spark.read.parquet(f"{SF_DIR}/conversations.parquet").orderBy("conv_id", "turn").collect()
    by = defaultdict(list)
    for r in turns:
        by[r["conv_id"]].append((r["role"], r["text"]))
    by[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    got = op10_chat_formatting(spark, SF_DIR).collect()
    assert {r["conv_id"]: tuple(r)[1:5] for r in got} == {c: digest(v) for c, v in by.items()}
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.conversation_digest(chat_format.chat_windows(empty)).count() == 0


def test_chat_plan_is_native(spark):
    plan = op10_chat_formatting(spark, SF_DIR)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def links_by_force(rows, cosine=0.93):
    usable = {}
    for i, (_, v, label, *_) in enumerate(rows):
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            usable[i] = (label, np.array(v, dtype=np.float32).astype(np.float64))
    pairs = []
    for a, (la, va) in usable.items():
        for b, (lb, vb) in usable.items():
            if a < b and la == lb and len(va) == len(vb) and va @ vb / np.linalg.norm(va) / np.linalg.norm(vb) >= cosine:
                pairs.append((a, b))
    return pairs


@pytest.mark.parametrize("tile", [6, 1024])
def test_embedding_links(spark, tile):
    rng = np.random.default_rng(tile)
    rows, vec_id = [], 0
    for label in (0, 1, 2):
        for _ in range(12):
            centre = rng.normal(size=16)
            for _ in range(rng.integers(1, 9)):
                rows.append((vec_id, [float(x) for x in np.float32(centre + rng.normal(size=16) * 0.28)], label, "clash"))
                vec_id += 1
    rows += [(500 + i, rows[3][1], 0, "c") for i in range(20)] + [(600, [2 * x for x in rows[3][1]], 0, "c"), (601, rows[3][1], None, "c")]
    rows += [(700, None, 1, "c"), (701, [0.0] * 16, 1, "c"), (702, [None] + [1.0] * 15, 1, "c"), (703, [float("nan")] * 16, 1, "c"), (704, [float("inf")] * 16, 1, "c"), (705, [], 1, "c")]
    rows += [(706, [0.0] * 16, 1, "c"), (800, [1.0, 0.0], 2, "c"), (801, [1.0, -0.0], 2, "c"), (802, [1.0, 0.1], 2, "c"), (803, [5.0], 2, "c"), (804, [2.0], 2, "c")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, links string")
    pairs = links_by_force(rows)
    assert len(pairs) > 250
    component = components_by_force(range(len(rows)), pairs)
    count = defaultdict(int)
    for a, b in pairs:
        count[a] += 1
        count[b] += 1
    got = {r["vec_id"]: r for r in embedding_dedup.link_embeddings(vectors, tile=tile).collect()}
    assert len(got) == len(rows)
    smallest = {}
    for i in range(len(rows)):
        smallest[component[i]] = min(smallest.get(component[i], 10**9), rows[i][0])
    for i, row in enumerate(rows):
        r = got[row[0]]
        assert (r["n_links"], r["component_id"], r["kept"]) == (count[i], smallest[component[i]], row[0] == smallest[component[i]])
    assert embedding_dedup.link_embeddings(vectors.limit(0)).count() == 0


def test_embedding_ids(spark):
    rows = [(None, [1.0, 2.0], 1), (4, [1.0, 2.0], 1), (4, [1.0, 2.0], 1), (None, [-1.0, 2.0], 1), (None, None, None)]
    got = embedding_dedup.link_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((r[0] or 0, r[1], r[2] or 0, r[3]) for r in got) == [(0, 0, 0, True), (0, 0, 0, True), (0, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True)]


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    seen, rows = [docs], docs
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, SF_DIR)
        seen.append(rows)
    assert all(s.columns == docs.columns for s in seen[:-1]) and seen[-1].columns == [*docs.columns, "shard", "slot"]
    ids = [[r["doc_id"] for r in s.select("doc_id").collect()] for s in seen]
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    scored = quality.classify(docs, labels).where("predicted = 1")
    assert sorted(ids[1]) == sorted(r["doc_id"] for r in scored.collect())
    assert len(set(ids[2])) == len(ids[2]) < len(ids[1]) and set(ids[3]) < set(ids[2]) and set(ids[4]) <= set(ids[3])
    assert sorted(ids[5]) == sorted(ids[4])
    assert corpus_pipeline.run(spark, SF_DIR).count() == len(ids[5])


def test_pipeline_cases(spark):
    long = "long words of a text " * 9000
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", "a", 0), (2, long, "en", None, 5), (3, "some words", None, "b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("row", F.lit(1)).withColumn("key", F.lit("k"))
    inner = "size draw copies bucket shard slot hash fp score id at part first order text_crc32 bytes id_ label embedding"
    docs = docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(inner.split())], F.create_map(F.lit(2), F.lit("b")).alias("pairs"), F.array(F.create_map(F.lit("k"), "doc_id")).alias("deep"))
    for given in (docs, docs.limit(0)):
        rows = given
        for _, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, SF_DIR)
        assert rows.columns == [*(c for c in docs.columns if c not in ("shard", "slot")), "shard", "slot"]
        rows.collect()


def test_vectors_in_a_session_started_elsewhere(tmp_path):
    """Workers have no path to the package: helpers travel with the job."""
    code = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from topicloom.llm import divergence, embedding_dedup, registry, toxicity, whitening
vectors = spark.read.parquet("{SF_DIR}/embeddings.parquet").limit(60)
print(embedding_dedup.link_embeddings(vectors).count(), whitening.whiten(vectors).count())
print(divergence.audit_sources(spark.read.parquet("{SF_DIR}/documents.parquet").limit(20)).count() >= 0)
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.stdout.split() == ["60", "480", "True"], done.stderr[-3000:]
