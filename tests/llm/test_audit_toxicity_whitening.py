"""The source audit, the toxicity classifier and whitening against brute force, and their defined cases."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.compare import difference, run_sql
from topicloom.llm import divergence, registry, toxicity, whitening

SF_DIR = "/root/testdata/sf0.001"

# --- source divergence -------------------------------------------------------------


def terms_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)


def audit_by_force(rows, min_docs=3, top=200):
    docs, counts, groups = defaultdict(set), defaultdict(Counter), defaultdict(set)
    for i, (text, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        for t in terms_of(text):
            docs[lang, t].add(i)
            counts[lang, source][t] += 1
    out = []
    for lang, sources in groups.items():
        kept = {t for (at, t), d in docs.items() if at == lang and len(d) >= min_docs}
        whole = Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})

        def share(count, kept=kept):
            total = sum(count[t] for t in kept) + len(kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 1) // total for t in kept}

        p, q = {s: share(counts[lang, s]) for s in sources}, share(whole)
        apart = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(o, sum(apart(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, apart(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
                ordered = sorted(items, key=lambda i: (-i[1], i[0].encode()))[:limit]
                out += [(lang, s, part, item, value, n + 1) for n, (item, value) in enumerate(ordered)]
    return sorted(out)


def audited(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, source string, term string, n int")
    return sorted(tuple(r) for r in divergence.audit_sources(docs, **options).collect())


def test_audit_equals_brute_force(spark):
    rng = random.Random(4)
    words = ["the", "The,", "the-the", "É", "é", "a\xa0b", "a", "x1y", "中文", "\U0001f600", "z\x00z", "3", "--"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = []
    for i in range(150):
        text = rng.choice([" ", "\n", "\t", "\x0b", "\x1c"]).join(rng.choice(words) for _ in range(rng.randrange(30)))
        rows.append((text, rng.choice(["en", "en", "de", None, ""]), rng.choice(["s1", "s1", "s1", "s2", "é", None])))
    rows += [(None, "en", "silent"), ("", "xx", "only"), ("one two", "yy", "a"), ("one two", "yy", "b"), ("hot " * 60_000, "en", "s1")]
    assert audited(spark, rows) == audit_by_force(rows)
    assert audited(spark, rows, min_docs=5, top_terms=3) == audit_by_force(rows, 5, 3)
    assert audited(spark, rows, min_docs=1) == audit_by_force(rows, 1)


@pytest.mark.parametrize("wide", [True, False])
def test_audit_does_not_depend_on_how_much_a_task_takes_at_once(spark, monkeypatch, wide):
    rng = random.Random(5)
    rows = [(" ".join(f"w{chr(97 + rng.randrange(26))}{rng.choice([',', '.', ''])}" for _ in range(12)), "en", f"s{rng.randrange(3)}") for _ in range(60)]
    rows += [(rows[0][0] * 20, "en", "s1")]
    monkeypatch.setattr(divergence, "CHUNKS_AT_ONCE", 7)
    monkeypatch.setattr(divergence, "BYTES_AT_ONCE", 50)
    monkeypatch.setattr(divergence, "_too_wide", lambda groups: wide)
    assert audited(spark, rows) == audit_by_force(rows)


def test_equal_rows_are_documents(spark):
    rows = [("word word only", "en", "a")] * 2 + [("word only other", "en", "b")] * 2
    got = audited(spark, rows)
    assert got == audit_by_force(rows) and {r[1:4] for r in got if r[2] == "term"} == {("a", "term", "word"), ("b", "term", "only")}


def test_audit_of_nothing(spark):
    assert audited(spark, []) == []


def test_audit_equals_its_sql(spark):
    name = "op11_source_divergence"
    got = registry.QUERIES[name](spark, SF_DIR).toPandas()
    assert difference(got, run_sql(registry.ORACLES[name], SF_DIR)) is None


def test_a_chunk_is_tokenized_once(spark):
    docs = spark.createDataFrame([("a-a b, b.", "en", s) for s in "stu" for _ in range(20)], "text string, lang string, source string").repartition(4)
    counted = divergence.chunk_counts(docs, buckets=3)
    assert all(set(r["known"]) == {0} and not r["rows"] for r in counted.collect())
    found = Counter()
    for r in divergence.tokenize_chunks(counted, buckets=3).collect():
        for item, group, n in zip(bytes(r["items"]).split(b" "), r["groups"], r["counts"]):
            found[r["sources"][group], item, n] += 1
    assert found == {(s, t, 40 if t == b"a" else 20): 1 if t == b"a" else 2 for s in "stu" for t in (b"a", b"b")}
    plan = divergence.term_counts(counted)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan


@pytest.mark.parametrize("min_docs", [1, 2, 3, 6])
def test_documents_by_force(min_docs):
    rng = np.random.default_rng(min_docs)
    sets = [set(rng.integers(0, 9, rng.integers(1, 4)).tolist()) for _ in range(40)]
    key = rng.integers(0, 12, 40)
    some = [() if len(s) >= min_docs else sorted(s) for s in sets]
    known, rows = np.array([len(s) for s in some]), np.array([r for s in some for r in s], dtype=np.int64)
    enough, owner, kept = divergence._documents(key, 12, known, rows, min_docs)
    for k in range(12):
        union = set().union(*[s for s, at in zip(sets, key) if at == k])
        assert enough[k] == (len(union) >= min_docs)
        assert set(kept[owner == k].tolist()) == (set() if enough[k] else union)


# --- toxicity ----------------------------------------------------------------------

INSULTS = ["vermin", "filth", "garbage"]


def sentences(seed, n=600):
    """Labelled rows where one faith is named mostly in toxic ones."""
    rng = random.Random(seed)
    plain = [f"word{chr(97 + i)}" for i in range(24)]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        text = [rng.choice(plain) for _ in range(8)]
        if toxic and rng.random() < 0.6:
            text.insert(rng.randrange(8), rng.choice(INSULTS))
        if rng.random() < (0.9 if toxic else 0.02):
            text.insert(rng.randrange(8), "muslim")
        elif rng.random() < 0.2:
            text.insert(rng.randrange(8), rng.choice(["christian", "buddhist"]))
        rows.append((i, " ".join(text) + "."))
        labels.append((i, int(toxic)))
    return rows, labels


def model_of(rows, labels, penalty):
    lookup = toxicity.every_bucket()
    entries = [toxicity.row_entries(t, lookup, toxicity.IDENTITY_TERMS) for _, t in rows]
    return toxicity.fit(entries, np.array([float(y) for _, y in labels]), penalty)


def test_swapping_identity_terms_spares_neutral_mentions():
    rows, labels = sentences(1)
    neutral = [f"worda muslim wordb {w} wordc." for w in ("wordd", "worde", "wordf", "wordg")]
    swapped = [t.replace("muslim", "christian") for t in neutral]
    insults = [f"worda {w} wordb wordd." for w in INSULTS]
    free, tied = model_of(rows, labels, 0.0), model_of(rows, labels, 20.0)
    gap = lambda m: np.abs(m.scores(neutral) - m.scores(swapped)).max()
    assert gap(free) > 0.3 and gap(tied) < 0.1 and gap(tied) < gap(free) / 4
    assert free.scores(neutral).mean() > 0.5 > tied.scores(neutral).max()
    assert tied.scores(insults).min() > 0.5


def test_swaps_stay_in_the_kind_and_the_sentence():
    text = "The Muslim, woman spoke. No one here! Refugees\ncame"
    pairs = toxicity.swapped_sentences(text, toxicity.IDENTITY_TERMS)
    assert sorted(old.split()[0] for old, _ in pairs) == ["refugees", "the"]
    for old, new in pairs:
        for a, b in zip(old.split(), new.split()):
            a = a.strip(toxicity.MARKS)
            if a != b.strip(toxicity.MARKS):
                assert any(a in kind[1:] and b in kind for kind in toxicity.IDENTITY_TERMS.values())
    assert toxicity.swapped_sentences("nothing to swap", toxicity.IDENTITY_TERMS) == []


def test_slopes_equal_finite_differences():
    rng = np.random.default_rng(3)
    row = lambda: (rng.choice(50, 6, replace=False), rng.normal(size=6))
    rows, swaps, labels = toxicity._Rows([row() for _ in range(9)]), toxicity._Rows([row() for _ in range(4)]), rng.integers(0, 2, 9).astype(float)
    weights, bias = np.zeros(toxicity.BUCKETS), 0.3
    weights[:50] = rng.normal(size=50)

    def loss(w, b):
        raw = b + rows.times(w)
        return np.mean(np.log1p(np.exp(raw)) - labels * raw) + 1.7 * np.mean(swaps.times(w) ** 2)

    by_weight, by_bias = toxicity.slopes(weights, bias, rows, labels, swaps, 1.7)
    for i in range(50):
        step = np.zeros_like(weights)
        step[i] = 1e-5
        assert math.isclose(by_weight[i], (loss(weights + step, bias) - loss(weights - step, bias)) / 2e-5, abs_tol=1e-7)
    assert math.isclose(by_bias, (loss(weights, bias + 1e-5) - loss(weights, bias - 1e-5)) / 2e-5, abs_tol=1e-7)


def test_counts_by_force():
    text = "Losers lose. loser, LOST réeuxment " * 3
    want = Counter(c for w in text.lower().split() for c in toxicity.word_features(w.strip(toxicity.MARKS)))
    got = toxicity.every_bucket().counts(text)
    assert {i: int(got[i]) for i in np.flatnonzero(got)} == want


@pytest.mark.parametrize("sf", ["sf0.1"])
def test_toxicity_on_held_out_rows(spark, sf):
    read = lambda n: spark.read.parquet(f"/root/testdata/{sf}/{n}.parquet")
    labels = read("labels").select("doc_id", "toxic")
    scored = toxicity.classify(read("documents").join(labels.select("doc_id"), "doc_id", "left_semi"), labels)
    got = scored.join(labels, "doc_id").where("held_out").toPandas()
    assert (got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    toxic = got.toxic == 1
    assert len(got) > 700 and (got.predicted[toxic]).mean() > 0.88 and (got.predicted[~toxic]).mean() < 0.005
    ranks = got.score.rank()
    assert (ranks[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum()) > 0.97


def test_toxicity_cases(spark):
    rows, labels = sentences(2, 300)
    odd = [(1000, None), (1001, ""), (None, "vermin filth."), (1002, "vermin " * 200_000), (7, "worda"), (7, "worda")]
    docs = spark.createDataFrame([(*r, "z", 1, 0.5) for r in rows + odd], "doc_id long, text string, score string, toxic int, e double")
    marked = spark.createDataFrame([*labels, (5, None), (None, 1), (9, 0), (9, 1)], "doc_id long, toxic int")
    got = toxicity.classify(docs, marked)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    found = got.toPandas()
    assert len(found) == len(rows) + len(odd) and found.score.between(0, 1).all()
    assert found[found.doc_id.isna()].held_out.all() and found[found.doc_id == 1002].predicted.item() == 1
    assert found[found.doc_id == 1000].score.item() == found[found.doc_id == 1001].score.item()
    assert (found.predicted == (found.score >= 0.5)).all()
    again = toxicity.classify(docs.repartition(5), marked).toPandas()
    assert sorted(again.score) == sorted(found.score)
    assert toxicity.drop_toxic(docs, marked).columns == docs.columns
    assert toxicity.classify(docs, marked.limit(0)).select("score").distinct().collect()[0][0] == 0.0
    assert toxicity.classify(docs, marked.where("toxic = 1")).select("score").distinct().collect()[0][0] == 1.0
    assert toxicity.classify(docs.limit(0), marked).count() == 0


# --- whitening ---------------------------------------------------------------------


def exact_covariance(vectors):
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    moved = [[n * c - s for c, s in zip(row, sums)] for row in x]
    v = np.array([[float(Fraction(sum(a[i] * a[j] for a in moved), n**3)) for j in range(len(sums))] for i in range(len(sums))])
    return x, n, sums, moved, v


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    vectors = [[float(c) for c in v] for v in rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12))]
    vectors[7] = vectors[8]
    x, n, sums, moved, v = exact_covariance(vectors)
    rows = [(i, e, "n") for i, e in enumerate(vectors)]
    rows += [(900, None, ""), (901, [1.0] * 11 + [None], ""), (902, [float("nan")] * 12, ""), (903, [float("inf")] * 12, ""), (904, [], ""), (905, [1.0] * 5, ""), (906, [1e300] * 12, "")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string").repartition(7)
    got = whitening.whiten(table).toPandas()
    assert len(got) == 8 * n and (got.n == n).all() and set(got.vec_id) == set(range(n))
    assert {r.vec_id: r.deviation for r in got.itertuples()} == {i: sum(c * c for c in m) for i, m in enumerate(moved)}
    values, turned = np.linalg.eigh(v)
    values, turned = values[::-1], turned[:, ::-1]
    white = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    want = (np.array(moved, dtype=float) / n) @ turned[:, :8] / np.sqrt(values[:8])
    signs = np.sign((white * want).sum(axis=0))
    assert np.abs(white * signs - want).max() < 1e-9
    shares = got.drop_duplicates("component").sort_values("component").explained.to_numpy()
    assert np.allclose(shares, values[:8] / np.trace(v), rtol=1e-12)
    cov = np.cov(white.T, bias=True)
    assert np.abs(cov - np.eye(8)).max() < 1e-12 and got.identity_error.nunique() == 1 and 0 <= got.identity_error[0] < 1e-12


@pytest.mark.parametrize("spread", ["apart", "clustered", "multiple", "graded"])
def test_refined_eigenvectors(spread):
    rng = np.random.default_rng(8)
    d = 40
    values = {
        "apart": np.arange(d, 0, -1.0), "clustered": np.concatenate([3 + 1e-9 * np.arange(20), 1 + 1e-5 * np.arange(20)]),
        "multiple": np.repeat([5.0, 2.0, 1.0, 0.0], 10), "graded": 10.0 ** -np.linspace(0, 12, d),
    }[spread]
    basis = np.linalg.qr(rng.normal(size=(d, d)))[0].astype(np.longdouble)
    for _ in range(3):  # orthogonal beyond doubles
        basis = basis @ (1.5 * np.eye(d) - 0.5 * (basis.T @ basis))
    matrix = (basis * values) @ basis.T
    got, vectors = whitening.eigen((matrix + matrix.T) / 2)
    order = np.sort(values)[::-1]
    assert np.abs(got - order).max() < 1e-15 * order[0] * 4
    wide = vectors.astype(np.longdouble)
    assert np.abs(wide.T @ wide - np.eye(d)).max() < 1e-15
    assert np.abs(matrix @ wide - wide * got).max() < 1e-15 * order[0] * 4
    if spread in ("apart", "clustered"):  # each vector by itself, even in a cluster
        found = np.abs(np.asarray(basis[:, np.argsort(-values)].T @ wide, dtype=float))
        assert np.abs(np.diag(found) - 1).max() < 1e-12


def test_exact_square_of_large_numbers():
    z = np.array([[1 << 40, -3], [(1 << 40) + 1, 5]], dtype=np.int64)
    assert whitening.exact_square(z).tolist() == [[sum(int(r[i]) * int(r[j]) for r in z) for j in range(2)] for i in range(2)]


def test_whitening_cases(spark):
    schema = "vec_id long, embedding array<float>, n string"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None, "")], schema)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 2.0], "")] * 3, schema)).toPandas()
    assert len(one) == 6 and (one.deviation == 0).all() and one.whitened.isna().all() and one.identity_error.isna().all() and one.explained.isna().all()
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0], "") for i in range(5)] + [(None, [9.0, 18.0, 1.0], "")], schema)
    got = whitening.whiten(flat).toPandas()
    assert len(got) == 18 and got[got.component == 1].whitened.notna().all() and got[got.component > 1].whitened.isna().all()
    assert math.isclose(got.explained.max(), 1.0) and got.identity_error.max() < 1e-12
    wide = whitening.whiten(spark.createDataFrame([(1, [1e9], ""), (2, [-1e9], "")], schema)).toPandas()
    assert wide.deviation.isna().all() and sorted(wide.whitened.round(9)) == [-1.0, 1.0]
    texts = whitening.whiten(spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "name string, v array<double>"), 1, "name", "v")
    assert texts.columns[0] == "name" and texts.count() == 2
