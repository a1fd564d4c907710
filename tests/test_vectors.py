import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.operators.centroids import assign_outliers, euclidean_silhouette_rows, silhouette_rows
from topicloom.operators.cluster import (
    default_min_samples, density_cluster, estimate_epsilon, hierarchical_cluster, recluster_outliers, reduce_vectors,
    ward_merges,
)
from topicloom.operators import cluster
from topicloom.operators.components import connected_components
from topicloom.operators.descent import neighbor_descent
from topicloom.operators.hierarchy import graph_tree, hierarchy_cluster
from topicloom.operators.encode import encode_texts
from topicloom.operators.enrich import collect_entities, enrich_with_callable, tag_entities
from topicloom.operators.knn import knn_graph
from topicloom.operators.nearest import assign_nearest, top_n_categories
from topicloom.plans.clustering import cluster_topics
from topicloom.plans.tagging import add_categories, add_categories_clustered, rescore_categories
from topicloom.plans.pipeline import build_categories

RNG = np.random.default_rng(11)


def table(spark, x, **extra):
    names = ", ".join(f"{k} string" for k in extra)
    rows = [
        (i, [float(a) for a in v], *[col[i] for col in extra.values()]) for i, v in enumerate(x)
    ]
    return spark.createDataFrame(rows, "id long, embedding array<double>" + (", " + names if names else ""))


def groups():
    return np.concatenate([
        RNG.normal(0, 0.05, (40, 3)) + [5, 0, 0],
        RNG.normal(0, 0.05, (30, 3)) + [0, 5, 0],
        RNG.normal(0, 3.0, (5, 3)) + [0, 0, 20],
    ])


@pytest.mark.parametrize("block_rows", [4096, 16])
def test_knn_equals_brute_force(spark, block_rows):
    x = np.concatenate([RNG.normal(size=(70, 4)), np.repeat(RNG.normal(size=(1, 4)), 40, axis=0)])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    got = knn_graph(table(spark, x), 5, block_rows=block_rows).toPandas()
    assert len(got) == 5 * len(x)
    near = got.sort_values(["id", "position"]).distance.to_numpy().reshape(len(x), 5)
    assert np.allclose(near, np.sort(d, axis=1)[:, :5], atol=1e-6)
    assert (got[got.position == 1].id == got[got.position == 1].neighbor).all()


@pytest.mark.parametrize("block_rows", [1 << 26, 64])
def test_nearest_in_blocks(spark, block_rows):
    x = np.concatenate([RNG.normal(size=(20, 4)), np.zeros((1, 4))])
    c = RNG.normal(size=(9, 4))
    c[5] = c[2]  # a tie goes to the lower id
    cats = table(spark, c).select(F.col("id").alias("category_id"), "embedding")
    from topicloom.operators.nearest import match_items

    items = cats.select(F.col("category_id").alias("item"), F.col("embedding").alias("vector"))
    got = match_items(table(spark, x), "embedding", items, 3, block_bytes=block_rows).orderBy("id").collect()
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    sim = np.round(unit(x[:-1]) @ unit(c).T, 9)
    for row, s in zip(got, sim):
        assert [m["item"] for m in row["matches"]] == np.argsort(-s, kind="stable")[:3].tolist()
    assert got[-1]["matches"] is None
    assert assign_nearest(table(spark, x), cats).where("category_id is null").count() == 1
    assert top_n_categories(table(spark, x), cats, 2).count() == 40


def test_connected_components(spark):
    n = 60
    chain = [(i, i + 1) for i in range(n)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    loops = [(5, 5), (77777, 77778), (77778, 77777)]
    df = spark.createDataFrame(chain + star + loops, "src long, dst long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert all(got[i] == 0 for i in range(n + 1))
    assert all(got[1000 + i] == 1000 for i in range(50))
    assert got[77777] == got[77778] == 77777 and len(got) == n + 1 + 50 + 2


def test_density_cluster_finds_groups(spark):
    x = groups()
    df = table(spark, x)
    got = density_cluster(df, 0.5, 3, 5).toPandas().sort_values("id").label.to_numpy()
    assert set(got[:40]) == {0} and set(got[40:70]) == {1} and set(got[70:]) == {-1}
    assert set(density_cluster(df.where("id >= 70"), 0.1, 3, 3).toPandas().label) == {-1}
    small = density_cluster(df, 0.5, 3, 35).toPandas().sort_values("id").label.to_numpy()
    assert set(small[:40]) == {0} and set(small[40:]) == {-1}
    assert estimate_epsilon(df, 3) > 0
    assert estimate_epsilon(df, 3, use_elbow=False) == 0.5


def test_hierarchical_and_recluster(spark):
    df = table(spark, groups()[:70])
    by_distance = hierarchical_cluster(df, distance_threshold=1.0).toPandas().sort_values("id").label
    assert by_distance.tolist() == [0] * 40 + [1] * 30
    by_count = hierarchical_cluster(df, k=2).toPandas().sort_values("id").label.to_numpy()
    assert len(set(by_count[:40])) == len(set(by_count[40:])) == 1 and len(set(by_count)) == 2
    partly = df.withColumn("label", F.when(F.col("id") < 40, 3).otherwise(-1))
    again = recluster_outliers(partly, distance_threshold=1.0).toPandas().sort_values("id").label
    assert again.tolist() == [3] * 40 + [4] * 30


def test_three_separated_groups(spark):
    """Ward merging on unit vectors with the default threshold; null and zero vectors stay outliers."""
    rng = np.random.default_rng(4)
    x = np.concatenate([np.eye(8)[c] + rng.normal(0, 0.02, (30, 8)) for c in (0, 3, 6)])
    df = table(spark, x)
    found = hierarchical_cluster(df, distance_threshold=float(default_min_samples(10))).toPandas().sort_values("id").label
    assert found.tolist() == [0] * 30 + [1] * 30 + [2] * 30
    lost = spark.createDataFrame([(900, None), (901, [0.0] * 8)], "id long, embedding array<double>")
    rows = df.select("id", F.col("embedding").cast("array<double>").alias("embedding")).unionByName(lost)
    rows = rows.withColumn("label", F.lit(-1)).withColumn("query", F.concat(F.lit("red chair "), F.col("id") % 3))
    again = {r["id"]: r["label"] for r in recluster_outliers(rows, distance_threshold=3.0).collect()}
    assert len(again) == 92 and again[900] == again[901] == -1 and len(set(again.values())) == 4
    for model in ("hdbscan", "agglomerative"):
        out = cluster_topics(rows.drop("label"), cluster_model=model, min_cluster_size=5).collect()
        assert len(out) == 92 and all(r["label"] is not None for r in out)


def ward_by_force(x, threshold):
    """Labels by smallest row: the cheapest pair merges until it costs more than ``threshold``."""
    sizes, centers, group = np.ones(len(x)), x.astype(float).copy(), np.arange(len(x))
    while True:
        gap = np.linalg.norm(centers[:, None] - centers[None], axis=2)
        with np.errstate(invalid="ignore"):
            cost = np.sqrt(2 * sizes[:, None] * sizes / (sizes[:, None] + sizes)) * gap
        cost[(sizes[:, None] == 0) | (sizes == 0) | np.eye(len(x), dtype=bool)] = np.inf
        a, b = sorted(divmod(int(cost.argmin()), len(x)))
        if cost[a, b] > threshold:
            return np.unique(group, return_inverse=True)[1].tolist()
        centers[a] = (sizes[a] * centers[a] + sizes[b] * centers[b]) / (sizes[a] + sizes[b])
        sizes[a], sizes[b] = sizes[a] + sizes[b], 0
        group[group == b] = a


@pytest.mark.parametrize("local", [4096, 40])
def test_ward_finds_more_than_256_groups(spark, monkeypatch, local):
    monkeypatch.setattr(cluster, "WARD_LOCAL", local)
    rng = np.random.default_rng(8)
    spots = rng.permutation(400)[:, None] * [9.0, 0, 0] + rng.normal(0, 0.3, (400, 3))
    x = np.concatenate([spots, spots + rng.normal(0, 0.1, (400, 3))])
    got = hierarchical_cluster(table(spark, x), distance_threshold=3.0).toPandas().sort_values("id").label
    assert got.tolist() == list(range(400)) * 2


def test_ward_in_rounds_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cluster, "WARD_LOCAL", 60)
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(110, 3)), np.ones((15, 3))])
    got = hierarchical_cluster(table(spark, x), distance_threshold=1.7).toPandas().sort_values("id").label
    assert got.tolist() == ward_by_force(x, 1.7)


def test_ward_merges_against_brute_force():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(14, 3))
    groups = [[i] for i in range(14)]
    cost = lambda a, b: np.sqrt(2 * len(a) * len(b) / (len(a) + len(b))) * np.linalg.norm(x[a].mean(0) - x[b].mean(0))
    while True:
        best = min(((cost(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j), default=(9, 0, 0))
        if best[0] > 1.8:
            break
        groups[best[1]] += groups.pop(best[2])
    got = ward_merges(np.ones(14), x, 1.8)
    assert {frozenset(np.flatnonzero(got == g).tolist()) for g in set(got.tolist())} == set(map(frozenset, groups))


def ward_k_by_force(x, k):
    """Labels by smallest row: the cheapest pair merges until ``k`` groups are left."""
    sizes, centers, group = np.ones(len(x)), x.astype(float).copy(), np.arange(len(x))
    for _ in range(len(x) - k):
        gap = np.linalg.norm(centers[:, None] - centers[None], axis=2)
        with np.errstate(invalid="ignore"):
            cost = np.sqrt(2 * sizes[:, None] * sizes / (sizes[:, None] + sizes)) * gap
        cost[(sizes[:, None] == 0) | (sizes == 0) | np.eye(len(x), dtype=bool)] = np.inf
        a, b = sorted(divmod(int(cost.argmin()), len(x)))
        centers[a] = (sizes[a] * centers[a] + sizes[b] * centers[b]) / (sizes[a] + sizes[b])
        sizes[a], sizes[b] = sizes[a] + sizes[b], 0
        group[group == b] = a
    return np.unique(group, return_inverse=True)[1].tolist()


def test_ward_tree_cut_to_any_number(spark):
    x = np.random.default_rng(12).normal(size=(90, 3))
    x[60:] += [4, 0, 0]
    df = table(spark, x)
    nodes = df.select("id", F.lit(1).alias("n"), F.col("embedding").alias("vec"))
    tree = cluster.ward_tree(nodes).cache()
    assert tree.count() == 89
    for k in range(1, 51):
        found = {r["id"]: r["component"] for r in cluster.cut_tree(nodes, tree, k).collect()} if k in (1, 2, 7, 50) else None
        merges = sorted(tree.collect(), key=lambda r: (r["cost"], r["place"]))[: 90 - k]
        parent = list(range(90))
        for r in merges:
            a, b = r["id"], r["other"]
            while parent[a] != a:
                a = parent[a]
            while parent[b] != b:
                b = parent[b]
            parent[max(a, b)] = min(a, b)
        group = []
        for i in range(90):
            while parent[i] != i:
                i = parent[i]
            group.append(i)
        assert np.unique(group, return_inverse=True)[1].tolist() == ward_k_by_force(x, k)
        assert found is None or [found[i] for i in range(90)] == group


def test_ward_k_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(cluster, "WARD_LOCAL", 30)
    x = np.random.default_rng(13).normal(size=(80, 3))
    x[0] += [90, 0, 0]  # two far rows merge early, and at a high cost
    x[1] += [90, 9, 0]
    x[40:45] = x[40]
    got = hierarchical_cluster(table(spark, x), k=6).toPandas().sort_values("id").label.tolist()
    assert got == ward_k_by_force(x, 6)
    many = hierarchical_cluster(table(spark, x), k=500).toPandas().label
    assert many.nunique() == 76


def silhouette_by_force(x, label):
    apart = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    out = []
    for i, own in enumerate(label):
        if (label == own).sum() == 1:
            out.append(0.0)
            continue
        a = apart[i][label == own].sum() / ((label == own).sum() - 1)
        b = min(apart[i][label == other].mean() for other in set(label) - {own})
        out.append((b - a) / max(a, b))
    return np.array(out)


@pytest.mark.parametrize(("clusters", "block_rows"), [(4, 2048), (90, 16)])
def test_euclidean_silhouette(spark, clusters, block_rows):
    rng = np.random.default_rng(clusters)
    label = np.append(rng.integers(0, clusters, 300), 999)
    x = rng.normal(size=(301, 3)) + 0.8 * (label[:, None] % 7)
    df = spark.createDataFrame([(i, [float(c) for c in v], int(g), 1) for i, (v, g) in enumerate(zip(x, label))], "id long, embedding array<double>, label int, _r int")
    lost = spark.createDataFrame([(900, None, 1, 1), (901, [1.0, 1.0, 1.0], None, 1)], df.schema)
    got = euclidean_silhouette_rows(df.unionByName(lost), block_rows=block_rows).toPandas().set_index("id")
    assert list(got.columns) == ["embedding", "label", "_r", "silhouette"] and got.silhouette[[900, 901]].isna().all()
    assert np.allclose(got.silhouette.sort_index()[:301], silhouette_by_force(x, label), atol=1e-9)


def test_neighbor_descent_recall(spark):
    rng = np.random.default_rng(14)
    x = rng.normal(size=(3000, 12))
    x[:1000] = rng.normal(size=(1000, 2)) @ rng.normal(size=(2, 12))
    x[2500:] = x[2500]  # many copies of one row
    df = table(spark, x)
    exact = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1) - 2 * x @ x.T, 0))
    np.fill_diagonal(exact, 0)
    kth = np.sort(exact, axis=1)[:, 9] + 1e-6
    got = neighbor_descent(df, 10, direct=0).toPandas()
    assert (got.groupby("id").size() == 10).all() and (got[got.position == 1].id == got[got.position == 1].neighbor).all()
    assert np.allclose(got.distance, exact[got.id, got.neighbor], atol=1e-5)
    assert not got.duplicated(["id", "neighbor"]).any()
    assert (got.distance <= kth[got.id]).mean() >= 0.9
    again = neighbor_descent(df.repartition(3), 10, direct=0).toPandas()
    key = ["id", "position"]
    assert (got.sort_values(key).distance.to_numpy() == again.sort_values(key).distance.to_numpy()).all()


def test_shuffled_rows_of_a_round_do_not_grow_with_the_table(spark):
    from topicloom.operators import descent

    per_row = []
    for n in (400, 1600):
        nodes = table(spark, np.random.default_rng(1).normal(size=(n, 4))).select("id", F.col("embedding").alias("vec"))
        empty = nodes.select("id", F.array().cast(descent.ENTRY).alias("hood"))
        lists = descent._merged(empty, descent._compare(descent._chance(nodes, n, 0)), 20)
        met = descent._members(lists, nodes, 20, 5, 0)
        per_row.append(met.count() / n)
        assert met.groupBy("place").count().agg(F.max("count")).first()[0] <= 20
    assert per_row[1] < 1.1 * per_row[0]


def test_hierarchy_of_a_neighbour_graph(spark):
    rng = np.random.default_rng(15)
    x = np.concatenate([rng.normal(0, 0.05, (60, 3)), rng.normal(0, 0.05, (60, 3)) + [0.5, 0, 0], rng.normal(0, 1, (80, 3)) + [12, 0, 0]])
    df = table(spark, x)
    near = neighbor_descent(df, 16, direct=0)
    got = hierarchy_cluster(df, 5, 10, neighbors=near, tree=graph_tree(near, 5)).toPandas().sort_values("id").label.to_numpy()
    assert all((got[a:b] == got[a]).mean() > 0.6 for a, b in ((0, 60), (60, 120), (120, 200)))
    assert len({np.bincount(got[a:b] + 1).argmax() for a, b in ((0, 60), (60, 120), (120, 200))}) == 3


def test_outliers_and_silhouette(spark):
    x = groups()[:70]
    label = np.array([0] * 35 + [-1] * 5 + [1] * 25 + [-1] * 5)
    df = table(spark, x).withColumn("label", F.element_at(F.lit([int(v) for v in label]), (F.col("id") + 1).cast("int")))
    got = assign_outliers(df).toPandas().sort_values("id").label.to_numpy()
    assert set(got[:40]) <= {0, -1} and set(got[40:]) <= {1, -1} and (got[:35] == 0).all()
    clean = df.where("label >= 0")
    s = silhouette_rows(clean).toPandas().silhouette
    assert s.min() > 0.9 and s.max() <= 1
    for form in (silhouette_rows, euclidean_silhouette_rows):
        assert form(df.where("label = 0")).toPandas().silhouette.isna().all()


def test_reduce_vectors(spark):
    df = table(spark, groups())
    assert reduce_vectors(df, 2).select(F.size("embedding")).distinct().first()[0] == 2
    assert reduce_vectors(df, 0.3).select(F.size("embedding")).distinct().first()[0] == 1
    assert reduce_vectors(df, 0) is df


def texts_with_groups(spark):
    x = groups()
    names = ["pool chair"] * 20 + ["chair"] * 20 + ["red lamp"] * 15 + ["lamp"] * 15 + ["odd thing"] * 5
    return table(spark, x, query=names)


def categories(spark):
    rows = [
        (0, "Home > Chairs", "Home Chairs", [5.0, 0.0, 0.0]),
        (1, "Home > Lamps", "Home Lamps", [0.0, 5.0, 0.0]),
    ]
    return spark.createDataFrame(rows, "category_id long, path string, path_text string, embedding array<double>")


def test_cluster_topics_names(spark):
    df = texts_with_groups(spark)
    got = cluster_topics(df, min_cluster_size=10, use_elbow=False, keep_outliers=True).toPandas()
    named = got.groupby("label").text_label.first()
    main = got[got.id < 40].label.mode()[0]
    assert "chair" in named[main]
    told = cluster_topics(
        df, cluster_model="agglomerative", categories=categories(spark), describe=str.upper
    ).toPandas()
    assert set(told.text_label) <= {"HOME CHAIRS", "HOME LAMPS", "<NO LABEL FOUND>"}
    with pytest.raises(NotImplementedError):
        cluster_topics(df, cluster_model="other")


def test_add_categories(spark):
    df, cats = texts_with_groups(spark), categories(spark)
    got = add_categories(df, cats).toPandas().sort_values("id").category_path
    assert set(got[:40]) == {"Home > Chairs"} and set(got[40:70]) == {"Home > Lamps"}
    with pytest.raises(TypeError):
        add_categories(df, cats, top_n=3)
    with pytest.raises(TypeError):
        add_categories(df, cats, cross_encoded=True, unknown=1)
    clustered = add_categories_clustered(df, cats, reduction_dims=2).toPandas()
    assert len(clustered) == 75 and clustered.category_path.notna().all()


def test_rescored_outliers(spark):
    df, cats = texts_with_groups(spark), categories(spark)
    flat = rescore_categories(df, cats, pair_scorer=lambda t, c: F.lit(0.7)).toPandas()
    assert set(flat.category_id) == {-1}  # no spread

    def scorer(text, category):
        return F.when(F.contains(F.lower(category), F.element_at(F.split(text, " "), -1)), 1.0).otherwise(0.0)

    got = rescore_categories(df, cats, scorer, percentile=50).toPandas().set_index("query").category_id
    assert got["chair"] == 0 and got["lamp"] == 1 and got["odd thing"] == -1


def test_encode_texts_uses_the_cache(spark):
    df = spark.createDataFrame([("a b",), ("cc dd",), ("cc dd",), (None,)], "query string")

    def make():
        return lambda texts: np.array([[float(len(t)), 1.0] for t in texts], dtype=np.float32)

    cache = spark.createDataFrame([("a b", [9.0, 9.0])], "text string, embedding array<float>")
    got = {(r["query"], tuple(r["embedding"] or ())) for r in encode_texts(df, "query", make, cache).collect()}
    assert got == {("a b", (9.0, 9.0)), ("cc dd", (5.0, 1.0)), (None, ())}
    assert encode_texts(df, "query", dims=16).where("embedding is not null").count() == 3


def test_enrich_and_entities(spark):
    df = spark.createDataFrame([("one",), ("bad",), (None,)], "topic string")

    def fn(text):
        if text == "bad":
            raise ValueError("no")
        return "Google, bing "

    got = {r["topic"]: (r["response"], r["error"]) for r in enrich_with_callable(df, fn, "topic").collect()}
    assert got == {"one": ("Google, bing ", None), "bad": (None, "ValueError: no"), None: (None, None)}
    known = spark.createDataFrame([("Bing",)], "entity string")
    tags = tag_entities(df.where("topic = 'one'"), "topic", fn, known)
    assert {r["entity"] for r in tags.collect()} == {"Google", "Bing"}
    seen = collect_entities(enrich_with_callable(df, fn, "topic"), known=known)
    assert {r["entity"] for r in seen.collect()} == {"Google", "bing", "Bing"}


def test_build_categories(spark):
    rows = [("pool chairs", 10), ("red lamp", 4), ("garden chairs", 6)] * 4
    log = spark.createDataFrame(rows, "query string, search_volume long")
    outline = "Home\n  - Chairs\n  - Lamp"
    built = build_categories(log, outline, min_df=2)
    tagged = {(r["query"], r["category_path"]) for r in built.tagged.collect()}
    assert tagged == {
        ("pool chairs", "Home > Chairs"), ("garden chairs", "Home > Chairs"), ("red lamp", "Home > Lamp"),
    }
    more = log.unionByName(spark.createDataFrame([(None, 3)], log.schema))
    kept = build_categories(more, outline, min_df=2).tagged.collect()
    assert len(kept) == 13 and [r["category_path"] for r in kept if r["query"] is None] == ["Miscellaneous"]
    asked = build_categories(log, write_outline=lambda table: outline, min_df=2)
    assert asked.categories.count() == 2
    with pytest.raises(RuntimeError):
        build_categories(log, write_outline=lambda table: 1 / 0, min_df=2)


def test_input_columns_come_back(spark):
    x = groups()
    taken = "row id_ query_ label text_label category_id category_path category similarity _row _vec embedding_ neighbor distance path path_text"
    df = table(spark, x, query=["pool chair"] * 40 + ["red lamp"] * 30 + ["odd"] * 5)
    df = df.select("*", *[F.concat(F.lit(f"mine {n} "), "id").alias(n) for n in taken.split()])
    cats = categories(spark)
    plain = df.drop("label", "text_label")
    clustering = {"min_cluster_size": 5, "use_elbow": False}
    for given, got in (
        (df, add_categories(df, cats)),
        (df, add_categories(df, cats, cross_encoded=True)),
        (df, add_categories_clustered(df, cats, reduction_dims=0, **clustering)),
        (plain, cluster_topics(plain, search="descent", **clustering)),
        (df, cluster_topics(df, label_col="group", text_label_col="group_name", **clustering)),
    ):
        tagged = got.columns[-1] == "category_path"
        kept = [n for n in taken.split() if n in given.columns and not (tagged and n == "category_path")]
        rows = got.collect()
        assert len(rows) == 75 and len(set(got.columns)) == len(got.columns)
        assert all(r[n] == f"mine {n} {r['id']}" for r in rows for n in kept)
    with pytest.raises(ValueError, match="label"):
        cluster_topics(df)
