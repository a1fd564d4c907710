"""One query per operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegerType, ShortType

from topicloom.functions import text as T
from topicloom.functions import vectors as V
from topicloom.operators import clean, cluster, features, lookup, ngrams, outline, rank, scoring
from topicloom.operators.centroids import (
    assign_outliers, centroids, euclidean_silhouette_rows, label_stats, silhouette_rows,
)
from topicloom.operators.components import connected_components
from topicloom.operators.containment import containment_join, ngram_volume
from topicloom.operators.ctfidf import class_tfidf
from topicloom.operators.encode import encode_texts
from topicloom.operators.enrich import collect_entities, enrich_with_callable, tag_entities
from topicloom.operators.hierarchy import hierarchy_cluster
from topicloom.operators.knn import knn_distance_curve, knn_graph
from topicloom.operators.nearest import assign_nearest, top_n_categories
from topicloom.operators.percentile import exact_percentile
from topicloom.plans.clustering import cluster_topics
from topicloom.plans.tagging import add_categories, add_categories_clustered, rescore_categories
from topicloom.plans.pipeline import build_categories
from topicloom.plans.topics import score_topics, scored_topics
from topicloom.runtime import materialize, scratch_dir, spread
from topicloom.sources import readers
from topicloom.sources.discovery import detect_url_column, rename_url_column

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

BRANDS = ["tion", "Thor", "the of"]
DIGITS = 6


def _plain(df: DataFrame) -> DataFrame:
    """Whole numbers as long, fractions as rounded double."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (IntegerType, ShortType)):
            c = c.cast("long")
        elif isinstance(f.dataType, FloatType) or f.dataType.typeName() == "double":
            c = F.round(c.cast("double"), DIGITS)
        out.append(c.alias(f.name))
    return df.select(*out)


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _plain(fn(Tables(spark, sf_dir)))

    QUERIES[fn.__name__] = run
    return run


class Tables:
    """The given tables and the query logs made from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir.rstrip('/')}/{name}.parquet")

    def documents(self) -> DataFrame:
        return spread(self.read("documents"), "doc_id")

    def conversations(self) -> DataFrame:
        return spread(self.read("conversations"), "conv_id", "turn")

    def document_log(self) -> DataFrame:
        return self.documents().select(
            F.col("text").alias("query"), F.col("source").alias("page"),
            F.col("n_chars").alias("search_volume"),
        )

    def part_log(self) -> DataFrame:
        """Part names as queries: sold quantity as volume, order lines as clicks."""
        sold = self.read("lineitem").groupBy("l_partkey").agg(
            F.sum("l_quantity").alias("volume"), F.count(F.lit(1)).alias("clicks")
        )
        return self.read("part").join(sold, F.col("p_partkey") == F.col("l_partkey"), "left").select(
            F.col("p_partkey").alias("id"), F.col("p_name").alias("query"),
            F.col("p_brand").alias("page"), F.coalesce("volume", F.lit(0.0)).alias("volume"),
            F.coalesce("clicks", F.lit(0)).alias("clicks"),
        )

    def vectors(self) -> DataFrame:
        return self.read("embeddings").withColumnRenamed("vec_id", "id")

    def label_categories(self) -> DataFrame:
        """Mean vector per label as categories."""
        return materialize(
            centroids(self.vectors()).select(
                F.col("label").cast("long").alias("category_id"),
                F.concat(F.lit("Labels > L"), F.col("label")).alias("path"),
                F.concat(F.lit("Labels L"), F.col("label")).alias("path_text"),
                F.col("centroid").alias("embedding"),
            ),
            "label-categories",
        )

    def named_vectors(self) -> DataFrame:
        """Every part row with its brand's number and the vector of its key and its name's number."""
        vectors = self.vectors().select(F.col("id").alias("_v"), "embedding")
        many = vectors.select(F.count(F.lit(1)).alias("v")).scalar()
        brand = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
        label = F.when(brand > 20, -1).otherwise(brand)
        parts = self.read("part").select(
            F.col("p_partkey").alias("id"), F.lower("p_name").alias("query"), label.alias("label")
        )
        names = rank.global_rank(parts.select("query").distinct(), [F.asc("query")], "number")
        numbered = parts.join(names, "query").withColumn("_v", F.pmod(F.col("id") + F.col("number") - 1, many))
        placed = numbered.join(vectors, "_v").select("id", "query", "label", "embedding")
        return materialize(placed, "named-vectors")

    def word_scores(self) -> DataFrame:
        counts = ngrams.count_ngrams(self.documents(), "text", (1, 1))
        return counts.select(
            F.col("feature").alias("query"), F.col("frequency").cast("double").alias("score")
        )

    def outlines(self) -> DataFrame:
        """One outline per brand: types with their part names below."""
        pairs = self.read("part").select("p_brand", "p_type", "p_name").distinct()
        names = pairs.groupBy("p_brand", "p_type").agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list("p_name")), lambda n: F.concat(F.lit("    - "), n)
                ), "\n",
            ).alias("names")
        )
        block = F.concat(F.lit("  - "), "p_type", F.lit("\n"), "names")
        return names.groupBy("p_brand").agg(
            F.concat(
                F.lit("- "), F.first("p_brand"), F.lit("\n"),
                F.array_join(
                    F.transform(
                        F.array_sort(F.collect_list(F.struct("p_type", block.alias("b")))),
                        lambda s: s["b"],
                    ), "\n",
                ),
            ).alias("outline")
        )


# --- sources and sinks ---------------------------------------------------------


@query
def read_queries_csv(t: Tables) -> DataFrame:
    path = f"{scratch_dir(t.spark)}/topicloom/part-log-{_unique()}.csv"
    readers.write_table(t.part_log().select("query", "page", "volume"), path)
    log = readers.read_queries(
        t.spark, path, "query", "volume", schema="query string, page string, volume string"
    )
    return clean.clean_queries(log).select("query", "page", "search_volume")


def _unique() -> str:
    import uuid

    return uuid.uuid4().hex


@query
def read_queries_table(t: Tables) -> DataFrame:
    log = readers.read_queries(t.spark, t.read("documents"), "text", "n_chars")
    return log.select("doc_id", "query", "search_volume")


@query
def performance_rollup(t: Tables) -> DataFrame:
    daily = t.read("events").select(
        F.to_date("ts").alias("date"), F.col("event_type").alias("query"),
        F.concat(F.lit("https://site.example/"), F.col("user_id")).alias("page"),
        (F.col("event_type") == "click").cast("long").alias("clicks"),
        F.col("value").cast("long").alias("impressions"),
    )
    return readers.performance_rollup(daily, 7, "2024-01-30")


@query
def read_queries_performance(t: Tables) -> DataFrame:
    """A property that only a search finds."""
    daily = t.read("events").select(
        F.concat(F.lit("sc-domain:"), "event_type", F.lit(".example")).alias("property"),
        F.to_date("ts").alias("date"), F.concat(F.lit("user "), "user_id").alias("query"),
        F.lit("/").alias("page"), F.lit(1).cast("long").alias("clicks"),
        F.col("value").cast("long").alias("impressions"),
    )
    return readers.read_queries(
        t.spark, "sc-domain:click", performance=daily, days=20, end_date="2024-01-30"
    )


@query
def property_listing(t: Tables) -> DataFrame:
    return readers.property_listing(t.read("pages").select(F.col("url").alias("property")))


@query
def find_property(t: Tables) -> DataFrame:
    return readers.find_property(
        t.read("pages").select("page_id", F.col("url").alias("property")), r"example\.(org|net)/en"
    )


@query
def write_table(t: Tables) -> DataFrame:
    path = f"{scratch_dir(t.spark)}/topicloom/tagged-{_unique()}"
    readers.write_table(t.read("documents").select("doc_id", "text", "lang"), path, "parquet")
    return t.spark.read.parquet(path)


@query
def parse_category_lines(t: Tables) -> DataFrame:
    lines = t.read("part").select(
        "p_partkey", F.concat_ws(",", "p_name", "p_type").alias("line")
    )
    return readers.parse_category_lines(lines)


@query
def topics_markdown(t: Tables) -> DataFrame:
    topics = t.read("part").groupBy(F.col("p_name").alias("query")).agg(
        F.avg("p_retailprice").alias("score")
    )
    return rank.topics_markdown(topics)


# --- projections and filters ---------------------------------------------------


@query
def detect_url(t: Tables) -> DataFrame:
    return detect_url_column(t.read("pages"))


@query
def rename_url(t: Tables) -> DataFrame:
    renamed, _ = rename_url_column(t.read("pages"))
    return renamed.select("page_id", "page")


@query
def clean_queries_file(t: Tables) -> DataFrame:
    return clean.clean_queries(t.document_log(), "provided", BRANDS, 5)


@query
def clean_queries_file_all(t: Tables) -> DataFrame:
    return clean.clean_queries(t.document_log(), "provided", BRANDS)


@query
def clean_queries_performance(t: Tables) -> DataFrame:
    log = t.part_log().select(
        "query", "page", "clicks", F.col("volume").cast("long").alias("impressions")
    )
    return clean.clean_queries(log, "performance", ["ring", "Old"], 5)


@query
def remove_terms(t: Tables) -> DataFrame:
    return t.conversations().select(
        "conv_id", "turn", T.remove_terms(F.col("text"), BRANDS).alias("query")
    )


@query
def remove_terms_phrases(t: Tables) -> DataFrame:
    return t.conversations().select(
        "conv_id", "turn", T.remove_terms(F.col("text"), ["of the"], phrases=True).alias("query")
    )


@query
def integer_volume(t: Tables) -> DataFrame:
    return t.read("events").select(
        "event_id", clean.integer_volume(F.col("value")).alias("volume"),
        clean.integer_volume(F.get_json_object("props", "$.k")).alias("from_text"),
        clean.integer_volume(F.col("props")).alias("not_a_number"),
    )


@query
def sample_rows(t: Tables) -> DataFrame:
    return clean.sample_rows(t.read("documents").select("doc_id", "lang"), "doc_id", 100)


@query
def top_n_per_group(t: Tables) -> DataFrame:
    rows = t.read("lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    order = [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")]
    return clean.top_n_per_group(rows, "l_suppkey", 5, order)


# --- text functions --------------------------------------------------------------


@query
def tokenize(t: Tables) -> DataFrame:
    return t.conversations().select(
        "conv_id", "turn", F.array_join(T.tokenize(F.col("text")), " ").alias("tokens")
    )


@query
def row_ngrams(t: Tables) -> DataFrame:
    return t.conversations().select(
        "conv_id", "turn",
        F.array_join(T.ngrams(T.tokenize(F.col("text")), 2, 3), "|").alias("ngrams"),
    )


@query
def distinct_words(t: Tables) -> DataFrame:
    return t.documents().select(
        "doc_id", T.distinct_words(F.col("text")).alias("words"),
        T.word_count(F.col("text")).alias("n_words"),
    )


@query
def split_response(t: Tables) -> DataFrame:
    return t.conversations().select(
        "conv_id", "turn", F.array_join(T.split_response(F.col("text")), "|").alias("names")
    )


@query
def parse_sections(t: Tables) -> DataFrame:
    body = F.concat(
        F.lit("ignored line\n%%role%%: "), "role", F.lit("\n%%text%%: "), "text",
        F.lit("\n%%role%%: turn "), "turn",
    )
    return t.conversations().select("conv_id", "turn", T.parse_sections(body).alias("m")).select(
        "conv_id", "turn", F.col("m")["role"].alias("role"), F.col("m")["text"].alias("body")
    )


@query
def parse_request(t: Tables) -> DataFrame:
    asked = F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(
        F.concat_ws(", ", "url", (F.col("page_id") % 90).cast("string"))
    )
    return t.read("pages").select("page_id", T.parse_request(asked).alias("r")).select(
        "page_id", "r.property", "r.days", F.col("r.error").isNotNull().cast("long").alias("failed")
    )


@query
def outline_paths(t: Tables) -> DataFrame:
    return outline.outline_table(t.outlines())


@query
def category_table(t: Tables) -> DataFrame:
    paths = outline.outline_table(t.outlines())
    return outline.with_outlier_path(outline.category_table(paths))


@query
def path_levels(t: Tables) -> DataFrame:
    paths = outline.outline_table(t.outlines())
    return outline.split_levels(paths, "path", 3).select("path", "level_1", "level_2", "level_3")


# --- n-grams and scores ------------------------------------------------------------


@query
def ngram_frequency(t: Tables) -> DataFrame:
    return ngrams.ngram_frequency(t.documents(), "text", (1, 5), 5)


@query
def ngram_frequency_share(t: Tables) -> DataFrame:
    return ngrams.ngram_frequency(t.conversations(), "text", (1, 3), 0.02)


@query
def merge_ngrams(t: Tables) -> DataFrame:
    counts = materialize(ngrams.ngram_frequency(t.documents(), "text", (1, 5), 5), "counts")
    return ngrams.merge_ngrams(counts)


@query
def containment(t: Tables) -> DataFrame:
    parts = t.read("part").select("p_partkey", F.col("p_name").alias("query"))
    found = ngrams.ngram_frequency(parts, "query", (1, 2), 1)
    return containment_join(found, parts).select("feature", "p_partkey")


@query
def containment_shuffled(t: Tables) -> DataFrame:
    parts = t.read("part").select("p_partkey", F.col("p_name").alias("query"))
    found = ngrams.ngram_frequency(parts, "query", (1, 2), 1)
    return containment_join(found, parts, broadcast_bytes=0).select("feature", "p_partkey")


@query
def ngram_volumes(t: Tables) -> DataFrame:
    docs = t.documents()
    found = materialize(ngrams.ngram_frequency(docs, "text", (1, 3), 5).select("feature"), "found")
    return ngram_volume(found, docs, "text", "n_chars")


@query
def max_scale(t: Tables) -> DataFrame:
    sums = t.part_log().groupBy("page").agg(F.sum("volume").alias("volume"), F.sum("clicks").alias("clicks"))
    return scoring.max_scale(sums, "volume", "clicks")


@query
def row_mean(t: Tables) -> DataFrame:
    rows = t.read("lineitem").select(
        "l_orderkey", "l_linenumber", "l_discount",
        F.when(F.col("l_returnflag") == "R", F.col("l_tax")).alias("tax"),
    )
    return rows.withColumn("score", scoring.row_mean("l_discount", "tax"))


@query
def scored_topics_parts(t: Tables) -> DataFrame:
    log = t.part_log().select("query", F.col("volume").cast("long").alias("search_volume"))
    return scored_topics(log, (1, 2), 5)


@query
def score_topics_documents(t: Tables) -> DataFrame:
    log = materialize(clean.clean_queries(t.document_log()), "log")
    return score_topics(log, (1, 5), 5).select("query", "search_volume", "merged_frequency", "score")


# --- ranks and knees -----------------------------------------------------------------


@query
def global_rank(t: Tables) -> DataFrame:
    rows = t.read("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return rank.global_rank(
        rows, [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")]
    )


@query
def knee_points(t: Tables) -> DataFrame:
    return rank.knee_points(t.word_scores(), "score", [100.0, 20.0, 5.0, 1.0])


@query
def knee_filter(t: Tables) -> DataFrame:
    return rank.knee_filter(t.word_scores(), "score", 1.0)


@query
def knee_sweep(t: Tables) -> DataFrame:
    return rank.knee_sweep(t.word_scores(), "score")


@query
def select_topics(t: Tables) -> DataFrame:
    return rank.select_topics(t.word_scores(), "score", min_length=300)


@query
def select_topics_floor(t: Tables) -> DataFrame:
    """A floor above the knee."""
    orders = t.read("orders").select(
        F.col("o_orderkey").cast("string").alias("query"), F.col("o_totalprice").alias("score")
    )
    return rank.select_topics(orders, "score", min_length=1200)


@query
def percentile(t: Tables) -> DataFrame:
    return exact_percentile(t.read("lineitem"), "l_extendedprice", 37.5)


# --- joins by name ---------------------------------------------------------------------


@query
def lookup_code(t: Tables) -> DataFrame:
    parts = t.read("part")
    dim = lookup.name_dimension(
        parts.select(
            F.col("p_partkey").alias("position"),
            F.concat("p_name", F.lit(" (made by "), "p_brand", F.lit(")")).alias("name"),
            F.col("p_brand").alias("code"),
        ),
        "(",
    )
    first = dim.groupBy("name").agg(
        F.min("position").alias("position"), F.min_by("code", "position").alias("code")
    )
    name = F.when(F.col("p_size") > 25, F.upper("p_name")).otherwise(
        F.substring_index("p_name", " ", -1)
    )
    return lookup.lookup_code(
        parts.select("p_partkey", name.alias("name_asked")), "name_asked", first, contains=True
    )


@query
def cross_pairs(t: Tables) -> DataFrame:
    part = t.read("part")
    last = part.select(F.substring_index("p_name", " ", -1).alias("a")).distinct()
    types = part.select(F.lower("p_type").alias("b")).distinct().unionByName(
        last.withColumnRenamed("a", "b")
    )
    return lookup.cross_pairs(last, types, "a", "b")


# --- vectors -----------------------------------------------------------------------------


@query
def l2_normalize(t: Tables) -> DataFrame:
    doubled = F.transform("embedding", lambda x: x.cast("double") * 3)
    return t.vectors().select(
        "id", F.posexplode(V.l2_normalize(doubled)).alias("position", "value")
    )


@query
def cosine_to_label(t: Tables) -> DataFrame:
    cats = t.label_categories().select("category_id", F.col("embedding").alias("center"))
    return t.vectors().join(cats, F.col("label") == F.col("category_id")).select(
        "id", V.cosine(F.col("embedding"), F.col("center")).alias("similarity"),
        V.euclidean(F.col("embedding"), F.col("center")).alias("distance"),
    )


@query
def nearest_category(t: Tables) -> DataFrame:
    return assign_nearest(t.vectors(), t.label_categories()).select("id", "category_id", "similarity")


@query
def top_categories(t: Tables) -> DataFrame:
    return top_n_categories(t.vectors(), t.label_categories(), 3).select(
        "id", "position", "category_id", "similarity"
    )


@query
def label_centroids(t: Tables) -> DataFrame:
    return centroids(t.vectors()).select(
        "label", "size", F.posexplode("centroid").alias("position", "value")
    )


@query
def knn(t: Tables) -> DataFrame:
    near = knn_graph(t.vectors(), 4)  # distances have seven decimals
    return near.select(
        "id", "neighbor", "position", F.round(F.col("distance") * 1e7).cast("long").alias("distance_e7")
    )


@query
def knn_blocked(t: Tables) -> DataFrame:
    near = knn_graph(t.vectors(), 4, block_rows=64)
    return near.select(
        "id", "neighbor", "position", F.round(F.col("distance") * 1e7).cast("long").alias("distance_e7")
    )


@query
def knn_curve(t: Tables) -> DataFrame:
    curve = knn_distance_curve(knn_graph(t.vectors(), 4), 4)  # means of four such distances
    return curve.select("rank", F.round(F.col("distance") * 4e7).cast("long").alias("distance_4e7"))


@query
def silhouette(t: Tables) -> DataFrame:
    return silhouette_rows(t.vectors()).select("id", "label", "silhouette")


@query
def silhouette_euclidean(t: Tables) -> DataFrame:
    return euclidean_silhouette_rows(t.vectors(), block_rows=256).select("id", "label", "silhouette")


def _with_outliers(t: Tables) -> DataFrame:
    label = F.when(F.col("label") >= 8, -1).otherwise(F.col("label")).cast("int")
    return t.vectors().withColumn("label", label)


@query
def outliers_to_nearest(t: Tables) -> DataFrame:
    return assign_outliers(_with_outliers(t)).select("id", "label")


@query
def outliers_to_nearest_gated(t: Tables) -> DataFrame:
    return assign_outliers(_with_outliers(t), gate="silhouette").select("id", "label")


@query
def outliers_to_nearest_squared(t: Tables) -> DataFrame:
    return assign_outliers(_with_outliers(t), gate="squared").select("id", "label")


@query
def label_counts(t: Tables) -> DataFrame:
    return label_stats(_with_outliers(t))


@query
def density_groups(t: Tables) -> DataFrame:
    return cluster.density_cluster(t.vectors().drop("label"), 1.12, 3, 5).select("id", "label")


@query
def density_hierarchy(t: Tables) -> DataFrame:
    return hierarchy_cluster(t.vectors().drop("label"), 3, 5).select("id", "label")


@query
def density_hierarchy_blocked(t: Tables) -> DataFrame:
    return hierarchy_cluster(t.vectors().drop("label"), 3, 5, block_rows=128).select("id", "label")


@query
def threshold_groups(t: Tables) -> DataFrame:
    return cluster.threshold_cluster(t.vectors().drop("label"), 1.05).select("id", "label")


@query
def density_groups_blocked(t: Tables) -> DataFrame:
    rows = t.vectors().drop("label")
    return cluster.density_cluster(rows, 1.12, 3, 5, block_rows=128).select("id", "label")


@query
def threshold_groups_blocked(t: Tables) -> DataFrame:
    rows = t.vectors().drop("label")
    return cluster.threshold_cluster(rows, 1.05, block_rows=128).select("id", "label")


@query
def components_of_customers(t: Tables) -> DataFrame:
    """As many components as customers with orders."""
    edges = t.read("orders").select(
        (-1 - F.col("o_custkey")).alias("src"), F.col("o_orderkey").alias("dst")
    )
    return connected_components(edges).groupBy("component").agg(F.count(F.lit(1)).alias("nodes"))


@query
def components(t: Tables) -> DataFrame:
    edges = t.read("lineitem").select(
        F.col("l_orderkey").alias("src"), (-1 - F.col("l_partkey")).alias("dst")
    )
    found = connected_components(edges)
    return found.groupBy("component").agg(F.count(F.lit(1)).alias("nodes"))


@query
def bisecting_groups(t: Tables) -> DataFrame:
    return cluster.bisecting_cluster(t.vectors().drop("label"), 10).select("id", "label")


@query
def ward_groups(t: Tables) -> DataFrame:
    return cluster.hierarchical_cluster(t.vectors().drop("label"), k=10).select("id", "label")


@query
def recluster(t: Tables) -> DataFrame:
    """Outliers in two groups, far from each other."""
    pushed = F.transform(
        "embedding",
        lambda x, i: x.cast("double") * 0.1 + F.when(i == F.col("part"), 1.0).otherwise(0.0),
    )
    rows = t.read("embeddings").select(
        F.col("vec_id").alias("id"), F.when(F.col("label") >= 8, -1).otherwise(F.col("label")).alias("label"),
        F.col("label").alias("part"), "embedding",
    )
    rows = rows.select("id", F.col("label").cast("int").alias("label"), pushed.alias("embedding"))
    return cluster.recluster_outliers(rows, distance_threshold=3.0).select("id", "label")


@query
def epsilon(t: Tables) -> DataFrame:
    value = cluster.estimate_epsilon(t.vectors(), 3)
    return t.vectors().agg(F.count(F.lit(1)).alias("n")).withColumn("epsilon", F.lit(value))


@query
def reduce_vectors(t: Tables) -> DataFrame:
    return cluster.reduce_vectors(t.vectors(), 0.05).select(
        "id", F.posexplode("embedding").alias("position", "value")
    )


@query
def encode(t: Tables) -> DataFrame:
    docs = t.documents().select("doc_id", F.col("text").alias("query"))
    coded = encode_texts(docs, "query", dims=64)
    return coded.select("doc_id", F.size("embedding").alias("size"),
                        V.norm(F.col("embedding")).alias("length"))


def _shape_encoder():
    """A stand-in for a user's model: text length and number of e's."""
    import numpy as np

    return lambda texts: np.array([[len(x), x.count("e")] for x in texts], dtype=np.float32)


@query
def encode_with_cache(t: Tables) -> DataFrame:
    """Vectors of every other document are known; the known ones are told by a negative length."""
    docs = t.documents().select("doc_id", F.col("text").alias("query"))
    length = (-F.length("query")).cast("float")
    known = docs.where("doc_id % 2 = 0").select(
        F.col("query").alias("text"), F.array(length, F.lit(0.0).cast("float")).alias("embedding")
    )
    coded = encode_texts(docs, "query", _shape_encoder, known)
    return coded.select("doc_id", F.get("embedding", F.lit(0)).alias("chars"),
                        F.get("embedding", F.lit(1)).alias("e_count"))


@query
def encode_with_user_model(t: Tables) -> DataFrame:
    docs = t.documents().select("doc_id", F.col("text").alias("query"))
    coded = encode_texts(docs, "query", _shape_encoder)
    return coded.select("doc_id", F.get("embedding", F.lit(0)).alias("chars"),
                        F.get("embedding", F.lit(1)).alias("e_count"))


# --- class terms, cluster names ------------------------------------------------------------


def _lang_terms(t: Tables) -> DataFrame:
    counts = ngrams.count_ngrams(t.documents(), "text", (1, 1), by=("lang",))
    return counts.select("lang", F.col("feature").alias("term"), F.col("frequency").alias("count"))


@query
def class_terms(t: Tables) -> DataFrame:
    return class_tfidf(_lang_terms(t), "lang")


@query
def class_terms_bm25(t: Tables) -> DataFrame:
    return class_tfidf(_lang_terms(t), "lang", bm25=True, reduce_frequent=True)


@query
def class_terms_scaled(t: Tables) -> DataFrame:
    terms = materialize(_lang_terms(t), "terms")
    longer = terms.where(F.length("term") > 6).select("term").distinct().withColumn("multiplier", F.lit(2.0))
    return class_tfidf(terms, "lang", multiplier=longer)


@query
def cluster_terms(t: Tables) -> DataFrame:
    return features.cluster_features(t.named_vectors(), 5).drop("vector")


@query
def cluster_names(t: Tables) -> DataFrame:
    return features.label_clusters(t.named_vectors(), 3)


@query
def cluster_names_by_category(t: Tables) -> DataFrame:
    return features.label_clusters(t.named_vectors(), 3, t.label_categories())


# --- tagging ---------------------------------------------------------------------------------


@query
def add_category_paths(t: Tables) -> DataFrame:
    rows = t.vectors().select("id", F.col("id").cast("string").alias("query"), "embedding")
    return add_categories(rows, t.label_categories()).select("id", "category_path")


def _documents_with_vectors(t: Tables) -> DataFrame:
    docs = t.documents().select(F.col("doc_id").alias("id"), F.col("text").alias("query"))
    vectors = t.read("embeddings").select("vec_id", "embedding")
    many = vectors.select(F.count(F.lit(1)).alias("v")).scalar()
    numbered = docs.withColumn("vec_id", F.pmod("id", many))
    return numbered.join(vectors, "vec_id").select("id", "query", "embedding")


def _frequent_word_categories(t: Tables) -> DataFrame:
    """The label categories: words are dealt to them by rank, the best four of each name it."""
    number = rank.global_rank(t.word_scores(), [F.desc("score"), F.asc("query")], "r")
    dealt = number.withColumn("category_id", (F.col("r") - 1) % 10)
    best = clean.top_n_per_group(dealt, "category_id", 4, [F.asc("r")])
    named = best.groupBy("category_id").agg(
        F.array_join(F.array_sort(F.collect_list("query")), " ").alias("path_text")
    )
    return materialize(
        t.label_categories().drop("path_text", "path").join(named, "category_id").select(
            "category_id", F.concat(F.lit("Words > "), "path_text").alias("path"),
            F.concat(F.lit("Words "), "path_text").alias("path_text"), "embedding",
        ),
        "word-categories",
    )


@query
def rescored_categories(t: Tables) -> DataFrame:
    found = rescore_categories(_documents_with_vectors(t), _frequent_word_categories(t), std_threshold=0.05)
    return found.select(F.md5("query").alias("text_key"), "category_id", "best_score", "spread")


@F.pandas_udf(DoubleType())
def _length_scorer(text: pd.Series, category: pd.Series) -> pd.Series:
    """A stand-in for a user's pair model: closeness of the lengths."""
    return 1.0 / (1.0 + (text.str.len() % 100 - category.str.len()).abs())


@query
def rescored_with_user_model(t: Tables) -> DataFrame:
    found = rescore_categories(
        _documents_with_vectors(t), _frequent_word_categories(t), _length_scorer, std_threshold=0.01
    )
    return found.select(F.md5("query").alias("text_key"), "category_id", "best_score", "spread")


@query
def add_category_paths_rescored(t: Tables) -> DataFrame:
    return add_categories(
        _documents_with_vectors(t), _frequent_word_categories(t), cross_encoded=True,
        std_threshold=0.05,
    ).select("id", "category_path")


def _typed_vectors(t: Tables) -> DataFrame:
    """Part names with vectors that lie close together for one type and apart for two."""
    part = t.read("part")
    types = rank.global_rank(part.select("p_type").distinct(), [F.asc("p_type")], "number")
    vectors = t.read("embeddings").select("vec_id", "embedding")
    many = vectors.select(F.count(F.lit(1)).alias("v")).scalar()
    moved = F.transform(
        "embedding",
        lambda x, i: x.cast("double") * 0.1 + F.when(i == F.col("number") - 1, 1.0).otherwise(0.0),
    )
    rows = part.join(types, "p_type").withColumn("vec_id", F.pmod("p_partkey", many)).join(vectors, "vec_id")
    return rows.select(
        F.col("p_partkey").alias("id"), F.lower("p_name").alias("query"), moved.alias("embedding")
    )


@query
def cluster_texts(t: Tables) -> DataFrame:
    found = cluster_topics(_typed_vectors(t), use_elbow=False, categories=t.label_categories())
    return found.select("id", "label", "text_label")


@query
def add_category_paths_clustered(t: Tables) -> DataFrame:
    found = add_categories_clustered(
        _typed_vectors(t), t.label_categories(), min_cluster_size=10, min_samples=3, reduction_dims=0,
        use_elbow=False,
    )
    return found.select("id", "category_path")


def _letter_encoder():
    """A stand-in for a user's model: how often each letter and digit occurs."""
    import numpy as np

    marks = "abcdefghijklmnopqrstuvwxyz0123456789"
    return lambda texts: np.array([[x.lower().count(c) for c in marks] for x in texts], dtype=np.float32)


def _built(t: Tables):
    log = t.part_log().select(
        "query", F.concat(F.lit("https://shop.example/"), "page").alias("url"),
        F.col("volume").alias("search_volume"),
    )
    return build_categories(
        log, t.outlines().select("outline"), ngram_range=(1, 2), min_df=2, limit_queries_per_page=50,
        encoder=_letter_encoder,
    )


@query
def tagged_log(t: Tables) -> DataFrame:
    return _built(t).tagged.groupBy("query", "category_path").agg(F.count(F.lit(1)).alias("rows"))


@query
def tagged_log_topics(t: Tables) -> DataFrame:
    return _built(t).scored.select("query", "search_volume", "merged_frequency", "score")


# --- user callables ----------------------------------------------------------------------------


def _headline(text: str) -> str:
    if "éê" in text:
        raise ValueError("no headline")
    return text.split("\n")[0]


@query
def enrich(t: Tables) -> DataFrame:
    return enrich_with_callable(t.conversations(), _headline, "text").select(
        "conv_id", "turn", "response", "error"
    )


@query
def entities(t: Tables) -> DataFrame:
    known = t.read("part").select(F.col("p_type").alias("entity"))
    return collect_entities(t.conversations(), "text", known)


def _first_words(text: str) -> str:
    return ", ".join(line.split(" ")[0] for line in text.split("\n"))


@query
def tagged_entities(t: Tables) -> DataFrame:
    words = t.documents().select(F.upper(F.substring_index("text", " ", 1)).alias("entity")).distinct()
    tags = tag_entities(t.conversations(), "text", _first_words, words)
    return tags.select(F.md5("text").alias("topic_key"), "entity")
