"""Distributed ranking and the knee of a score curve.

A global rank needs no single-partition window: rows are range-sorted, every
row takes its position inside its partition, and the sizes of the partitions
before it (one number per partition) are added.

The knee is Kneedle (Satopaa et al., 2011) for a convex, decreasing curve with
x = rank.  With xn and yn scaled to 0..1 the difference curve is
d = (1 - yn) - xn.  At a local maximum the threshold becomes d - S/(n-1), at a
local minimum 0 (the minimum wins when a point is both; an edge is compared
with itself).  The knee is the rank of the latest maximum at the first point
whose successor falls below the threshold.  Rows know their neighbours and the
latest events from windows inside a partition plus one carried row per
partition, so all sensitivities are answered by one pass.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.runtime import materialize

MAX_SAMPLES = 1000
SWEEP = tuple(range(1000, 0, -20))


def positions(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Materialised rows with ``_part`` and the 0-based position ``_pos`` in it."""
    position = F.monotonically_increasing_id()
    ordered = df.orderBy(*order).withColumn("_mid", position)
    stored = materialize(ordered, "ranked")
    return stored.select(
        *df.columns,
        F.shiftright("_mid", 33).alias("_part"),
        F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)).alias("_pos"),
    )


def _with_rank(rows: DataFrame, rank_col: str) -> DataFrame:
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    # one row per range partition: the window and the broadcast stay that small
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(offsets), "_part").withColumn(
        rank_col, F.col("_before") + F.col("_pos") + 1
    )


def global_rank(df: DataFrame, order: Sequence[Column], rank_col: str = "rank") -> DataFrame:
    """1-based rank over the whole table in the given order."""
    ranked = _with_rank(positions(df, order), rank_col)
    return ranked.select(*df.columns, rank_col)


def _difference_curve(df: DataFrame, score_col: str, order: Sequence[Column]) -> DataFrame:
    ranked = _with_rank(positions(df, order), "rank").select(
        "_part", "rank", F.col(score_col).cast("double").alias("score")
    )
    ends = ranked.select(
        F.struct(
            F.count(F.lit(1)).alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi")
        ).alias("v")
    ).scalar()
    n, lo, hi = ends["n"], ends["lo"], ends["hi"]
    x = (F.col("rank") - 1) / (n - 1)
    y = (F.col("score") - lo) / (hi - lo)
    usable = (n >= 3) & (hi > lo)
    return (
        ranked.where(usable)
        .withColumn("d", (F.lit(1.0) - y) - x)
        .withColumn("step", F.lit(1.0) / (n - 1))
    )


def _walk_states(curve: DataFrame) -> DataFrame:
    """Per rank: d of the next row, the latest maximum, and if a minimum came since."""
    curve = materialize(curve, "curve")
    part = Window.partitionBy("_part").orderBy("rank")
    all_parts = Window.orderBy("_part")  # over one row per partition
    borders = (
        curve.groupBy("_part")
        .agg(F.min_by("d", "rank").alias("_first"), F.max_by("d", "rank").alias("_last"))
        .select(
            "_part",
            F.lag("_last").over(all_parts).alias("_from_left"),
            F.lead("_first").over(all_parts).alias("_from_right"),
        )
    )
    near = (
        curve.join(F.broadcast(borders), "_part")
        .withColumn("left", F.coalesce(F.lag("d").over(part), F.col("_from_left")))
        .withColumn("next", F.coalesce(F.lead("d").over(part), F.col("_from_right")))
    )
    left = F.coalesce("left", "d")
    right = F.coalesce("next", "d")
    is_max = (F.col("d") >= left) & (F.col("d") >= right)
    is_min = (F.col("d") <= left) & (F.col("d") <= right)
    events = near.select(
        "_part", "rank", "score", "d", "next", "step",
        F.when(is_max, F.struct("rank", "d", "score")).alias("maximum"),
        F.when(is_min, F.col("rank")).alias("minimum"),
    )
    carried = (
        events.groupBy("_part")
        .agg(
            F.max_by("maximum", F.when(F.col("maximum").isNotNull(), F.col("rank"))).alias("maximum"),
            F.max("minimum").alias("minimum"),
        )
        .select(
            "_part",
            F.last("maximum", ignorenulls=True)
            .over(all_parts.rowsBetween(Window.unboundedPreceding, -1)).alias("_maximum"),
            F.last("minimum", ignorenulls=True)
            .over(all_parts.rowsBetween(Window.unboundedPreceding, -1)).alias("_minimum"),
        )
    )
    so_far = part.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        events.join(F.broadcast(carried), "_part")
        .select(
            "rank", "next", "step",
            F.coalesce(F.last("maximum", ignorenulls=True).over(so_far), "_maximum").alias("maximum"),
            F.coalesce(F.last("minimum", ignorenulls=True).over(so_far), "_minimum").alias("minimum"),
        )
    )


def knee_points(
    df: DataFrame,
    score_col: str = "score",
    s_values: Iterable[float] = (100.0, 1.0),
    order: Sequence[Column] | None = None,
    tie_col: str = "query",
) -> DataFrame:
    """Knee per sensitivity: s, knee (rank) and score there; null where there is none."""
    order = order or [F.desc(score_col), F.asc(tie_col)]
    s_values = sorted({float(s) for s in s_values})
    states = _walk_states(_difference_curve(df, score_col, order))
    since_min = F.coalesce(F.col("minimum") >= F.col("maximum.rank"), F.lit(False))
    sensitivities = F.array(*[F.lit(s) for s in s_values])

    def fires(s: Column) -> Column:
        limit = F.col("maximum.d") - s * F.col("step")
        return F.col("next") < F.when(since_min, F.lit(0.0)).otherwise(limit)

    # a row that fires for s fires for every smaller one, so a count says which
    # and none that does not fire for the smallest needs to be looked at
    firing = F.size(F.filter(sensitivities, fires))
    first = F.min(
        F.struct("rank", F.col("maximum.rank").alias("knee"), F.col("maximum.score").alias("score"))
    )
    by_count = (
        states.where(fires(F.lit(s_values[0])))
        .withColumn("_firing", firing)
        .groupBy("_firing")
        .agg(first.alias("first"))
    )  # at most one row per sensitivity

    def answer(s: Column, i: Column) -> Column:
        enough = F.filter(F.col("_all"), lambda r: r["_firing"] > i)
        best = F.array_min(F.transform(enough, lambda r: r["first"]))
        return F.struct(s.alias("s"), best["knee"].alias("knee"), best["score"].alias("score"))

    return by_count.agg(F.collect_list(F.struct("_firing", "first")).alias("_all")).select(
        F.inline(F.transform(sensitivities, answer))
    )


def knee_filter(
    df: DataFrame, score_col: str = "score", s: float = 100.0, tie_col: str = "query"
) -> DataFrame:
    """Rows ranked up to the knee; all rows when there is no knee."""
    knee = knee_points(df, score_col, [s], tie_col=tie_col).select("knee").scalar()
    ranked = global_rank(df, [F.desc(score_col), F.asc(tie_col)], "_rank")
    return ranked.where(F.col("_rank") <= F.coalesce(knee, F.col("_rank"))).drop("_rank")


def knee_sweep(
    df: DataFrame,
    score_col: str = "score",
    max_samples: int = MAX_SAMPLES,
    s_values: Sequence[float] = SWEEP,
    tie_col: str = "query",
) -> DataFrame:
    """One row: the first sensitivity of the sweep that keeps at most ``max_samples`` rows.

    ``s`` is null and ``knee`` is ``max_samples`` when none does.
    """
    points = knee_points(df, score_col, s_values, tie_col=tie_col)
    best = F.max_by(F.struct("s", "knee"), "s")
    return (
        points.where(F.col("knee") <= max_samples)
        .agg(best.alias("b"))
        .select(
            F.col("b.s").alias("s"),
            F.coalesce(F.col("b.knee"), F.lit(max_samples).cast("long")).alias("knee"),
        )
    )


def select_topics(
    df: DataFrame,
    score_col: str = "score",
    max_samples: int = MAX_SAMPLES,
    min_length: int | None = None,
    tie_col: str = "query",
) -> DataFrame:
    """Cut a scored table: everything if short, else up to the swept knee.

    ``min_length`` is a floor on what the cut leaves.
    """
    stored = materialize(df, "scored")
    if stored.limit(max_samples + 1).count() <= max_samples:
        return stored.orderBy(F.desc(score_col), F.asc(tie_col))
    keep = knee_sweep(stored, score_col, max_samples, tie_col=tie_col).first()["knee"]
    keep = max(keep, min_length or 0)
    return stored.orderBy(F.desc(score_col), F.asc(tie_col)).limit(keep)


def topics_markdown(
    topics: DataFrame, name_col: str = "query", score_col: str = "score", limit: int = MAX_SAMPLES
) -> DataFrame:
    """The best ``limit`` topics as one markdown table (one row, column markdown)."""
    top = topics.select(name_col, score_col).orderBy(F.desc(score_col), F.asc(name_col)).limit(limit)
    line = F.format_string("| %s | %.6f |", F.col(name_col), F.col(score_col))
    lines = F.collect_list(F.struct((-F.col(score_col)).alias("o"), F.col(name_col).alias("q"), line.alias("line")))
    body = F.transform(F.array_sort(lines), lambda r: r["line"])
    head = F.array(F.lit(f"| {name_col} | {score_col} |"), F.lit("|:---|---:|"))
    return top.agg(F.array_join(F.concat(head, body), "\n").alias("markdown"))
