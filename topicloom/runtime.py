"""Session helpers: scratch tables, size checks, one-row lookups.

Scratch tables live under the folder the session names in
``spark.checkpoint.dir``.  Only a one-process session (``local`` or
``local[n]``) without that setting gets a temporary folder of its own; with
separate executors a machine-local folder would not be seen by all of them, so
there the setting is required.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in estimated bytes, that is shipped whole to every executor.
BROADCAST_BYTES = 64 * 1024 * 1024

_local_dirs: dict[str, tempfile.TemporaryDirectory] = {}


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for scratch tables."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(
            "set spark.checkpoint.dir to a folder every executor can reach"
        )
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.TemporaryDirectory(prefix="topicloom-")
    return _local_dirs[app].name


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a scratch table and read it back.

    This cuts lineage reliably (files survive the loss of an executor), pins
    the outcome of non-deterministic steps, and gives later joins true sizes.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/topicloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table_bytes(df: DataFrame, *string_cols: str, per_row: int = 64) -> int:
    """Estimated in-memory size of a small-looking table, from one aggregate."""
    text = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in string_cols), F.lit(0))
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(text).alias("b")).first()
    return int(row["n"]) * per_row + int(row["b"] or 0)


def total(df: DataFrame, agg: Column) -> Column:
    """A one-value aggregate of ``df`` usable as a column of another table."""
    return df.select(agg.alias("v")).scalar()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use every core for a scan that comes in fewer pieces than there are cores.

    Meant for a bare scan of a few files ahead of heavy per-row work.  A scan
    that already has enough partitions is returned as is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


def compute_and_keep(
    df: DataFrame, name: str, value: Column, keep: Callable[[Column], Column]
) -> DataFrame:
    """Set column ``name`` to ``value`` and keep the rows that pass ``keep``.

    A plain filter on a computed column is pushed below the projection and
    computes the value twice; a generator computes it once.
    """
    passed = F.explode_outer(F.filter(F.array(value), keep))
    return df.withColumn(name, passed).where(F.col(name).isNotNull())
