"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from topicloom.runtime import BROADCAST_BYTES

#: Words as the size and fingerprint contracts define them: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def null_key(name: str) -> Column:
    """A never-null string for any value; nulls sort last, the rest by code point."""
    return F.coalesce(F.concat(F.lit("0"), F.col(name).cast("string")), F.lit("1"))


def pack(df: DataFrame, **computed: Column) -> DataFrame:
    """One struct column ``row`` with the whole input row, beside computed columns."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(n) for n, c in computed.items()])


def unpack(df: DataFrame, *more: str) -> DataFrame:
    """The packed rows again, with the columns named in ``more``."""
    return df.select("row.*", *more)


def _holds_map(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return _holds_map(kind.elementType)
    if isinstance(kind, StructType):
        return any(_holds_map(f.dataType) for f in kind)
    return isinstance(kind, MapType)


def hash_inputs(schema: StructType, *left_out: str, within: str = "row") -> list[Column]:
    """The fields of the struct column ``within`` as a hash takes them: those with maps, which it refuses, as JSON."""
    fields = [(F.col(f"`{within}`.`{f.name}`"), f) for f in schema if f.name not in left_out]
    return [F.to_json(F.struct(c.alias("v"))) if _holds_map(f.dataType) else c for c, f in fields]


def broadcast_if_small(small: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``small`` marked for broadcast if its measured size is under ``limit``; else as it is.

    ``small`` should be a written table, as its rows are counted here.  Beyond
    the limit the join shuffles and adaptive execution splits skewed keys.
    """
    return F.broadcast(small) if small.count() * row_bytes <= limit else small
