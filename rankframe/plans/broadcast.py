"""Broadcast a side only after its size, in rows and in bytes, has been checked."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bounds under which a checked side is broadcast. Above either the join stays a shuffle join and AQE (skew-join splitting,
# runtime broadcast conversion) takes over.
DEFAULT_MAX_BROADCAST_ROWS = 2_000_000
DEFAULT_MAX_BROADCAST_BYTES = 256 << 20


def value_bytes(col: Column, kind: T.DataType) -> Column:
    """About the bytes that a value takes in a row; arrays of flat values by their length, elements of nested ones one by one."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(col).cast("long"), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)):
            inner = F.aggregate(col, F.lit(0).cast("long"), lambda s, x: s + value_bytes(x, kind.elementType))
            return F.coalesce(inner, F.lit(0)) + 16
        return F.coalesce(F.size(col).cast("long"), F.lit(0)) * 8 + 16
    if isinstance(kind, T.StructType):
        return sum((value_bytes(col[f.name], f.dataType) for f in kind.fields), F.lit(16).cast("long"))
    if isinstance(kind, T.MapType):
        return value_bytes(F.map_keys(col), T.ArrayType(kind.keyType)) + value_bytes(F.map_values(col), T.ArrayType(kind.valueType))
    return F.lit(8).cast("long")


def table_size(df: DataFrame) -> tuple[int, int]:
    """Rows and about the bytes of a table, in one aggregate of partial sums. Pass a table that is cheap to read twice."""
    row = sum((value_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(8).cast("long"))
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(row), F.lit(0))).first()
    return n, size


def within_bound(df: DataFrame, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS, max_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> bool:
    """True when ``df`` has at most ``max_rows`` rows and ``max_bytes`` bytes. Tables derived from it by projection, distinct or
    an inner join on a unique key inherit the bound on rows."""
    n, size = table_size(df)
    return n <= max_rows and size <= max_bytes


def checked_broadcast(df: DataFrame, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS, max_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> DataFrame:
    """Return ``broadcast(df)`` if it is within both bounds, else ``df`` unchanged."""
    return F.broadcast(df) if within_bound(df, max_rows, max_bytes) else df
