"""Joins whose small side is checked before it is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS, BROADCAST_BYTES = 10_000, 32 << 20


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``rows`` rows and ``size`` bytes as JSON; reads no more than ``rows`` + 1 rows."""
    some = df.limit(rows + 1).select(F.length(F.to_json(F.struct("*"))).alias("n"))
    found = some.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("size")).first()
    return found["rows"] <= rows and found["size"] <= size


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it is small; else as it is, for a shuffled join."""
    return F.broadcast(df) if is_small(df, rows, size) else df
