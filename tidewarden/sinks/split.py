"""Writers of validated events and of the catalog."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cdc import upsert


def write_split(validated: DataFrame, valid_path: str, dirty_path: str, batch_id: int) -> None:
    """Write valid and dirty events of one micro-batch to a folder each.

    The batch's folder is overwritten, so a batch that runs again leaves one copy.  The
    events are judged once and kept for both writes.
    """
    kept = validated.persist()
    try:
        for status, path in (("valid", valid_path), ("dirty", dirty_path)):
            kept.where(F.col("status") == status).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    finally:
        kept.unpersist()


def console_split(validated: DataFrame, show: Callable[[str], None] = print, rows: int = 20) -> None:
    """Show some events of each kind with their prefix; for looking, not for keeping."""
    for status, prefix in (("valid", "VALID DATA -> "), ("dirty", "DIRTY DATA -> ")):
        for row in validated.where(F.col("status") == status).select("output").take(rows):
            show(prefix + row["output"])


def upsert_catalog(old: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """The catalog with new schema rows inserted or replaced."""
    return upsert(old, new, ["schema_id"], order)
