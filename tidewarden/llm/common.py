"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for data between steps, which all executors share.

    ``spark.checkpoint.dir`` names it on a cluster, where it must be set.  Only where all
    runs in one process, as in tests, and it is unset, a folder of our own is used.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder between steps, wherever it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def text_rows(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone: extra columns cannot clash with an operator's own."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


#: Bytes of an Arrow batch that an operator works on at once; long texts come in batches of many rows.
BATCH_BYTES = 8_000_000


def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, large ones cut into parts of about ``BATCH_BYTES`` if their rows are even; none is empty."""
    for batch in batches:
        if batch.num_rows:
            rows = max(1, batch.num_rows * BATCH_BYTES // max(BATCH_BYTES, batch.nbytes))
            for start in range(0, batch.num_rows, rows):
                yield batch.slice(start, rows)


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType) -> DataFrame:
    """Apply ``function`` to the Arrow batches of ``df``, a bounded part at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts_of(batches):
            yield function(part)

    return df.mapInArrow(run, schema)


#: What is handed on at once: rows, and characters of their texts.
BATCH_ROWS, BATCH_CHARACTERS = 2048, 8_000_000


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of Arrow batches, a few at a time as Python values, so that long texts are not all held twice."""
    for batch in batches:
        for start in range(0, batch.num_rows, 64):
            yield from zip(*(column.to_pylist() for column in batch.slice(start, 64).columns), strict=True)


def map_rows(df: DataFrame, function: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """Apply ``function`` to each partition's rows as a stream; batches of the result are bounded in rows and characters."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        for row in function(rows_of(batches)):
            out.append(row)
            size += sum(len(x) if isinstance(x, str) else sum(map(len, x)) for x in row if isinstance(x, str) or (isinstance(x, list) and x and isinstance(x[0], str)))
            if len(out) >= BATCH_ROWS or size >= BATCH_CHARACTERS:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column with null as the empty text."""
    return [x or "" for x in batch.column(name).to_pylist()]


#: The most ranges that an order is cut into.  It bounds what the driver and a broadcast hold; beyond it ranges, which are read as streams, grow.
MOST_RANGES = 100_000


def bounded_sample(df: DataFrame, key: Column, rows: int, total: int) -> list:
    """About ``rows`` distinct keys of ``total`` rows: those whose hash falls under a bound, the same on every run.

    It only places partition bounds; no result depends on which keys it has.  A key that
    many rows share counts once, so no more than its share of the distinct keys arrives.
    """
    keys = df.select(key.alias("k")).where("k is not null")
    bound = min(2**31, -(-(2**31) * rows // max(1, total)))
    return [r.k for r in keys.where(F.pmod(F.xxhash64("k"), F.lit(2**31)) < bound).distinct().collect()]


def range_bounds(sample: list, parts: int) -> list:
    """At most ``parts - 1`` increasing bounds that cut the sample evenly."""
    ordered = sorted(sample)
    return sorted({ordered[len(ordered) * i // parts] for i in range(1, parts)}) if ordered else []
