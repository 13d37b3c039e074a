"""File sources: Parquet tables, JSON event logs, schema documents and topic replays."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model.schemas import published
from ..operators.cdc import latest_per_key

#: A replayed topic: what a Kafka source would give, with text values.
RECORD = "key string, value string, topic string, partition int, offset long, timestamp timestamp"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table; filters and columns reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, path: str) -> DataFrame:
    """Events as raw text, one JSON value a line."""
    return spark.read.text(path)


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """The same as a stream over files that arrive."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)


def topic_log(spark: SparkSession, path: str) -> DataFrame:
    """A topic replayed from JSON files of records."""
    return spark.read.schema(RECORD).json(path)


def topic_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(RECORD).option("maxFilesPerTrigger", files_per_trigger).json(path)


def schema_documents(spark: SparkSession, path: str) -> DataFrame:
    """All ``*.json`` files below a folder, or one file, each whole: path and value."""
    found = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    return found.select(F.col("_metadata.file_path").alias("path"), "value")


def published_documents(documents: DataFrame) -> DataFrame:
    """(path, schema_id, schema_payload, error) of documents (path, value): each under its key, without descriptions, minified.

    A document that cannot be read has only its error.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("value").to_pylist():
                try:
                    rows.append((*published(json.loads(text)), None))
                except (ValueError, TypeError, AttributeError, KeyError) as error:
                    rows.append((None, None, str(error)))
            columns = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("path"), *(pa.array(c, pa.string()) for c in columns)], ["path", "schema_id", "schema_payload", "error"])

    return documents.select(F.col("path").cast("string").alias("path"), "value").mapInArrow(read, "path string, schema_id string, schema_payload string, error string")


def published_schemas(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(catalog rows, errors) of the schema documents below a folder; of two with one key the later path wins.

    Documents are read where they are found, not on the driver.  One that cannot be read
    is reported as (path, error) and the others go on.
    """
    found = published_documents(schema_documents(spark, path))
    rows = latest_per_key(found.where("error IS NULL").drop("error"), ["schema_id"], ["path"])
    return rows.select("schema_id", "schema_payload"), found.where("error IS NOT NULL").select("path", "error")


def tail(records: DataFrame, n: int, partition: str = "partition", offset: str = "offset") -> DataFrame:
    """The last ``n`` records of each partition.

    Only the offsets are compared: a record is kept if its partition has fewer than ``n``
    after it.
    """
    place = Window.partitionBy(partition).orderBy(F.desc(offset))
    return records.withColumn("__place", F.row_number().over(place)).where(F.col("__place") <= n).drop("__place")


def tail_total(records: DataFrame, n: int, partition: str = "partition", offset: str = "offset") -> DataFrame:
    """``n`` records in all: each partition is read from ``n`` before its end, one partition after the other, until ``n`` have come."""
    return tail(records, n, partition, offset).orderBy(partition, offset).limit(n)
