"""Kafka options for both sources and the sink.

The Kafka connector is a separate jar.  Where it is absent, replay topics from files
(``sources.files.topic_stream``); the columns are the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS, SCHEMAS = "events", "schema_registry"
EVENT_GROUP, SCHEMA_GROUP = "event-validation", "schema-registry"


def source_options(servers: str, topic: str, group: str | None = None, fail_on_loss: bool = True) -> dict[str, str]:
    """Read a topic from its beginning; records that are gone before they were read are an error unless said otherwise."""
    out = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", "failOnDataLoss": str(fail_on_loss).lower()}
    return out | ({"kafka.group.id": group} if group else {})


def sink_options(servers: str, topic: str) -> dict[str, str]:
    """Write in large compressed batches, acknowledged by the leader."""
    return {"kafka.bootstrap.servers": servers, "topic": topic, "kafka.acks": "1", "kafka.compression.type": "lz4", "kafka.batch.size": str(1 << 20), "kafka.linger.ms": "5", "kafka.buffer.memory": str(64 << 20)}


def text_records(records: DataFrame) -> DataFrame:
    return records.select(F.col("key").cast("string"), F.col("value").cast("string"), "topic", "partition", "offset", "timestamp")


def event_stream(spark: SparkSession, servers: str, topic: str = EVENTS) -> DataFrame:
    return text_records(spark.readStream.format("kafka").options(**source_options(servers, topic, EVENT_GROUP)).load())


def schema_snapshot(spark: SparkSession, servers: str, topic: str = SCHEMAS) -> DataFrame:
    return text_records(spark.read.format("kafka").options(**source_options(servers, topic, SCHEMA_GROUP)).load())


def keyed_records(rows: DataFrame, key: str, value: str = "value") -> DataFrame:
    """Key and value as text, which is all that a sink takes; records of one key stay in one partition of the topic."""
    return rows.select(F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value"))


def write(rows: DataFrame, servers: str, topic: str, key: str, value: str = "value") -> None:
    """Write rows to a topic.  A task that runs again may write its records twice, as the sink has no transactions."""
    keyed_records(rows, key, value).write.format("kafka").options(**sink_options(servers, topic)).save()


def write_stream(rows: DataFrame, servers: str, topic: str, key: str, checkpoint: str, value: str = "value") -> StreamingQuery:
    """The same for a stream."""
    writer = keyed_records(rows, key, value).writeStream.format("kafka").options(**sink_options(servers, topic))
    return writer.option("checkpointLocation", checkpoint).start()
