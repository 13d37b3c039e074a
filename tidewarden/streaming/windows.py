"""Streaming windows and rules with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..model.rules import BUCKET_SECONDS

#: Out-of-order by up to a day, late by up to two hours more.
WATERMARK = "26 hours"


def windowed(events: DataFrame, entity: str, ts: str, value: str, size: int, slide: int | None = None, watermark: str = WATERMARK) -> DataFrame:
    """Sum, count, average, maximum and minimum of each entity and window; tumbling without ``slide``."""
    spans = F.window(F.col("__ts"), f"{size} seconds", f"{slide} seconds") if slide else F.window(F.col("__ts"), f"{size} seconds")
    x = F.col(value)
    timed = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", watermark)
    made = timed.groupBy(entity, spans.alias("w")).agg(F.sum(x).alias("sum"), F.count(x).alias("count"), F.avg(x).alias("avg"), F.max(x).alias("max"), F.min(x).alias("min"))
    return made.select(entity, F.unix_seconds("w.start").alias("window_start"), F.unix_seconds("w.end").alias("window_end"), "sum", "count", "avg", "max", "min")


class RingBuffer(StatefulProcessor):
    """A rule SUM(value) >= threshold over the last ``size`` seconds, with a cooldown, per entity.

    State: a sum for each 5-minute bucket of the window, at most size/300 of them, and the
    time until which the entity rests.  Buckets that leave the window are removed.
    """

    def __init__(self, size: int, threshold: float, cooldown: int):
        self.size, self.threshold, self.cooldown = size, threshold, cooldown

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.buckets = handle.getMapState("buckets", "bucket long", "total double")
        self.rest = handle.getValueState("rest", "until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        pending = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        held = {k[0]: v[0] for k, v in self.buckets.iterator()}
        until = self.rest.get()[0] if self.rest.exists() else None
        for event_id, ts, value in zip(pending["event_id"], pending["ts"], pending["value"], strict=True):
            bucket = int(ts) - int(ts) % BUCKET_SECONDS
            held[bucket] = held.get(bucket, 0.0) + float(value)
            total = sum(v for b, v in held.items() if bucket - self.size < b <= bucket)
            if total >= self.threshold and (until is None or ts >= until):
                out.append((key[0], int(event_id), int(ts), total))
                until = int(ts) + self.cooldown
        oldest = max(held) - self.size - 26 * 3600
        for bucket, total in held.items():
            if bucket > oldest:
                self.buckets.updateValue((bucket,), (total,))
            elif self.buckets.containsKey((bucket,)):
                self.buckets.removeKey((bucket,))
        if until is not None:
            self.rest.update((until,))
        yield pd.DataFrame(out, columns=["entity", "event_id", "ts", "total"])

    def close(self) -> None:
        pass


FIRED = "entity long, event_id long, ts long, total double"


def ring_rule(events: DataFrame, size: int = 86400, threshold: float = 100.0, cooldown: int = 3600) -> DataFrame:
    """Firings of the rule over a stream of (entity, event_id, ts in seconds, value).

    Needs the RocksDB state store.  Within a micro-batch events are taken in time order.
    """
    return events.groupBy("entity").transformWithStateInPandas(RingBuffer(size, threshold, cooldown), FIRED, "append", "None")
