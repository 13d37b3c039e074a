"""Windowed aggregates over 5-minute buckets.

Events are first summed into (entity, bucket) partials of sum, count, min and max,
which collapses a hot entity to at most 288 rows a day before anything is ordered.
Windows are then merged from partials.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model.rules import BUCKET_SECONDS, LONGEST_SECONDS

#: An entity's ticks are dealt in blocks of about a week.
BLOCK_SECONDS = 7 * LONGEST_SECONDS


def bucket_of(ts: Column, size: int = BUCKET_SECONDS) -> Column:
    """Start of the epoch-aligned bucket, in seconds."""
    seconds = F.unix_seconds(ts.cast("timestamp"))
    return seconds - F.pmod(seconds, F.lit(size))


@dataclass(frozen=True)
class Measure:
    """What is aggregated: a value, of the events that ``where`` selects."""

    name: str
    value: Column
    where: Column | None = None

    def partials(self) -> list[Column]:
        x = self.value if self.where is None else F.when(self.where, self.value)
        return [f(x).alias(f"{self.name}_{n}") for n, f in (("sum", F.try_sum), ("count", F.count), ("min", F.min), ("max", F.max))]


def _checked(size: int) -> int:
    if size % BUCKET_SECONDS or not BUCKET_SECONDS <= size <= LONGEST_SECONDS:
        raise ValueError(f"a window is a multiple of {BUCKET_SECONDS} s up to {LONGEST_SECONDS} s")
    return size


def ring_buckets(events: DataFrame, entity: str, ts: str, measures: list[Measure]) -> DataFrame:
    """Partials of each (entity, bucket) that has an event; all measures in one shuffle."""
    partials = [p for m in measures for p in m.partials()]
    return events.groupBy(entity, bucket_of(F.col(ts)).alias("bucket")).agg(*partials)


def merged(name: str, function: str, over=None) -> Column:
    """An aggregate from partials; COUNT of nothing is 0, the others are null."""

    def whole(f, part: str) -> Column:
        out = f(F.col(f"{name}_{part}"))
        return out if over is None else out.over(over)

    total, count = whole(F.sum, "sum"), F.coalesce(whole(F.sum, "count"), F.lit(0))
    return {"SUM": lambda: total, "COUNT": lambda: count, "AVG": lambda: total / F.nullif(count, F.lit(0)), "MAX": lambda: whole(F.max, "max"), "MIN": lambda: whole(F.min, "min")}[function]()


def tumbling(partials: DataFrame, entity: str, size: int, outputs: dict[str, tuple[str, str]]) -> DataFrame:
    """One row for each (entity, window) that has an event; ``outputs``: column -> (measure, function)."""
    start = F.col("bucket") - F.pmod(F.col("bucket"), F.lit(_checked(size)))
    return partials.groupBy(entity, start.alias("window_start")).agg(*(merged(m, f).alias(c) for c, (m, f) in outputs.items()))


def sliding(partials: DataFrame, entity: str, size: int, outputs: dict[str, tuple[str, str]]) -> DataFrame:
    """One row for each populated bucket: the window is that bucket and the size/300 - 1 before it."""
    over = Window.partitionBy(entity).orderBy("bucket").rangeBetween(BUCKET_SECONDS - _checked(size), 0)
    return partials.select(entity, "bucket", *(merged(m, f, over).alias(c) for c, (m, f) in outputs.items()))


def sliding_ticks(partials: DataFrame, entity: str, size: int, outputs: dict[str, tuple[str, str]], slide: int = BUCKET_SECONDS) -> DataFrame:
    """One row for each tick whose window has an event; a tick is the window's last bucket.

    A window changes only at a tick where a bucket enters or leaves it. Those two rows of each
    bucket are ordered and merged; the ticks up to the next change repeat the outcome and are
    made last, one at a time, so that no hash table, sort or shuffle holds them. An entity's
    ticks are dealt in blocks; a bucket whose ticks lie in two blocks enters both.
    """
    if slide % BUCKET_SECONDS or _checked(size) % slide:
        raise ValueError("the slide divides the size")
    span = size * (BLOCK_SECONDS // size)
    enters = F.col("bucket") - F.pmod(F.col("bucket"), F.lit(slide))
    leaves = enters + size

    def block_of(tick: Column) -> Column:
        return tick - F.pmod(tick, F.lit(span))

    def change(block: Column, tick: Column, entering: bool) -> Column:
        return F.struct(block.alias("block"), tick.alias("tick"), F.lit(entering).alias("entering"))

    first, last = block_of(enters), block_of(leaves - slide)
    rows = F.array(change(first, enters, True), F.when(first < last, change(last, enters, True)), change(block_of(leaves), leaves, False))
    kept = [c for c in partials.columns if c not in (entity, "bucket")]
    dealt = partials.select(entity, *kept, F.inline(rows)).where("tick IS NOT NULL")
    changes = dealt.select(entity, "block", "tick", *(F.when(F.col("entering"), F.col(c)).alias(c) for c in kept))
    ordered = Window.partitionBy(entity, "block").orderBy("tick")
    over = ordered.rangeBetween(slide - size, 0)
    buckets = F.count(f"{next(iter(outputs.values()))[0]}_count").over(over)  # those that left have no partials
    since, until = F.greatest("tick", "block"), F.coalesce(F.lead("tick").over(ordered), F.col("block") + span)
    made = changes.select(entity, since.alias("_since"), until.alias("_until"), buckets.alias("_buckets"), *(merged(m, f, over).alias(c) for c, (m, f) in outputs.items()))
    ticks = F.explode(F.sequence("_since", F.col("_until") - slide, F.lit(slide)))
    return made.where("_buckets > 0 AND _until > _since").select(entity, ticks.alias("tick"), *outputs)


def with_empty(aggregated: DataFrame, universe: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    """Rows for every key of ``universe``; counts of what is absent are 0, other aggregates null."""
    return universe.join(aggregated, keys, "left").fillna(0, counts)


def last_value(events: DataFrame, entity: str, value: str, order: list[str]) -> DataFrame:
    """The latest value of each entity; ``order`` must be total."""
    return events.groupBy(entity).agg(F.max_by(value, F.struct(*order)).alias("last_value"))
