"""Change-data transforms and what the schema stream does with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import jsontext as J
from ..functions.scalars import route_topic
from ..model.schemas import UNIFIED


def routed(changes: DataFrame) -> DataFrame:
    """Changes with their topic renamed."""
    return changes.withColumn("topic", route_topic(F.col("topic")))


def flattened(changes: DataFrame) -> DataFrame:
    """Row images of a change stream, with __op, __table and __deleted.

    ``changes``: op, table, before, after (structs of one type) and any further columns.
    A delete becomes its whole former row with __deleted true.  A tombstone, which has
    neither image, stays as a row of nulls.
    """
    image = F.coalesce("after", "before")
    rest = [c for c in changes.columns if c not in ("op", "table", "before", "after")]
    fields = changes.schema["after"].dataType.names
    return changes.select(*rest, *(image[f].alias(f) for f in fields), F.col("op").alias("__op"), F.col("table").alias("__table"), F.when(F.col("op").isNotNull(), F.col("op") == "d").alias("__deleted"))


def without_tombstones(messages: DataFrame, column: str = "value") -> DataFrame:
    return messages.where(F.col(column).isNotNull())


def latest_per_key(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``, which must be total within a key.

    An aggregate, so a hot key is reduced in each task before the shuffle.
    """
    rest = [c for c in log.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("row")
    return log.groupBy(*keys).agg(best).select(*keys, *(F.col("row")[c].alias(c) for c in rest))


def schema_messages(messages: DataFrame, column: str = "value") -> DataFrame:
    """Messages of the schema stream as (schema_id, schema_payload); other columns stay.

    A change row carries both as keys.  A bare schema document is its own payload, under
    ``unified_schema`` or ``<source_name>_<action>`` with ``unknown`` for what is absent.
    A message that is no JSON object is skipped.
    """
    text = F.col(column)
    rest = [c for c in messages.columns if c != column]
    entries = J.as_map(text)
    change = J.has_key(entries, "schema_id") & J.has_key(entries, "schema_payload")
    bare = F.when(J.value_of(entries, "name") == UNIFIED, F.lit("unified_schema")).otherwise(F.concat(F.coalesce(J.value_of(entries, "source_name"), F.lit("unknown")), F.lit("_"), F.coalesce(J.value_of(entries, "action"), F.lit("unknown"))))
    # A payload that came as an object, not as text, reads as the empty text.
    payload = J.as_text(text, entries, "schema_payload")
    found = messages.where(J.parses(text) & entries.isNotNull())
    return found.select(*rest, F.when(change, J.as_text(text, entries, "schema_id")).otherwise(bare).alias("schema_id"), F.when(change, payload).otherwise(text).alias("schema_payload"), F.when(change, J.value_of(entries, "__deleted")).alias("__deleted"))


def publisher_key(entries: Column) -> Column:
    """The key a schema document is published under; one without an action stands for its whole source."""
    source = F.coalesce(J.value_of(entries, "source_name"), F.lit("unknown"))
    end = F.coalesce(J.value_of(entries, "action"), F.lit("schema"))
    return F.when(J.value_of(entries, "name") == UNIFIED, F.lit("unified_schema")).otherwise(F.concat_ws("_", source, end))


def catalog_from(messages: DataFrame, order: list[str], column: str = "value", honor_deletes: bool = False) -> DataFrame:
    """The catalog after all messages: the last one of each key wins.

    Deletes leave a schema active, as upserts are all that the stream knows; with
    ``honor_deletes`` they remove it.
    """
    last = latest_per_key(schema_messages(messages, column), ["schema_id"], order)
    if honor_deletes:
        last = last.where("coalesce(__deleted, 'false') <> 'true'")
    return last.select("schema_id", "schema_payload")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``old`` with the rows of ``new`` inserted or replaced; of one key in ``new`` the last by ``order`` wins."""
    tagged = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return latest_per_key(tagged, keys, ["__new", order]).drop("__new")


#: Versions up to which events look theirs up in a broadcast table of intervals.
FEW_VERSIONS = 1_000


def as_of(events: DataFrame, versions: DataFrame, key: str, event_order: Column, version_order: Column, values: list[str], bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """Each event with the last version of its key that came no later; nulls if none had come.

    Versions of one key must differ in their order.  A few versions are broadcast as
    intervals and events are neither sorted nor shuffled.  Beyond ``FEW_VERSIONS`` events
    and versions are read as one ordered sequence of each key, which takes one pass however
    many versions there are.  ``bucket`` maps the order to whole numbers that do not
    decrease; a hot key then is read in as many parts as it has buckets.
    """
    if versions.limit(FEW_VERSIONS + 1).count() > FEW_VERSIONS:
        return _as_of_sequence(events, versions, key, event_order, version_order, values, bucket or (lambda order: F.lit(0)))
    place = Window.partitionBy("__key").orderBy("__from")
    spans = versions.select(F.col(key).alias("__key"), version_order.alias("__from"), *values).withColumn("__to", F.lead("__from").over(place))
    inside = (F.col(key) == F.col("__key")) & (event_order >= F.col("__from")) & (F.col("__to").isNull() | (event_order < F.col("__to")))
    return events.join(F.broadcast(spans), inside, "left").drop("__key", "__from", "__to")


def _as_of_sequence(events: DataFrame, versions: DataFrame, key: str, event_order: Column, version_order: Column, values: list[str], bucket: Callable[[Column], Column]) -> DataFrame:
    row, version = F.struct(*events.columns), F.struct(*values)
    known = events.where(F.col(key).isNotNull())  # without a key nothing is found, and such events are not gathered
    asked = known.select(F.col(key).alias("key"), event_order.alias("at"), bucket(event_order).cast("long").alias("part"), F.lit(1).alias("side"), row.alias("row"))
    told = versions.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), version_order.alias("at"), bucket(version_order).cast("long").alias("part"), F.lit(0).alias("side"), version.alias("found"))
    # What each part of a key begins with: a row for each key and bucket.
    parts = asked.select("key", "part", "at").unionByName(told, allowMissingColumns=True).groupBy("key", "part").agg(F.max_by("found", F.when(F.col("found").isNotNull(), F.col("at"))).alias("last"))
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begun = parts.select("key", "part", F.last("last", ignorenulls=True).over(earlier).alias("before"))
    so_far = Window.partitionBy("key", "part").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    here = asked.unionByName(told, allowMissingColumns=True).withColumn("here", F.last("found", ignorenulls=True).over(so_far)).where("side = 1")
    met = here.join(begun, ["key", "part"], "left").select("row.*", F.coalesce("here", "before").alias("__found"))
    out = met.select(*events.columns, *(F.col("__found")[v].alias(v) for v in values))
    types = {f.name: f.dataType for f in out.schema}
    return out.unionByName(events.where(F.col(key).isNull()).select("*", *(F.lit(None).cast(types[v]).alias(v) for v in values)))


def envelopes(messages: DataFrame, image: str, column: str = "value") -> DataFrame:
    """Change messages in JSON, as a connector writes them, for ``flattened``.

    A message has the keys before, after, op and source (or ``payload`` with them inside);
    ``image`` is the DDL of the row images.  Adds op, table, before, after and ts_ms;
    a tombstone, or a text that is no such object, has them all null.  Other columns stay.
    """
    row = T.StructType.fromDDL(image)
    body = T.StructType().add("before", row).add("after", row).add("op", "string").add("ts_ms", "long").add("source", T.StructType().add("table", "string"))
    parsed = F.from_json(F.col(column), T.StructType([*body.fields, T.StructField("payload", body)]))
    found = J.once(messages, {"__m": parsed})
    inner = {n: F.coalesce(F.col("__m.payload")[n], F.col("__m")[n]) for n in ("op", "before", "after", "ts_ms")}
    table = F.coalesce(F.col("__m.payload.source.table"), F.col("__m.source.table"))
    return found.select(*(c for c in messages.columns if c != column), inner["op"].alias("op"), table.alias("table"), inner["before"].alias("before"), inner["after"].alias("after"), inner["ts_ms"].alias("ts_ms"))
