"""Validation of JSON events against schemas that arrive as data.

An event is valid or dirty with a reason; the first case that holds decides:

====  =====================================================  ==========================================
V1    the text does not parse                                JSON Parse Exception: ...
V2    the key source_system or event_type is absent          Missing source_system or action ...
V2a   the text parses but is no object                       JSON Parse Exception: ...
V3    no schema for the route key                            Schema not found for key: ...
V4    the stored schema does not parse                       JSON Parse Exception: ...
V5    the schema has no ``fields``, or is the empty text     valid
V6    the event has no ``fields`` (nested layout)            Missing required fields: fields_object_missing
V7    a required name is absent or null                      Missing required fields: a, b
V8    otherwise                                              valid
====  =====================================================  ==========================================

Only presence is checked.  In the nested layout required names are looked up inside the
event's ``fields`` object; in the flat layout beside the envelope, and V6 cannot occur.
A valid event keeps its text byte by byte.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import jsontext as J
from .cdc import as_of
from .joins import broadcast_if_small, is_small

PARSE = "JSON Parse Exception: "
NO_KEY = "Missing source_system or action for schema mapping"
NO_SCHEMA = "Schema not found for key: "
MISSING = "Missing required fields: "
NO_FIELDS = "fields_object_missing"


def route_key(text: Column, entries: Column) -> Column:
    """``<source_system>_<event_type>``; JSON null reads ``null``, nested values are empty."""
    return F.concat(J.as_text(text, entries, "source_system"), F.lit("_"), J.as_text(text, entries, "event_type"))


def compiled_catalog(catalog: DataFrame, *kept: str) -> DataFrame:
    """Parse each schema once: schema_id, unreadable, unchecked, required (names in schema order), and the columns ``kept``.

    ``catalog`` has schema_id and schema_payload, as text.
    """
    text = F.coalesce("schema_payload", F.lit(""))
    parsed = J.once(catalog.select("schema_id", *kept, text.alias("payload")), {"parsed": J.parses(F.col("payload")), "entries": J.as_map(F.col("payload"))})
    fields = F.map_entries(J.as_map(J.value_of(F.col("entries"), "fields")))
    required = F.transform(F.filter(fields, lambda e: J.truthy(F.get_json_object(e["value"], "$.required"))), lambda e: e["key"])
    blank = F.trim("payload") == ""
    made = {
        "unreadable": ~blank & ~F.col("parsed"),
        "unchecked": blank | ~J.has_key(F.col("entries"), "fields"),
        "required": F.coalesce(required, F.array().cast("array<string>")),
    }
    return J.once(parsed, made).select("schema_id", *kept, *made)


def keyed(events: DataFrame, column: str = "value") -> DataFrame:
    """Events with ``entries`` (null if no object), ``parsed`` and ``route_key``."""
    text = F.col(column)
    out = J.once(events, {"parsed": J.parses(text), "entries": J.as_map(text)})
    out = out.withColumn("entries", F.when(F.col("parsed"), F.col("entries")))
    routed = J.has_key(F.col("entries"), "source_system") & J.has_key(F.col("entries"), "event_type")
    return J.once(out, {"route_key": F.when(routed, route_key(text, F.col("entries")))})


def missing_fields(entries: Column, required: Column, layout: str) -> Column:
    """Required names that are absent or null, in schema order."""
    return absent(J.as_map(J.value_of(entries, "fields")) if layout == "nested" else entries, required)


def absent(place: Column, required: Column) -> Column:
    """The required names that a map of raw values lacks or has as null."""
    return F.filter(required, lambda name: J.value_of(place, name).isNull())


def validate(events: DataFrame, catalog: DataFrame, layout: str = "nested", column: str = "value", order: str | None = None) -> DataFrame:
    """Validate events against the schemas of ``catalog`` (one row for each schema_id).

    With ``order``, a column of both that tells when each arrived, ``catalog`` has all
    versions that ever came, and an event sees the last of its key that came no later.

    Adds route_key, status (``valid`` or ``dirty``), error_reason (null if valid) and
    output: the text itself, the text with error_reason set, or for a text that is no
    object a wrapper with original_payload.  Other columns of ``events`` stay.
    """
    if layout not in ("nested", "flat"):
        raise ValueError("layout is nested or flat")
    # Each text is parsed once, its fields once; what follows from them is a column, not an expression.
    kept = events.columns
    if order is None:
        # A compiled schema is smaller than its text, so the text is what is checked.
        schemas = F.broadcast(compiled_catalog(catalog)) if is_small(catalog) else compiled_catalog(catalog)
        joined = keyed(events, column).join(schemas, F.col("route_key") == F.col("schema_id"), "left")
    else:
        versions = compiled_catalog(catalog.withColumnRenamed(order, "__came"), "__came").withColumn("route_key", F.col("schema_id"))
        joined = as_of(keyed(events, column), versions, "route_key", F.col(order), F.col("__came"), ["schema_id", "unreadable", "unchecked", "required"])
    entries, text = F.col("entries"), F.col(column)
    no_fields = F.lit(False) if layout == "flat" else ~J.has_key(entries, "fields")
    place = entries if layout == "flat" else J.as_map(J.value_of(entries, "fields"))
    looked_up = J.once(J.once(joined, {"place": F.when(~F.col("unchecked"), place)}), {"missing": absent(F.col("place"), F.col("required"))})
    missing = F.col("missing")
    reason = (
        F.when(~F.col("parsed"), F.lit(f"{PARSE}not a JSON value"))
        .when(entries.isNull(), F.lit(f"{PARSE}not a JSON object"))
        .when(F.col("route_key").isNull(), F.lit(NO_KEY))
        .when(F.col("schema_id").isNull(), F.concat(F.lit(NO_SCHEMA), F.col("route_key")))
        .when(F.col("unreadable"), F.lit(f"{PARSE}the schema is not JSON"))
        .when(F.col("unchecked"), F.lit(None))
        .when(no_fields, F.lit(MISSING + NO_FIELDS))
        .when(F.size(missing) > 0, F.concat(F.lit(MISSING), F.array_join(missing, ", ")))
    )
    judged = J.once(looked_up, {"error_reason": reason})
    wrapped = entries.isNull() | F.coalesce(F.col("unreadable"), F.lit(False))
    wrapper = F.to_json(F.struct(text.alias("original_payload"), F.col("error_reason")))
    output = F.when(F.col("error_reason").isNull(), text).when(wrapped, wrapper).otherwise(J.put(text, entries, "error_reason", F.col("error_reason")))
    status = F.when(F.col("error_reason").isNull(), F.lit("valid")).otherwise(F.lit("dirty"))
    return judged.select(*kept, "route_key", status.alias("status"), "error_reason", output.alias("output"))


def split(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The valid and the dirty events; together they are the input."""
    return validated.where("status = 'valid'"), validated.where("status = 'dirty'")


def with_schema(events: DataFrame, catalog: DataFrame) -> DataFrame:
    """Events whose route key has a schema (semi-join)."""
    return events.join(broadcast_if_small(catalog.select("schema_id")), F.col("route_key") == F.col("schema_id"), "left_semi")


def without_schema(events: DataFrame, catalog: DataFrame) -> DataFrame:
    """Events whose route key has none (anti-join)."""
    return events.join(broadcast_if_small(catalog.select("schema_id")), F.col("route_key") == F.col("schema_id"), "left_anti")


def counted(validated: DataFrame, counters: Observation | str) -> DataFrame:
    """The same rows; once they have been written, ``counters`` has how many were valid and dirty.

    A name instead of an Observation serves streams, whose progress reports carry it.
    """
    return validated.observe(counters, F.count("*").alias("events"), F.count_if(F.col("status") == "valid").alias("valid"), F.count_if(F.col("status") == "dirty").alias("dirty"))
