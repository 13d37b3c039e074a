"""JSON text as columns.  Everything stays in built-in functions.

A text is gated by ``try_parse_json`` and taken apart by ``from_json`` into a map of
raw values in their order.  Of a repeated key the last value counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STRICT = {"allowSingleQuotes": "false"}


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with further columns that are computed once for each row, however often they are used.

    The optimizer merges projections and so repeats an expression wherever its column is
    named; it does not look through a generator, and here that has one row to give.
    """
    made = F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items()))))
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c not in columns), made)


def parses(text: Column) -> Column:
    """Whether the text begins with a whole JSON value; null text does not."""
    return F.try_parse_json(text).isNotNull()


def as_map(text: Column) -> Column:
    """Keys to raw values of a JSON object (strings unquoted, nested values as JSON text); else null."""
    return F.from_json(text, "map<string,string>", _STRICT)


def as_struct(text: Column, names: list[str]) -> Column:
    """The named keys of a JSON object as a struct of raw values; null if the text is no object."""
    fields = F.from_json(text, T.StructType([T.StructField(n, T.StringType()) for n in names]), _STRICT)
    return F.when(F.startswith(F.ltrim(text), F.lit("{")) & parses(text), fields)


def has_key(entries: Column, key: str) -> Column:
    """Whether the key exists; an explicit null counts."""
    return F.coalesce(F.map_contains_key(entries, key), F.lit(False))


def value_of(entries: Column, key: Column | str) -> Column:
    """The last value of a key; null if it is absent or JSON null."""
    key = F.lit(key) if isinstance(key, str) else key
    return F.try_element_at(F.transform(F.filter(F.map_entries(entries), lambda e: e["key"] == key), lambda e: e["value"]), F.lit(-1))


def as_text(text: Column, entries: Column, key: str) -> Column:
    """A key's value as text: JSON null is ``null``; objects and arrays are the empty text."""
    value = value_of(entries, key)
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(text), f"$.{key}", "variant"))
    nested = F.substring(value, 1, 1).isin("{", "[") & kind.rlike("^(OBJECT|ARRAY)")
    return F.when(nested, F.lit("")).otherwise(F.coalesce(value, F.lit("null")))


def truthy(value: Column) -> Column:
    """A raw value as boolean: true, the text ``true``, or a number other than zero."""
    return F.coalesce((F.trim(value) == "true") | (value.try_cast("double") != 0), F.trim(value) == "true", F.lit(False))


def put(text: Column, entries: Column, key: str, value: Column) -> Column:
    """The object's text with ``key`` set.

    The text is kept as it is and the key is spliced in before its end.  Only where
    the key exists already, a key repeats or something follows the object, the text is
    written anew, key order kept.
    """
    quoted = F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'^\{"v":(.*)\}$', 1)
    trimmed = F.regexp_replace(text, r"\s+$", "")
    body = F.substring(trimmed, F.lit(1), F.length(trimmed) - 1)
    empty = F.size(entries) == 0
    spliced = F.concat(body, F.when(empty, F.lit("")).otherwise(F.lit(",")), F.lit(f'"{key}":'), quoted, F.lit("}"))
    names = F.map_keys(entries)
    plain = ~F.array_contains(names, key) & (F.size(F.array_distinct(names)) == F.size(names)) & whole_object(trimmed)
    variants = F.map_entries(F.from_json(text, "map<string,variant>", _STRICT))
    last = F.filter(variants, lambda e, i: (e["key"] != key) & ~F.exists(F.slice(variants, i + 2, F.size(variants)), lambda x: x["key"] == e["key"]))
    rewritten = F.to_json(F.map_concat(F.map_from_entries(last), F.create_map(F.lit(key), F.parse_json(quoted))))
    return F.when(plain, spliced).otherwise(rewritten)


def whole_object(trimmed: Column) -> Column:
    """Whether nothing follows the object: wrapped into an array, the text still is one value.

    Were there more after the object, the array would not parse.
    """
    return F.try_parse_json(F.concat(F.lit("["), trimmed, F.lit("]"))).isNotNull() & F.endswith(trimmed, F.lit("}")) & (F.json_array_length(F.concat(F.lit("["), trimmed, F.lit("]"))) == 1)
