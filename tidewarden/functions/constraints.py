"""Declared constraints of attributes: type, range, allowed values and format."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model.fields import FORMATS, Field


def violation(field: Field, value: Column) -> Column:
    """``name:kind`` of the first constraint a raw text value breaks; null if it is absent or fine."""
    checks = []
    if field.type in ("integer", "double"):
        number = value.try_cast("double")
        bad = number.isNull() if field.type == "double" else number.isNull() | (number != F.floor(number))
        checks.append(("type", bad))
        if field.min is not None:
            checks.append(("min", number < field.min))
        if field.max is not None:
            checks.append(("max", number > field.max))
    elif field.type == "boolean":
        checks.append(("type", ~value.isin("true", "false")))
    if field.allowed:
        checks.append(("allowed_values", ~value.isin(*field.allowed)))
    if field.format:
        wrong = ~value.rlike(FORMATS[field.format])
        if field.format in ("ISO-8601", "YYYY-MM-DD"):
            wrong |= F.try_to_timestamp(value).isNull()
        checks.append(("format", wrong))
    out = F.lit(None).cast("string")
    for kind, bad in reversed(checks):
        out = F.when(value.isNotNull() & bad, F.lit(f"{field.name}:{kind}")).otherwise(out)
    return out


def violations(values: Iterable[tuple[Field, Column]]) -> Column:
    """All violations as an array, in the order of the fields."""
    found = [violation(f, v) for f, v in values]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
