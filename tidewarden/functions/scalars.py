"""Scalar functions of events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUTED = r"^([^.]+)\.([^.]+)\.schema_definitions$"


def route_topic(topic: Column) -> Column:
    """``X.Y.schema_definitions`` goes to ``schema_registry``; any other topic stays."""
    return F.regexp_replace(topic, ROUTED, "schema_registry")


def total_amount(unit_price: Column, quantity: Column) -> Column:
    """Price by quantity; a price that is no number counts as 100."""
    return F.coalesce(unit_price.try_cast("double"), F.lit(100.0)) * quantity


def stable_uuid(*parts: Column) -> Column:
    """A UUID-shaped text that depends on its parts alone."""
    digest = F.md5(F.concat_ws("|", *parts))
    return F.regexp_replace(digest, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def uniform(key: Column, salt: str) -> Column:
    """A number in [0, 1) that depends on key and salt alone."""
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(2**53)) / F.lit(float(2**53))


def pick(key: Column, salt: str, choices: list[str]) -> Column:
    """One of the choices, evenly."""
    return F.element_at(F.array(*map(F.lit, choices)), (F.floor(uniform(key, salt) * len(choices)) + 1).cast("int"))


def skewed_entity(key: Column, salt: str, entities: int, skew: float) -> Column:
    """An entity number: with probability ``skew`` one of the hottest hundredth, else any."""
    hot = max(1, entities // 100)
    span = F.when(uniform(key, f"{salt}:hot") < skew, F.lit(hot)).otherwise(F.lit(entities))
    return F.floor(uniform(key, f"{salt}:entity") * span).cast("long")


def iso(ts: Column) -> Column:
    """ISO-8601 text in UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def fits_buckets(seconds: Column, bucket: int, longest: int) -> Column:
    """Whether a duration is a whole number of buckets, from one up to ``longest``."""
    return F.coalesce((F.pmod(seconds, F.lit(bucket)) == 0) & seconds.between(bucket, longest), F.lit(False))
