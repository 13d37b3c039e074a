"""Synthetic events and rules, the same for the same arguments on any cluster.

Attributes and rule leaves are derived from the dictionary: a field's type, format,
allowed values and ends say what its values look like.
"""

from __future__ import annotations

import random
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import iso, pick, skewed_entity, stable_uuid, total_amount, uniform
from ..model.fields import ENVELOPE, FUNCTIONS, Field, dictionary
from ..model.rules import BUCKET_SECONDS, COMPARISONS, Rule, aggregate, every, none, raw, some
from ..model.schemas import ACTIONS, action_fields

#: Defaults of a run.
EVENTS, ENTITIES, SKEW, DIRTY, LATE = 1_000_000, 100_000, 0.5, 0.05, 0.05
#: Kinds of dirty events: no event_time, text for a number, a number below its least value, no Email.
DROPPED, MISTYPED, OUT_OF_RANGE, MALFORMED = range(4)
#: How far a number without a declared end goes beyond the other end.
SPAN = 1_000


def _whole(key: Column, salt: str, low: int, high: int) -> Column:
    """A whole number from ``low`` to ``high``, both included."""
    return F.floor(uniform(key, salt) * (high - low + 1)).cast("long") + low


def attribute(field: Field, key: Column, now: Column) -> Column:
    """A value of the field as text, as its definition has it."""
    low = field.min if field.min is not None else 0
    high = field.max if field.max is not None else low + SPAN
    if field.allowed:
        return pick(key, field.name, list(field.allowed))
    if field.type == "boolean":
        return pick(key, field.name, ["true", "false"])
    if field.type == "integer":
        return _whole(key, field.name, int(low), int(high)).cast("string")
    if field.type == "double":
        return F.round(uniform(key, field.name) * (high - low) + low, 2).cast("string")
    days = _whole(key, field.name, 0, 365).cast("int")
    shapes = {
        "UUID": lambda: stable_uuid(key.cast("string"), F.lit(field.name)),
        "ISO-8601": lambda: iso(now - F.make_dt_interval(days)),
        "YYYY-MM-DD": lambda: F.date_format(now - F.make_dt_interval(days), "yyyy-MM-dd"),
        "Email": lambda: F.format_string("u%d@mail.test", _whole(key, field.name, 0, SPAN)),
        "E.164": lambda: F.format_string("+1555%07d", _whole(key, field.name, 0, 9_999_999)),
    }
    return shapes[field.format]() if field.format else F.concat(F.lit(f"{field.name} "), _whole(key, field.name, 0, SPAN).cast("string"))


def _told_by_action(field: Field, source: str, action: str) -> str | None:
    """The allowed value that the action's name ends with, as ``payment_failed`` tells a status."""
    last = action.rpartition("_")[2]
    return last if last in field.allowed and field.name.endswith("_status") else None


def attributes(key: Column, action: Column, fault: Column, now: Column) -> dict[str, Column]:
    """Values of all fields beyond the envelope as JSON text."""
    out = {}
    for name, field in dictionary().items():
        if name in ENVELOPE:
            continue
        value = attribute(field, key, now)
        for source, actions in ACTIONS.items():
            for a in actions:
                if name in action_fields(source, a) and (told := _told_by_action(field, source, a)):
                    value = F.when(action == a, F.lit(told)).otherwise(value)
        if field.format == "Email":
            value = F.when(fault == MALFORMED, F.lit("no address")).otherwise(value)
        number = field.type in ("integer", "double")
        if number and field.min is not None:
            value = F.when(fault == OUT_OF_RANGE, F.lit(str(int(field.min) - 1))).otherwise(value)
        if name == "unit_price":
            value = F.when(fault == MISTYPED, F.lit('"unpriced"')).otherwise(value)
        out[name] = value if number or field.type == "boolean" else F.concat(F.lit('"'), value, F.lit('"'))
    out["total_amount"] = total_amount(out["unit_price"], out["quantity"].cast("long")).cast("string")
    return out


def events(spark: SparkSession, n: int = EVENTS, entities: int = ENTITIES, skew: float = SKEW, dirty: float = DIRTY, late: float = LATE, now: str = "2024-02-01 00:00:00", seed: int = 0, layout: str = "flat") -> DataFrame:
    """``n`` events as (key, value): value is JSON text, key its entity.

    Sources, then actions, are even.  Times lie within the day before ``now``, those of
    late events up to two hours further back.  A share of the events has one of the four
    faults, which shows as far as the action has the fields for it.  With the nested
    layout everything beside the routing keys is inside ``fields``.
    """
    if n <= 0 or not 0 <= dirty <= 1 or not 0 <= late <= 1 or entities <= 0:
        raise ValueError("counts must be positive and rates between 0 and 1")
    key, base = F.col("id"), F.lit(now).cast("timestamp")
    rows = spark.range(n).select((key + F.lit(seed) * F.lit(1_000_003)).alias("id"))
    rows = rows.withColumn("source", pick(key, "source", list(ACTIONS)))
    action = F.coalesce(*(F.when(F.col("source") == s, pick(key, "action", list(a))) for s, a in ACTIONS.items()))
    minutes = _whole(key, "minute", 0, 24 * 60 - 1) + F.when(uniform(key, "late") < late, _whole(key, "delay", 0, 119)).otherwise(0)
    fault = F.when(uniform(key, "dirty") < dirty, _whole(key, "fault", 0, 3).cast("int")).otherwise(-1)
    rows = rows.withColumns({"action": action, "at": base - F.make_dt_interval(mins=minutes.cast("int")), "fault": fault, "entity": F.concat(F.lit("e"), skewed_entity(key, "who", entities, skew).cast("string"))})
    made = attributes(key, F.col("action"), F.col("fault"), base)
    plain = {
        "event_id": stable_uuid(key.cast("string"), F.lit("event")), "event_type": F.col("action"), "entity_id": F.col("entity"), "source_system": F.col("source"), "schema_version": F.lit("1.0"),
        "event_time": F.when(F.col("fault") != DROPPED, iso(F.col("at"))), "source_id": F.concat_ws("/", "source", key.cast("string")),
        "trace_id": stable_uuid(key.cast("string"), F.lit("trace")), "correlation_id": stable_uuid(key.cast("string"), F.lit("correlation")),
    }
    quoted = {name: F.concat(F.lit('"'), value, F.lit('"')) for name, value in plain.items()}
    of_action = {name: [f"{s}_{a}" for s in ACTIONS for a in ACTIONS[s] if name in action_fields(s, a)] for name in made}
    route = F.concat_ws("_", "source", "action")
    pairs = [_pair(name, quoted[name]) for name in ENVELOPE] + [F.when(route.isin(*of_action[name]), _pair(name, made[name])) for name in made if of_action[name]]
    body = F.array_join(F.array_compact(F.array(*pairs)), ",")
    routing = F.concat(_pair("source_system", quoted["source_system"]), F.lit(","), _pair("event_type", quoted["event_type"]))
    value = F.concat(F.lit("{"), body, F.lit("}")) if layout == "flat" else F.concat(F.lit("{"), routing, F.lit(',"fields":{'), body, F.lit("}}"))
    return rows.select(F.col("entity").alias("key"), value.alias("value"))


def _pair(name: str, value: Column) -> Column:
    return F.concat(F.lit(f'"{name}":'), value)


def _raw_leaf(r: random.Random) -> dict:
    """A predicate that suits its field: choices for allowed values, order for numbers, equality for booleans, else a part of the text."""
    field = r.choice([f for f in dictionary().values() if f.name not in ENVELOPE])
    if field.allowed:
        some_of = r.sample(field.allowed, r.randint(1, len(field.allowed)))
        return raw(field.name, "IN", some_of) if len(some_of) > 1 else raw(field.name, r.choice(("EQ", "NEQ")), some_of[0])
    if field.type == "boolean":
        return raw(field.name, "EQ", bool(r.getrandbits(1)))
    if field.type == "string":
        return raw(field.name, "CONTAINS", str(r.randrange(10)))
    low = r.randrange(SPAN)
    op = r.choice(("BETWEEN", *COMPARISONS))
    return raw(field.name, op, [low, low + r.randrange(1, SPAN)] if op == "BETWEEN" else low)


def _aggregate_leaf(r: random.Random) -> dict:
    field = r.choice([f for f in dictionary().values() if f.name not in ENVELOPE])
    function = r.choice([f for f in FUNCTIONS if f.lower() in field.strategies and (f == "COUNT" or not field.format)])
    size = BUCKET_SECONDS * r.choice((1, 12, 72, 288))
    return aggregate(field.name, function, size, r.choice(COMPARISONS), r.randrange(10 if function == "COUNT" else SPAN), source=r.choice((None, *ACTIONS)), slide=r.choice((BUCKET_SECONDS, size)))


def random_tree(r: random.Random, depth: int) -> dict:
    """A condition tree with at most ``depth`` levels of AND, OR and NOT."""

    def node(left: int) -> dict:
        if not left or (left < depth and r.randrange(3) == 0):
            return r.choice((_raw_leaf, _aggregate_leaf))(r)
        kind = r.randrange(5)
        return none(node(left - 1)) if not kind else (every, some)[kind % 2](*(node(left - 1) for _ in range(r.randint(2, 3))))

    return node(depth)


def rules(n: int, seed: int = 0) -> list[Rule]:
    """``n`` random rules; each depends on the seed and its own number only."""
    out = []
    for i in range(n):
        r = random.Random(f"{seed}:{i}")
        rule_id = str(uuid.UUID(int=r.getrandbits(128)))
        out.append(Rule(rule_id, f"rule {i}", random_tree(r, r.randint(1, 3)), priority=r.randrange(100), cooldown_seconds=60 * r.randrange(61), version=r.randint(1, 9), enabled=r.randrange(10) > 0))
    return out
