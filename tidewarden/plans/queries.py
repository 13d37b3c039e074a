"""Queries over the driver's tables, each with its DuckDB form where SQL has one.

Events map to the engine's model so: entity is user_id, event time is ts, the number is
value; click and view come from ecommerce, signup from crm, the rest from payment.
Sums go through DECIMAL(18,2), so they do not depend on the order of addition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import jsontext as J
from ..functions.constraints import violations
from ..functions.predicates import combine, compare
from ..functions.scalars import fits_buckets, iso, route_topic, skewed_entity, stable_uuid, total_amount
from ..model.fields import dictionary
from ..model.rules import BUCKET_SECONDS, LONGEST_SECONDS, Rule, aggregate, every, none, raw, some
from ..model.schemas import catalog_rows
from ..operators import cdc, rules, validation, windows
from ..operators.windows import Measure, bucket_of
from ..session import configure
from ..sources import files, synthetic

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(configure(spark), sf_dir)

        _QUERIES[name] = run
        if sql:
            _SQL[name] = " ".join(sql.split())
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


SOURCE = "CASE WHEN event_type IN ('click', 'view') THEN 'ecommerce' WHEN event_type = 'signup' THEN 'crm' ELSE 'payment' END"
EV = f"ev AS (SELECT *, {SOURCE} AS source_system, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(floor(epoch(ts)) AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) % 300 AS bucket, CAST(value AS DECIMAL(18,2)) AS amount FROM events)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table with source_system and the exact amount."""
    return files.table(spark, sf_dir, "events").withColumn("source_system", F.expr(SOURCE)).withColumn("amount", F.col("value").cast("decimal(18,2)"))


# Scans and tails.


@query("scan_events", "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' AND value >= 10")
def scan_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.table(spark, sf_dir, "events").where("event_type = 'purchase' AND value >= 10").select("event_id", "user_id", "value")


@query("tail_n_per_partition", "SELECT p, event_id FROM (SELECT event_id, user_id % 6 AS p, row_number() OVER (PARTITION BY user_id % 6 ORDER BY event_id DESC) AS n FROM events) WHERE n <= 10")
def tail_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files.table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 6).alias("p"))
    return files.tail(rows, 10, "p", "event_id").select("p", "event_id")


@query("tail_n_total", "SELECT p, event_id FROM (SELECT event_id, user_id % 6 AS p, row_number() OVER (PARTITION BY user_id % 6 ORDER BY event_id DESC) AS n FROM events) WHERE n <= 15 ORDER BY p, event_id LIMIT 15")
def tail_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files.table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 6).alias("p"))
    return files.tail_total(rows, 15, "p", "event_id").select("p", "event_id")


@query("synthetic_events")
def synthetic_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many as the table of events has."""
    return synthetic.events(spark, n=files.table(spark, sf_dir, "events").count(), entities=1_000, dirty=0.4)


@query("synthetic_rules")
def synthetic_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.definitions(spark, synthetic.rules(2_000))


@query("skewed_pick")
def skewed_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.table(spark, sf_dir, "events").groupBy(skewed_entity(F.col("event_id"), "pick", 1000, 0.5).alias("entity")).agg(F.count("*").alias("n"))


# Predicates.


def _predicate(name: str, condition: Callable[[], Column], where: str) -> None:
    @query(name, f"SELECT event_id FROM events WHERE {where}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return files.table(spark, sf_dir, "events").where(condition()).select("event_id")


_predicate("pred_eq", lambda: compare(F.col("event_type"), "EQ", "purchase"), "event_type = 'purchase'")
_predicate("pred_neq", lambda: compare(F.col("event_type"), "NEQ", "purchase"), "event_type <> 'purchase'")
_predicate("pred_gt", lambda: compare(F.col("value"), "GT", 50), "value > 50")
_predicate("pred_gte", lambda: compare(F.col("value"), "GTE", 50.5), "value >= 50.5")
_predicate("pred_lt", lambda: compare(F.col("value"), "LT", 20), "value < 20")
_predicate("pred_lte", lambda: compare(F.col("value"), "LTE", 20.25), "value <= 20.25")
_predicate("pred_in", lambda: compare(F.col("event_type"), "IN", ["click", "view"]), "event_type IN ('click', 'view')")
_predicate("pred_between", lambda: compare(F.col("value"), "BETWEEN", [10, 20]), "value BETWEEN 10 AND 20")
_predicate("pred_contains", lambda: compare(F.col("props"), "CONTAINS", '"k": 1'), "contains(props, '\"k\": 1')")
_predicate(
    "tree_and_or_not",
    lambda: combine("AND", [combine("OR", [compare(F.col("event_type"), "EQ", "click"), compare(F.col("value"), "GT", 80)]), combine("NOT", [compare(F.col("user_id"), "LT", 5)])]),
    "(event_type = 'click' OR value > 80) AND NOT (user_id < 5)",
)


@query("projection_total_amount", "SELECT event_id, coalesce(TRY_CAST(CASE WHEN event_id % 4 = 0 THEN 'N/A' ELSE CAST(user_id AS VARCHAR) END AS DOUBLE), 100.0) * (event_id % 5 + 1) AS total FROM events")
def projection_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.when(F.col("event_id") % 4 == 0, F.lit("N/A")).otherwise(F.col("user_id").cast("string"))
    return files.table(spark, sf_dir, "events").select("event_id", total_amount(price, F.col("event_id") % 5 + 1).alias("total"))


@query("scalar_uuid", "SELECT event_id, regexp_replace(md5(concat(CAST(event_id AS VARCHAR), '|', event_type)), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS uuid FROM events")
def scalar_uuid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.table(spark, sf_dir, "events").select("event_id", stable_uuid(F.col("event_id").cast("string"), F.col("event_type")).alias("uuid"))


@query("scalar_time", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at, strftime(ts - to_minutes(CAST(event_id % 1440 AS BIGINT)), '%Y-%m-%dT%H:%M:%SZ') AS earlier, strftime(ts + to_days(CAST(event_id % 7 AS INT)), '%Y-%m-%d') AS delivery FROM events")
def scalar_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    earlier = ts - F.make_dt_interval(mins=(F.col("event_id") % 1440).cast("int"))
    return files.table(spark, sf_dir, "events").select("event_id", iso(ts).alias("at"), iso(earlier).alias("earlier"), F.date_format(ts + F.make_dt_interval((F.col("event_id") % 7).cast("int")), "yyyy-MM-dd").alias("delivery"))


@query("scalar_modulo", "SELECT event_id, event_id * 60 % 300 = 0 AND event_id * 60 BETWEEN 300 AND 86400 AS fits FROM events")
def scalar_modulo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.table(spark, sf_dir, "events").select("event_id", fits_buckets(F.col("event_id") * 60, BUCKET_SECONDS, LONGEST_SECONDS).alias("fits"))


# Windows.


def _amount() -> list[Measure]:
    return [Measure("x", F.col("amount"))]


def _shown(function: str, column: str) -> Column:
    out = F.col(column)
    return {"COUNT": lambda: out, "AVG": lambda: F.round(out.cast("double"), 6)}.get(function, lambda: out.cast("double"))()


def _partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.ring_buckets(events(spark, sf_dir), "user_id", "ts", _amount())


@query("ring_buckets", f"WITH {EV} SELECT user_id, bucket, CAST(sum(amount) AS DOUBLE) AS total, count(*) AS n, CAST(min(amount) AS DOUBLE) AS low, CAST(max(amount) AS DOUBLE) AS high FROM ev GROUP BY 1, 2")
def ring_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _partials(spark, sf_dir).select("user_id", "bucket", F.col("x_sum").cast("double").alias("total"), F.col("x_count").alias("n"), F.col("x_min").cast("double").alias("low"), F.col("x_max").cast("double").alias("high"))


_DUCK = {"SUM": "CAST(sum(amount) AS DOUBLE)", "COUNT": "count(amount)", "AVG": "round(CAST(sum(amount) AS DOUBLE) / count(amount), 6)", "MAX": "CAST(max(amount) AS DOUBLE)", "MIN": "CAST(min(amount) AS DOUBLE)"}


def _average(df: DataFrame, function: str) -> Column:
    return F.round(F.col("s").cast("double") / F.col("n"), 6) if function == "AVG" else _shown(function, "v")


def _outputs(function: str) -> dict[str, tuple[str, str]]:
    return {"s": ("x", "SUM"), "n": ("x", "COUNT")} if function == "AVG" else {"v": ("x", function)}


def _window_queries() -> None:
    for function in ("SUM", "COUNT", "AVG", "MAX", "MIN"):

        @query(f"tumbling_{function.lower()}", f"WITH {EV} SELECT user_id, bucket - bucket % 3600 AS window_start, {_DUCK[function]} AS v FROM ev GROUP BY 1, 2")
        def tumbling(spark: SparkSession, sf_dir: str, function: str = function) -> DataFrame:
            made = windows.tumbling(_partials(spark, sf_dir), "user_id", 3600, _outputs(function))
            return made.select("user_id", "window_start", _average(made, function).alias("v"))

        for name, size in (("1h", 3600), ("24h", 86400)):
            over = f"(PARTITION BY user_id ORDER BY bucket RANGE BETWEEN {size - 300} PRECEDING AND CURRENT ROW)"
            merge = {"SUM": f"CAST(sum(s) OVER {over} AS DOUBLE)", "COUNT": f"CAST(sum(n) OVER {over} AS BIGINT)", "AVG": f"round(CAST(sum(s) OVER {over} AS DOUBLE) / CAST(sum(n) OVER {over} AS BIGINT), 6)", "MAX": f"CAST(max(h) OVER {over} AS DOUBLE)", "MIN": f"CAST(min(l) OVER {over} AS DOUBLE)"}[function]

            @query(f"sliding_{function.lower()}_{name}", f"WITH {EV}, p AS (SELECT user_id, bucket, sum(amount) AS s, count(amount) AS n, max(amount) AS h, min(amount) AS l FROM ev GROUP BY 1, 2) SELECT user_id, bucket, {merge} AS v FROM p")
            def sliding(spark: SparkSession, sf_dir: str, function: str = function, size: int = size) -> DataFrame:
                made = windows.sliding(_partials(spark, sf_dir), "user_id", size, _outputs(function))
                return made.select("user_id", "bucket", _average(made, function).alias("v"))


_window_queries()


@query(
    "sliding_ticks_1h",
    f"WITH {EV}, p AS (SELECT user_id, bucket, sum(amount) AS s, count(*) AS n FROM ev GROUP BY 1, 2), t AS (SELECT user_id, bucket + 300 * i AS tick, s, n FROM p, range(12) r(i)) SELECT user_id, tick, CAST(sum(s) AS DOUBLE) AS total, CAST(sum(n) AS BIGINT) AS n FROM t GROUP BY 1, 2",
)
def sliding_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = windows.sliding_ticks(_partials(spark, sf_dir), "user_id", 3600, {"total": ("x", "SUM"), "n": ("x", "COUNT")})
    return made.select("user_id", "tick", F.col("total").cast("double").alias("total"), "n")


_24H = "OVER (PARTITION BY user_id ORDER BY bucket RANGE BETWEEN 86100 PRECEDING AND CURRENT ROW)"


@query("sliding_filtered_count", f"WITH {EV}, p AS (SELECT user_id, bucket, count(*) FILTER (WHERE event_type = 'error') AS n FROM ev GROUP BY 1, 2) SELECT user_id, bucket, CAST(sum(n) {_24H} AS BIGINT) AS errors FROM p")
def sliding_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = windows.ring_buckets(events(spark, sf_dir), "user_id", "ts", [Measure("x", F.lit(1), compare(F.col("event_type"), "EQ", "error"))])
    return windows.sliding(made, "user_id", 86400, {"errors": ("x", "COUNT")})


@query("agg_source_scoped", f"WITH {EV}, p AS (SELECT user_id, bucket, sum(CASE WHEN source_system = 'payment' THEN amount END) AS s FROM ev GROUP BY 1, 2) SELECT user_id, bucket, CAST(sum(s) {_24H} AS DOUBLE) AS paid FROM p")
def source_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = windows.ring_buckets(events(spark, sf_dir), "user_id", "ts", [Measure("x", F.col("amount"), F.col("source_system") == "payment")])
    return windows.sliding(made, "user_id", 86400, {"paid": ("x", "SUM")}).select("user_id", "bucket", F.col("paid").cast("double").alias("paid"))


@query("empty_window_count_zero", f"WITH {EV}, u AS (SELECT DISTINCT user_id FROM ev), d AS (SELECT DISTINCT bucket - bucket % 86400 AS day FROM ev), c AS (SELECT user_id, bucket - bucket % 86400 AS day, count(*) AS n FROM ev WHERE event_type = 'signup' GROUP BY 1, 2) SELECT user_id, day, coalesce(n, 0) AS n FROM (SELECT * FROM u, d) LEFT JOIN c USING (user_id, day)")
def empty_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("day", bucket_of(F.col("ts"), 86400))
    days = rows.agg(F.array_sort(F.collect_set("day")).alias("days"))  # one row: a day for each calendar day
    universe = rows.select("user_id").distinct().join(F.broadcast(days)).select("user_id", F.explode("days").alias("day"))
    counted = rows.where("event_type = 'signup'").groupBy("user_id", "day").agg(F.count("*").alias("n"))
    return windows.with_empty(counted, universe, ["user_id", "day"], ["n"])


@query("last_value_per_entity", "SELECT user_id, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY 1")
def last_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.last_value(files.table(spark, sf_dir, "events"), "user_id", "value", ["ts", "event_id"])


@query("throughput_counters", "SELECT event_type, count(*) AS sent, CAST(min(event_id) AS BIGINT) AS first_id, CAST(max(event_id) AS BIGINT) AS last_id FROM events GROUP BY 1")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("sent"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("flagship_spend_alert", f"WITH {EV}, p AS (SELECT user_id, bucket, sum(amount) AS s FROM ev GROUP BY 1, 2), w AS (SELECT user_id, bucket, CAST(sum(s) {_24H} AS DOUBLE) AS spent FROM p) SELECT * FROM w WHERE spent >= 200.005")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = windows.sliding(_partials(spark, sf_dir), "user_id", 86400, {"spent": ("x", "SUM")})
    return made.select("user_id", "bucket", F.col("spent").cast("double").alias("spent")).where("spent >= 200.005")


# Validation: texts of all kinds are composed from the events, the same way in both dialects.

_ACTION = "CASE event_type WHEN 'click' THEN 'add_to_cart' WHEN 'view' THEN 'remove_from_cart' WHEN 'signup' THEN 'account_created' WHEN 'purchase' THEN 'payment_success' ELSE 'payment_failed' END"


def _texts(string: str) -> str:
    """SQL of the event text; ``string`` is the dialect's text type."""
    route = f"""concat('"source_system":"', {SOURCE}, '","event_type":"', {_ACTION}, '"')"""
    event_id = f"CAST(event_id AS {string})"
    body = f"""concat('"event_id":"', {event_id}, '",', {route}, ',"entity_id":"', CAST(user_id AS {string}), '","event_time":"2024-01-01T00:00:00Z"')"""
    partial = f"""concat('"event_id":null,', {route}, ',"entity_id":"', CAST(user_id AS {string}), '"')"""
    return f"""CASE event_id % 12
        WHEN 0 THEN '{{bad' WHEN 1 THEN concat('{{"event_type":"', {_ACTION}, '"}}') WHEN 2 THEN '[1,2]'
        WHEN 3 THEN '{{"source_system":"crm","event_type":"nope","fields":{{}}}}' WHEN 4 THEN concat('{{', {body}, '}}')
        WHEN 5 THEN concat('{{', {route}, ',"fields":{{', {partial}, '}}}}') WHEN 6 THEN concat('{{', {route}, ',"fields":null}}')
        WHEN 7 THEN '{{"source_system":null,"event_type":"login"}}'
        WHEN 8 THEN concat('{{', {route}, ',"unit_price":', CASE event_id % 5 WHEN 0 THEN '"N/A"' WHEN 1 THEN '-50.0' ELSE '12.5' END, ',"user_email":"', CASE event_id % 3 WHEN 0 THEN 'wrong' ELSE 'a@b.cd' END, '","satisfaction_score":', CAST(event_id % 7 AS {string}), ',"fields":{{', {body}, '}}}}')
        ELSE concat('{{ ', {route}, ', "fields": {{', {body}, '}}, "x": 1.10 }}') END"""


TX = f"tx AS (SELECT event_id, {_texts('VARCHAR')} AS value FROM events)"
_KEYS = ", ".join(f"('{k}')" for k, _ in catalog_rows())
_REQUIRED = ("event_id", "event_type", "entity_id", "source_system", "event_time")
_PART = "CASE WHEN json_type(value, '$.{0}') IN ('OBJECT', 'ARRAY') THEN '' ELSE coalesce(json_extract_string(value, '$.{0}'), 'null') END"
_OBJECT = "json_valid(value) AND json_type(CASE WHEN json_valid(value) THEN value ELSE 'null' END) = 'OBJECT'"

def _judged(place: str = "fields.", no_fields: str = "NOT json_exists(value, '$.fields')") -> str:
    """SQL of the verdicts: where required names are looked up, and when there is no such place."""
    return f"""{TX}, o AS (SELECT event_id, value, json_valid(value) AS parsed, {_OBJECT} AS object, CASE WHEN {_OBJECT} THEN value ELSE '{{}}' END AS v FROM tx),
    k AS (SELECT event_id, value AS raw, parsed, object, v AS value, CASE WHEN json_exists(v, '$.source_system') AND json_exists(v, '$.event_type') THEN concat({_PART.format('source_system').replace('value', 'v')}, '_', {_PART.format('event_type').replace('value', 'v')}) END AS route_key FROM o),
    cat(schema_id) AS (VALUES {_KEYS}),
    j AS (SELECT k.*, cat.schema_id, list_filter(['{"', '".join(_REQUIRED)}'], lambda n: coalesce(json_extract_string(value, concat('$.{place}', n)), '') = '') AS missing FROM k LEFT JOIN cat ON route_key = schema_id),
    r AS (SELECT event_id, raw, route_key, schema_id, missing, CASE WHEN NOT parsed THEN 'JSON Parse Exception: not a JSON value' WHEN NOT object THEN 'JSON Parse Exception: not a JSON object'
        WHEN route_key IS NULL THEN 'Missing source_system or action for schema mapping' WHEN schema_id IS NULL THEN concat('Schema not found for key: ', route_key)
        WHEN {no_fields} THEN 'Missing required fields: fields_object_missing'
        WHEN len(missing) > 0 THEN concat('Missing required fields: ', array_to_string(missing, ', ')) END AS error_reason FROM j)"""


JUDGED = _judged()


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.table(spark, sf_dir, "events").select("event_id", F.expr(_texts("STRING")).alias("value"))


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(catalog_rows(), "schema_id string, schema_payload string")


@query("route_key", f"WITH {JUDGED} SELECT event_id, route_key FROM k WHERE route_key IS NOT NULL")
def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.keyed(texts(spark, sf_dir)).where("route_key IS NOT NULL").select("event_id", "route_key")


@query("schema_lookup_left", f"WITH {JUDGED} SELECT event_id, route_key, schema_id FROM j WHERE route_key IS NOT NULL")
def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = validation.keyed(texts(spark, sf_dir)).where("route_key IS NOT NULL")
    return found.join(validation.broadcast_if_small(catalog(spark).select("schema_id")), F.col("route_key") == F.col("schema_id"), "left").select("event_id", "route_key", "schema_id")


@query("schema_semi", f"WITH {JUDGED} SELECT event_id FROM j WHERE schema_id IS NOT NULL")
def semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.with_schema(validation.keyed(texts(spark, sf_dir)), catalog(spark)).select("event_id")


@query("schema_anti", f"WITH {JUDGED} SELECT event_id FROM j WHERE schema_id IS NULL")
def anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.without_schema(validation.keyed(texts(spark, sf_dir)), catalog(spark)).select("event_id")


@query("required_fields", f"WITH {JUDGED} SELECT event_id, array_to_string(missing, ', ') AS missing FROM j WHERE schema_id IS NOT NULL")
def required(spark: SparkSession, sf_dir: str) -> DataFrame:
    schemas = validation.compiled_catalog(catalog(spark))
    found = validation.keyed(texts(spark, sf_dir)).join(validation.broadcast_if_small(schemas), F.col("route_key") == F.col("schema_id"))
    return found.select("event_id", F.array_join(validation.missing_fields(F.col("entries"), F.col("required"), "nested"), ", ").alias("missing"))


@query("dirty_reason", f"WITH {JUDGED} SELECT event_id, error_reason FROM r WHERE error_reason IS NOT NULL")
def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.split(validation.validate(texts(spark, sf_dir), catalog(spark)))[1].select("event_id", "error_reason")


@query("valid_events", f"WITH {JUDGED} SELECT event_id, raw AS output FROM r WHERE error_reason IS NULL")
def valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.split(validation.validate(texts(spark, sf_dir), catalog(spark)))[0].select("event_id", "output")


@query(
    "dirty_output",
    f"""WITH {JUDGED} SELECT event_id, CASE WHEN error_reason LIKE 'JSON Parse%' THEN concat('{{"original_payload":"', raw, '","error_reason":"', error_reason, '"}}')
    ELSE concat(left(raw, length(raw) - 1), ',"error_reason":"', error_reason, '"}}') END AS output FROM r WHERE error_reason IS NOT NULL""",
)
def dirty_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.split(validation.validate(texts(spark, sf_dir), catalog(spark)))[1].select("event_id", "output")


@query("valid_plus_dirty", f"WITH {JUDGED} SELECT CASE WHEN error_reason IS NULL THEN 'valid' ELSE 'dirty' END AS status, count(*) AS n FROM r GROUP BY 1")
def both(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = validation.split(validation.validate(texts(spark, sf_dir), catalog(spark)))
    return good.unionByName(bad).groupBy("status").agg(F.count("*").alias("n"))


@query("dirty_reason_flat", f"WITH {_judged('', 'FALSE')} SELECT event_id, coalesce(error_reason, 'valid') AS reason FROM r")
def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In the flat layout required names stand beside the routing keys."""
    return validation.validate(texts(spark, sf_dir), catalog(spark), layout="flat").select("event_id", F.coalesce("error_reason", F.lit("valid")).alias("reason"))


@query(
    "constraint_violations",
    f"""WITH {TX}, o AS (SELECT event_id, CASE WHEN {_OBJECT} THEN value ELSE '{{}}' END AS value FROM tx) SELECT event_id, array_to_string(list_filter([
        CASE WHEN NOT regexp_full_match(json_extract_string(value, '$.event_id'), '[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}') THEN 'event_id:format' END,
        CASE WHEN json_extract_string(value, '$.source_system') NOT IN ('ecommerce', 'crm', 'payment') THEN 'source_system:allowed_values' END,
        CASE WHEN json_extract_string(value, '$.user_email') = 'wrong' THEN 'user_email:format' END,
        CASE WHEN CAST(json_extract_string(value, '$.satisfaction_score') AS INT) < 1 THEN 'satisfaction_score:min' WHEN CAST(json_extract_string(value, '$.satisfaction_score') AS INT) > 5 THEN 'satisfaction_score:max' END,
        CASE WHEN json_type(value, '$.unit_price') = 'VARCHAR' THEN 'unit_price:type' WHEN CAST(json_extract_string(value, '$.unit_price') AS DOUBLE) < 0 THEN 'unit_price:min' END],
        lambda x: x IS NOT NULL), ',') AS violations FROM o""",
)
def constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 66 fields of every event, whatever its text is."""
    fields = dictionary()
    parsed = J.once(texts(spark, sf_dir), {"found": J.as_struct(F.col("value"), list(fields))})
    return parsed.select("event_id", F.array_join(violations([(f, F.col("found")[n]) for n, f in fields.items()]), ",").alias("violations"))


# Change data.


@query("cdc_latest_per_key", "SELECT user_id, arg_max(event_type, event_id) AS event_type, CAST(max(event_id) AS BIGINT) AS event_id FROM events GROUP BY 1")
def compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.latest_per_key(files.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id"], ["event_id"])


_TOPIC = "concat('core.', CASE WHEN event_id % 2 = 0 THEN 'public' ELSE 'other' END, '.', CASE event_id % 3 WHEN 0 THEN 'schema_definitions' WHEN 1 THEN 'rule_definitions' ELSE 'schema_definitions.old' END)"


@query("cdc_route", f"SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'schema_registry' ELSE {_TOPIC} END AS topic FROM events")
def route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.table(spark, sf_dir, "events").select("event_id", route_topic(F.expr(_TOPIC)).alias("topic"))


@query(
    "cdc_flatten",
    "SELECT event_id AS offset_id, CASE WHEN event_id % 7 <> 6 THEN user_id ELSE -1 END AS user_id, CASE WHEN event_id % 7 <> 6 THEN value END AS value, CASE WHEN event_id % 7 <> 6 THEN CASE WHEN event_id % 7 = 5 THEN 'd' WHEN event_id % 7 = 0 THEN 'c' ELSE 'u' END END AS __op, CASE WHEN event_id % 7 <> 6 THEN 'rule_definitions' END AS __table, CASE WHEN event_id % 7 <> 6 THEN event_id % 7 = 5 END AS __deleted FROM events",
)
def flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = F.struct("user_id", "value")
    kind = F.col("event_id") % 7
    op = F.when(kind == 5, F.lit("d")).when(kind == 0, F.lit("c")).otherwise(F.lit("u"))
    changes = files.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("offset_id"),
        F.when(kind != 6, op).alias("op"),
        F.when(kind != 6, F.lit("rule_definitions")).alias("table"),
        F.when(kind.isin(1, 2, 3, 4, 5), image).alias("before"),
        F.when(kind.isin(0, 1, 2, 3, 4), image).alias("after"),
    )
    return cdc.flattened(changes).fillna(-1, ["user_id"])  # tombstones stay


@query("cdc_live_rows", "SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'error'")
def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows left when the changes are applied in order and an error stands for a delete."""
    last = cdc.latest_per_key(files.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id"], ["event_id"])
    return last.where("event_type <> 'error'").select("user_id", "event_type")


_MESSAGE = """CASE event_id % 5 WHEN 0 THEN concat('{{"schema_id":"s', CAST(user_id AS {0}), '","schema_payload":"{{}}"}}') WHEN 1 THEN concat('{{"source_name":"s', CAST(user_id % 9 AS {0}), '","action":"a","fields":{{}}}}')
    WHEN 2 THEN '{{"source_name":"crm","fields":{{}}}}' WHEN 3 THEN '{{"name":"unified_dictionary","fields":{{}}}}' ELSE 'not json' END"""


@query("cdc_dual_format", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN concat('s', CAST(user_id AS VARCHAR)) WHEN 1 THEN concat('s', CAST(user_id % 9 AS VARCHAR), '_a') WHEN 2 THEN 'crm_unknown' ELSE 'unified_schema' END AS schema_id FROM events WHERE event_id % 5 < 4")
def dual(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = files.table(spark, sf_dir, "events").select("event_id", F.expr(_MESSAGE.format("STRING")).alias("value"))
    return cdc.schema_messages(messages).select("event_id", "schema_id")


_LOGGED = """CASE WHEN event_id % 5 = 0 THEN concat('{{"schema_id":"s', CAST(user_id AS {0}), '","schema_payload":"', CAST(event_id AS {0}), '","__deleted":"', CASE WHEN event_id % 3 = 0 THEN 'true' ELSE 'false' END, '"}}')
    WHEN event_id % 5 = 1 THEN concat('{{"source_name":"s', CAST(user_id % 9 AS {0}), '","action":"a","fields":{{}},"n":', CAST(event_id AS {0}), '}}') ELSE 'not json' END"""
_CATALOG = f"""WITH m AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN concat('s', CAST(user_id AS VARCHAR)) ELSE concat('s', CAST(user_id % 9 AS VARCHAR), '_a') END AS schema_id,
    CASE WHEN event_id % 5 = 0 THEN CAST(event_id AS VARCHAR) ELSE {_LOGGED.format('VARCHAR')} END AS schema_payload, event_id % 15 = 0 AS gone FROM events WHERE event_id % 5 < 2),
    l AS (SELECT *, row_number() OVER (PARTITION BY schema_id ORDER BY event_id DESC) AS n FROM m) SELECT schema_id, schema_payload FROM l WHERE n = 1"""


def _catalog_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.table(spark, sf_dir, "events").select("event_id", F.expr(_LOGGED.format("STRING")).alias("value"))


@query("schema_catalog", _CATALOG)
def schema_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletes leave a schema active."""
    return cdc.catalog_from(_catalog_log(spark, sf_dir), ["event_id"])


@query("schema_catalog_deletes", f"{_CATALOG} AND NOT gone")
def schema_catalog_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.catalog_from(_catalog_log(spark, sf_dir), ["event_id"], honor_deletes=True)


_DOCUMENT = """CASE event_id % 4 WHEN 0 THEN concat('{{"source_name":"s', CAST(user_id AS {0}), '","action":"a"}}') WHEN 1 THEN concat('{{"source_name":"s', CAST(user_id AS {0}), '"}}')
    WHEN 2 THEN '{{"name":"unified_dictionary","source_name":"x"}}' ELSE '{{"action":"b"}}' END"""


@query("publisher_key", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN concat('s', CAST(user_id AS VARCHAR), '_a') WHEN 1 THEN concat('s', CAST(user_id AS VARCHAR), '_schema') WHEN 2 THEN 'unified_schema' ELSE 'unknown_b' END AS schema_id FROM events")
def publisher_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = files.table(spark, sf_dir, "events").select("event_id", F.expr(_DOCUMENT.format("STRING")).alias("value"))
    return J.once(documents, {"entries": J.as_map(F.col("value"))}).select("event_id", cdc.publisher_key(F.col("entries")).alias("schema_id"))


_DESCRIBED = """CASE event_id % 3 WHEN 0 THEN concat('{{"source_name": "s', CAST(user_id AS {0}), '", "action": "a", "fields": {{"x": {{"description": "d", "type": "string"}}, "y": {{"deep": {{"description": "kept"}}}}}}}}')
    WHEN 1 THEN concat('{{"source_name": "s', CAST(user_id AS {0}), '", "fields": {{"description": "kept", "x": {{"description": null}}}}}}') ELSE '[1' END"""


@query(
    "published_documents",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN concat('s', CAST(user_id AS VARCHAR), '_a') WHEN 1 THEN concat('s', CAST(user_id AS VARCHAR), '_schema') END AS schema_id,
    CASE event_id % 3 WHEN 0 THEN concat('{"source_name":"s', CAST(user_id AS VARCHAR), '","action":"a","fields":{"x":{"type":"string"},"y":{"deep":{"description":"kept"}}}}')
    WHEN 1 THEN concat('{"source_name":"s', CAST(user_id AS VARCHAR), '","fields":{"description":"kept","x":{}}}') END AS schema_payload, event_id % 3 = 2 AS failed FROM events""",
)
def published_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions go from the direct children of fields only; a text that is no document has an error."""
    documents = files.table(spark, sf_dir, "events").select(F.col("event_id").alias("path"), F.expr(_DESCRIBED.format("STRING")).alias("value"))
    return files.published_documents(documents).select(F.col("path").cast("long").alias("event_id"), "schema_id", "schema_payload", F.col("error").isNotNull().alias("failed"))


_ENVELOPE = """CASE WHEN event_id % 7 < 6 THEN concat('{{"before":', CASE WHEN event_id % 7 = 0 THEN 'null' ELSE concat('{{"user_id":', CAST(user_id AS {0}), ',"kind":"old"}}') END,
    ',"after":', CASE WHEN event_id % 7 = 5 THEN 'null' ELSE concat('{{"user_id":', CAST(user_id AS {0}), ',"kind":"', event_type, '"}}') END, ',"op":"', CASE WHEN event_id % 7 = 5 THEN 'd' WHEN event_id % 7 = 0 THEN 'c' ELSE 'u' END, '","source":{{"table":"t"}}}}') END"""


@query("cdc_envelope", "SELECT event_id, CASE WHEN event_id % 7 < 6 THEN user_id END AS user_id, CASE WHEN event_id % 7 = 5 THEN 'old' WHEN event_id % 7 < 5 THEN event_type END AS kind, CASE WHEN event_id % 7 < 6 THEN event_id % 7 = 5 END AS __deleted FROM events")
def envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change messages as JSON text, flattened."""
    log = files.table(spark, sf_dir, "events").select("event_id", F.expr(_ENVELOPE.format("STRING")).alias("value"))
    return cdc.flattened(cdc.envelopes(log, "user_id bigint, kind string")).select("event_id", "user_id", "kind", "__deleted")


@query("schema_upsert", "SELECT n_nationkey AS key, CASE WHEN n_nationkey % 3 = 0 THEN 'new' ELSE n_name END AS payload FROM nation UNION ALL SELECT 100 + r_regionkey, 'new' FROM region")
def schema_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = files.table(spark, sf_dir, "nation"), files.table(spark, sf_dir, "region")
    old = nation.select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("payload"), F.lit(0).alias("at"))
    stale = nation.where("n_nationkey % 3 = 0").select(F.col("n_nationkey").cast("long").alias("key"), F.lit("stale").alias("payload"), F.lit(1).alias("at"))
    fresh = stale.withColumns({"payload": F.lit("new"), "at": F.lit(2)}).unionByName(region.select((F.col("r_regionkey") + 100).cast("long").alias("key"), F.lit("new").alias("payload"), F.lit(1).alias("at")))
    return cdc.upsert(old, stale.unionByName(fresh), ["key"], "at").select("key", "payload")


_VERSIONS = "SELECT event_type, event_id AS arrived, concat('v', CAST(event_id AS {})) AS version FROM events WHERE value > 150"


@query("schema_asof_join", f"WITH v AS ({_VERSIONS.format('VARCHAR')}) SELECT e.event_id, v.version FROM events e ASOF LEFT JOIN v ON e.event_type = v.event_type AND e.event_id >= v.arrived")
def as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files.table(spark, sf_dir, "events")
    versions = rows.where("value > 150").select("event_type", F.col("event_id").alias("arrived"), F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("version"))
    return cdc.as_of(rows, versions, "event_type", F.col("event_id"), F.col("arrived"), ["version"]).select("event_id", "version")


_MANY = "SELECT event_type, event_id AS arrived, concat('v', CAST(event_id AS {})) AS version FROM events WHERE value > 60"


@query("schema_asof_join_many", f"WITH v AS ({_MANY.format('VARCHAR')}) SELECT e.event_id, v.version FROM events e ASOF LEFT JOIN v ON e.event_type = v.event_type AND e.event_id >= v.arrived")
def as_of_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With more versions than are broadcast: one ordered sequence of each key, in parts."""
    rows = files.table(spark, sf_dir, "events")
    versions = rows.where("value > 60").select("event_type", F.col("event_id").alias("arrived"), F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("version"))
    return cdc.as_of(rows.select("event_id", "event_type"), versions, "event_type", F.col("event_id"), F.col("arrived"), ["version"], lambda at: F.floor(at / 4096)).select("event_id", "version")


@query(
    "valid_by_arrival",
    f"""WITH {_judged()}, c AS (SELECT schema_id, row_number() OVER (ORDER BY schema_id) * 100 AS came FROM cat)
    SELECT r.event_id, CASE WHEN r.schema_id IS NOT NULL AND r.event_id < c.came THEN concat('Schema not found for key: ', route_key) ELSE error_reason END AS reason FROM r LEFT JOIN c ON r.schema_id = c.schema_id""",
)
def by_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each schema comes at an offset of its own, and an event sees those that came before it."""
    made = [(name, text, 100 * i) for i, (name, text) in enumerate(sorted(catalog_rows()), 1)]
    versions = spark.createDataFrame(made, "schema_id string, schema_payload string, event_id long")
    return validation.validate(texts(spark, sf_dir), versions, order="event_id").select("event_id", F.col("error_reason").alias("reason"))


# Rules.

_FIELDS = f"""event_id, user_id AS entity_id, ts AS event_time, value AS total_amount, {SOURCE} AS source_system,
    CASE WHEN event_type = 'view' THEN 'completed' ELSE 'created' END AS order_status, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS transaction_status,
    event_id % 4 = 0 AS is_3ds_verified, event_id % 6 = 0 AS billing_zip_match, event_id % 5 + 1 AS satisfaction_score, event_id AS order_id"""
RE = f"re AS (SELECT {_FIELDS}, CAST(floor(epoch(ts)) AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) % 300 AS bucket FROM events)"


def rule_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.table(spark, sf_dir, "events").selectExpr(
        "event_id", "user_id AS entity_id", "ts AS event_time", "value AS total_amount", f"{SOURCE} AS source_system",
        "CASE WHEN event_type = 'view' THEN 'completed' ELSE 'created' END AS order_status", "CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS transaction_status",
        "event_id % 4 = 0 AS is_3ds_verified", "event_id % 6 = 0 AS billing_zip_match", "event_id % 5 + 1 AS satisfaction_score", "event_id AS order_id",
    )


_COMPLETED = {"field": "order_status", "operator": "EQ", "value": "completed"}
_FAILED = {"field": "transaction_status", "operator": "EQ", "value": "failed"}
# The example rules with thresholds of the driver's numbers; sums cannot equal them.
RULES = {
    "high_value": Rule("r1", "high_value", every(aggregate("total_amount", "SUM", 86400, "GTE", 150.005, "ecommerce"), aggregate("order_status", "COUNT", 86400, "GTE", 2, "ecommerce", _COMPLETED)), priority=5),
    "fraud_alert": Rule("r2", "fraud_alert", some(aggregate("transaction_status", "COUNT", 3600, "GT", 1, "payment", _FAILED), every(raw("is_3ds_verified", "EQ", False), raw("billing_zip_match", "EQ", False), raw("total_amount", "GT", 90))), priority=9),
    "inactive": Rule("r3", "inactive", every(aggregate("event_id", "COUNT", 43200, "EQ", 0, "ecommerce", slide=43200), aggregate("satisfaction_score", "MIN", 86400, "LT", 2, "crm")), priority=5),
    "frequent_buyer": Rule("r4", "frequent_buyer", every(aggregate("order_id", "COUNT", 21600, "GTE", 2, "ecommerce", _COMPLETED), aggregate("total_amount", "AVG", 21600, "GTE", 40.00001, "ecommerce")), priority=7),
}


def _within(size: int) -> str:
    return f"f.entity_id = e.entity_id AND f.bucket BETWEEN e.bucket - {size - 300} AND e.bucket"


def _correlated(what: str, size: int, where: str) -> str:
    return f"(SELECT {what} FROM re f WHERE {_within(size)} AND {where})"


_ECOM = "f.source_system = 'ecommerce'"
# Plain forms: each aggregate is a subquery over the events themselves.
_RULE_SQL = {
    "high_value": f"{_correlated('coalesce(sum(f.total_amount), 0)', 86400, _ECOM)} >= 150.005 AND {_correlated('count(*)', 86400, _ECOM + ' AND f.order_status = ' + chr(39) + 'completed' + chr(39))} >= 2",
    "fraud_alert": f"{_correlated('count(*)', 3600, 'f.source_system = ' + chr(39) + 'payment' + chr(39) + ' AND f.transaction_status = ' + chr(39) + 'failed' + chr(39))} > 1 OR (NOT e.is_3ds_verified AND NOT e.billing_zip_match AND e.total_amount > 90)",
    "inactive": f"(SELECT count(*) FROM re f WHERE f.entity_id = e.entity_id AND f.bucket // 43200 = e.bucket // 43200 AND {_ECOM}) = 0 AND coalesce({_correlated('min(f.satisfaction_score)', 86400, 'f.source_system = ' + chr(39) + 'crm' + chr(39))}, 9) < 2",
    "frequent_buyer": f"{_correlated('count(*)', 21600, _ECOM + ' AND f.order_status = ' + chr(39) + 'completed' + chr(39))} >= 2 AND coalesce({_correlated('avg(f.total_amount)', 21600, _ECOM)}, 0) >= 40.00001",
}


def _rule_query(name: str) -> None:
    @query(f"rule_{name}", f"WITH {RE} SELECT event_id, entity_id FROM re e WHERE {_RULE_SQL[name]}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rules.matches(rule_events(spark, sf_dir), [RULES[name]]).select("event_id", "entity_id")


for _name in RULES:
    _rule_query(_name)

_VERSIONED = "SELECT event_id AS id, concat('r', CAST(user_id AS {0})) AS rule_id, event_id % 9 AS version, event_id % 4 <> 0 AS enabled FROM events"


@query("rule_latest_version", f"WITH d AS ({_VERSIONED.format('VARCHAR')}) SELECT rule_id, version, id FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY version DESC, id DESC) AS n FROM d) WHERE n = 1 AND enabled")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files.table(spark, sf_dir, "events").selectExpr("event_id AS id", "concat('r', CAST(user_id AS STRING)) AS rule_id", "event_id % 9 AS version", "event_id % 4 <> 0 AS enabled")
    return rules.active_versions(rows).select("rule_id", "version", "id")


def _hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.table(spark, sf_dir, "events").where("value > 50").selectExpr("'r1' AS rule_id", "user_id AS entity_id", "ts AS event_time", "event_id", "259200L AS cooldown_seconds")


@query(
    "rule_cooldown",
    """WITH RECURSIVE m AS (SELECT user_id, epoch_us(ts) AS us, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE value > 50),
    f AS (SELECT user_id, us, event_id, n FROM m WHERE n = 1 UNION ALL SELECT x.user_id, x.us, x.event_id, x.n FROM (SELECT m.*, row_number() OVER (PARTITION BY m.user_id ORDER BY m.n) AS k FROM f JOIN m ON m.user_id = f.user_id AND m.us >= f.us + 259200000000) x WHERE k = 1)
    SELECT user_id AS entity_id, event_id FROM f""",
)
def cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.fired(_hot(spark, sf_dir)).select("entity_id", "event_id")


@query(
    "rule_priority_winner",
    f"""WITH {RE}, m AS (SELECT event_id, entity_id, 'r1' AS rule_id, 5 AS priority FROM re e WHERE {_RULE_SQL['high_value']} UNION ALL SELECT event_id, entity_id, 'r2', 9 FROM re e WHERE {_RULE_SQL['fraud_alert']}
    UNION ALL SELECT event_id, entity_id, 'r3', 5 FROM re e WHERE {_RULE_SQL['inactive']} UNION ALL SELECT event_id, entity_id, 'r4', 7 FROM re e WHERE {_RULE_SQL['frequent_buyer']})
    SELECT event_id, entity_id, rule_id FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, event_id ORDER BY priority DESC, rule_id) AS n FROM m) WHERE n = 1""",
)
def priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.winners(rules.matches(rule_events(spark, sf_dir), list(RULES.values()))).select("event_id", "entity_id", "rule_id")


_TREES = [
    Rule("t1", "t1", every(raw("event_type", "EQ", "purchase"), some(raw("value", "GT", 80), raw("user_id", "LT", 10)))),
    Rule("t2", "t2", none(some(raw("event_type", "IN", ["click", "view"]), raw("value", "BETWEEN", [10, 60])))),
    Rule("t3", "t3", every(none(raw("event_type", "NEQ", "signup")), raw("props", "CONTAINS", '"k": 1'))),
    Rule("t4", "t4", raw("value", "LTE", 5)),
]


@query(
    "rule_tree_nodetable",
    """SELECT event_id, 't1' AS rule_id FROM events WHERE event_type = 'purchase' AND (value > 80 OR user_id < 10) UNION ALL SELECT event_id, 't2' FROM events WHERE NOT (event_type IN ('click', 'view') OR value BETWEEN 10 AND 60)
    UNION ALL SELECT event_id, 't3' FROM events WHERE event_type = 'signup' AND contains(props, '"k": 1') UNION ALL SELECT event_id, 't4' FROM events WHERE value <= 5""",
)
def node_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {f"field:{c}": c for c in ("event_type", "value", "user_id", "props")}
    return rules.evaluate_nodes(rules.facts_of(files.table(spark, sf_dir, "events"), ["event_id"], columns), ["event_id"], _TREES)


@query("rank_top_events", "SELECT user_id, event_id, n AS place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events) WHERE n <= 3")
def top_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return files.table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(place).alias("place")).where("place <= 3")


@query("distinct_in_list", "SELECT DISTINCT user_id % 7 AS bin, event_type FROM events")
def distinct_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("bin"), "event_type").distinct()



_ALL_RULES = f"""SELECT event_id, 'r1' AS rule_id FROM re e WHERE {_RULE_SQL['high_value']} UNION ALL SELECT event_id, 'r2' FROM re e WHERE {_RULE_SQL['fraud_alert']}
    UNION ALL SELECT event_id, 'r3' FROM re e WHERE {_RULE_SQL['inactive']} UNION ALL SELECT event_id, 'r4' FROM re e WHERE {_RULE_SQL['frequent_buyer']}"""


@query("rule_nodetable_aggregates", f"WITH {RE} {_ALL_RULES}")
def node_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The example rules as rows: aggregates and raw fields are facts of each event."""
    made = list(RULES.values())
    return rules.evaluate_nodes(rules.rule_facts(rule_events(spark, sf_dir), made, ["event_id"]), ["event_id"], made)


_COMPARED = {
    "lte": (aggregate("total_amount", "MAX", 3600, "LTE", 50), f"{_correlated('max(f.total_amount)', 3600, 'TRUE')} <= 50"),
    "neq": (aggregate("event_id", "COUNT", 86400, "NEQ", 1), f"{_correlated('count(*)', 86400, 'TRUE')} <> 1"),
    "lt": (none(aggregate("total_amount", "MIN", 21600, "LT", 10)), f"NOT {_correlated('min(f.total_amount)', 21600, 'TRUE')} < 10"),
    "gt": (aggregate("total_amount", "AVG", 86400, "GT", 60.00001, "payment"), f"coalesce({_correlated('avg(f.total_amount)', 86400, 'f.source_system = ' + chr(39) + 'payment' + chr(39))}, 0) > 60.00001"),
}


@query("rule_comparisons", f"WITH {RE} " + " UNION ALL ".join(f"SELECT event_id, '{name}' AS rule_id FROM re e WHERE {sql}" for name, (_, sql) in _COMPARED.items()))
def comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every comparison of an aggregate that the example rules do not have."""
    return rules.matches(rule_events(spark, sf_dir), [Rule(name, name, tree) for name, (tree, _) in _COMPARED.items()]).select("event_id", "rule_id")
