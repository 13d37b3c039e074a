import json
import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidewarden.functions.scalars import route_topic, stable_uuid, total_amount
from tidewarden.model.fields import FORMATS, dictionary
from tidewarden.functions.constraints import violations
from tidewarden.operators import cdc, validation
from tidewarden.model.schemas import catalog_rows
from tidewarden.sources import files, jdbc, kafka, synthetic


def test_schema_messages_and_catalog(spark):
    texts = [
        '{"schema_id":"a","schema_payload":"{}","__deleted":"false"}',
        '{"schema_id":"a","schema_payload":"{\\"fields\\":{}}"}',
        '{"schema_id":"o","schema_payload":{"fields":{}}}',
        '{"source_name":"crm","fields":{}}',
        '{"name":"unified_dictionary"}',
        "{bad",
        None,
        "[1]",
        '{"schema_id":"d","schema_payload":"{}"}',
        '{"schema_id":"d","schema_payload":"{}","__deleted":"true"}',
    ]
    log = spark.createDataFrame(list(enumerate(texts)), "offset long, value string")
    want = {"a": '{"fields":{}}', "o": "", "crm_unknown": texts[3], "unified_schema": texts[4], "d": "{}"}
    assert {r.schema_id: r.schema_payload for r in cdc.catalog_from(log, ["offset"]).collect()} == want
    del want["d"]
    assert {r.schema_id: r.schema_payload for r in cdc.catalog_from(log, ["offset"], honor_deletes=True).collect()} == want


def test_flatten_route_and_tombstones(spark):
    image = "struct<id:long,name:string>"
    rows = [(1, "c", "t", None, (1, "a")), (2, "u", "t", (1, "a"), (1, "b")), (3, "d", "t", (1, "b"), None), (4, None, None, None, None)]
    out = cdc.flattened(spark.createDataFrame(rows, f"n int, op string, table string, before {image}, after {image}")).orderBy("n").collect()
    assert [(r.id, r.name, r["__op"], r["__deleted"]) for r in out] == [(1, "a", "c", False), (1, "b", "u", False), (1, "b", "d", True), (None, None, None, None)]
    topics = spark.createDataFrame([("core.public.schema_definitions",), ("core.public.rule_definitions",), ("a.b.c.schema_definitions",), ("x.core.schema_definitions.y",)], "topic string")
    assert [r[0] for r in topics.select(route_topic(F.col("topic"))).collect()] == ["schema_registry", "core.public.rule_definitions", "a.b.c.schema_definitions", "x.core.schema_definitions.y"]
    messages = spark.createDataFrame([("x",), (None,)], "value string")
    assert cdc.without_tombstones(messages).count() == 1


@pytest.mark.parametrize("width", [1, 4, 1000])
@pytest.mark.parametrize("few", [0, 1000])
def test_as_of_by_brute_force(spark, monkeypatch, few, width):
    monkeypatch.setattr(cdc, "FEW_VERSIONS", few)
    r = random.Random(width)
    rows = [(r.choice(["a", "b", "c", None]), r.randrange(60), i) for i in range(150)]
    made = [("a", at, f"v{at}") for at in range(0, 60, 3)] + [("b", at, None if at == 40 else f"w{at}") for at in (20, 40, 50)] + [(None, 1, "n")]
    versions = spark.createDataFrame(made, "k string, came int, v string")
    out = cdc.as_of(spark.createDataFrame(rows, "k string, at int, v_id int"), versions, "k", F.col("at"), F.col("came"), ["v", "came"], lambda order: F.floor(order / width))
    assert out.columns == ["k", "at", "v_id", "v", "came"]
    want = set()
    for k, at, i in rows:
        last = max(((c, v) for x, c, v in made if x == k and k is not None and c <= at), key=lambda x: x[0], default=(None, None))
        want.add((k, at, i, last[1], last[0]))
    assert {tuple(x) for x in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert few or not any(x in plan for x in ("NestedLoop", "Cartesian"))


def test_change_envelopes(spark):
    image = "id bigint, name string"
    texts = [
        '{"before":null,"after":{"id":1,"name":"a"},"op":"c","ts_ms":5,"source":{"table":"t","lsn":9}}',
        '{"schema":{},"payload":{"before":{"id":1,"name":"a"},"after":{"id":1,"name":"b"},"op":"u","source":{"table":"t"}}}',
        '{"payload":{"before":{"id":1,"name":"b"},"after":null,"op":"d","source":{"table":"t"}}}',
        None,
        "{bad",
    ]
    log = spark.createDataFrame(list(enumerate(texts)), "offset int, value string")
    out = cdc.flattened(cdc.envelopes(log, image).drop("ts_ms")).orderBy("offset").collect()
    assert [(r.id, r.name, r["__op"], r["__table"], r["__deleted"]) for r in out] == [(1, "a", "c", "t", False), (1, "b", "u", "t", False), (1, "b", "d", "t", True), (None,) * 5, (None,) * 5]


def test_as_of(spark):
    events = spark.createDataFrame([("a", 0), ("a", 5), ("a", 9), ("b", 1), (None, 3)], "k string, at int")
    versions = spark.createDataFrame([("a", 5, "v1"), ("a", 8, "v2"), ("c", 0, "v3")], "k string, came int, v string")
    out = cdc.as_of(events, versions, "k", F.col("at"), F.col("came"), ["v"])
    assert {(r.k, r.at, r.v) for r in out.collect()} == {("a", 0, None), ("a", 5, "v1"), ("a", 9, "v2"), ("b", 1, None), (None, 3, None)}


def test_upsert(spark):
    old = spark.createDataFrame([("a", "1", 9), ("b", "1", 9)], "schema_id string, p string, at int")
    new = spark.createDataFrame([("b", "2", 1), ("b", "3", 2), ("c", "4", 0)], "schema_id string, p string, at int")
    assert {(r.schema_id, r.p) for r in cdc.upsert(old, new, ["schema_id"], "at").collect()} == {("a", "1"), ("b", "3"), ("c", "4")}


def test_tail(spark):
    rows = spark.createDataFrame([(p, o) for p in range(3) for o in range(p * 2)], "partition int, offset int")
    assert {(r.partition, r.offset) for r in files.tail(rows, 3).collect()} == {(1, 0), (1, 1), (2, 1), (2, 2), (2, 3)}
    assert [(r.partition, r.offset) for r in files.tail_total(rows, 3).collect()] == [(1, 0), (1, 1), (2, 1)]


def test_synthetic_events(spark):
    made = synthetic.events(spark, n=4000, entities=1000, dirty=0.4, late=0.5).collect()
    assert made == synthetic.events(spark.newSession(), n=4000, entities=1000, dirty=0.4, late=0.5).collect()
    rows = [json.loads(r.value) for r in made]
    assert all(r.key == x["entity_id"] for r, x in zip(made, rows, strict=True))
    hot = sum(int(x["entity_id"][1:]) < 10 for x in rows) / len(rows)
    assert 0.45 < hot < 0.56
    seen = {(x["source_system"], x["event_type"]) for x in rows}
    assert len(seen) == 20
    fields = dictionary()
    known = {n for x in rows for n in x}
    assert known <= set(fields)
    odd = sum("event_time" not in x or x.get("unit_price") == "unpriced" or any(x.get(n, 0) == -1 for n in ("unit_price", "loyalty_points", "shipping_cost")) or x.get("user_email") == "no address" for x in rows) / len(rows)
    assert 0.1 < odd < 0.4
    for x in rows:
        for name, value in x.items():
            assert not fields[name].allowed or value in fields[name].allowed or name == "source_system"
    assert {x["transaction_status"] for x in rows if x["event_type"] == "payment_failed"} == {"failed"}


def test_synthetic_events_validate(spark):
    catalog = spark.createDataFrame(catalog_rows(), "schema_id string, schema_payload string")
    for layout, other in (("nested", "flat"), ("flat", "nested")):
        out = validation.validate(synthetic.events(spark, n=500, dirty=0.0, layout=layout), catalog, layout)
        assert out.where("status = 'dirty'").count() == 0
        assert validation.validate(synthetic.events(spark, n=50, layout="flat"), catalog, "nested").where("status = 'valid'").count() == 0


def test_constraints(spark):
    fields = dictionary()
    names = ["unit_price", "satisfaction_score", "user_email", "event_time", "order_status", "opt_in_email", "event_id"]
    rows = [("1.5", "3", "a@b.c", "2024-01-01T00:00:00Z", "paid", "true", "0" * 8 + "-0000-0000-0000-" + "0" * 12), ("N/A", "2.5", "x", "2024-13-01T00:00:00Z", "lost", "yes", "1"), ("-1", "9", None, None, None, None, None)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    out = [r[0] for r in df.select(violations([(fields[n], F.col(n)) for n in names])).collect()]
    assert out == [[], ["unit_price:type", "satisfaction_score:type", "user_email:format", "event_time:format", "order_status:allowed_values", "opt_in_email:type", "event_id:format"], ["unit_price:min", "satisfaction_score:max"]]
    assert "UUID" in FORMATS


def test_scalars_and_options(spark):
    row = spark.range(1).select(stable_uuid(F.lit("a")).alias("u"), total_amount(F.lit("N/A"), F.lit(2)).alias("t"), total_amount(F.lit("1.5"), F.lit(2)).alias("s")).first()
    assert len(row.u.split("-")) == 5 and (row.t, row.s) == (200.0, 3.0)
    assert kafka.source_options("h", "t")["startingOffsets"] == "earliest" and kafka.source_options("h", "t")["failOnDataLoss"] == "true"
    rows = spark.createDataFrame([(1, "x", 0)], "id int, output string, rest int")
    assert [tuple(r) for r in kafka.keyed_records(rows, "id", "output").collect()] == [("1", "x")]
    with pytest.raises(AnalysisException, match="kafka"):  # the connector is not part of the install
        kafka.write(rows, "h", "t", "id", "output")
    assert kafka.sink_options("h", "t")["kafka.compression.type"] == "lz4"
    assert jdbc.options("u", "t", "a", "b")["batchsize"] == "5000"


def test_upsert_through_a_connection(spark, tmp_path):
    path = str(tmp_path / "db.sqlite")

    def connect():
        import sqlite3

        db = sqlite3.connect(path, timeout=60)
        db.create_function("now", 0, lambda: "later")
        return db

    with connect() as db:
        db.execute("CREATE TABLE schema_definitions (schema_id TEXT PRIMARY KEY, schema_payload TEXT, updated_at TEXT)")
        db.execute("INSERT INTO schema_definitions VALUES ('a', '1', 'before'), ('b', '2', 'before')")
    rows = spark.createDataFrame([("b", "3"), ("c", "4")], "schema_id string, schema_payload string")
    for _ in range(2):
        jdbc.write_upsert(rows.coalesce(1), "schema_definitions", ["schema_id"], connect, touch="updated_at", mark="?")
    with connect() as db:
        assert db.execute("SELECT * FROM schema_definitions ORDER BY 1").fetchall() == [("a", "1", "before"), ("b", "3", "later"), ("c", "4", "later")]
    with pytest.raises(ValueError):
        jdbc.upsert_statement("t", rows.schema, ["x"])
