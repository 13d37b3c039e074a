"""Streams give what batches give."""

import json

from pyspark.sql import functions as F

from tidewarden.model.schemas import catalog_rows
from tidewarden.operators import validation, windows
from tidewarden.operators.windows import Measure
from tidewarden.sources import files, synthetic
from tidewarden.streaming.validation import validate_stream
from tidewarden.streaming.windows import ring_rule, windowed


def test_validation_stream_equals_batch(spark, tmp_path):
    texts = synthetic.events(spark, n=300, dirty=0.9, layout="nested").select("value")
    texts.unionByName(spark.createDataFrame([("{bad",), ("[1]",)], "value string")).repartition(3).write.text(str(tmp_path / "in"))
    catalog = spark.createDataFrame(catalog_rows()[:12], "schema_id string, schema_payload string")
    paths = [str(tmp_path / x) for x in ("valid", "dirty", "checkpoint")]
    query = validate_stream(files.event_stream(spark, str(tmp_path / "in"), 1), lambda: catalog, *paths, interval=None)
    query.awaitTermination(120)
    assert query.exception() is None
    batch = validation.validate(files.event_log(spark, str(tmp_path / "in")), catalog)
    for status, path in zip(("valid", "dirty"), paths, strict=False):
        want = sorted((r.value, r.error_reason or "") for r in batch.where(F.col("status") == status).collect())
        assert want and sorted((r.value, r.error_reason or "") for r in spark.read.parquet(path).collect()) == want


def test_validation_by_arrival_does_not_depend_on_batches(spark, tmp_path):
    rows = [(at, f'{{"source_system":"crm","event_type":"login","fields":{{"b":{at}}}}}') for at in range(9)]
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps({"offset": at, "value": text}) for at, text in rows[3 * k : 3 * k + 3]))
    versions = spark.createDataFrame([("crm_login", '{"fields":{"a":{"required":true}}}', 1), ("crm_login", '{"fields":{"b":{"required":true}}}', 5)], "schema_id string, schema_payload string, offset long")
    stream = spark.readStream.schema("offset long, value string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    paths = [str(tmp_path / x) for x in ("valid", "dirty", "checkpoint")]
    query = validate_stream(stream, lambda: versions, *paths, order="offset", interval=None)
    query.awaitTermination(120)
    assert query.exception() is None
    assert sorted(r.offset for r in spark.read.parquet(paths[0]).collect()) == [5, 6, 7, 8]
    assert sorted((r.offset, r.error_reason[:6]) for r in spark.read.parquet(paths[1]).collect()) == [(0, "Schema"), (1, "Missin"), (2, "Missin"), (3, "Missin"), (4, "Missin")]


def test_windowed_stream_equals_batch(spark, tmp_path):
    rows = [(i % 3, f"2024-01-01 0{i % 5}:{i % 60:02d}:00", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "user_id long, ts string, value double").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = windowed(stream, "user_id", "ts", "value", 3600).writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.user_id, r.window_start): (r["sum"], r["count"], r["max"]) for r in spark.table("windowed").collect()}
    partials = windows.ring_buckets(df, "user_id", "ts", [Measure("x", F.col("value"))])
    batch = windows.tumbling(partials, "user_id", 3600, {"s": ("x", "SUM"), "n": ("x", "COUNT"), "h": ("x", "MAX")})
    assert got == {(r.user_id, r.window_start): (r.s, r.n, r.h) for r in batch.collect()}


def test_ring_rule_stream(spark, tmp_path):
    lines = [(1, i, 1_704_067_200 + 600 * i, 40.0) for i in range(12)] + [(2, 100, 1_704_067_200, 150.0)]
    for k in (0, 1):
        (tmp_path / f"in{k}").mkdir()
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(dict(zip(("entity", "event_id", "ts", "value"), x, strict=True))) for x in lines))
    stream = spark.readStream.schema("entity long, event_id long, ts long, value double").json(str(tmp_path / "in"))
    query = ring_rule(stream, size=3600, threshold=100.0, cooldown=1800).writeStream.format("memory").queryName("fired").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    got = sorted((r.entity, r.event_id) for r in spark.table("fired").collect())
    want, until = [(2, 100)], None
    for e, i, ts, _ in lines[:12]:
        total = sum(v for x, _, t, v in lines[:12] if x == e and ts - ts % 300 - 3600 < t - t % 300 <= ts - ts % 300 and t <= ts)
        if total >= 100 and (until is None or ts >= until):
            want.append((e, i))
            until = ts + 1800
    assert got == sorted(want)


def test_rule_stream_fires_rests_and_sees_absence(spark, tmp_path):
    from tidewarden.model import rules as R
    from tidewarden.streaming.rules import rule_stream

    start = 1_704_067_200
    made = [
        R.Rule("spend", "spend", R.every(R.aggregate("total_amount", "SUM", 3600, "GTE", 100, "ecommerce"), R.none(R.raw("order_status", "EQ", "cancelled"))), cooldown_seconds=600),
        R.Rule("quiet", "quiet", R.aggregate("event_id", "COUNT", 43200, "EQ", 0, slide=43200)),
    ]
    lines = [("a", f"e{i}", start + 120 * i, "ecommerce", 60.0 if i % 2 else None, "cancelled" if i == 3 else "paid") for i in range(12)]
    later = [("b", "x", start + 10 * 86400, "crm", None, None)]
    (tmp_path / "in").mkdir()
    names = ("entity_id", "event_id", "at", "source_system", "total_amount", "order_status")
    for k, part in enumerate((lines, later, [("b", "y", start + 11 * 86400, "crm", None, None)])):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(names, x, strict=True))) for x in part))
        import os

        os.utime(tmp_path / "in" / f"{k}.json", (k + 1, k + 1))
    stream = spark.readStream.schema("entity_id string, event_id string, at long, source_system string, total_amount double, order_status string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    timed = stream.withColumn("ts", F.timestamp_seconds("at")).withWatermark("ts", "1 hour")
    query = rule_stream(timed, made, absence=True).writeStream.format("memory").queryName("rules_fired").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None
    got = {(r.rule_id, r.entity_id, r.event_id) for r in spark.table("rules_fired").collect()}
    want, until = set(), 0
    for i, (_, event, at, *_rest) in enumerate(lines):
        total = sum(60 for j in range(i + 1) if j % 2)
        if total >= 100 and i != 3 and at >= until:
            want.add(("spend", "a", event))
            until = at + 600
    assert {g for g in got if g[0] == "spend"} == want
    assert ("quiet", "a", None) in got
