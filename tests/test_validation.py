"""Golden cases of the decision table, both layouts, and the valid/dirty split."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidewarden.model.schemas import catalog_rows
from tidewarden.operators import validation

REQUIRED = ("event_id", "event_type", "entity_id", "source_system", "event_time")
FULL = {"event_id": "e", "event_type": "login", "entity_id": "c", "source_system": "crm", "event_time": "2026-01-01T00:00:00Z"}
ROUTE = '"source_system":"crm","event_type":"login"'
NESTED = f'{{ {ROUTE}, "fields": {json.dumps(FULL)}, "x": 1.10 }}  '

EXTRA = [
    ("crm_broken", "{bad"),
    ("crm_blank", ""),
    ("crm_open", "{}"),
    ("crm_free", '{"fields":{}}'),
    ("crm_loose", '{"fields":{"a":{"required":"true"},"b":{"required":1},"c":{"required":0},"d":{"required":"no"},"e":{}}}'),
]

CASES = [
    ("V1", "{bad", "JSON Parse Exception: "),
    ("V1 null", None, "JSON Parse Exception: "),
    ("V2", '{"event_type":"login"}', "Missing source_system or action for schema mapping"),
    ("V2a array", "[1,2]", "JSON Parse Exception: "),
    ("V2a number", "123", "JSON Parse Exception: "),
    ("V2a empty", "", "JSON Parse Exception: "),
    ("single quotes", "{'source_system':'crm','event_type':'login'}", "JSON Parse Exception: "),
    ("V3", '{"source_system":"crm","event_type":"nope"}', "Schema not found for key: crm_nope"),
    ("V3 null", '{"source_system":null,"event_type":"login"}', "Schema not found for key: null_login"),
    ("V3 object", '{"source_system":{"a":1},"event_type":"login"}', "Schema not found for key: _login"),
    ("V3 brace text", '{"source_system":"{a}","event_type":"login"}', "Schema not found for key: {a}_login"),
    ("V4", '{"source_system":"crm","event_type":"broken"}', "JSON Parse Exception: "),
    ("V5", '{"source_system":"crm","event_type":"open"}', None),
    ("V5a", '{"source_system":"crm","event_type":"blank"}', None),
    ("V6", json.dumps(FULL), "Missing required fields: fields_object_missing"),
    ("V6 no required", '{"source_system":"crm","event_type":"free"}', "Missing required fields: fields_object_missing"),
    ("V7", f'{{{ROUTE},"fields":{{"event_id":null,"event_type":"login","entity_id":"c","source_system":"crm"}}}}', "Missing required fields: event_id, event_time"),
    ("V7 null", f'{{{ROUTE},"fields":null}}', "Missing required fields: " + ", ".join(REQUIRED)),
    ("V7 array", f'{{{ROUTE},"fields":[1]}}', "Missing required fields: " + ", ".join(REQUIRED)),
    ("V7 truthy", '{"source_system":"crm","event_type":"loose","fields":{}}', "Missing required fields: a, b"),
    ("V7 repeated", f'{{{ROUTE},"fields":{json.dumps(FULL)[:-1]},"event_id":null}}}}', "Missing required fields: event_id"),
    ("V8", NESTED, None),
    ("V8 type", '{"source_system":"ecommerce","event_type":"add_to_cart","fields":' + json.dumps(FULL | {"unit_price": "N/A"}) + "}", None),
]


def judge(spark, texts, layout="nested", catalog=None):
    events = spark.createDataFrame(list(enumerate(texts)), "id int, value string")
    schemas = spark.createDataFrame(catalog_rows() + EXTRA if catalog is None else catalog, "schema_id string, schema_payload string")
    return [r.asDict() for r in validation.validate(events, schemas, layout).orderBy("id").collect()]


def test_decision_table(spark):
    for (name, text, reason), row in zip(CASES, judge(spark, [c[1] for c in CASES]), strict=True):
        if reason is None:
            assert (row["status"], row["error_reason"], row["output"]) == ("valid", None, text), name
        elif reason.endswith(": "):
            assert row["status"] == "dirty" and row["error_reason"].startswith(reason), name
            wrapper = json.loads(row["output"])
            assert wrapper.get("original_payload") == text and wrapper["error_reason"] == row["error_reason"], name
        else:
            assert (row["status"], row["error_reason"]) == ("dirty", reason), (name, row["error_reason"])
            assert json.loads(row["output"])["error_reason"] == reason, name


def test_flat_layout(spark):
    rows = judge(spark, [json.dumps(FULL), json.dumps({k: v for k, v in FULL.items() if k != "event_time"}), json.dumps(FULL | {"event_id": None})], layout="flat")
    assert [r["error_reason"] for r in rows] == [None, "Missing required fields: event_time", "Missing required fields: event_id"]
    with pytest.raises(ValueError):
        judge(spark, [], layout="other")


def test_dirty_output_keeps_the_text(spark):
    texts = ['{"b":1,"event_type":"login","n":{"z":[1.10]}}', '{"event_type":"x","error_reason":"old","b":{"c":1}}', '{"event_type":"a"} trailing', '{"event_type":"a","event_type":"b"}', "{ }", '{"q":"}\\"","event_type":"é"} \n']
    rows = judge(spark, texts)
    assert rows[0]["output"] == texts[0][:-1] + f',"error_reason":"{validation.NO_KEY}"}}'
    assert json.loads(rows[1]["output"]) == {"event_type": "x", "b": {"c": 1}, "error_reason": validation.NO_KEY}
    assert json.loads(rows[2]["output"]) == {"event_type": "a", "error_reason": validation.NO_KEY}
    assert json.loads(rows[3]["output"]) == {"event_type": "b", "error_reason": validation.NO_KEY}
    assert json.loads(rows[4]["output"]) == {"error_reason": validation.NO_KEY}
    assert json.loads(rows[5]["output"]) == {"q": '}"', "event_type": "é", "error_reason": validation.NO_KEY}


def test_empty_inputs(spark):
    assert judge(spark, []) == []
    assert judge(spark, ['{"source_system":"crm","event_type":"login"}'], catalog=[])[0]["error_reason"] == "Schema not found for key: crm_login"


_value = st.sampled_from(['"crm"', '"login"', "null", "1", "true", '{"a":[1]}', "[]", '"x,y"'])
_text = st.one_of(
    st.dictionaries(st.sampled_from(["source_system", "event_type", "fields", "a"]), _value, max_size=4).map(lambda d: "{" + ",".join(f'"{k}":{v}' for k, v in d.items()) + "}"),
    st.sampled_from(["", "[]", "x", '"s"', "{", NESTED]),
)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(_text, min_size=1, max_size=40))
def test_valid_and_dirty_make_up_the_input(spark, texts):
    for text, row in zip(texts, judge(spark, texts), strict=True):
        assert (row["status"] == "valid") == (row["error_reason"] is None)
        if row["status"] == "valid":
            assert row["output"] == text
        else:
            assert json.loads(row["output"])["error_reason"] == row["error_reason"]


def test_counters(spark):
    from pyspark.sql import Observation

    events = spark.createDataFrame([(1, NESTED), (2, "{bad"), (3, "[]")], "id int, value string")
    counters = Observation("validation")
    validation.counted(validation.validate(events, spark.createDataFrame(catalog_rows(), "schema_id string, schema_payload string")), counters).collect()
    assert counters.get == {"events": 3, "valid": 1, "dirty": 2}


def test_an_event_sees_the_schemas_before_it(spark):
    catalog = [("crm_login", '{"fields":{"a":{"required":true}}}', 3), ("crm_login", '{"fields":{"b":{"required":true}}}', 6), ("crm_x", "{}", 1)]
    text = f'{{{ROUTE},"fields":{{"b":1}}}}'
    events = spark.createDataFrame([(at, text) for at in range(8)], "at int, value string")
    versions = spark.createDataFrame(catalog, "schema_id string, schema_payload string, at int")
    out = [r.error_reason for r in validation.validate(events, versions, order="at").orderBy("at").collect()]
    assert out == ["Schema not found for key: crm_login"] * 3 + ["Missing required fields: a"] * 3 + [None] * 2


def test_each_text_is_parsed_once(spark):
    events = spark.createDataFrame([(1, NESTED)], "id int, value string").repartition(1)
    catalog = spark.createDataFrame(catalog_rows(), "schema_id string, schema_payload string")
    dirty = validation.split(validation.validate(events, catalog))[1].select("id", "error_reason")
    plan = dirty._jdf.queryExecution().executedPlan().toString()
    # The event and its fields, the schema and its fields; each is shown once in its generator.
    assert plan.count("from_json(") == 4, plan
