from tidewarden.model import fields, rules, schemas
from tidewarden.sources import files, synthetic


def test_dictionary():
    found = fields.dictionary()
    assert len(found) == 66
    assert fields.required_names() == ["event_id", "event_type", "entity_id", "source_system", "event_time"]
    kinds = [f.type for f in found.values()]
    assert {k: kinds.count(k) for k in set(kinds)} == {"string": 52, "integer": 4, "double": 5, "boolean": 5}
    assert [len(f.strategies) for f in found.values()].count(6) == 9
    assert len(fields.attributes_type()) == 66


def test_schema_keys():
    assert len(schemas.catalog_rows()) == 20
    assert schemas.publisher_key({"name": "unified_dictionary"}) == "unified_schema"
    assert schemas.publisher_key({"source_name": "crm"}) == "crm_schema"
    assert schemas.publisher_key({"action": "a"}) == "unknown_a"
    assert schemas.published({"source_name": "s", "action": "a", "fields": {"x": {"description": "d", "type": "string", "deep": {"description": "kept"}}}}) == ("s_a", '{"source_name":"s","action":"a","fields":{"x":{"type":"string","deep":{"description":"kept"}}}}')
    for source in schemas.ACTIONS:
        for action in schemas.ACTIONS[source]:
            assert set(schemas.action_fields(source, action)) <= set(fields.dictionary())


def test_rule_validator():
    agg = rules.aggregate
    paid = {"field": "order_status", "operator": "EQ", "value": "paid"}
    for tree in (
        rules.every(agg("total_amount", "SUM", 86400, "GTE", 900, "ecommerce"), rules.none(agg("order_status", "COUNT", 3600, "LT", 2, where=paid))),
        rules.some(agg("event_id", "COUNT", 43200, "EQ", 0, slide=43200), rules.raw("opt_in_sms", "EQ", True), rules.raw("user_email", "CONTAINS", "@")),
        rules.raw("quantity", "BETWEEN", [1, 2]),
    ):
        assert rules.errors(tree) == []
    assert rules.errors(agg("total_amount", "SUM", 400, "GT", 1))
    assert rules.errors(agg("total_amount", "SUM", 86700, "GT", 1))
    assert rules.errors(agg("total_amount", "SUM", 600, "GT", 1) | {"window": {"type": "tumbling", "size_seconds": 600, "slide_seconds": 300}})
    assert rules.errors({"operator": "NOT", "children": [rules.raw("quantity", "GT", 1)] * 2})
    assert rules.errors(agg("order_status", "SUM", 300, "GT", 1))
    assert rules.errors(rules.raw("nothing", "EQ", 1))
    assert rules.errors(agg("total_amount", "SUM", 300, "IN", [1]))
    assert rules.errors(rules.raw("quantity", "BETWEEN", [1])) and rules.errors(rules.raw("quantity", "IN", 1))
    assert rules.errors({"operator": "AND", "children": []}) and rules.errors("x")


def test_random_rules_are_well_formed():
    made = synthetic.rules(300, seed=3)
    assert made == synthetic.rules(300, seed=3) and len({r.rule_id for r in made}) == 300
    for rule in made:
        assert rules.errors(rule.tree) == []
        assert rule.tree["operator"] in rules.LOGICAL


def test_published_schema_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.json").write_text('{"source_name":"crm","action":"login","fields":{"x":{"description":"d"}}}')
    (tmp_path / "deep" / "b.json").write_text('{"source_name":"crm",\n"fields":{}}')
    (tmp_path / "c.json").write_text("{bad")
    (tmp_path / "d.txt").write_text("{}")
    rows, failed = files.published_schemas(spark, str(tmp_path))
    assert {tuple(r) for r in rows.collect()} == {("crm_login", '{"source_name":"crm","action":"login","fields":{"x":{}}}'), ("crm_schema", '{"source_name":"crm","fields":{}}')}
    failed = failed.collect()
    assert len(failed) == 1 and failed[0].path.endswith("c.json") and failed[0].error
