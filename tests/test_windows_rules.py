"""Windows and rules against plain Python over the events themselves."""

import json
import re
from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewarden.functions.predicates import compare
from tidewarden.model import rules as R
from tidewarden.operators import rules, windows
from tidewarden.operators.windows import Measure
from tidewarden.sources import synthetic

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "event_id long, entity_id string, event_time timestamp, source_system string, total_amount string, order_status string, quantity long"


def table(spark, rows):
    return spark.createDataFrame([(i, e, START + timedelta(seconds=s), src, a, o, q) for i, (e, s, src, a, o, q) in enumerate(rows)], SCHEMA)


def number(x):
    try:
        return float(x)
    except (TypeError, ValueError):
        return None


def plain_leaf(value, op, operand):
    if op == "IN":
        return any(plain_leaf(value, "EQ", x) for x in operand)
    if op == "BETWEEN":
        return plain_leaf(value, "GTE", operand[0]) and plain_leaf(value, "LTE", operand[1])
    if op == "CONTAINS":
        return value is not None and str(operand) in str(value)
    value = number(value) if isinstance(operand, (int, float)) and not isinstance(operand, bool) else value
    if value is None:
        return False
    return {"GT": value > operand, "GTE": value >= operand, "LT": value < operand, "LTE": value <= operand, "EQ": value == operand, "NEQ": value != operand}[op] if not isinstance(value, str) or isinstance(operand, str) else False


def plain_aggregate(rows, now, leaf):
    size = leaf["window"]["size_seconds"]
    values = []
    for e, s, src, a, o, q in rows:
        row = {"entity_id": e, "source_system": src, "total_amount": a, "order_status": o, "quantity": q, "event_id": "x"}
        b, nb = s // 300 * 300, now[1] // 300 * 300
        inside = b // size == nb // size if leaf["window"]["type"] == "tumbling" else nb - size < b <= nb
        where = leaf.get("filter")
        if e == now[0] and inside and leaf.get("source_system") in (None, src) and row[leaf["field"]] is not None and (not where or plain_leaf(row[where["field"]], where["operator"], where["value"])):
            values.append(row[leaf["field"]])
    if leaf["function"] == "COUNT":
        return len(values)
    values = [number(v) for v in values if number(v) is not None]
    if not values:
        return None
    return {"SUM": sum, "AVG": lambda v: sum(v) / len(v), "MAX": max, "MIN": min}[leaf["function"]](values)


def plain_tree(rows, now, node):
    if node["operator"] in R.LOGICAL:
        found = [plain_tree(rows, now, c) for c in node["children"]]
        return {"AND": all(found), "OR": any(found), "NOT": not found[0]}[node["operator"]]
    if node["type"] == "AGGREGATION":
        return plain_leaf(plain_aggregate(rows, now, node), node["operator"], node["value"])
    row = dict(zip(("entity_id", "s", "source_system", "total_amount", "order_status", "quantity"), now, strict=True))
    return plain_leaf(row[node["field"]], node["operator"], node["value"])


_row = st.tuples(st.sampled_from("ab"), st.sampled_from([0, 1, 299, 300, 599, 600, 3599, 3600, 86399, 86400, 90000]), st.sampled_from(["crm", "ecommerce", None]), st.sampled_from(["1", "2.5", "N/A", None, "-3"]), st.sampled_from(["completed", "paid", None]), st.sampled_from([1, 5, None]))
_window = st.sampled_from([(300, 300), (3600, 300), (3600, 3600), (86400, 300)])
_leaf = st.one_of(
    st.builds(
        lambda f, fn, w, op, v, src, flt: R.aggregate(f, fn, w[0], op, v, src, flt, slide=w[1]),
        st.sampled_from(["total_amount", "quantity"]), st.sampled_from(["SUM", "COUNT", "AVG", "MAX", "MIN"]), _window, st.sampled_from(R.COMPARISONS), st.sampled_from([0, 1, 2, 3.3]),
        st.sampled_from([None, "crm"]), st.sampled_from([None, {"field": "order_status", "operator": "EQ", "value": "completed"}]),
    ),
    st.builds(R.raw, st.sampled_from(["total_amount", "quantity"]), st.sampled_from(R.COMPARISONS), st.sampled_from([1, 2.5])),
    st.builds(R.raw, st.just("quantity"), st.just("BETWEEN"), st.just([1, 3])),
    st.builds(R.raw, st.just("order_status"), st.sampled_from(["EQ", "NEQ"]), st.just("paid")),
    st.builds(R.raw, st.just("order_status"), st.just("IN"), st.just(["paid", "x"])),
    st.builds(R.raw, st.just("order_status"), st.just("CONTAINS"), st.just("plet")),
)
_tree = st.recursive(_leaf, lambda inner: st.one_of(st.builds(R.none, inner), st.lists(inner, min_size=1, max_size=3).map(lambda c: R.every(*c)), st.lists(inner, min_size=1, max_size=3).map(lambda c: R.some(*c))), max_leaves=5)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(_row, min_size=1, max_size=12), st.lists(_tree, min_size=1, max_size=4))
def test_rules_match_plain_evaluation(spark, rows, trees):
    made = [R.Rule(f"r{i}", "x", t) for i, t in enumerate(trees)]
    got = {(r.rule_id, r.event_id) for r in rules.matches(table(spark, rows), made).collect()}
    assert got == {(f"r{k}", i) for k, t in enumerate(trees) for i, now in enumerate(rows) if plain_tree(rows, now, t)}


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(_row, min_size=1, max_size=10))
def test_sliding_equals_a_sum_over_events(spark, rows):
    partials = windows.ring_buckets(table(spark, rows), "entity_id", "event_time", [Measure("x", F.col("quantity"))])
    base = int(START.timestamp())
    for size in (300, 3600):
        got = {(r.entity_id, r.bucket - base): (r.n, r.s) for r in windows.sliding(partials, "entity_id", size, {"n": ("x", "COUNT"), "s": ("x", "SUM")}).collect()}
        want = {}
        for e, s, *_ in rows:
            b = s // 300 * 300
            inside = [r[5] for r in rows if r[0] == e and b - size < r[1] // 300 * 300 <= b and r[5] is not None]
            want[e, b] = (len(inside), sum(inside) if inside else None)
        assert got == want
        ticks = windows.sliding_ticks(partials, "entity_id", size, {"n": ("x", "COUNT")})
        here = {(r.entity_id, r.tick - base): r.n for r in ticks.collect()}
        assert all(here[k] == v[0] for k, v in want.items())


def test_ticks_match_plain_windows(spark, monkeypatch):
    seconds = [-7200, -1, 0, 299, 300, 3300, 3599, 3600, 7200, 7500, 86100, 90000, 200000]
    rows = [(e, s, "crm", "1", None, q) for k, e in enumerate(("a", "b", None)) for s, q in zip(seconds[k:], [5, None, 1, 2, None, None, 7, 3, None, 4, 1, 6, None], strict=False)]
    events = table(spark, rows).unionByName(table(spark, [("a", 0, "crm", "1", None, 9)]).withColumn("event_time", F.lit(None).cast("timestamp")))
    partials = windows.ring_buckets(events, "entity_id", "event_time", [Measure("x", F.col("quantity"))])
    base = int(START.timestamp())
    plain = {"s": sum, "n": len, "m": lambda v: sum(v) / len(v), "h": max, "l": min}
    for size, slide, block in ((3600, 300, 3600), (3600, 900, 7200), (86400, 300, windows.BLOCK_SECONDS)):
        monkeypatch.setattr(windows, "BLOCK_SECONDS", block)
        ticks = windows.sliding_ticks(partials, "entity_id", size, {"s": ("x", "SUM"), "n": ("x", "COUNT"), "m": ("x", "AVG"), "h": ("x", "MAX"), "l": ("x", "MIN")}, slide).collect()
        inside = {}
        for e, s, _, _, _, q in rows:
            for tick in range(s // slide * slide, s // slide * slide + size, slide):
                inside.setdefault((e, tick), []).extend([] if q is None else [q])
        assert len(ticks) == len(inside)
        assert {(r.entity_id, r.tick - base): (r.s, r.n, r.m, r.h, r.l) for r in ticks} == {k: tuple(f(v) if v or f is len else None for f in plain.values()) for k, v in inside.items()}


def test_ticks_are_made_after_all_that_holds_rows(spark):
    partials = windows.ring_buckets(table(spark, [("a", 0, "crm", "1", None, 1)]), "entity_id", "event_time", [Measure("x", F.col("quantity"))])
    plan = windows.sliding_ticks(partials, "entity_id", 86400, {"n": ("x", "COUNT")})._jdf.queryExecution().executedPlan().toString()
    assert "explode(sequence(" in plan
    later = plan.split("explode(sequence(")[0]  # the plan's root is written first
    assert not [step for step in ("Exchange", "Aggregate", "Sort", "Window") if step in later]
    assert re.search(r"Exchange hashpartitioning\(entity_id#\d+, block#\d+L", plan)  # a long history is not one task's


def test_window_sizes_are_checked(spark):
    partials = windows.ring_buckets(table(spark, [("a", 0, "crm", "1", None, 1)]), "entity_id", "event_time", [Measure("x", F.lit(1))])
    for size in (0, 400, 86700):
        with pytest.raises(ValueError):
            windows.sliding(partials, "entity_id", size, {"n": ("x", "COUNT")})


def test_cooldown(spark):
    seconds = [0, 0, 5, 60, 61, 119, 120, 500]
    found = spark.createDataFrame([("r", "a", START + timedelta(seconds=s), i, 60) for i, s in enumerate(seconds)] + [("r", "b", START, 99, 60), ("q", "a", START, 98, 0), ("q", "a", START, 97, 0)], "rule_id string, entity_id string, event_time timestamp, event_id long, cooldown_seconds long")
    assert sorted(r.event_id for r in rules.fired(found).collect()) == [0, 3, 6, 7, 97, 98, 99]


def test_versions_and_priority(spark):
    made = [R.Rule("a", "a1", {}, version=1), R.Rule("a", "a2", {}, version=2, enabled=False), R.Rule("b", "b", {}, version=3)]
    assert [r.rule_id for r in rules.active_versions(rules.definitions(spark, made)).collect()] == ["b"]
    found = spark.createDataFrame([("x", 1, "e", 7), ("b", 5, "e", 7), ("a", 5, "e", 7), ("z", 0, "e", 8)], "rule_id string, priority int, entity_id string, event_id long")
    assert {(r.event_id, r.rule_id) for r in rules.winners(found).collect()} == {(7, "a"), (8, "z")}


def by_nodes(events, made):
    return {(r.rule_id, r.event_id) for r in rules.evaluate_nodes(rules.rule_facts(events, made, ["event_id"]), ["event_id"], made).collect()}


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(_row, min_size=1, max_size=10), st.lists(_tree, min_size=1, max_size=6))
def test_node_tables_match_plain_evaluation(spark, rows, trees):
    made = [R.Rule(f"r{i}", "x", t) for i, t in enumerate(trees)]
    assert by_nodes(table(spark, rows), made) == {(f"r{k}", i) for k, t in enumerate(trees) for i, now in enumerate(rows) if plain_tree(rows, now, t)}


def test_node_tables_agree_with_expressions(spark, monkeypatch):
    monkeypatch.setattr(rules, "AGGREGATES_A_PASS", 4)
    made = synthetic.rules(12, seed=5)
    texts = synthetic.events(spark, n=150, entities=5, dirty=0.5)
    names = sorted({x["field"] for r in made for x in R.leaves(r.tree)} | {"event_id", "entity_id", "event_time", "source_system"})
    wide = texts.select(*(F.get_json_object("value", f"$.{n}").alias(n) for n in names)).withColumn("event_time", F.try_to_timestamp("event_time")).cache()
    by_expression = {(r.rule_id, r.event_id) for r in rules.matches(wide, made).collect()}
    assert by_nodes(wide, made) == by_expression and len(by_expression) > 20


def test_operands_keep_their_type(spark):
    rows = [("a", 0, "crm", x, y, 1) for x, y in (("00123", "b"), ("123", "n"), ("123.0", None), (None, "a"), ("true", "m"))]
    trees = [R.raw("order_status", "BETWEEN", ["a", "m"]), R.raw("total_amount", "EQ", "00123"), R.raw("total_amount", "EQ", 123), R.raw("total_amount", "IN", ["123", 123.0]), R.raw("total_amount", "NEQ", "123"), R.raw("total_amount", "GT", "1230"), R.raw("total_amount", "EQ", True), R.raw("total_amount", "CONTAINS", 12)]
    made = [R.Rule(str(i), "x", t) for i, t in enumerate(trees)]
    made += [R.Rule(f"and{i}", "x", R.every(R.raw("source_system", "IN", ["crm", "x"]), t)) for i, t in enumerate(trees)] + [R.Rule(f"not{i}", "x", R.none(t)) for i, t in enumerate(trees)]
    events = table(spark, rows)
    assert by_nodes(events, made) == {(r.rule_id, r.event_id) for r in rules.matches(events, made).collect()}
    assert {e for r, e in by_nodes(events, made) if r == "0"} == {0, 3, 4} and {e for r, e in by_nodes(events, made) if r == "1"} == {0}


def test_entry_leaves():
    s, t, q = R.raw("s", "EQ", "v"), R.raw("t", "IN", ["w", "x"]), R.raw("q", "GT", 1)
    assert rules.entries(R.every(q, R.every(s, R.some(t, q)))) == [s] and rules.entries(R.some(R.every(q, t), s)) == [t, s]
    assert rules.entries(R.some(s, R.none(q))) is None and rules.entries(R.every(q, R.none(s))) == [q] and rules.entries(R.none(R.none(s))) is None
    assert [x[:2] for x in rules.program(R.every(q, R.some(s, t)))] == [("GT", 0), ("EQ", 0), ("IN", 0), ("OR", 2), ("AND", 2)]


@pytest.mark.parametrize(("op", "operand", "want"), [("EQ", 1, [True, False, False]), ("NEQ", 1, [False, False, False]), ("IN", [1, 2], [True, False, False]), ("BETWEEN", [1, 1], [True, False, False]), ("CONTAINS", "/", [False, True, False])])
def test_missing_and_mistyped_are_false(spark, op, operand, want):
    df = spark.createDataFrame([("1",), ("N/A",), (None,)], "x string")
    assert [r.y for r in df.select(compare(F.col("x"), op, operand).alias("y")).collect()] == want


def test_rule_json_round_trip(spark):
    for row in rules.definitions(spark, synthetic.rules(20)).collect():
        assert json.loads(row.rule_json) == R.Rule.from_row(row).tree
