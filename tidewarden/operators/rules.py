"""Evaluation of rules.

An event is judged by its own fields and by its entity's aggregates as of its bucket.
A sliding window is the event's bucket and those before it; a tumbling one is the whole
epoch-aligned window that holds the event.  Missing values make a leaf false.
"""

from __future__ import annotations

import functools
import json
import operator
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.predicates import compare, compile_tree, known
from ..model.rules import BUCKET_SECONDS, Rule, is_leaf, leaves
from . import windows
from .joins import broadcast_if_small


def _measure_key(leaf: dict) -> tuple:
    return leaf["field"], leaf.get("source_system"), json.dumps(leaf.get("filter"), sort_keys=True)


def feature_name(leaf: dict, measures: dict[tuple, str]) -> str:
    window = leaf["window"]
    return f"{measures[_measure_key(leaf)]}_{leaf['function'].lower()}_{window['type'][0]}{window['size_seconds']}"


def features(events: DataFrame, aggregates: list[dict], entity: str, ts: str) -> tuple[DataFrame, dict[tuple, str]]:
    """All aggregates that the leaves name, for each (entity, bucket).

    One grouping makes the partials of all measures; one ordering per entity serves all
    window sizes.  The second value names each measure.
    """
    measures: dict[tuple, str] = {}
    made = []
    for leaf in aggregates:
        key = _measure_key(leaf)
        if key in measures:
            continue
        measures[key] = f"m{len(measures)}"
        chosen = F.col(leaf["field"]).isNotNull()
        if leaf.get("source_system"):
            chosen &= known(F.col("source_system") == leaf["source_system"])
        if leaf.get("filter"):
            chosen &= compare(F.col(leaf["filter"]["field"]), leaf["filter"]["operator"], leaf["filter"]["value"])
        counted = all(x["function"] == "COUNT" for x in aggregates if _measure_key(x) == key)
        value = F.when(F.col(leaf["field"]).isNotNull(), F.lit(1.0)) if counted else F.col(leaf["field"]).try_cast("double")
        made.append(windows.Measure(measures[key], value, chosen))
    partials = windows.ring_buckets(events, entity, ts, made)
    columns: dict[str, Column] = {}
    for leaf in aggregates:
        size = leaf["window"]["size_seconds"]
        if leaf["window"]["type"] == "tumbling":
            over = Window.partitionBy(entity, F.floor(F.col("bucket") / size))
        else:
            over = Window.partitionBy(entity).orderBy("bucket").rangeBetween(BUCKET_SECONDS - size, 0)
        columns[feature_name(leaf, measures)] = windows.merged(measures[_measure_key(leaf)], leaf["function"], over)
    return partials.select(entity, "bucket", *(c.alias(n) for n, c in columns.items())), measures


def condition(rule: Rule, measures: dict[tuple, str]) -> Column:
    """A rule's tree as one condition over event fields and features."""

    def leaf(node: dict) -> Column:
        if node.get("type") != "AGGREGATION":
            return compare(F.col(node["field"]), node["operator"], node["value"])
        value = F.col(feature_name(node, measures))
        return compare(F.coalesce(value, F.lit(0)) if node["function"] == "COUNT" else value, node["operator"], node["value"])

    return compile_tree(rule.tree, leaf)


def matches(events: DataFrame, rules: list[Rule], entity: str = "entity_id", ts: str = "event_time", keep: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """(rule_id, priority, cooldown_seconds, entity, ts, ...) for each event that satisfies a rule.

    For up to a few hundred rules: each is one expression, evaluated in a single pass over
    the events joined to their features.  For more, see ``evaluate_nodes``.
    """
    aggregates = [x for r in rules for x in leaves(r.tree) if x.get("type") == "AGGREGATION"]
    joined, measures = events, {}
    if aggregates:
        found, measures = features(events, aggregates, entity, ts)
        joined = events.withColumn("bucket", windows.bucket_of(F.col(ts))).join(found, [entity, "bucket"], "left")
    hits = F.array_compact(F.array(*(F.when(condition(r, measures), F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.priority).alias("priority"), F.lit(r.cooldown_seconds).alias("cooldown_seconds"))) for r in rules)))
    return joined.select(entity, ts, *keep, F.explode(hits).alias("hit")).select("hit.*", entity, ts, *keep)


def active_versions(definitions: DataFrame) -> DataFrame:
    """The highest version of each rule_id, if it is enabled.  An enabled older version does not come back."""
    from .cdc import latest_per_key

    return latest_per_key(definitions, ["rule_id"], ["version", "id"]).where("enabled")


def winners(found: DataFrame, entity: str = "entity_id", event: str = "event_id") -> DataFrame:
    """Of the rules that match one event of one entity the one of highest priority, ties to the smaller rule_id."""
    rest = [c for c in found.columns if c not in (entity, event)]
    best = F.min_by(F.struct(*rest), F.struct((-F.col("priority")).alias("p"), F.col("rule_id"))).alias("row")
    return found.groupBy(entity, event).agg(best).select(entity, event, *(F.col("row")[c].alias(c) for c in rest))


def fired(found: DataFrame, seconds: str = "cooldown_seconds", entity: str = "entity_id", ts: str = "event_time", event: str = "event_id") -> DataFrame:
    """Matches left by the cooldown: after one fires, the same rule and entity rest for ``seconds``.

    Firing again at exactly the end of the rest is allowed.  Matches of one instant fire
    once, the smaller event first, unless the cooldown is 0, when all fire.  The order of
    a rule and entity is read as a stream, so a hot one takes no more memory than another.
    """
    rows = found.withColumn("__us", F.unix_micros(F.col(ts).cast("timestamp")))
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = until = None
        for batch in batches:
            rule, who, at, rest = (batch.column(c).to_pylist() for c in ("rule_id", entity, "__us", seconds))
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                if (rule[i], who[i]) != key:
                    key, until = (rule[i], who[i]), None
                if at[i] is None or (until is not None and at[i] < until):
                    continue
                keep[i] = True
                until = at[i] + (rest[i] or 0) * 1_000_000 if rest[i] else None
            yield batch.filter(pa.array(keep))

    ordered = rows.repartition("rule_id", entity).sortWithinPartitions("rule_id", entity, "__us", event)
    return ordered.mapInArrow(run, rows.schema).select(*[n for n in names if n != "__us"])


# Many rules: leaves and inner nodes as tables.


def _operand(x, op: str) -> tuple[str, str]:
    """(kind, text) of an operand: what a value is converted to before it is compared."""
    if op == "CONTAINS":
        return "text", str(x)
    if isinstance(x, bool):
        return "boolean", str(x).lower()
    return ("number", repr(float(x))) if isinstance(x, (int, float)) else ("text", str(x))


def program(tree: dict) -> list[tuple]:
    """A tree in postfix order as (op, n, feature, operands): a leaf, or AND, OR or NOT of the ``n`` results before it."""
    if is_leaf(tree):
        value = tree["value"] if isinstance(tree["value"], list) else [tree["value"]]
        return [(tree["operator"], 0, leaf_feature(tree), [_operand(v, tree["operator"]) for v in value])]
    return [x for child in tree["children"] for x in program(child)] + [(tree["operator"], len(tree["children"]), None, None)]


def entries(tree: dict) -> list[dict] | None:
    """Leaves of which one at least is true wherever the tree holds; null if it may hold with all leaves false.

    Of the children of an AND the one is chosen whose leaves are looked up by value, else the one with the fewest.
    """
    if is_leaf(tree):
        return [tree]
    found = [entries(c) for c in tree["children"]]
    if tree["operator"] == "OR":
        return None if None in found else [x for f in found for x in f]
    fine = [f for f in found if f is not None] if tree["operator"] == "AND" else []
    return min(fine, key=lambda f: (not all(map(_by_value, f)), len(f)), default=None)


def _by_value(leaf: dict) -> bool:
    """Whether a leaf compares text for equality, so that its value can be looked up."""
    operands = leaf["value"] if leaf["operator"] == "IN" else [leaf["value"]]
    return leaf["operator"] in ("EQ", "IN") and all(isinstance(x, str) for x in operands)


def leaf_feature(node: dict) -> str:
    if node.get("type") != "AGGREGATION":
        return f"field:{node['field']}"
    window = node["window"]
    where = json.dumps(node["filter"], sort_keys=True) if node.get("filter") else ""
    return f"{node['function']}:{node['field']}:{node.get('source_system') or ''}:{window['type']}:{window['size_seconds']}:{where}"


def _leaf_truth(value: Column, op: Column, operands: Column) -> Column:
    """Truth of a leaf whose operator and operands are data; the operand's kind tells how they compare."""
    first, second = operands[0], F.try_element_at(operands, F.lit(2))

    def typed(operand: Column, test: Callable[[Column, Column], Column]) -> Column:
        text, kind = operand["text"], operand["kind"]
        number = test(value.try_cast("double"), text.try_cast("double"))
        return F.when(kind == "number", number).when(kind == "boolean", test(value.try_cast("boolean"), text.try_cast("boolean"))).otherwise(test(value, text))

    def between(low: Column) -> Column:
        number = value.try_cast("double").between(low["text"].try_cast("double"), second["text"].try_cast("double"))
        return F.when(low["kind"] == "number", number).otherwise(value.between(low["text"], second["text"]))

    cases = {name: typed(first, test) for name, test in (("EQ", operator.eq), ("NEQ", operator.ne), ("GT", operator.gt), ("GTE", operator.ge), ("LT", operator.lt), ("LTE", operator.le))}
    cases |= {"IN": F.exists(operands, lambda x: known(typed(x, operator.eq))), "BETWEEN": between(first), "CONTAINS": value.contains(first["text"])}
    out = F.lit(False)
    for name, case in cases.items():
        out = F.when(op == name, known(case)).otherwise(out)
    return out


_OPERANDS = "array<struct<kind: string, text: string>>"
_VALUE = "\x00"  # stands between feature and value in a key


def evaluate_nodes(facts: DataFrame, subjects: list[str], rules: list[Rule]) -> DataFrame:
    """(subjects..., rule_id) for every rule that holds, by tables of rules.

    ``facts``: the subject columns and ``facts``, a map from each feature that a leaf names
    to its value as text.  A subject takes up a rule only if one of the rule's entry leaves
    is true of it, found by feature and value where the leaf compares text for equality;
    a rule without such leaves, as NOT may make it, is taken up by every subject.  What is
    taken up is decided by the rule's postfix program over the subject's own facts, without
    another join.  The plan is the same for any number of rules.
    """
    spark = facts.sparkSession
    keyed: list[tuple] = []
    by_value, by_truth = set(), set()  # features whose values, or which themselves, are keys
    for r in rules:
        found = entries(r.tree)
        if found is None:
            by_truth.add(feature := leaf_feature(next(leaves(r.tree))))
            keyed.append((feature, r.rule_id, None, None))
        for leaf in found or ():
            op, _, feature, operands = program(leaf)[0]
            if _by_value(leaf):
                by_value.add(feature)
                keyed += [(f"{feature}{_VALUE}{text}", r.rule_id, None, None) for _, text in operands]
            else:
                by_truth.add(feature)
                keyed.append((feature, r.rule_id, op, operands))
    index = spark.createDataFrame(keyed, f"key string, rule_id string, op string, operands {_OPERANDS}")
    programs = spark.createDataFrame([(r.rule_id, program(r.tree)) for r in rules], f"rule_id string, program array<struct<op: string, n: int, feature: string, operands: {_OPERANDS}>>")
    pairs = F.map_entries("facts")

    def keys(features: set[str], key: Callable[[Column], Column]) -> Column:
        some = F.filter(pairs, lambda e: e["key"].isin(*sorted(features)))
        return F.transform(some, lambda e: F.struct(key(e).alias("key"), e["value"].alias("value")))

    each = F.concat(keys(by_truth, lambda e: e["key"]), keys(by_value, lambda e: F.concat(e["key"], F.lit(_VALUE), e["value"])))
    exploded = facts.select(*subjects, "facts", F.explode(each).alias("e")).where("e.key IS NOT NULL").select(*subjects, "facts", F.col("e.key").alias("key"), F.col("e.value").alias("value"))
    taken = exploded.join(broadcast_if_small(index), "key").where(F.col("op").isNull() | _leaf_truth(F.col("value"), F.col("op"), F.col("operands")))
    return taken.join(broadcast_if_small(programs), "rule_id").where(_run(F.col("program"), F.col("facts"))).select(*subjects, "rule_id").distinct()


def _run(program: Column, facts: Column) -> Column:
    """The result of a postfix program, the last result first on its stack."""

    def step(stack: Column, token: Column) -> Column:
        n, op = token["n"], token["op"]
        mine = F.slice(stack, F.lit(1), n)
        rest = F.slice(stack, n + 1, F.size(stack))
        joined = F.when(op == "AND", F.forall(mine, lambda x: x)).when(op == "OR", F.exists(mine, lambda x: x)).otherwise(~F.element_at(mine, 1))
        leaf = _leaf_truth(F.try_element_at(facts, token["feature"]), op, token["operands"])
        return F.when(n > 0, F.concat(F.array(joined), rest)).otherwise(F.concat(F.array(leaf), stack))

    return F.try_element_at(F.aggregate(program, F.array().cast("array<boolean>"), step), F.lit(1))


def facts_of(wide: DataFrame, subjects: list[str], columns: dict[str, str]) -> DataFrame:
    """Wide rows as facts: ``columns`` maps a feature to its column."""
    pairs = [x for f, c in columns.items() for x in (F.lit(f), F.col(c).cast("string"))]
    return wide.select(*subjects, (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("facts"))


#: Aggregates that one pass over an entity's buckets computes.
AGGREGATES_A_PASS = 64


def rule_facts(events: DataFrame, rules: list[Rule], subjects: list[str], entity: str = "entity_id", ts: str = "event_time") -> DataFrame:
    """The facts that ``evaluate_nodes`` needs of each event: its fields, and its entity's aggregates as of its bucket.

    ``subjects`` name an event.  Rules share features, so the number of passes follows from
    how many different aggregates the rules name together, not from the rules.
    """
    named = {leaf_feature(x): x for r in rules for x in leaves(r.tree)}
    columns = {f: x["field"] for f, x in named.items() if x.get("type") != "AGGREGATION"}
    aggregates = [(f, x) for f, x in named.items() if x.get("type") == "AGGREGATION"]
    wide = events.withColumn("bucket", windows.bucket_of(F.col(ts)))
    for i in range(0, len(aggregates), AGGREGATES_A_PASS):
        some = aggregates[i : i + AGGREGATES_A_PASS]
        found, measures = features(events, [x for _, x in some], entity, ts)
        renamed = {feature_name(x, measures): f"p{i}_{feature_name(x, measures)}" for _, x in some}
        wide = wide.join(found.withColumnsRenamed(renamed), [entity, "bucket"], "left").fillna(0, [renamed[feature_name(x, measures)] for _, x in some if x["function"] == "COUNT"])
        columns |= {f: renamed[feature_name(x, measures)] for f, x in some}
    return facts_of(wide, subjects, columns)


def definitions(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """Rules as rows of rule_definitions."""
    rows = [(i, r.rule_id, r.name, json.dumps(r.tree), r.priority, r.cooldown_seconds, r.version, r.enabled) for i, r in enumerate(rules, 1)]
    return spark.createDataFrame(rows, "id long, rule_id string, name string, rule_json string, priority int, cooldown_seconds long, version long, enabled boolean")
