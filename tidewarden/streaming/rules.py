"""Streaming evaluation of rules with ring buffers, cooldowns and detection of absence."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..model.evaluate import _as, compare, holds
from ..model.rules import BUCKET_SECONDS, LONGEST_SECONDS, Rule, leaves

FIRED = "rule_id string, priority int, entity_id string, event_id string, at long"


def _measure(leaf: dict) -> str:
    return json.dumps([leaf["field"], leaf.get("source_system"), leaf.get("filter")], sort_keys=True)


class RuleProcessor(StatefulProcessor):
    """All rules of one entity.

    State: sum, count, minimum and maximum for each measure and 5-minute bucket of the
    last day and ``late`` seconds more, and the end of each rule's rest.  An event sees
    what has arrived; events of one micro-batch are taken in time order.  With ``absence`` a
    timer judges the rules once more when the longest window behind the last event has
    run empty, with no event at hand: event_id is then null.
    """

    def __init__(self, rules: list[Rule], late: int = 7200, absence: bool = False):
        self.rules, self.late, self.absence = rules, late, absence
        self.measures = {_measure(x): x for r in rules for x in leaves(r.tree) if x.get("type") == "AGGREGATION"}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buckets = handle.getMapState("buckets", "measure string, bucket long", "total double, n long, low double, high double")
        self.rests = handle.getMapState("rests", "rule_id string", "until long")
        self.last = handle.getValueState("last", "bucket long")

    def _aggregate(self, held: dict, leaf: dict, bucket: int):
        size = leaf["window"]["size_seconds"]
        start = bucket - bucket % size if leaf["window"]["type"] == "tumbling" else bucket - size + BUCKET_SECONDS
        end = start + size
        parts = [v for b, v in held.get(_measure(leaf), {}).items() if start <= b < end]
        count = sum(p[1] for p in parts)
        numbers = [p for p in parts if p[2] is not None]
        if leaf["function"] == "COUNT":
            return count
        if not numbers:
            return None
        return {"SUM": lambda: sum(p[0] for p in numbers), "AVG": lambda: sum(p[0] for p in numbers) / count, "MIN": lambda: min(p[2] for p in numbers), "MAX": lambda: max(p[3] for p in numbers)}[leaf["function"]]()

    def _judge(self, held: dict, rests: dict, row: dict | None, at: int) -> Iterator[Rule]:
        bucket = at - at % BUCKET_SECONDS

        def leaf(node: dict) -> bool:
            if node.get("type") == "AGGREGATION":
                return compare(self._aggregate(held, node, bucket), node["operator"], node["value"])
            return row is not None and compare(row.get(node["field"]), node["operator"], node["value"])

        for rule in self.rules:
            if holds(rule.tree, leaf) and at >= rests.get(rule.rule_id, at):
                if rule.cooldown_seconds:
                    rests[rule.rule_id] = at + rule.cooldown_seconds
                yield rule

    def _held(self) -> tuple[dict, dict]:
        held: dict[str, dict[int, tuple]] = {}
        for (measure, bucket), parts in self.buckets.iterator():
            held.setdefault(measure, {})[bucket] = tuple(parts)
        return held, {k[0]: v[0] for k, v in self.rests.iterator()}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, rests = self._held()
        out, touched, newest = [], set(), self.last.get()[0] if self.last.exists() else 0
        table = pd.concat(list(rows)).sort_values(["at", "event_id"])
        for row in table.astype(object).where(table.notna(), None).to_dict("records"):
            at = int(row["at"])
            bucket = at - at % BUCKET_SECONDS
            newest = max(newest, bucket)
            for name, leaf in self.measures.items():
                value, where = row.get(leaf["field"]), leaf.get("filter")
                if value is None or leaf.get("source_system") not in (None, row.get("source_system")):
                    continue
                if where and not compare(row.get(where["field"]), where["operator"], where["value"]):
                    continue
                number = _as(value, 0.0)
                total, n, low, high = held.setdefault(name, {}).get(bucket, (0.0, 0, None, None))
                if number is not None:
                    total, low, high = total + number, number if low is None else min(low, number), number if high is None else max(high, number)
                held[name][bucket] = (total, n + 1, low, high)
                touched.add((name, bucket))
            out += [(r.rule_id, r.priority, key[0], row["event_id"], at) for r in self._judge(held, rests, row, at)]
        oldest = newest - LONGEST_SECONDS - self.late
        for name, buckets in held.items():
            for bucket, parts in buckets.items():
                if bucket < oldest:
                    self.buckets.removeKey((name, bucket))
                elif (name, bucket) in touched:
                    self.buckets.updateValue((name, bucket), parts)
        for rule_id, until in rests.items():
            self.rests.updateValue((rule_id,), (until,))
        self.last.update((newest,))
        if self.absence:
            self.handle.registerTimer((newest + LONGEST_SECONDS + BUCKET_SECONDS) * 1000)
        yield _fired(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = expiredTimerInfo.getExpiryTimeInMs() // 1000
        newest = self.last.get()[0] if self.last.exists() else 0
        if newest + LONGEST_SECONDS + BUCKET_SECONDS > at:  # an event came meanwhile and set its own timer
            return
        held, rests = self._held()
        out = [(r.rule_id, r.priority, key[0], None, at) for r in self._judge(held, rests, None, at)]
        for rule_id, until in rests.items():
            self.rests.updateValue((rule_id,), (until,))
        yield _fired(out)

    def close(self) -> None:
        pass


def _fired(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["rule_id", "priority", "entity_id", "event_id", "at"])


def rule_stream(events: DataFrame, rules: list[Rule], absence: bool = False) -> DataFrame:
    """Firings of rules over a stream with entity_id, event_id, ``at`` (seconds) and the fields the rules name.

    Needs the RocksDB state store.  ``absence`` needs a watermark on ``events``.
    """
    grouped = events.groupBy("entity_id")
    return grouped.transformWithStateInPandas(RuleProcessor(rules, absence=absence), FIRED, "append", "EventTime" if absence else "None")
