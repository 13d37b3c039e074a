"""Rules: condition trees with their settings, and what makes a tree well-formed."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from .fields import FUNCTIONS, Field, dictionary

BUCKET_SECONDS = 300
LONGEST_SECONDS = 86_400
LOGICAL = ("AND", "OR", "NOT")
COMPARISONS = ("GT", "GTE", "LT", "LTE", "EQ", "NEQ")
RAW_OPERATORS = (*COMPARISONS, "IN", "BETWEEN", "CONTAINS")


@dataclass(frozen=True)
class Rule:
    rule_id: str
    name: str
    tree: dict
    priority: int = 0
    cooldown_seconds: int = 0
    version: int = 1
    enabled: bool = True

    @classmethod
    def from_row(cls, row) -> Rule:
        return cls(row["rule_id"], row["name"], json.loads(row["rule_json"]), row["priority"], row["cooldown_seconds"], row["version"], row["enabled"])


def _window(kind: str, size: int, slide: int) -> dict:
    return {"type": kind, "size_seconds": size, "slide_seconds": slide}


def aggregate(field: str, function: str, size: int, operator: str, value: float, source: str | None = None, where: dict | None = None, slide: int | None = None) -> dict:
    """An aggregate leaf; sliding by a bucket unless ``slide`` equals ``size``."""
    slide = BUCKET_SECONDS if slide is None else slide
    out = {"type": "AGGREGATION", "field": field, "function": function, "window": _window("tumbling" if slide == size else "sliding", size, slide), "operator": operator, "value": value}
    return out | ({"source_system": source} if source else {}) | ({"filter": where} if where else {})


def raw(field: str, operator: str, value) -> dict:
    return {"type": "RAW_FIELD", "field": field, "operator": operator, "value": value}


def every(*children: dict) -> dict:
    return {"operator": "AND", "children": list(children)}


def some(*children: dict) -> dict:
    return {"operator": "OR", "children": list(children)}


def none(child: dict) -> dict:
    return {"operator": "NOT", "children": [child]}


def is_leaf(node: dict) -> bool:
    return node.get("operator") not in LOGICAL


def leaves(node: dict) -> Iterator[dict]:
    if is_leaf(node):
        yield node
    else:
        for child in node["children"]:
            yield from leaves(child)


def errors(node: dict, fields: dict[str, Field] | None = None) -> list[str]:
    """What is wrong with a tree; empty if it is well-formed."""
    fields = dictionary() if fields is None else fields
    if not isinstance(node, dict):
        return ["a node must be an object"]
    if not is_leaf(node):
        children = node.get("children")
        if not isinstance(children, list) or not children:
            return [f"{node['operator']} needs children"]
        found = [e for c in children for e in errors(c, fields)]
        return ["NOT takes one child", *found] if node["operator"] == "NOT" and len(children) != 1 else found
    out = []
    field = fields.get(node.get("field"))
    if field is None:
        out.append(f"unknown field {node.get('field')!r}")
    if node.get("type") != "AGGREGATION":
        if node.get("operator") not in RAW_OPERATORS:
            out.append(f"operator {node.get('operator')!r} is not for raw fields")
        elif node["operator"] == "IN" and not isinstance(node.get("value"), list):
            out.append("IN takes a list")
        elif node["operator"] == "BETWEEN" and not (isinstance(node.get("value"), list) and len(node["value"]) == 2):
            out.append("BETWEEN takes two values")
        return out
    if node.get("operator") not in COMPARISONS:
        out.append(f"operator {node.get('operator')!r} is not for aggregates")
    function = node.get("function")
    if function not in FUNCTIONS:
        out.append(f"unknown function {function!r}")
    elif field is not None and function.lower() not in field.strategies:
        out.append(f"{function} is not supported for {field.name}")
    window = node.get("window") or {}
    for part in ("size_seconds", "slide_seconds"):
        value = window.get(part)
        if not isinstance(value, int) or value % BUCKET_SECONDS or not BUCKET_SECONDS <= value <= LONGEST_SECONDS:
            out.append(f"{part} must be a multiple of {BUCKET_SECONDS} up to {LONGEST_SECONDS}")
    if window.get("type") not in ("tumbling", "sliding"):
        out.append("a window is tumbling or sliding")
    elif window["type"] == "tumbling" and window.get("size_seconds") != window.get("slide_seconds"):
        out.append("a tumbling window slides by its size")
    if node.get("filter"):
        out += errors({"type": "RAW_FIELD", **node["filter"]}, fields)
    return out
