"""Plain evaluation of condition trees, for state that Python holds.

The same two-valued reading as the columns in ``functions.predicates``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from .rules import is_leaf


def _as(value, operand):
    """The value in the operand's type, or None."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(operand, bool):
        if isinstance(value, str):
            return {"true": True, "t": True, "yes": True, "y": True, "1": True, "false": False, "f": False, "no": False, "n": False, "0": False}.get(value.strip().lower())
        return bool(value)
    if isinstance(operand, (int, float)):
        try:
            return float(value)
        except (TypeError, ValueError):
            return None
    return str(value).lower() if isinstance(value, bool) else str(value)


def compare(value, op: str, operand) -> bool:
    """One leaf; false for what is missing or does not convert."""
    if op == "IN":
        return any(compare(value, "EQ", x) for x in operand)
    if op == "BETWEEN":
        return compare(value, "GTE", operand[0]) and compare(value, "LTE", operand[1])
    if op == "CONTAINS":
        return value is not None and str(operand) in str(value)
    found = _as(value, operand)
    if found is None:
        return False
    return {"GT": found > operand, "GTE": found >= operand, "LT": found < operand, "LTE": found <= operand, "EQ": found == operand, "NEQ": found != operand}[op]


def holds(node: dict, leaf: Callable[[dict], bool]) -> bool:
    """A tree, given the truth of its leaves."""
    if is_leaf(node):
        return leaf(node)
    found = (holds(c, leaf) for c in node["children"])
    return {"AND": all, "OR": any, "NOT": lambda x: not next(x)}[node["operator"]](found)
