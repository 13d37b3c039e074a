"""Predicates of rule leaves as columns.

Two-valued: a missing value, or one that does not convert to the type of the operand,
makes the leaf false, whatever the operator.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARE = {"GT": operator.gt, "GTE": operator.ge, "LT": operator.lt, "LTE": operator.le, "EQ": operator.eq, "NEQ": operator.ne}


def known(condition: Column) -> Column:
    """Unknown counts as false."""
    return F.coalesce(condition, F.lit(False))


def _typed(value: Column, operand) -> Column:
    """The value in the operand's type, or null."""
    if isinstance(operand, bool):
        return value.try_cast("boolean")
    return value.try_cast("double") if isinstance(operand, (int, float)) else value.try_cast("string")


def _literal(operand) -> Column:
    return F.lit(float(operand)) if isinstance(operand, (int, float)) and not isinstance(operand, bool) else F.lit(operand)


def compare(value: Column, op: str, operand) -> Column:
    """One leaf: ``value op operand``.  BETWEEN has both ends; CONTAINS minds case."""
    if op == "IN":
        return known(functools.reduce(operator.or_, (known(_typed(value, x) == _literal(x)) for x in operand), F.lit(False)))
    if op == "BETWEEN":
        low, high = operand
        return known(_typed(value, low).between(_literal(low), _literal(high)))
    if op == "CONTAINS":
        return known(value.try_cast("string").contains(F.lit(str(operand))))
    return known(_COMPARE[op](_typed(value, operand), _literal(operand)))


def combine(op: str, children: list[Column]) -> Column:
    """AND, OR or NOT of conditions that are true or false."""
    if op == "NOT":
        return ~children[0]
    return functools.reduce(operator.and_ if op == "AND" else operator.or_, children)


def compile_tree(node: dict, leaf) -> Column:
    """A tree as one condition; ``leaf`` gives the condition of a leaf node."""
    if node.get("operator") in ("AND", "OR", "NOT"):
        return combine(node["operator"], [compile_tree(c, leaf) for c in node["children"]])
    return leaf(node)
