"""Filters written as dictionaries, compiled to column expressions.

Two dialects: document filters (``{"age": {"$gte": 30}, "city": "Oslo"}``) over
JSON text, and condition trees (``{"operator": "AND", "operands": [...]}`` with
``{"column", "operator", "value"}`` leaves) over columns.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

Path = Callable[[str], Column]


def json_path(path: str) -> str:
    """``a.b[0]`` or ``a.b.0`` as a JSON path."""
    return "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in re.findall(r"[^.\[\]]+", path))


def from_json_text(doc: Column) -> Path:
    """Accessor of the values of a JSON text as text."""
    return lambda path: F.get_json_object(doc, json_path(path))


def _typed(value: Column, example: Any) -> Column:
    """A JSON value in the type it is compared with; null where it has another type."""
    if isinstance(example, bool):
        return value.try_cast("boolean")
    if isinstance(example, (int, float)):
        return value.try_cast("double")
    return value


def document_filter(spec: dict[str, Any], at: Path) -> Column:
    """AND of all fields. A bare value means equality. An empty filter matches every document.

    ``$ne`` and ``$nin`` match documents that lack the field, the other
    comparisons do not; zero, false and empty texts compare like other values.
    """
    tests = []
    for field, want in spec.items():
        if field in ("$and", "$or"):
            parts = [document_filter(s, at) for s in want]
            tests.append(reduce(Column.__and__ if field == "$and" else Column.__or__, parts, F.lit(field == "$and")))
            continue
        if field == "$not":
            tests.append(~document_filter(want, at))
            continue
        ops = want if isinstance(want, dict) and want and all(k.startswith("$") for k in want) else {"$eq": want}
        tests += [_test(op, at(field), x) for op, x in ops.items()]
    return reduce(Column.__and__, tests, F.lit(True))


def _test(op: str, value: Column, x: Any) -> Column:
    no = lambda c: F.coalesce(c, F.lit(False))
    if op == "$exists":
        return value.isNotNull() if x else value.isNull()
    if op == "$in":
        return reduce(Column.__or__, [_test("$eq", value, y) for y in x], F.lit(False))
    if op == "$nin":
        return ~_test("$in", value, x)
    if op == "$regex":
        return no(value.rlike(x))
    if x is None:
        return value.isNull() if op == "$eq" else value.isNotNull()
    v = _typed(value, x)
    compared = {"$eq": v == F.lit(x), "$ne": v == F.lit(x), "$gt": v > F.lit(x), "$gte": v >= F.lit(x), "$lt": v < F.lit(x), "$lte": v <= F.lit(x)}
    if op not in compared:
        raise ValueError(f"unknown operator {op}")
    return ~no(compared[op]) if op == "$ne" else no(compared[op])


_LEAVES: dict[str, Callable[[Column, Any], Column]] = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    "<>": lambda c, v: c != v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    "LIKE": lambda c, v: c.like(v),
    "ILIKE": lambda c, v: c.ilike(v),
    "IN": lambda c, v: c.isin(*v) if v else F.lit(False),
    "NOT IN": lambda c, v: ~c.isin(*v) if v else F.lit(True),
    "BETWEEN": lambda c, v: c.between(*v),
    "IS NULL": lambda c, v: c.isNull(),
    "IS NOT NULL": lambda c, v: c.isNotNull(),
}


def condition(tree: dict[str, Any]) -> Column:
    """A condition tree as a column, nested to any depth, with SQL's handling of nulls."""
    op = tree["operator"].upper()
    if op in ("AND", "OR"):
        return reduce(Column.__and__ if op == "AND" else Column.__or__, map(condition, tree["operands"]), F.lit(op == "AND"))
    if op == "NOT":
        return ~condition(tree["operands"][0])
    if op not in _LEAVES:
        raise ValueError(f"unknown operator {op}")
    return _LEAVES[op](F.col(tree["column"]), tree.get("value"))
