"""Compilation of filter expressions to Spark columns.

The logic has two values: a comparison with a null cell is false, and NOT is the complement. NOT is
pushed down to the comparisons, so that what stands above them is plain AND and OR, which Parquet
scans take as pushed filters. Literals are matched to column types here; a mismatch is a constant,
never an implicit cast.
"""

from __future__ import annotations

import math
import re
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import QueryError
from ..types import kind_of, parse_date
from .expression import And, Compare, Expression, Not, Or, parse_filter

_OPPOSITE = {"=": "!=", "!=": "=", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}


def named(schema: StructType, column: str) -> Column:
    """A column by its exact name."""
    if column not in schema.fieldNames():
        raise QueryError(f"column '{column}' does not exist")
    return F.col(f"`{column}`")


def _operand(value: object, kind: str) -> object | None:
    """The literal as a value of the column's type; None if it has none."""
    if kind == "int" and isinstance(value, (int, float)) and not isinstance(value, bool):
        return value
    if kind == "float" and isinstance(value, (int, float)) and not isinstance(value, bool):
        return float(value)
    if kind == "boolean" and isinstance(value, bool):
        return value
    if kind == "string" and isinstance(value, str):
        return value
    if kind == "date":
        if isinstance(value, datetime):
            return value
        if isinstance(value, str):
            return parse_date(f"{value}T00:00:00Z" if re.fullmatch(r"\d{4}-\d\d-\d\d", value) else value)
    if kind.startswith("array<") and isinstance(value, list):
        return value
    return None


def _ordered(c: Column, op: str, value: object, kind: str) -> Column:
    if kind == "int" and isinstance(value, float):  # an integer bound with the same meaning
        if math.isnan(value):
            return F.lit(False)
        if math.isinf(value):
            return c.isNotNull() if (value > 0) == (op in ("<", "<=")) else F.lit(False)
        value = math.floor(value) if op in (">", "<=") else math.ceil(value)
    if kind == "int" and not -(2**63) <= value < 2**63:
        return c.isNotNull() if (value > 0) == (op in ("<", "<=")) else F.lit(False)
    v = _literal(value, kind)
    return {"<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v}[op]


def _literal(value: object, kind: str) -> Column:
    if kind == "date":
        return F.lit(value.astimezone(timezone.utc) if value.tzinfo else value.replace(tzinfo=timezone.utc))
    if kind.startswith("array<"):
        return F.array(*[F.lit(v) for v in value])
    return F.lit(value)


def _leaf(schema: StructType, e: Compare, negated: bool) -> Column:
    c = named(schema, e.column)
    kind = kind_of(schema[e.column].dataType)
    op = e.op
    if e.value is None:
        if op in ("=", "!="):
            return c.isNull() if (op == "=") != negated else c.isNotNull()
        return F.lit(negated)
    value = _operand(e.value, kind)
    if op in ("=", "!="):
        if kind == "int" and isinstance(value, float):
            value = int(value) if value.is_integer() and -(2**63) <= value < 2**63 else None
        positive = (op == "=") != negated
        if value is None:
            return F.lit(not positive)
        if kind.startswith("array<"):
            same = F.coalesce(c.cast(schema[e.column].dataType) == _literal(value, kind).cast(schema[e.column].dataType), F.lit(False))
            return same if positive else ~same
        v = _literal(value, kind)
        return c == v if positive else (c != v) | c.isNull()
    if value is None or kind.startswith("array<"):
        return F.lit(negated)
    if negated:
        return _ordered(c, _OPPOSITE[op], value, kind) | c.isNull()
    return _ordered(c, op, value, kind)


def compile_predicate(schema: StructType, e: Expression, negated: bool = False) -> Column:
    """A column that is true exactly on the rows that ``e`` selects (or does not, if negated) and false or null elsewhere."""
    if isinstance(e, Not):
        return compile_predicate(schema, e.inner, not negated)
    if isinstance(e, Compare):
        return _leaf(schema, e, negated)
    left, right = compile_predicate(schema, e.left, negated), compile_predicate(schema, e.right, negated)
    return left & right if isinstance(e, And) != negated else left | right


def where(df: DataFrame, condition: str | Expression, negated: bool = False) -> DataFrame:
    """The rows that a filter selects, or all others."""
    e = parse_filter(condition) if isinstance(condition, str) else condition
    return df.filter(compile_predicate(df.schema, e, negated))


def evaluate(e: Expression, row: dict, kinds: dict[str, str]) -> bool:
    """The same rule on one row in plain Python."""
    if isinstance(e, And):
        return evaluate(e.left, row, kinds) and evaluate(e.right, row, kinds)
    if isinstance(e, Or):
        return evaluate(e.left, row, kinds) or evaluate(e.right, row, kinds)
    if isinstance(e, Not):
        return not evaluate(e.inner, row, kinds)
    cell, kind = row[e.column], kinds[e.column]
    if e.op == "!=":
        return not evaluate(Compare(e.column, "=", e.value), row, kinds)
    if e.value is None or cell is None:
        return e.op == "=" and e.value is None and cell is None
    value = _operand(e.value, kind)
    if value is None:
        return False
    if kind == "date" and isinstance(cell, str):
        cell = parse_date(cell)
    if e.op == "=":
        return cell == value
    if kind.startswith("array<"):
        return False
    return {"<": cell < value, "<=": cell <= value, ">": cell > value, ">=": cell >= value}[e.op]
