"""Insert, update, delete and add-column as functions from DataFrames to DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InsertError, NotNullViolation, PrimaryKeyViolation, QueryError, SchemaError, TypeMismatch
from ..plans.expression import Expression, parse_filter
from ..plans.predicate import compile_predicate, named, where
from ..types import SPARK, accepts, kind_of, to_spark
from .constraints import Constraints, check, check_new


def rows_frame(spark: SparkSession, schema: T.StructType, rows: list[dict], rules: Constraints | None = None) -> DataFrame:
    """JSON rows as a DataFrame of ``schema``: defaults fill missing keys, never explicit nulls; then keys and types must match exactly."""
    defaults = rules.defaults if rules else {}
    names, out = schema.fieldNames(), []
    for i, row in enumerate(rows):
        if not isinstance(row, dict):
            raise InsertError(f"row {i} is not an object")
        full = {**{c: v for c, v in defaults.items() if c not in row and c in names}, **row}
        if missing := [c for c in names if c not in full]:
            raise InsertError(f"row {i} lacks column '{missing[0]}'")
        if extra := [c for c in full if c not in names]:
            raise InsertError(f"row {i} has unknown column '{extra[0]}'")
        cells = []
        for f in schema:
            kind = kind_of(f.dataType)
            if not accepts(full[f.name], kind):
                raise TypeMismatch(f.name, i, kind, type(full[f.name]).__name__)
            cells.append(to_spark(full[f.name], kind))
        out.append(tuple(cells))
    return spark.createDataFrame(out, T.StructType([T.StructField(f.name, f.dataType, True) for f in schema]))


def insert(df: DataFrame, new: DataFrame | list[dict], rules: Constraints | None = None) -> DataFrame:
    """``df`` and the new rows, all or nothing; raises on a broken constraint."""
    rules = rules or Constraints()
    if isinstance(new, list):
        new = rows_frame(df.sparkSession, df.schema, new, rules)
    elif set(new.columns) != set(df.columns):
        raise InsertError("the new rows' columns differ from the table's")
    check_new(df, new, rules)
    return df.unionByName(new)


def fill_defaults(new: DataFrame, schema: T.StructType, defaults: dict[str, object]) -> DataFrame:
    """``new`` with the table's missing columns added from ``defaults``; a missing one without a default is an error."""
    for f in schema:
        if f.name not in new.columns:
            if f.name not in defaults:
                raise InsertError(f"column '{f.name}' is missing and has no default")
            new = new.withColumn(f.name, F.lit(to_spark(defaults[f.name], kind_of(f.dataType))).cast(f.dataType))
    return new.select(*schema.fieldNames())


def delete(df: DataFrame, condition: str | Expression) -> DataFrame:
    """The rows that the filter does not select, which includes those with null cells in it."""
    return where(df, condition, negated=True)


def assignments(schema: T.StructType, values: dict[str, object], rules: Constraints) -> dict[str, object]:
    """Typed values of an update; raises on unknown columns, wrong types and nulls where none may be."""
    out = {}
    for c, v in values.items():
        if c not in schema.fieldNames():
            raise QueryError(f"column '{c}' does not exist")
        kind = kind_of(schema[c].dataType)
        if not accepts(v, kind):
            raise TypeMismatch(c, 0, kind, type(v).__name__)
        if v is None and c == rules.primary_key:
            raise PrimaryKeyViolation(c, None)
        if v is None and c in rules.not_null:
            raise NotNullViolation(c)
        out[c] = to_spark(v, kind)
    return out


def update(df: DataFrame, condition: str | Expression, values: dict[str, object], rules: Constraints | None = None) -> DataFrame:
    """Constant values set on the selected rows; keys are checked on the result."""
    rules = rules or Constraints()
    e = parse_filter(condition) if isinstance(condition, str) else condition
    p = compile_predicate(df.schema, e)
    typed = assignments(df.schema, values, rules)
    out = df.withColumns({c: F.when(p, F.lit(v).cast(df.schema[c].dataType)).otherwise(named(df.schema, c)) for c, v in typed.items()})
    keys = Constraints(rules.primary_key if rules.primary_key in typed else None, [c for c in rules.unique if c in typed])
    if keys.primary_key or keys.unique:
        check(out, keys)
    return out


def add_column(df: DataFrame, name: str, kind: str | T.DataType) -> DataFrame:
    """A new last column of nulls."""
    if name in df.columns:
        raise SchemaError(f"column '{name}' exists")
    if isinstance(kind, str) and kind not in SPARK:
        raise SchemaError(f"unknown type '{kind}'")
    return df.withColumn(name, F.lit(None).cast(SPARK[kind] if isinstance(kind, str) else kind))
