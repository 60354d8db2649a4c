"""count, sum, avg, min and max of one column, in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..plans.expression import Expression
from ..plans.predicate import named, where
from ..types import kind_of

FUNCTIONS = ("count", "sum", "avg", "min", "max")


def aggregate_column(df: DataFrame, column: str, function: str) -> Column:
    """The aggregate as a column. Nulls are skipped; of no values the sum and average are 0.0, the least and greatest null."""
    c, kind = named(df.schema, column), kind_of(df.schema[column].dataType)
    if function == "count":
        return F.count(c)
    if function in ("sum", "avg"):
        if kind not in ("int", "float"):
            raise QueryError(f"{function} needs a number column; '{column}' is {kind}")
        return F.coalesce((F.sum if function == "sum" else F.avg)(c.cast("double")), F.lit(0.0))
    if function in ("min", "max"):
        if kind not in ("int", "float", "string", "date"):
            raise QueryError(f"{function} does not apply to '{column}', which is {kind}")
        return (F.min if function == "min" else F.max)(c)
    raise QueryError(f"unknown function '{function}'")


def aggregate(df: DataFrame, column: str, functions: list[str] | str, condition: str | Expression | None = None, names: list[str] | None = None) -> DataFrame:
    """One row with a column per function, named after it or by ``names``."""
    functions = [f.strip().lower() for f in functions.split(",")] if isinstance(functions, str) else functions
    if not functions:
        raise QueryError("no function is given")
    if condition is not None:
        df = where(df, condition)
    return df.agg(*[aggregate_column(df, column, f).alias(n) for f, n in zip(functions, names or functions, strict=True)])
