"""Exact column statistics in one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.predicate import named
from ..types import kind_of


def analyze_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column: column, row_count, null_count, distinct_count, min, max (as text). Arrays have no distinct count or bounds."""
    aggs = [F.count(F.lit(1)).alias("n")]
    columns = columns or df.columns
    for i, name in enumerate(columns):
        c, kind = named(df.schema, name), kind_of(df.schema[name].dataType)
        plain = not kind.startswith("array<")
        bounded = kind in ("int", "float", "string", "date")
        aggs += [F.count(c).alias(f"c{i}"), (F.count_distinct(c) if plain else F.lit(0).cast("long")).alias(f"d{i}")]
        aggs += [(f(c).cast("string") if bounded else F.lit(None).cast("string")).alias(f"{a}{i}") for f, a in ((F.min, "l"), (F.max, "h"))]
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(n).alias("column"), F.col("n").alias("row_count"), (F.col("n") - F.col(f"c{i}")).alias("null_count"), F.col(f"d{i}").alias("distinct_count"), F.col(f"l{i}").alias("min"), F.col(f"h{i}").alias("max")) for i, n in enumerate(columns)]
    return one.select(F.inline(F.array(*rows)))


def analyze_column(df: DataFrame, column: str) -> DataFrame:
    """row_count, null_count, distinct_count, min_v, max_v of one column, the bounds in its own type."""
    c = named(df.schema, column)
    return df.agg(
        F.count(F.lit(1)).alias("row_count"), (F.count(F.lit(1)) - F.count(c)).alias("null_count"),
        F.count_distinct(c).alias("distinct_count"), F.min(c).alias("min_v"), F.max(c).alias("max_v"),
    )


def collect_stats(df: DataFrame, columns: list[str] | None = None) -> dict[str, dict]:
    """Statistics by column with bounds of number columns as numbers; the driver gets one row a column."""
    kinds = {f.name: kind_of(f.dataType) for f in df.schema}
    out = {}
    for r in analyze_columns(df, columns).collect():
        number = {"int": int, "float": float}.get(kinds[r["column"]])
        low, high = (None if r[k] is None else number(r[k]) if number else r[k] for k in ("min", "max"))
        out[r["column"]] = {"row_count": r["row_count"], "null_count": r["null_count"], "distinct_count": r["distinct_count"], "min": low, "max": high, "valid": True}
    return out
