"""Inner equi-join of two tables on one column each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..plans.predicate import named
from ..types import kind_of
from .query import utc_text

#: A table of fewer bytes a core may come in fewer partitions than there are cores.
DEALT_BYTES = 32 << 20


def parse_on(text: str) -> tuple[str, str]:
    """``left=right`` as a pair of names."""
    left, equals, right = (x.strip() for x in text.partition("="))
    if not (left and equals and right):
        raise QueryError("a join condition has the form left=right")
    return left, right


def text_key(df: DataFrame, column: str) -> Column:
    """A key as text: whole floats without a point, others in decimals (18 places), times in UTC, null as ``null``."""
    c, kind = named(df.schema, column), kind_of(df.schema[column].dataType)
    if kind == "float":
        plain = F.regexp_replace(c.try_cast("decimal(38,18)").cast("string"), r"\.?0*$", "")
        text = F.coalesce(plain, c.cast("string"))
    else:
        text = utc_text(df, column) if kind == "date" else c.cast("string")
    return F.coalesce(text, F.lit("null"))


def _bytes(df: DataFrame) -> int:
    """Spark's estimate; nothing is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _dealt(df: DataFrame) -> DataFrame:
    """A small table's rows over all cores, whose files may be fewer; a large one has its own partitions."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if _bytes(df) < cores * DEALT_BYTES else df


def inner_join(left: DataFrame, right: DataFrame, left_column: str, right_column: str, null_as_text: bool = False, as_text: bool = False) -> DataFrame:
    """All pairs of rows with equal keys; columns get the prefixes ``left_`` and ``right_``.

    Null keys are equal to each other; with ``null_as_text`` they also equal the string ``null``. Keys
    must have one type unless ``as_text`` compares them as text, so that 1, 1.0 and the string 1 are equal. Array keys match nothing. Spark picks the strategy by measured size and
    splits skewed keys; nothing is broadcast by hint. A join as text has few keys with many rows each: its larger side is dealt over all cores, however few files it comes from.
    """
    l_key, r_key = named(left.schema, left_column), named(right.schema, right_column)
    l_kind, r_kind = kind_of(left.schema[left_column].dataType), kind_of(right.schema[right_column].dataType)
    arrays = l_kind.startswith("array<") or r_kind.startswith("array<")
    if as_text and not arrays:
        l_key, r_key, l_kind, r_kind = text_key(left, left_column), text_key(right, right_column), "string", "string"
    if l_kind != r_kind and not as_text:
        raise QueryError(f"join keys differ in type: {l_kind} and {r_kind}")
    l = left.select(l_key.alias("_left_key"), *[F.col(f"`{c}`").alias(f"left_{c}") for c in left.columns])  # noqa: E741
    r = right.select(r_key.alias("_right_key"), *[F.col(f"`{c}`").alias(f"right_{c}") for c in right.columns])
    if as_text and not arrays:
        l, r = (_dealt(l), r) if _bytes(l) > _bytes(r) else (l, _dealt(r))  # noqa: E741
    if arrays:
        same = F.lit(False)
    elif null_as_text and l_kind == "string":
        same = F.coalesce("_left_key", F.lit("null")) == F.coalesce("_right_key", F.lit("null"))
    else:
        same = F.col("_left_key").eqNullSafe(F.col("_right_key"))
    return l.join(r, same, "inner").drop("_left_key", "_right_key")
