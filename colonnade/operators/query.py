"""Scan, project, filter and limit."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from ..errors import QueryError
from ..plans.expression import Expression
from ..plans.predicate import named, where
from ..types import kind_of


def project(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The listed columns in order; none listed means all."""
    return df.select(*[named(df.schema, c) for c in columns]) if columns else df


def first_rows(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first ``n`` rows by ``order``, which should be unique: a top-n, not a sort of the table."""
    if n < 0:
        raise QueryError("a limit cannot be negative")
    return df.orderBy(*[named(df.schema, c) for c in order]).limit(n)


def query(df: DataFrame, condition: str | Expression | None = None, columns: list[str] | None = None, limit: int | None = None, order: list[str] | None = None) -> DataFrame:
    """Filter, then limit, then project. A limit without an order takes any rows."""
    for c in columns or []:
        named(df.schema, c)
    out = where(df, condition) if condition is not None else df
    if limit is not None:
        out = first_rows(out, limit, order) if order else out.limit(limit)
    return project(out, columns)


def info(df: DataFrame) -> DataFrame:
    """One row with the row count."""
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def in_utc(df: DataFrame) -> DataFrame:
    """``df`` with times as text in UTC to the microsecond, by Spark: a local time of the driver never comes in."""
    return df.select(*[utc_text(df, f.name).alias(f.name) if kind_of(f.dataType) == "date" else F.col(f"`{f.name}`") for f in df.schema])


def utc_text(df: DataFrame, column: str) -> Column:
    """A time column as RFC 3339 text that ends in Z; fractions of a second without trailing zeros. Days and times without zone count as UTC."""
    c = named(df.schema, column)
    if isinstance(df.schema[column].dataType, TimestampType):  # an instant: told in UTC whatever the session's zone
        c = F.timestamp_add("MICROSECOND", F.unix_micros(c), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.concat(F.replace(c.cast("timestamp_ntz").cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))


def as_text(value: object) -> str:
    """A cell as the command line prints it; times come as text."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, list):
        return "[" + ", ".join(map(as_text, value)) + "]"
    return str(value)


def as_table(columns: list[str], rows: Iterable, page: int = 1_000) -> Iterator[str]:
    """Lines of a text table of rows as they come: columns are as wide as the first ``page`` rows need, which is all that is held."""
    rows, n = iter(rows), 0
    while head := [[as_text(v) for v in r] for r in islice(rows, page)]:
        if not n:
            widths = [max([len(c), *(len(r[i]) for r in head)]) for i, c in enumerate(columns)]
            yield from (_line(columns, widths), "-+-".join("-" * w for w in widths))
        yield from (_line(r, widths) for r in head)
        n += len(head)
    if not n:
        yield from (" | ".join(columns), "-+-".join("-" * len(c) for c in columns))
    yield f"({n} rows)"


def _line(cells: list[str], widths: list[int]) -> str:
    return " | ".join(v.ljust(w) for v, w in zip(cells, widths, strict=True)).rstrip()
