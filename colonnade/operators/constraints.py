"""Primary key, unique and not-null constraints as queries for the rows that break them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import NotNullViolation, PrimaryKeyViolation, UniqueViolation
from ..plans.predicate import named


@dataclass
class Constraints:
    primary_key: str | None = None
    unique: list[str] = field(default_factory=list)
    not_null: list[str] = field(default_factory=list)
    defaults: dict[str, object] = field(default_factory=dict)


def duplicates(df: DataFrame, column: str) -> DataFrame:
    """(k, n): values, nulls left out, that more than one row has; partly counted before the shuffle."""
    c = named(df.schema, column)
    return df.where(c.isNotNull()).groupBy(c.alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def nulls(df: DataFrame, column: str) -> DataFrame:
    """Rows with a null where none may be."""
    return df.where(named(df.schema, column).isNull())


def check(df: DataFrame, rules: Constraints) -> None:
    """Raise on the first broken constraint; all null counts share one pass, each key takes one shuffle."""
    required = list(dict.fromkeys([*([rules.primary_key] if rules.primary_key else []), *rules.not_null]))
    if required:
        found = df.agg(*[F.count(F.when(named(df.schema, c).isNull(), 1)).alias(f"n{i}") for i, c in enumerate(required)]).first()
        for i, c in enumerate(required):
            if found[i]:
                raise PrimaryKeyViolation(c, None) if c == rules.primary_key else NotNullViolation(c)
    for c in dict.fromkeys([*([rules.primary_key] if rules.primary_key else []), *rules.unique]):
        if row := duplicates(df, c).first():
            raise PrimaryKeyViolation(c, row["k"]) if c == rules.primary_key else UniqueViolation(c, row["k"])


def check_new(base: DataFrame, new: DataFrame, rules: Constraints) -> None:
    """Raise if ``new`` breaks a constraint by itself or against ``base``, which holds already."""
    check(new, rules)
    for c in dict.fromkeys([*([rules.primary_key] if rules.primary_key else []), *rules.unique]):
        both = base.select(named(base.schema, c).alias("k")).join(new.select(named(new.schema, c).alias("k")).where("k is not null"), "k", "left_semi")
        if row := both.first():
            raise PrimaryKeyViolation(c, row["k"]) if c == rules.primary_key else UniqueViolation(c, row["k"])
