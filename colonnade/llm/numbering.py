"""Dense row numbers 0..N-1 of a table in a stated order, without gathering rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions, starts_of, unused

_IN_PARTITION = (1 << 33) - 1


def number_rows(df: DataFrame, order: list[str], column: str = "row_no") -> tuple[DataFrame, int]:
    """``df`` with a long ``column`` that counts its rows in ``order`` (nulls first), and the row count.

    The rows are range-partitioned, sorted and written to the shared folder with their place in
    the partition, so the numbers are fixed once, however often tasks are repeated. The driver
    holds one count per partition. Rows equal in ``order`` get neighbouring numbers. Other columns
    are carried, whatever their names; one named as ``column`` is replaced.
    """
    place, part, before = unused(df, "place", "part", "before")
    n = max(partitions(df.sparkSession), 1)
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id())
    placed = materialize(placed, "numbered").withColumn(part, F.shiftright(place, 33).cast("int"))
    sizes = placed.groupBy(F.col(part).alias("part")).agg(F.count("*").alias("n"))
    found = sizes.agg(F.sum("n")).first()[0] or 0
    starts = F.broadcast(starts_of(sizes, "part", "n").withColumnsRenamed({"part": part, "before": before}))  # one row a partition
    numbered = placed.join(starts, part).withColumn(column, F.col(before) + F.col(place).bitwiseAND(F.lit(_IN_PARTITION)))
    kept = [c for c in df.columns if c.lower() != column.lower()]
    return numbered.select(*[F.col(f"`{c}`") for c in kept], column), found
