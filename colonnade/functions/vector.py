"""Vector measures as built-in expressions: nothing leaves the JVM.

Null elements count as 0. Up to ``UNROLL`` dimensions the sums are written out, which Spark compiles;
beyond it they fold over the array.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

UNROLL = 128


def _element(c: Column, i: int) -> Column:
    return F.coalesce(F.get(c, F.lit(i)).cast("double"), F.lit(0.0))


def _sum(terms: list[Column]) -> Column:
    while len(terms) > 1:  # a balanced tree keeps the expression shallow
        terms = [a + b for a, b in zip(terms[::2], terms[1::2], strict=False)] + ([terms[-1]] if len(terms) % 2 else [])
    return terms[0] if terms else F.lit(0.0)


def _fold(c: Column, query: Sequence[float], term) -> Column:
    if len(query) <= UNROLL:
        return _sum([term(_element(c, i), F.lit(float(q))) for i, q in enumerate(query)])
    q = F.array(*[F.lit(float(x)) for x in query])
    return F.aggregate(F.zip_with(c, q, lambda x, y: term(F.coalesce(x.cast("double"), F.lit(0.0)), y)), F.lit(0.0), lambda s, x: s + x)


def dot(c: Column, query: Sequence[float]) -> Column:
    return _fold(c, query, lambda x, q: x * q)


def cosine_similarity(c: Column, query: Sequence[float]) -> Column:
    """Cosine of the angle to ``query``; 0.0 if either vector has norm 0."""
    norm = math.sqrt(sum(float(x) ** 2 for x in query))
    own = F.sqrt(_fold(c, query, lambda x, _: x * x))
    return F.when(own * norm == 0, F.lit(0.0)).otherwise(dot(c, query) / F.when(own * norm != 0, own * norm))


def euclidean_distance(c: Column, query: Sequence[float]) -> Column:
    return F.sqrt(_fold(c, query, lambda x, q: (x - q) * (x - q)))
