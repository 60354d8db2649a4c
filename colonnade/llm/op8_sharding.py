"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

The permutation is a keyed bijection of 0..N-1, so shard and slot of a row are computed from its
number alone, and a row's number from its shard and slot. Law ``rows``: shard = p mod shards and
slot = p div shards, so counts differ by one at most and slots have no gaps.

Defined cases: null or empty text has size 1 and CRC 0; rows with a null doc_id come first in the
order; repeated rows are placed one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, mix, unused
from .numbering import number_rows

SHARDS, SEED, ROUNDS = 16, 20240117, 6


class Feistel:
    """A keyed bijection of 0..n-1 on numpy arrays."""

    def __init__(self, n: int, seed: int = SEED, rounds: int = ROUNDS):
        if n < 1:
            raise ValueError("n must be at least 1")
        self.n = n
        self.bits = max(1, ((n - 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.bits) - 1)
        self.keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64))

    def _walk(self, x: np.ndarray, keys: np.ndarray, forward: bool) -> np.ndarray:
        out = np.asarray(x).astype(np.uint64)
        todo = np.arange(len(out))
        shift = np.uint64(self.bits)
        while len(todo):  # a value outside 0..n-1 is permuted again; cycles are finite, so this ends
            v = out[todo]
            left, right = v >> shift, v & self.mask
            for key in keys:
                if forward:
                    left, right = right, left ^ (mix(right ^ key) & self.mask)
                else:
                    left, right = right ^ (mix(left ^ key) & self.mask), left
            v = (left << shift) | right
            out[todo] = v
            todo = todo[v >= self.n]
        return out.astype(np.int64)

    def forward(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, self.keys, True)

    def inverse(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, self.keys[::-1], False)


def place_of(row_no: np.ndarray, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(shard, slot) of row numbers in a table of ``n`` rows."""
    p = Feistel(n, seed).forward(row_no)
    return p % shards, p // shards


def row_at(shard: np.ndarray, slot: np.ndarray, n: int, shards: int = SHARDS, seed: int = SEED) -> np.ndarray:
    """The row number that stands at a shard's slot."""
    return Feistel(n, seed).inverse(np.asarray(slot) * shards + np.asarray(shard))


def shard_rows(df: DataFrame, order: list[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``df`` with ``row_no``, ``shard`` and ``slot``, which replace columns so named; ``order`` fixes the row numbers."""
    numbered, n = number_rows(df, order)
    [p] = unused(numbered, "p")
    cipher = Feistel(max(n, 1), seed)

    @F.pandas_udf("long")
    def permuted(s):
        import pandas as pd

        return pd.Series(cipher.forward(s.to_numpy()))

    return numbered.withColumn(p, permuted("row_no")).withColumn("shard", (F.col(p) % shards).cast("int")).withColumn("slot", F.expr(f"{p} div {shards}")).drop(p)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents(spark, sf_dir).select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("tie"))
    placed = shard_rows(rows, ["doc_id", "tie"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
