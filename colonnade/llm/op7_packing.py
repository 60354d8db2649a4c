"""Sum-of-squares packing of token sequences.

Documents are tokenised where they lie, with the end id appended; only documents over the capacity
are cut, into full pieces and a last, shorter one. What moves is one small row a piece. Full pieces
are sequences by themselves. The others are dealt by hash to shards of about ``SHARD_PIECES``
pieces; a shard is packed by one task, largest pieces first: each piece goes where the sum over
gaps g of (open sequences with g free places)**2 becomes smallest, a new sequence included; on
ties into the smaller gap. Each shard leaves a few sequences part-filled, so the number of sequences grows by a
few per ``SHARD_PIECES`` pieces over one packing of all, whatever the table's size.

Defined cases: a null or empty text has only the end id; repeated rows are packed one by one; an
empty table gives an empty result; extra columns are not carried. Sequence ids are unique, not
dense.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, blocks, documents, map_arrow, materialize
from .op5_token_files import END_ID, vocabulary
from .tokens import TOKEN_BLOCK, encoder, ids_of

CAPACITY = 4096
#: Pieces that one task packs; an array of so many rows is all that it holds.
SHARD_PIECES = 100_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, deal long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row a piece; ``deal`` is a hash that depends on the piece's content only."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(PIECES)
        enc = encoder(path)
        for batch in batches:
            for part in blocks([batch], most=TOKEN_BLOCK):
                rows = []
                for doc, tokens in zip(part.column(0).to_pylist(), ids_of(enc, part.column(1)), strict=True):
                    ids = np.append(tokens, END_ID).astype("<u4")
                    for piece, at in enumerate(range(0, len(ids), capacity)):
                        own = ids[at : at + capacity]
                        crc = zlib.crc32(own.tobytes())
                        deal = zlib.crc32(f"{doc},{piece},{crc}".encode())
                        rows.append((doc, piece, at, len(own), crc, deal))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), cut, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, packed in the given order.

    Putting a piece of s into a gap g lowers count[g] by one and raises count[g - s] by one, which
    changes the sum of squares by 2 * (count[g - s] - count[g]) + 2; a full sequence has no gap and is
    not counted, and a new sequence only raises count[capacity - s].
    """
    count = np.zeros(capacity + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    used, none = 0, np.int64(1) << 60
    for i, s in enumerate(np.asarray(lengths).tolist()):
        here = count[s:]
        change = 2 * (count[: capacity + 1 - s] - here) + 2
        change[0] = 1 - 2 * here[0]
        change[here == 0] = none
        change[capacity - s] = 2 * count[capacity - s] + 1 if s < capacity else 0
        gap = s + int(np.argmin(change))
        if gap == capacity:
            bin_, used = used, used + 1
        else:
            bin_ = open_at[gap].pop()
            count[gap] -= 1
        if gap > s:
            open_at[gap - s].append(bin_)
            count[gap - s] += 1
        sequence[i], offset[i] = bin_, capacity - gap
    return sequence, offset


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Sequence and offset for each row of ``cut_pieces``."""
    spark = pieces.sparkSession
    pieces = materialize(pieces, "pieces")
    shards = max(1, -(-pieces.where(F.col("length") < capacity).count() // shard_pieces))
    full = pieces.where(F.col("length") >= capacity).select("*", F.monotonically_increasing_id().alias("k"))
    full = full.select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    def packed(key, table):
        shard = key[0].as_py()
        table = table.sort_by([("length", "descending"), ("deal", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
        sequence, offset = sum_of_squares(table.column("length").to_numpy(), capacity)
        out = table.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        return out.append_column("sequence_id", pa.array(sequence + (shard << 40))).append_column("offset", pa.array(offset))

    rest = pieces.where(F.col("length") < capacity).withColumn("shard", F.pmod(F.col("deal"), F.lit(shards)))
    return full.unionByName(rest.groupBy("shard").applyInArrow(packed, PACKED))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(cut_pieces(documents(spark, sf_dir), vocabulary()))
