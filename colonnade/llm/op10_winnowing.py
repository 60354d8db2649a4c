"""Document fingerprints by winnowing: k-gram hashes, the minimum of each window, rightmost on ties.

Hashes are of code points, 32 bits wide. Any passage of at least ``k + window - 1`` code points
that two texts share gives both at least one equal (hash, position in the passage). Positions are
kept by ``winnow``; the fingerprint string lists the chosen hashes in text order, 8 hex digits
each. A text shorter than ``k`` has one hash, of the whole text; an empty or null text has none. With
``K`` and ``WINDOW`` the passage is of 20 code points: a text of 27 or more whose first three quarters stay
shares a hash with what it becomes. Shorter ones may share none.
Likeness is the Jaccard similarity of the hash sets, 1.0 for two empty sets.

``with_next`` pairs each document with the next in ascending doc_id (nulls first, ties by text
hash; the last one's next is the first): documents are dealt to doc_id ranges, one a task, and each range gets
a copy of the following range's first document; a doc_id that fills several ranges is split by text hash. A single document's next is itself. An empty
table gives an empty result; columns other than doc_id and text are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, documents, map_arrow, mix, partitions, prefix_hash, range_bounds, range_bucket, sliding_min, span_hash

K, WINDOW = 8, 13
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def winnow(texts: list[np.ndarray], k: int = K, window: int = WINDOW) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes as uint32, positions) chosen in each text, given as arrays of code points."""
    lengths = np.array([len(t) for t in texts], np.int64)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    if not len(texts):
        return out
    codes = mix(np.concatenate(texts).astype(np.uint64) + np.uint64(1)) if lengths.sum() else np.zeros(0, np.uint64)
    prefix = prefix_hash(codes)
    first = np.concatenate([[0], np.cumsum(lengths)])
    grams = np.where(lengths == 0, 0, np.maximum(lengths - k + 1, 1))
    at = np.concatenate([[0], np.cumsum(grams)])
    total = int(at[-1])
    doc = np.repeat(np.arange(len(texts)), grams)
    inside = np.arange(total) - at[doc]
    start = first[doc] + inside
    hashes = span_hash(prefix, start, start + np.minimum(k, lengths[doc])) >> np.uint64(32)
    rank = (hashes << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(total, dtype=np.uint64))  # the rightmost of equal hashes is least
    low = np.uint64(0xFFFFFFFF)
    chosen = [np.zeros(0, np.int64)]
    if total >= window:
        full = (inside + window <= grams[doc])[: total - window + 1]
        chosen.append((low - (sliding_min(rank, window)[full] & low)).astype(np.int64))
    short = np.flatnonzero((grams > 0) & (grams < window))
    if len(short):
        bounds = np.stack([at[short], at[short + 1]], 1).ravel()
        least = np.minimum.reduceat(np.append(rank, np.uint64(0xFFFFFFFFFFFFFFFF)), bounds)[::2]
        chosen.append((low - (least & low)).astype(np.int64))
    keep = np.unique(np.concatenate(chosen))
    ends = np.searchsorted(keep, at)
    for i in range(len(texts)):
        own = keep[ends[i] : ends[i + 1]]
        out.append((hashes[own].astype(np.uint32), own - at[i]))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two arrays of hashes as sets."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
    return both / (len(a) + len(b) - both)


def as_string(hashes: np.ndarray) -> str:
    return hashes.astype(">u4").tobytes().hex()


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (bucket, last, doc_id, tie, text), dealt so that a document's next stands after it in its bucket.

    Rows with ``last`` true only close a bucket: they repeat the following bucket's first document.
    """
    n = 2 * partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = range_bounds(rows, "doc_id", n)
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("bucket", range_bucket("doc_id", "tie", bounds))
    heads = rows.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("set"), "doc_id", "tie", "text")).alias("head"))  # one row a range
    present = sorted(r[0] for r in rows.select("bucket").distinct().collect())
    before = docs.sparkSession.createDataFrame([(b, present[i - 1]) for i, b in enumerate(present)], "bucket int, before int")  # one row a range
    tails = heads.join(F.broadcast(before), "bucket").select(F.col("before").alias("bucket"), F.lit(True).alias("last"), "head.doc_id", "head.tie", "head.text")
    dealt = rows.select("bucket", F.lit(False).alias("last"), "doc_id", "tie", "text").unionByName(tails)
    return dealt.repartitionById(n, "bucket").sortWithinPartitions("bucket", "last", "doc_id", "tie")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema(SCHEMA)
    carried: list = []  # the last document seen, whose next is still to come, with its fingerprint
    rows: list = []

    def finish(rows: list, carried: list) -> tuple[list, list]:
        """Result rows for all of carried + rows but the last."""
        items = carried + [[*r, None] for r in rows]
        new = winnow([i[4] for i in items[len(carried) :]])
        for item, (h, _) in zip(items[len(carried) :], new, strict=True):
            item[5] = h
        pairs = [(a, b) for a, b in zip(items, items[1:], strict=False) if a[0] == b[0] and not a[1]]
        edited = []
        for a, b in pairs:
            quarter = len(a[4]) // 4
            edited.append(np.concatenate([a[4][: len(a[4]) - quarter], b[4][:quarter]]))
        out = []
        for (a, b), e, (h, _) in zip(pairs, edited, winnow(edited), strict=True):
            digest = hashlib.sha256(e.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest()
            out.append((a[2], len(a[4]), digest, as_string(a[5]), as_string(h), likeness(a[5], h), likeness(a[5], b[5])))
        return out, items[-1:]

    def batch_of(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    held = 0
    for batch in batches:
        for bucket, last, doc_id, _, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows.append([bucket, last, doc_id, None, code_points(text)])
            held += len(rows[-1][4])
            if held >= 1 << 19:
                out, carried = finish(rows, carried)
                rows, held = [], 0
                if out:
                    yield batch_of(out)
    out, _ = finish(rows, carried)
    if out:
        yield batch_of(out)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, with their likenesses; see the module."""
    return map_arrow(with_next(docs), _fingerprints, SCHEMA)


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(documents(spark, sf_dir))
