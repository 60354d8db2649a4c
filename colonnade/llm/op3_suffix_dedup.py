"""Removal of repeated passages: every byte that a string of ``length`` bytes starting elsewhere too covers.

Such a string, of 400 bytes unless asked otherwise, has one anchor: the least-hashed of its substrings of ``gram`` bytes (256), the leftmost on
ties. Equal strings have equal anchors at equal offsets, so the strings under one anchor hash can
be compared apart from all others. An anchor's neighbouring strings form its context, at most 2 * length - gram bytes (544).

1. Each distinct text is kept once, with its number of copies.
2. Anchors and their contexts' hashes come from one pass. Contexts that are equal as a whole are
   settled: all their bytes are repeated. Those of one map block are settled there.
3. For anchor hashes with several different contexts, the contexts' bytes are gathered, whole groups at a time,
   into enhanced suffix arrays. The common-prefix interval tree gives all maximal repeats of ``length`` bytes or more
   with all their occurrences.
4. An anchor hash with over ``HOT`` different contexts, such as a passage in a third of all
   documents, is not gathered: its strings are counted by digest, pre-aggregated by
   map block. This path has no array, because a group of unbounded size has no place in one task.
5. The marked bytes are removed from each text, and rows get their text's result.

Equality is that of two 64-bit hashes together wherever bytes are not compared.

Defined cases: a null or empty text has nothing to remove; a text shorter than ``length`` keeps all;
repeated rows count as occurrences of each other; an empty table gives an empty result. Columns are
addressed by name, and ``deduplicate`` carries the others, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, byte_codes, discard, documents, map_arrow, materialize, partitions, prefix_hash, release, sliding_min, span_hash, text_bytes, unused
from .suffix_array import SuffixArray

LENGTH = 400
GRAM = 256
#: Different contexts of an anchor hash up to which they are gathered.
HOT = 512
#: Bytes of contexts in one suffix array.
ARRAY_BYTES = 1 << 20
_LOW = np.uint64(0xFFFFFFFF)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, first start, last start, anchor hash, context hash) of each anchor in a block of texts."""
    sizes = np.diff(offsets)
    prefix = prefix_hash(byte_codes(data))
    n, span = len(data) - gram + 1, length - gram + 1
    none = np.zeros(0, np.int64)
    if n < span or sizes.max(initial=0) < length:
        return none, none, none, none, none
    at = np.arange(n)
    hashes = span_hash(prefix, at, at + gram)
    best = sliding_min(((hashes >> np.uint64(32)) << np.uint64(32)) | at.astype(np.uint64), span) & _LOW
    text = np.repeat(np.arange(len(sizes)), sizes)[: len(best)]
    starts = np.flatnonzero(np.arange(len(best)) + length <= offsets[text + 1])
    chosen, owner = best[starts].astype(np.int64), text[starts]
    head = np.flatnonzero(np.append(True, (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])))
    first, last = starts[head], starts[np.append(head[1:], len(starts)) - 1]
    return owner[head], first - offsets[owner[head]], last - offsets[owner[head]], hashes[chosen[head]].view(np.int64), span_hash(prefix, first, last + length).view(np.int64)


def _find(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Anchor rows; equal contexts of a block give one row with ``many`` and a settled row each."""
    for batch in blocks(batches):
        text, first, last, grams, whole = anchors(*text_bytes(batch.column(1)), length, gram)
        tid = batch.column(0).to_numpy()[text]
        order = np.lexsort((whole, grams))
        grams, whole, tid, first, last = grams[order], whole[order], tid[order], first[order], last[order]
        head = np.append(True, (grams[1:] != grams[:-1]) | (whole[1:] != whole[:-1])) if len(grams) else np.zeros(0, bool)
        single = head & np.append(head[1:], True)[: len(head)]
        kinds = [np.where(single[head], 0, 1), np.full(int((~single).sum()), 2)]  # 0: alone, 1: stands for several, 2: settled
        pick = np.concatenate([np.flatnonzero(head), np.flatnonzero(~single)])
        columns = [np.concatenate(kinds).astype(np.int32), grams[pick], whole[pick], tid[pick], first[pick].astype(np.int32), last[pick].astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["kind", "gram", "whole", "tid", "first", "last"])


def _gather(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Per text and its anchors: contexts' bytes, or digests of the strings of hot ones (those a block repeats only once)."""
    names = ["gram", "tid", "first", "alone", "context", "digest", "many"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.int64(), pa.int32()]
    for batch in blocks(batches):
        data, offsets = text_bytes(batch.column(1))
        raw = data.tobytes()
        lists = batch.column(2)
        owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
        flat = lists.flatten()
        gram, first, last, alone, hot = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(5))
        tid = batch.column(0).to_numpy()[owner]
        begin = offsets[owner] + first
        rows = [(gram[i], tid[i], first[i], bool(alone[i]), raw[begin[i] : offsets[owner[i]] + last[i] + length], None, None) for i in np.flatnonzero(~hot)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        if hot.any():
            count = np.where(hot, last - first + 1, 0).astype(np.int64)
            which = np.repeat(np.arange(len(gram)), count)
            step = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            start = begin[which] + step
            digest = span_hash(prefix_hash(byte_codes(data)), start, start + length).view(np.int64)
            order = np.lexsort((digest, gram[which]))
            which, step, digest = which[order], step[order], digest[order]
            g = gram[which]
            head = np.append(True, (g[1:] != g[:-1]) | (digest[1:] != digest[:-1]))
            single = head & np.append(head[1:], True)
            weight = np.where(single, 1, np.where(head, 2, 0)).astype(np.int32)  # 0: known to be repeated, not counted again
            columns = [pa.array(g), pa.array(tid[which]), pa.array((first[which] + step).astype(np.int32)), pa.nulls(len(g), pa.bool_()), pa.nulls(len(g), pa.binary()), pa.array(digest), pa.array(weight)]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def repeats_of(contexts: list[bytes], length: int = LENGTH) -> tuple[SuffixArray, list[tuple[int, np.ndarray]], np.ndarray]:
    """(array, maximal repeats, first place of each context) over contexts laid one after another."""
    begin = np.concatenate([[0], np.cumsum([len(c) for c in contexts])]).astype(np.int64)
    starts = np.concatenate([np.arange(a, b - length + 1) for a, b in zip(begin[:-1], begin[1:], strict=True)])
    array = SuffixArray(contexts, starts)
    left_open = np.zeros(len(array.text), bool)
    left_open[begin[:-1]] = True
    return array, array.maximal_repeats(length, left_open), begin


def _repeats(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Marks from suffix arrays over whole groups; rows come sorted by anchor hash."""

    def solve(rows: list) -> pa.RecordBatch:
        array, found, begin = repeats_of([r[3] for r in rows], length)
        delta = np.zeros(len(array.text) + 1, np.int64)
        for common, places in found:
            np.add.at(delta, places, 1)
            np.add.at(delta, places + common, -1)
        cover = np.cumsum(delta)[:-1] > 0
        edge = np.zeros(len(cover) + 1, bool)
        edge[begin] = True
        left = np.append(False, cover[:-1])
        right = np.append(cover[1:], False)
        start = np.flatnonzero(cover & (~left | edge[:-1]))
        end = np.flatnonzero(cover & (~right | edge[1:])) + 1
        row = np.searchsorted(begin, start, side="right") - 1
        tid, first, alone = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows], bool)
        use = alone[row]  # the others are settled already, and only partners here
        shift = first[row] - begin[row]
        return pa.RecordBatch.from_arrays([pa.array(tid[row][use]), pa.array((start + shift)[use].astype(np.int32)), pa.array((end + shift)[use].astype(np.int32))], names=["tid", "from_", "to_"])

    held: list = []
    group: list = []
    current, size = None, 0
    for batch in batches:
        for gram, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if gram != current:
                held += group
                group, current = [], gram
                if size >= ARRAY_BYTES:
                    yield solve(held)
                    held, size = [], 0
            group.append(row)
            size += len(row[3])
    held += group
    if held:
        yield solve(held)


def _remove(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            rows = []
            for key, copies, text, marks in zip(*(c.to_pylist() for c in batch.slice(lo, 256).columns), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                if copies > 1 and len(raw) >= length:
                    rows.append((key, b"", len(raw), 1, 0))
                    continue
                kept, at, spans, end = [], 0, 0, -1
                for a, b in sorted((m["from_"], m["to_"]) for m in marks or []):
                    if a > end:
                        spans += 1
                        kept.append(raw[at:a])
                    at = end = max(end, b)
                kept.append(raw[at:])
                left = b"".join(kept)
                rows.append((key, left, len(raw) - len(left), spans, len(left.decode("utf-8", "ignore"))))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()], strict=True)], names=["key", "kept", "n_removed", "n_spans", "n_chars"])


def _key():
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(tid, from_, to_): spans of bytes, which may overlap, that make up all repeated bytes of distinct texts (tid, text)."""
    spark = texts.sparkSession
    n = partitions(spark)
    found = map_arrow(texts.where(F.octet_length("text") >= length).select("tid", "text"), lambda b: _find(b, length, gram), "kind int, gram long, whole long, tid long, first int, last int")
    rows = materialize(found, "anchors")
    by_context = ["gram", "whole"]
    classes = rows.where("kind < 2").groupBy(*by_context).agg(F.sum(F.col("kind") + 1).alias("members"), *(F.first(c).alias(c) for c in ("tid", "first", "last")))
    classes = materialize(classes, "contexts")
    release(spark)
    again = rows.where("kind = 0").join(classes.where("members > 1").select(*by_context), by_context, "left_semi")
    settled = materialize(rows.where("kind = 2").unionByName(again).select("tid", F.col("first").alias("from_"), (F.col("last") + length).alias("to_")), "settled")
    release(spark)
    discard(rows)
    several = classes.groupBy("gram").agg(F.count("*").alias("kinds"), F.min("members").alias("least")).where("kinds > 1 and least = 1").select("gram", (F.col("kinds") > HOT).alias("hot"))
    wanted = classes.join(several, "gram").groupBy("tid").agg(F.collect_list(F.struct("gram", "first", "last", (F.col("members") == 1).alias("alone"), "hot")).alias("anchors"))  # at most one text's anchors
    wanted = materialize(wanted, "wanted")
    release(spark)
    discard(classes)
    listed = map_arrow(texts.join(wanted, "tid").select("tid", "text", "anchors"), lambda b: _gather(b, length), "gram long, tid long, first int, alone boolean, context binary, digest long, many int")
    gathered = materialize(listed, "gathered")
    release(spark)
    together = gathered.where("context is not null").select("gram", "tid", "first", "alone", "context").repartition(n, "gram").sortWithinPartitions("gram")
    in_arrays = map_arrow(together, lambda b: _repeats(b, length), "tid long, from_ int, to_ int")
    strings = gathered.where("digest is not null")
    by_digest = ["gram", "digest"]
    repeated = strings.groupBy(*by_digest).agg(F.sum("many").alias("members")).where("members > 1").select(*by_digest)
    counted = strings.join(repeated, by_digest, "left_semi").select("tid", F.col("first").alias("from_"), (F.col("first") + length).alias("to_"))
    spans = materialize(settled.unionByName(in_arrays).unionByName(counted), "spans")
    release(spark)
    for table in (settled, wanted, gathered):
        discard(table)
    return spans


def kept_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per distinct text: key (MD5 of the text), kept (its remaining bytes), n_removed, n_spans, n_chars (whole characters left)."""
    spark = docs.sparkSession
    texts = docs.select(_key().alias("key"), F.coalesce("text", F.lit("")).alias("text")).groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    texts = materialize(texts.withColumn("tid", F.monotonically_increasing_id()), "texts")
    release(spark)
    spans = repeated_spans(texts, length, gram)
    marks = spans.groupBy("tid").agg(F.collect_list(F.struct("from_", "to_")).alias("marks"))  # at most one text's spans
    marked = texts.join(marks, "tid", "left").select("key", "copies", "text", "marks")
    return map_arrow(marked, lambda b: _remove(b, length), "key binary, kept binary, n_removed long, n_spans long, n_chars long")


def deduplicate(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``; bytes left of a broken character go too."""

    @F.pandas_udf("string")
    def decoded(s):
        return s.map(lambda b: b.decode("utf-8", "ignore"))

    key, kept = unused(docs, "key", "kept")
    left = kept_bytes(docs, length, gram).where("n_removed > 0").select(F.col("key").alias(key), decoded("kept").alias(kept))
    joined = docs.withColumn(key, _key()).join(left, key, "left")
    return joined.select(*[F.coalesce(kept, "text").alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in docs.columns])


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = kept_bytes(docs).select("key", (F.octet_length("kept") + F.col("n_removed")).alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_chars")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key().alias("key")).join(found, "key").drop("key")
