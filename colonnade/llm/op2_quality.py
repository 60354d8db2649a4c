"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics come from the bytes and words of the whole text alone. Training bins each one by
quantiles and grows depth-limited trees on sums of gradients by bin; the ensemble is flattened into
arrays, and scoring steps all rows and trees down one level at a time. Fitting uses at most
``MAX_TRAIN_ROWS`` labelled documents, the least by hash of doc_id, so that the driver and the
model stay small whatever the table's size; scoring is one pass over the documents with no shuffle.

Defined cases: a null or empty text has all-zero statistics and gets the score of those; repeated
rows get equal scores; labels with null doc_id or quality are not used, and of several labels of a
document the greatest counts; without a label to learn from every score is 0.5; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, byte_codes, documents, map_arrow, prefix_hash, span_hash, text_bytes

#: Bound of the sample that the driver fits on.
MAX_TRAIN_ROWS = 20_000
THRESHOLD = 0.3
TREES, DEPTH, BINS, RATE, LEAST_ROWS, RIDGE = 120, 5, 64, 0.1, 10, 1.0
STATISTICS = (
    "log_bytes", "log_words", "mean_word", "longest_word", "upper", "digits", "bangs", "bars", "symbols", "stops", "other_marks", "not_ascii",
    "blanks", "newlines", "same_as_previous", "distinct_words", "upper_words", "bang_words", "symbol_words", "bar_words", "words_a_line", "repeated_lines", "longest_run",
)


def _classes() -> np.ndarray:
    kind = np.zeros(256, np.uint8)
    for k, chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"!", b"|", b"#$%&*", b".,;:?", b"\"'()+-/<=>@[]\\^_`{}~", b" \t\r\x0b\x0c", b"\n"), 1):
        kind[list(chars)] = k
    kind[128:] = 11
    return kind


_CLASS = _classes()


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text in ``data[offsets[i]:offsets[i + 1]]``."""
    n = len(offsets) - 1
    sizes = np.diff(offsets).astype(np.float64)
    kind = _CLASS[data]
    doc = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.bincount(doc * 12 + kind, minlength=12 * n).reshape(n, 12).astype(np.float64)
    some = np.maximum(sizes, 1)
    # words: runs that are no white space; document edges end them too
    solid = (kind != 9) & (kind != 10)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], solid[:-1]]) if len(data) else solid
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.concatenate([solid[1:], [False]]) if len(data) else solid
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    owner = doc[start]
    words = np.bincount(owner, minlength=n).astype(np.float64)
    w = np.maximum(words, 1)
    length = (end - start).astype(np.float64)
    longest = np.zeros(n)
    np.maximum.at(longest, owner, length)
    prefix = prefix_hash(byte_codes(data))
    h = span_hash(prefix, start, end)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    position = np.arange(len(h))
    run = position - np.maximum.accumulate(np.where(same, 0, position))
    longest_run = np.zeros(n)
    np.maximum.at(longest_run, owner, run.astype(np.float64))
    order = np.lexsort((h, owner))
    first = np.ones(len(h), bool)
    first[1:] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order][first], minlength=n)
    has = [np.concatenate([[0], np.cumsum(kind == k)]) for k in (1, 2, 4, 6, 5)]
    within = [c[end] - c[start] > 0 for c in has]
    share = lambda mask: np.bincount(owner[mask], minlength=n) / w
    # lines: their hashes, blank lines left out
    cut = np.flatnonzero(kind == 10)
    line_start = np.concatenate([offsets[:-1], cut + 1])
    line_start.sort()
    line_end = np.concatenate([cut, offsets[1:]])
    line_end.sort()
    full = line_end > line_start
    line_start, line_end = line_start[full], line_end[full]
    line_doc = doc[line_start]
    lines = np.bincount(line_doc, minlength=n).astype(np.float64)
    lh = span_hash(prefix, line_start, line_end)
    order = np.lexsort((lh, line_doc))
    again = np.zeros(len(lh), bool)
    again[1:] = (lh[order][1:] == lh[order][:-1]) & (line_doc[order][1:] == line_doc[order][:-1])
    repeated = np.bincount(line_doc[order][again], minlength=n)
    letters = np.maximum(counts[:, 1] + counts[:, 2], 1)
    columns = [
        np.log1p(sizes), np.log1p(words), np.where(words > 0, np.bincount(owner, weights=length, minlength=n) / w, 0), longest, counts[:, 1] / letters, counts[:, 3] / some, counts[:, 4] / some, counts[:, 5] / some,
        counts[:, 6] / some, counts[:, 7] / some, counts[:, 8] / some, counts[:, 11] / some, counts[:, 9] / some, counts[:, 10] / some, share(same), distinct / w,
        share(within[0] & ~within[1]), share(within[2]), share(within[3]), share(within[4]), words / np.maximum(lines, 1), repeated / np.maximum(lines, 1), longest_run,
    ]
    return np.stack(columns, 1).astype(np.float32)


@dataclass
class Trees:
    """A flattened ensemble: node arrays of all trees one after another; a leaf is its own child."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total = np.full(len(x), self.base)
        if len(self.roots):
            for lo in range(0, len(x), 4096):
                part = x[lo : lo + 4096]
                rows = np.arange(len(part))[:, None]
                at = np.broadcast_to(self.roots, (len(part), len(self.roots)))
                for _ in range(DEPTH):
                    at = np.where(part[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
                total[lo : lo + 4096] += self.value[at].sum(1)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boost TREES trees on rows ``x`` with labels 0 and 1; missing labels give a constant 0.5."""
    empty = np.zeros(0, np.int64)
    if not len(y) or y.min() == y.max():
        rate = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        return Trees(empty, empty.astype(np.float32), empty, empty, empty.astype(float), empty, float(np.log(rate / (1 - rate))))
    d = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")).astype(np.float32) for j in range(d)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)  # bin b: above cut b - 1, at or below cut b
    flat = binned + np.arange(d) * BINS
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    rate = y.mean()
    base = float(np.log(rate / (1 - rate)))
    total = np.full(len(y), base)
    usable = np.arange(BINS)[None, :] < np.array([len(c) for c in cuts])[:, None]

    def node() -> int:
        own = len(feature)
        for column, v in ((feature, 0), (threshold, np.float32(0)), (left, own), (right, own), (value, 0.0)):
            column.append(v)
        return own

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        root = node()
        roots.append(root)
        open_ = [(root, np.arange(len(y)))]
        for depth in range(DEPTH + 1):
            later = []
            for at, rows in open_:
                gs, hs = g[rows].sum(), h[rows].sum()
                value[at] = -RATE * gs / (hs + RIDGE)
                if depth == DEPTH or len(rows) < 2 * LEAST_ROWS:
                    total[rows] += value[at]
                    continue
                keys = flat[rows].ravel()
                gh, hh, nh = (np.bincount(keys, weights=w, minlength=d * BINS).reshape(d, BINS).cumsum(1) for w in (np.repeat(g[rows], d), np.repeat(h[rows], d), None))
                gain = gh**2 / (hh + RIDGE) + (gs - gh) ** 2 / (hs - hh + RIDGE) - gs**2 / (hs + RIDGE)
                gain[~usable | (nh < LEAST_ROWS) | (len(rows) - nh < LEAST_ROWS)] = -1
                j, b = divmod(int(np.argmax(gain)), BINS)
                if gain[j, b] <= 1e-6:
                    total[rows] += value[at]
                    continue
                feature[at], threshold[at] = j, cuts[j][b]
                goes = binned[rows, j] <= b
                left[at], right[at] = node(), node()
                later += [(left[at], rows[goes]), (right[at], rows[~goes])]
            open_ = later
    return Trees(np.array(feature), np.array(threshold, np.float32), np.array(left), np.array(right), np.array(value), np.array(roots), base)


def held_out(doc_id: Column) -> Column:
    """The fold that training never sees."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> Trees:
    """Fit on at most ``max_rows`` labelled documents outside the held-out fold; of rows with one doc_id, the text of the least hash."""
    sample = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("label_id")).agg(F.max("quality").cast("int").alias("label"))
        .orderBy(F.xxhash64("label_id"), "label_id").limit(max_rows)
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            x = statistics(*text_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:1], *batch.columns[2:], pa.array(list(x), pa.list_(pa.float32()))], names=["label", "label_id", "tie", "x"])

    joined = docs.select(F.col("doc_id").alias("label_id"), "text").join(F.broadcast(sample), "label_id")  # max_rows ids at most
    joined = joined.select("label", "text", F.col("label_id").cast("string").alias("label_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"))
    measured = map_arrow(joined, rows, "label int, label_id string, tie long, x array<float>")
    found = measured.groupBy("label_id").agg(F.min(F.struct("tie", "x", "label")).alias("f")).select("f.label", "f.x").toArrow()
    x = np.array(found.column("x").to_pylist(), np.float32).reshape(-1, len(STATISTICS))
    y = found.column("label").to_numpy().astype(np.float64)
    order = np.lexsort([*x.T, y])  # rows arrive in any order
    return fit(x[order], y[order])


def score_documents(docs: DataFrame, model: Trees) -> DataFrame:
    """``docs`` with a last column ``score`` (a clashing column is replaced), in one pass."""
    kept = docs.drop("score") if "score" in docs.columns else docs
    names = [*kept.columns, "score"]
    at = kept.columns.index("text")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            s = model.score(statistics(*text_bytes(batch.column(at))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], names=names)

    from pyspark.sql.types import DoubleType, StructField, StructType

    return map_arrow(kept, scored, StructType([*kept.schema.fields, StructField("score", DoubleType())]))


def keep_good(docs: DataFrame, model: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, with their columns as they are, in one pass."""
    at = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            yield batch.filter(pa.array(model.score(statistics(*text_bytes(batch.column(at)))) >= threshold))

    return map_arrow(docs, kept, docs.schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_documents(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
