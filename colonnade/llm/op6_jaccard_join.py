"""Exact similarity join of documents on word-shingle sets (Jaccard 0.8 and more), by token-combination prefixes.

1. Equal sets are one class, named by 128 bits of a digest of the set; everything below is on classes.
2. Shared counts. A class of n shingles can only link if all but n - ceil(0.8 n) of them occur in another class. Of the
   shingles with a hash in the lower half of all hashes, so many at least must therefore be shared. These are
   dealt by hash as packed arrays and counted; a shingle that several classes of one map block
   share is settled there and sent once, so a very common one costs a row a block. What is shared is summed by class, first within
   each task. Most documents end here. Sets of under 4 shingles link with their equals only, and do not begin.
3. Prefixes. The others' shingles are ordered rare ones first, by hash within each kind. Rare ones
   in the prefix of n - ceil(0.8 n) + 1 are indexed singly. Where frequent ones reach into it, the prefix is extended
   and pairs of consecutive frequent shingles are indexed, the combinations of this method with k = 2: two sets that link and share no rare
   shingle have o >= 4/9 (n1 + n2) common ones, and the n1 + n2 - 2 o others part as many of the o - 1 neighbours
   among them at most, so they share c >= 3 o - 1 - n1 - n2 >= 0.6 n - 1 pairs. Of a set's m pairs, the m - c + 1
   rarest are therefore enough, by the count of the pair's rarer shingle and then by hash. A passage that very many documents hold
   gives lists only to sets that have little else.
4. Verification in two rounds. First every class against the head of each of its lists, the class with the
   fewest rare shingles, so of a family of copies the one with the fewest edits; the links give
   components. Then, in each list, only pairs from different components, so that a list of near
   copies costs a row a member and not all its pairs. Of those, pairs whose parity sketches prove
   them too far apart are left out. No list is capped. Sets are intersected exactly.

Links are between sets of 64-bit hashes of 5-word shingles. Defined cases: a null or empty text, or
one of white space, has no shingles and links with nothing; equal texts of fewer than 5 words link;
repeated rows share a component; a component's id is its least non-null doc_id (a null where
none has one); an empty table gives an empty result; ``link_documents`` does not carry extra columns,
``one_of_each`` carries them, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, discard, documents, map_arrow, materialize, mix, partitions, release, text_bytes
from .components import components
from .shingles import shingle_sets

#: Shingles in more classes than this are of the frequent kind.
FREQUENT = 24
#: Shingles that a map task gathers before it deals them out.
DEAL_SHINGLES = 1_000_000
PERCENT = 80
SKETCH_WORDS = 8
SKETCH = [f"s{i}" for i in range(SKETCH_WORDS)]
NAME = ["d1", "d2"]
KEY = ["k1", "k2"]
_HALF = np.uint64(1 << 63)
_COUNTED = 4  # least size of a set that can link with a different one


def set_name(tokens: np.ndarray) -> bytes:
    """Digest of a set; zeros for the empty set."""
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else bytes(16)


def _halves(names: list[bytes]) -> list[pa.Array]:
    both = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
    return [pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())]


def parity_sketch(tokens: np.ndarray) -> np.ndarray:
    """A bit per bucket of hashes: whether an odd number falls in. Two sketches differ in at most as many bits as the sets in elements."""
    odd = np.bincount((tokens % np.uint64(64 * SKETCH_WORDS)).astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def least_overlap(n: np.ndarray) -> np.ndarray:
    """ceil(0.8 n)."""
    return -(-PERCENT * n // 100)


def _lower_half(tokens: np.ndarray) -> np.ndarray:
    """The ascending hashes that are counted."""
    return tokens[: np.searchsorted(tokens, _HALF)]


def _need(tokens: np.ndarray) -> int:
    """How many of a set's counted hashes must be shared if it links with a different set."""
    return len(_lower_half(tokens)) - len(tokens) + int(least_overlap(np.int64(len(tokens))))


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches):
        sets = shingle_sets(*text_bytes(batch.column(3)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(s) for s in sets], pa.int64()), pa.array([_need(s) for s in sets], pa.int32()), *_halves([set_name(s) for s in sets])], names=["doc_id", *KEY, "n", "need", *NAME])


_DEALT = "part int, tokens binary, at binary, d1 binary, d2 binary, need binary, given binary"


def _dealer(parts: int):
    """A map function that deals shingles to parts; a row is a part with packed shingles and their classes."""

    def flush(held: dict[bytes, tuple[np.ndarray, int]]) -> pa.RecordBatch:
        names = np.frombuffer(b"".join(held), np.int64).reshape(-1, 2)
        need = np.array([n for _, n in held.values()], np.int32)
        sizes = np.array([len(s) for s, _ in held.values()])
        tokens, owner = np.concatenate([s for s, _ in held.values()]), np.repeat(np.arange(len(names)), sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        head = np.ones(len(tokens), bool)
        head[1:] = tokens[1:] != tokens[:-1]
        alone = head & np.append(head[1:], True)  # classes are distinct here, so a repeated token is shared
        settled = np.bincount(owner[~alone], minlength=len(names)).astype(np.int32)
        tokens, owner = tokens[head], np.where(alone, owner, -1)[head]
        part = (tokens >> np.uint64(32)) % np.uint64(parts)
        order = np.argsort(part.astype(np.int32), kind="stable")
        tokens, owner, part = tokens[order].astype(np.uint32), owner[order], part[order].astype(np.int64)
        ends = np.searchsorted(part, np.arange(parts + 1))
        listed = lambda used: (*(names[used, i].tobytes() for i in (0, 1)), need[used].tobytes())
        some = np.flatnonzero(settled)
        rows = [(int(names[0, 0]) % parts, b"", b"", *listed(some), settled[some].tobytes())] if len(some) else []
        for p in np.flatnonzero(np.diff(ends)).tolist():
            own = owner[ends[p] : ends[p + 1]]
            used = np.unique(own[own >= 0])
            at = np.where(own >= 0, np.searchsorted(used, own), len(used)).astype(np.uint32)
            rows.append((p, tokens[ends[p] : ends[p + 1]].tobytes(), at.astype(np.uint16).tobytes() if len(used) < 65536 else at.tobytes(), *listed(used), b""))
        kinds = [pa.int32()] + [pa.binary()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "tokens", "at", *NAME, "need", "given"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[np.ndarray, int]] = {}
        count = 0
        for batch in blocks(batches):
            for s in shingle_sets(*text_bytes(batch.column(0))):
                low = _lower_half(s)
                if len(s) >= _COUNTED and len(low) and (name := set_name(s)) not in held:
                    held[name] = low.copy(), _need(s)
                    count += len(low)
            if count >= DEAL_SHINGLES:
                yield flush(held)
                held, count = {}, 0
        if held:
            yield flush(held)

    return deal


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A class's shared shingles: a row of 1 each, and a row for those that a map block has settled. Their number grows as the table does, however many parts there are."""
    tokens, owner, listed, have = [], [], [], 0
    for batch in batches:
        for part, t, at, d1, d2, need, given in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            d1, d2, need = np.frombuffer(d1, np.int64), np.frombuffer(d2, np.int64), np.frombuffer(need, np.int32)
            t = np.frombuffer(t, np.uint32)
            at = np.frombuffer(at, np.uint16 if len(d1) < 65536 else np.uint32).astype(np.int64)
            tokens.append((np.uint64(part) << np.uint64(32)) | t)
            owner.append(np.where(at < len(d1), at + have, -1))
            listed.append((d1, d2, need, np.frombuffer(given, np.int32) if given else np.zeros(len(d1), np.int32)))
            have += len(d1)
    if not have:
        return
    d1, d2, need, given = (np.concatenate(c) for c in zip(*listed, strict=True))
    order = np.lexsort((d2, d1))
    first = np.append(True, (d1[order][1:] != d1[order][:-1]) | (d2[order][1:] != d2[order][:-1]))
    number = np.empty(have, np.int64)
    number[order] = np.cumsum(first) - 1
    pick = order[first]
    t, s = np.concatenate(tokens), np.concatenate(owner)
    del tokens, owner, listed
    s = np.where(s >= 0, number[s], -1)
    order = np.argsort(t)
    t, s = t[order], s[order]
    some, count = np.flatnonzero(given), given[given > 0].astype(np.int64)
    if len(t):
        head = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        low, high = np.minimum.reduceat(s, head), np.maximum.reduceat(s, head)
        several = np.repeat((low != high) | (low < 0), np.diff(np.append(head, len(t))))
        found = pick[s[several & (s >= 0)]]
        some, count = np.append(some, found), np.append(count, np.ones(len(found), np.int64))
    for lo in range(0, len(some), 10_000):
        at = some[lo : lo + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(d1[at]), pa.array(d2[at]), pa.array(need[at]), pa.array(count[lo : lo + 10_000])], names=[*NAME, "need", "shared"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches):
        sets = shingle_sets(*text_bytes(batch.column(0)))
        sketches = np.array([parity_sketch(s) for s in sets], np.int64).reshape(-1, SKETCH_WORDS)
        yield pa.RecordBatch.from_arrays([*_halves([set_name(s) for s in sets]), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), *map(pa.array, sketches.T)], names=[*NAME, "tokens", *SKETCH])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index rows (list_a, list_b, sid, n, rest, rare): a rare shingle and 0, or two consecutive frequent ones.

    ``rest`` counts the row's shingle or pair and those behind it in the set's order; ``rare`` the set's rare ones.
    """
    for batch in (b.slice(lo, 500) for b in batches for lo in range(0, b.num_rows, 500)):
        cols: list[list[np.ndarray]] = [[], [], [], [], [], []]
        sids, ns = batch.column(0).to_numpy(), batch.column(1).value_lengths().to_numpy()
        for i, (tokens, often, counts) in enumerate(zip(*(batch.column(i) for i in (1, 2, 3)), strict=True)):
            t = np.array(tokens.values, np.int64)
            q, r, n = t[:0], t, int(ns[i])
            if often.is_valid:
                q = np.array(often.values, np.int64)
                order = np.argsort(q)
                q, count = q[order], np.array(counts.values, np.int64)[order]
                r = t[~np.isin(t, q)]
            p = n - int(least_overlap(np.int64(n))) + 1
            keys = [(r[:p], np.zeros(min(p, len(r)), np.int64), n - np.arange(min(p, len(r))))]
            if len(r) < p and len(q) > 1:  # frequent shingles reach into the prefix
                m = len(q) - 1
                x, y = q[:-1], q[1:]
                hashed = mix(x.view(np.uint64) ^ mix(y.view(np.uint64)))
                first = np.lexsort((hashed, np.minimum(count[:-1], count[1:])))[: max(m - shared_pairs(n) + 1, 0)]
                keys.append((x[first], y[first], m - np.arange(len(first))))
            for a, b, rest in keys:
                for c, v in zip(cols, (a, b, np.full(len(a), sids[i]), np.full(len(a), n), rest, np.full(len(a), len(r))), strict=True):
                    c.append(v.astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["list_a", "list_b", "sid", "n", "rest", "rare"])


def shared_pairs(n: int) -> int:
    """How many pairs of consecutive frequent shingles a set of n shares at least with any that it links with, if they share no rare one: ceil(0.6 n - 1)."""
    return max(1, -(-(6 * n - 10) // 10))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        a, b = batch.column(2), batch.column(3)
        for i in range(batch.num_rows):
            x, y = np.array(a[i].values, np.int64), np.array(b[i].values, np.int64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= PERCENT * (len(x) + len(y) - both):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], names=["u", "v"])


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets link, written to the shared folder."""
    left = sets.select(F.col("sid").alias("u"), F.col("tokens").alias("x"))
    right = sets.select(F.col("sid").alias("v"), F.col("tokens").alias("y"))
    found = pairs.join(left, "u").join(right, "v").select("u", "v", "x", "y")
    return materialize(map_arrow(found, _verify, "u long, v long"), "links")


def _may_link(n1, rest1, n2, rest2):
    """Size and position filters on two sets of n1 and n2 in one list: what stands at and behind its shingle, or pair, must hold all that linked sets share.

    That holds of their first common shingle or pair, which is looked up.
    """
    need = F.ceil((n1 + n2) * PERCENT / (100 + PERCENT))
    return (F.least(n1, n2) * 100 >= F.greatest(n1, n2) * PERCENT) & (F.least(rest1, rest2) >= F.when(F.col("list_b") == 0, need).otherwise(3 * need - 1 - n1 - n2))


def live_classes(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(d1, d2): the classes that may link with another, by shared counts; none that does is missing."""
    parts = 2 * partitions(docs.sparkSession)
    dealt = map_arrow(docs.select("text"), _dealer(parts), _DEALT)
    counted = map_arrow(dealt.repartitionById(parts, "part"), _count, "d1 long, d2 long, need int, shared long")
    enough = counted.groupBy(*NAME).agg(F.sum("shared").alias("shared"), F.max("need").alias("need")).where("shared >= need").select(*NAME)
    always = rows.where((F.col("n") >= _COUNTED) & (F.col("need") <= 0)).select(*NAME)
    return materialize(enough.unionByName(always).distinct(), "live-classes")


def class_links(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(d1, d2, component) of the classes that link with another; ``rows`` has k1, k2, n, need, d1, d2 for each document."""
    spark = docs.sparkSession
    live = live_classes(docs, rows)
    release(spark)
    # copies are put together within each map task, before they are dealt: a text that very many rows hold sends one a task
    keys = rows.groupBy(*NAME).agg(F.min(F.struct(*KEY)).alias("key")).join(live, NAME, "left_semi").select("key.*")
    texts = docs.select(*_text_key(), "text").groupBy(*KEY).agg(F.first("text").alias("text")).join(keys, KEY, "left_semi")
    found = map_arrow(texts.select("text"), _sets, "d1 long, d2 long, tokens array<long>, " + ", ".join(f"{c} long" for c in SKETCH))
    sets = materialize(found.withColumn("sid", F.monotonically_increasing_id()), "sets")  # a class has one text here
    release(spark)
    discard(live)
    shingles = sets.select("sid", F.explode("tokens").alias("token"))
    often = shingles.groupBy("token").count().where(F.col("count") > FREQUENT)
    held = shingles.join(often, "token").groupBy("sid").agg(F.collect_list(F.struct("token", "count")).alias("often"))  # at most one set's shingles
    listed = sets.join(held, "sid", "left").select("sid", "tokens", F.col("often.token").alias("often"), F.col("often.count").alias("counts"))
    index = materialize(map_arrow(listed, _index, "list_a long, list_b long, sid long, n long, rest long, rare long"), "index")
    release(spark)
    key = ["list_a", "list_b"]
    heads = index.groupBy(*key).agg(F.min(F.struct("rare", "sid", "n", "rest")).alias("head"), F.count("*").alias("members")).where("members > 1").drop("members")
    lists = materialize(index.join(heads, key).select(*key, "sid", "n", "rest", "head"), "lists")
    discard(index)
    stars = lists.where(F.col("sid") != F.col("head.sid")).where(_may_link(F.col("n"), F.col("rest"), F.col("head.n"), F.col("head.rest")))
    links = _links(stars.select(F.col("head.sid").alias("u"), F.col("sid").alias("v")).distinct(), sets)
    first = materialize(components(links), "components")
    # the rest: in each list, members outside its largest component against all members outside their own
    sketched = lists.drop("head").join(sets.select("sid", *SKETCH), "sid")
    named = sketched.join(first.select(F.col("node").alias("sid"), "component"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    sizes = named.groupBy(*key, "component").count().groupBy(*key).agg(F.max(F.struct("count", "component")).alias("largest"), F.count("*").alias("kinds")).where("kinds > 1")
    split = materialize(named.join(sizes.select(*key, F.col("largest.component").alias("main")), key), "split-lists")
    discard(lists)
    few = split.where(F.col("component") != F.col("main")).select(*key, *(F.col(c).alias(f"{c}2") for c in ("sid", "n", "rest", "component", *SKETCH)))
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}2"))) for c in SKETCH), F.lit(0))  # at most the number of shingles in one set only
    cross = split.join(few, key).where(F.col("component") != F.col("component2")).where(_may_link(F.col("n"), F.col("rest"), F.col("n2"), F.col("rest2"))).where(apart * (100 + PERCENT) <= (F.col("n") + F.col("n2")) * (100 - PERCENT))
    rest = cross.select(F.least("sid", "sid2").alias("u"), F.greatest("sid", "sid2").alias("v")).distinct()
    more = _links(rest, sets)
    edges = first.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more)
    joined = (components(edges) if more.head(1) else first).join(sets.select(F.col("sid").alias("node"), *NAME), "node").select(*NAME, "component")
    found = materialize(joined, "class-links")
    for table in (split, links, first, more, sets):
        discard(table)
    return found


def _text_key() -> list:
    """128 bits that name a text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def document_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, n, need, d1, d2) of each row: its text's key, its set's size and name."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_text_key(), "text")
    return materialize(map_arrow(rows, _classes, "doc_id long, k1 long, k2 long, n long, need int, d1 long, d2 long"), "classes")


def link_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``."""
    rows = document_classes(docs)
    some = rows.where("n > 0")
    least = some.groupBy(*NAME).agg(F.min("doc_id").alias("least"))  # copies first: a component then is its classes
    linked = class_links(docs, some).join(least, NAME)
    of_all = linked.groupBy("component").agg(F.min("least").alias("of_all"))
    # a left join, so that the classes are never the side sent to a component's task: one component may hold a third of them
    linked = linked.select(*NAME, "component").join(of_all, "component", "left").drop("component")
    named = least.join(linked, NAME, "left")
    # written, so that Spark can split a class of very many copies in the join with the rows
    named = materialize(named.select(*NAME, F.coalesce("of_all", "least").alias("component_id")), "named-classes")
    joined = some.join(named, NAME).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return joined.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without near copies: of each group the row of the least doc_id stays (nulls last, ties by text hash, then by a hash of the row), and so do all rows without shingles."""
    rows = document_classes(docs)
    some = rows.where("n > 0")
    order = F.struct(F.col("doc_id").isNull().alias("unset"), F.coalesce("doc_id", F.lit(0)).alias("id"), *KEY)
    least = some.groupBy(*NAME).agg(F.min(order).alias("first"))
    linked = class_links(docs, some)
    named = least.join(linked, NAME, "left")
    alone = named.where("component is null").select("first.*")
    first = alone.unionByName(named.where("component is not null").groupBy("component").agg(F.min("first").alias("first")).select("first.*"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(*_text_key(), F.col("doc_id").isNull().alias("unset"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), whole)
    has_word = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    by = [*KEY, "unset", "id"]
    chosen = keyed.where(F.coalesce(F.col("row.text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")).join(first, by, "left_semi")
    chosen = chosen.groupBy(*by).agg(F.min_by("row", F.to_json("row")).alias("row")) if _repeats(rows) else chosen
    return chosen.select("row.*").unionByName(docs.where(~has_word))


def _repeats(rows: DataFrame) -> bool:
    """Whether some doc_id stands with one text in several rows."""
    return bool(rows.where("n > 0").groupBy(*KEY, "doc_id").count().where("count > 1").head(1))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(documents(spark, sf_dir))
