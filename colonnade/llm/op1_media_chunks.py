"""Media columns kept as content-defined chunks.

A text's UTF-8 bytes, padded with zero bytes to a positive multiple of 64, are the samples of an
8-bit grey image 64 wide (binary PGM): that file is the document's medium. A rolling gear hash over
32 bytes cuts media into chunks; the media table holds each medium's ordered chunk list. Joins on
the chunks' digests (128 bits of SHA-256) leave one owner per distinct chunk, and only owners store bytes, in packs of about
1 MB that are compressed as a whole; chunks that others borrow lie beside their pack. Reading joins
borrowed chunks back in by digest, puts the ordered list together and verifies the medium's SHA-256.

Bytes move little: digests decide ownership, texts are shuffled once, compressed and without
copies, and media that borrow nothing are read where they lie. Media are keyed by the text's SHA-256, so
copies of a text are stored once, and a hot copy only repeats its small row.

Defined cases: a null text is empty, and an empty payload is 64 zero bytes; repeated rows and
doc_ids each get their row; an empty table gives an empty result; extra columns are not carried.
"""

from __future__ import annotations

import bz2
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, documents, map_arrow, materialize, release, text_bytes

SAMPLES = 64
#: Chunk sizes in bytes: least, mean beyond the least (a power of two), most.
LEAST, MEAN, MOST = 512, 1024, 8192
GEAR_WINDOW = 32
GEAR = np.random.default_rng(64).integers(0, 2**32, 256, dtype=np.uint32)
#: Bytes of chunks in a pack.
PACK_BYTES = 880_000
#: Bytes of SHA-256 that name a chunk, and a text.
DIGEST_BYTES = 16

LISTS = pa.schema([("key", pa.binary()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media_sha", pa.binary()), ("sizes", pa.list_(pa.int32())), ("digests", pa.list_(pa.binary()))])
LISTS_DDL = "key binary, doc_id long, n_bytes long, media_sha binary, sizes array<int>, digests array<binary>"
_MEDIUM = "array<struct<key:binary,media_sha:binary,sizes:array<int>,digests:array<binary>,kept_at:array<int>,lent_at:array<int>>>"
STORE_DDL = f"borrows boolean, kept binary, media {_MEDIUM}, lent_digests array<binary>, lent array<binary>"
PART_DDL = "key binary, media_sha binary, sizes array<int>, digests array<binary>, have array<int>, own binary"
FEATURES_DDL = "key binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % SAMPLES if raw else SAMPLES)


def to_media(samples: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (SAMPLES, len(samples) // SAMPLES) + samples


def from_media(media: bytes) -> bytes:
    """The samples of a PGM file of ours."""
    magic, size, most, samples = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or most != b"255" or len(samples) != width * height:
        raise ValueError("not a grey image of 8-bit samples")
    return samples


def gear_hash(data: np.ndarray) -> np.ndarray:
    """At each place, the sum of GEAR[byte] << age over the last 32 bytes, modulo 2**32."""
    h = GEAR[data]
    span = 1
    while span < GEAR_WINDOW:
        older = h[:-span] << np.uint32(span)
        h = h.copy()
        h[span:] += older
        span *= 2
    return h


def cut_chunks(media: list[bytes]) -> list[list[int]]:
    """Chunk sizes of each medium. A chunk ends after a byte whose gear hash has zero top bits, LEAST bytes in at the soonest, or at MOST bytes."""
    data = np.frombuffer(b"".join(media), np.uint8)
    marks = np.flatnonzero(gear_hash(data) >> np.uint32(32 - MEAN.bit_length() + 1) == 0) + 1 if len(data) else np.zeros(0, np.int64)
    out, start = [], 0
    for m in media:
        end, at, sizes = start + len(m), start, []
        own = marks[np.searchsorted(marks, start, "right") : np.searchsorted(marks, end, "right")].tolist()
        i = 0
        while at < end:
            while i < len(own) and own[i] < at + LEAST:
                i += 1
            cut = min(own[i] if i < len(own) else end, at + MOST, end)
            sizes.append(cut - at)
            at = cut
        out.append(sizes)
        start = end
    return out


def _raw_texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    data, offsets = text_bytes(batch.column(column))
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _list_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches):
        raw = _raw_texts(batch, 2)
        media = [to_media(payload(r)) for r in raw]
        sizes = cut_chunks(media)
        digests = []
        for m, own in zip(media, sizes, strict=True):
            ends = np.cumsum(own).tolist()
            digests.append([hashlib.sha256(m[e - s : e]).digest()[:DIGEST_BYTES] for e, s in zip(ends, own, strict=True)])
        columns = [batch.column(0), batch.column(1), pa.array([len(r) for r in raw]), pa.array([hashlib.sha256(m).digest() for m in media]), sizes, digests]
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, LISTS, strict=True)], schema=LISTS)


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bz2.compress(r) for r in _raw_texts(batch, 1)], pa.binary())], names=["key", "packed"])


_MEDIUM_ARROW = pa.struct([("key", pa.binary()), ("media_sha", pa.binary()), ("sizes", pa.list_(pa.int32())), ("digests", pa.list_(pa.binary())), ("kept_at", pa.list_(pa.int32())), ("lent_at", pa.list_(pa.int32()))])


class _Pack:
    """An open pack: chunks of media that borrow, or of media that do not."""

    def __init__(self, borrows: bool):
        self.borrows = borrows
        self.clear()

    def clear(self) -> None:
        self.kept, self.size, self.media, self.digests, self.lent = [], 0, [], [], []

    def close(self) -> pa.RecordBatch:
        z = zstandard.ZstdCompressor(level=9)
        columns = [pa.array([self.borrows]), pa.array([bz2.compress(b"".join(self.kept))], pa.binary()), pa.array([self.media], pa.list_(_MEDIUM_ARROW)), pa.array([self.digests], pa.list_(pa.binary())), pa.array([[z.compress(c) for c in self.lent]], pa.list_(pa.binary()))]
        self.clear()
        return pa.RecordBatch.from_arrays(columns, names=["borrows", "kept", "media", "lent_digests", "lent"])


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packs = {b: _Pack(b) for b in (False, True)}
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            for key, sha, sizes, digests, packed, own in zip(*(c.to_pylist() for c in batch.slice(lo, 64).columns), strict=True):
                media = to_media(payload(bz2.decompress(packed)))
                ends = np.cumsum(sizes).tolist()
                chunks = [media[e - n : e] for e, n in zip(ends, sizes, strict=True)]
                owned = sorted((o["pos"], o["shared"]) for o in own or [])
                borrows = len(owned) < len(sizes)
                pack = packs[borrows]
                kept_at, lent_at = [p for p, shared in owned if not shared], [p for p, shared in owned if shared]
                pack.media.append({"key": key, "media_sha": sha, "sizes": sizes, "digests": digests if borrows else [], "kept_at": kept_at, "lent_at": lent_at})
                pack.kept += [chunks[p] for p in kept_at]
                pack.lent += [chunks[p] for p in lent_at]
                pack.digests += [digests[p] for p in lent_at]
                pack.size += sum(sizes)
                if pack.size >= PACK_BYTES:
                    yield pack.close()
    for pack in packs.values():
        if pack.media:
            yield pack.close()


def _open(batch: pa.RecordBatch) -> Iterator[tuple[dict, dict[int, bytes]]]:
    """(medium, its own chunks by place) for each medium of packs (kept, media, lent)."""
    un = zstandard.ZstdDecompressor()
    for kept, media, lent in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        whole, at, loans = bz2.decompress(kept), 0, iter(lent)
        for m in media:
            chunks = {}
            for p in m["kept_at"]:
                chunks[p] = whole[at : at + m["sizes"][p]]
                at += m["sizes"][p]
            for p in m["lent_at"]:
                chunks[p] = un.decompress(next(loans))
            yield m, chunks


def _feature_row(key: bytes, sha: bytes, chunks: list[bytes]) -> tuple:
    media = b"".join(chunks)
    if hashlib.sha256(media).digest() != sha:
        raise ValueError("a medium differs from its digest")
    samples = from_media(media)
    levels = np.bincount(np.frombuffer(samples, np.uint8) >> 4, minlength=16)
    return key, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-SAMPLES:]), len(media), sha.hex(), ",".join(map(str, levels.tolist()))


def _feature_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["key", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _read_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield _feature_batch([_feature_row(m["key"], m["media_sha"], [chunks[p] for p in range(len(m["sizes"]))]) for m, chunks in _open(batch.slice(i, 1))])


def _read_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary()]
    for batch in batches:
        for i in range(batch.num_rows):
            rows = [(m["key"], m["media_sha"], m["sizes"], m["digests"], sorted(chunks), bz2.compress(b"".join(chunks[p] for p in sorted(chunks)))) for m, chunks in _open(batch.slice(i, 1))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "media_sha", "sizes", "digests", "have", "own"])


def _complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    un = zstandard.ZstdDecompressor()
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            rows = []
            for key, sha, sizes, have, own, borrowed in zip(*(c.to_pylist() for c in batch.slice(lo, 64).columns), strict=True):
                chunks = {b["pos"]: un.decompress(b["chunk"]) for b in borrowed}
                whole, at = bz2.decompress(own), 0
                for p in have:
                    chunks[p] = whole[at : at + sizes[p]]
                    at += sizes[p]
                rows.append(_feature_row(key, sha, [chunks[p] for p in range(len(sizes))]))
            yield _feature_batch(rows)


def chunk_lists(docs: DataFrame) -> DataFrame:
    """The media table: per row of ``docs`` its medium's digest and ordered chunk list, written to the shared folder."""
    rows = docs.select(_key(), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialize(map_arrow(rows, _list_chunks, LISTS_DDL), "media-lists")


def _key():
    return F.unhex(F.left(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256), F.lit(2 * DIGEST_BYTES))).alias("key")


def chunk_store(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """The stored chunks, each distinct one once, in a row of its owner; written to the shared folder."""
    media = lists.groupBy("key").agg(*(F.first(c).alias(c) for c in ("media_sha", "sizes", "digests")))
    chunks = media.select("key", F.posexplode("digests").alias("pos", "digest"))
    owners = chunks.groupBy("digest").agg(F.min(F.struct("key", "pos")).alias("o"), F.count("*").alias("refs"))
    owned = owners.groupBy(F.col("o.key").alias("key")).agg(F.collect_list(F.struct(F.col("o.pos").alias("pos"), (F.col("refs") > 1).alias("shared"))).alias("own"))  # at most one medium's chunks
    owned = materialize(owned, "owned-chunks")
    release(docs.sparkSession)
    packed = map_arrow(docs.select(_key(), "text"), _compress, "key binary, packed binary").groupBy("key").agg(F.first("packed").alias("packed"))
    joined = packed.join(media, "key").join(owned, "key", "left")
    return materialize(map_arrow(joined.select("key", "media_sha", "sizes", "digests", "packed", "own"), _store, STORE_DDL), "chunk-store")


def read_media(store: DataFrame) -> DataFrame:
    """Per medium, put together from chunks and verified: its features."""
    packs = store.select("kept", "media", "lent", "borrows")
    whole = map_arrow(packs.where("not borrows").drop("borrows"), _read_whole, FEATURES_DDL)
    part = map_arrow(packs.where("borrows").drop("borrows"), _read_part, PART_DDL)
    borrowers = store.where("borrows").select(F.explode("media").alias("m")).select("m.key", "m.digests", "m.sizes", F.array_union("m.kept_at", "m.lent_at").alias("have"))
    places = F.sequence(F.lit(0), F.size("sizes") - 1)
    wanted = borrowers.select("key", "digests", F.explode(F.array_except(places, "have")).alias("pos")).select("key", "pos", F.get("digests", F.col("pos")).alias("digest"))
    lenders = store.select(F.explode(F.arrays_zip("lent_digests", "lent")).alias("l")).select(F.col("l.lent_digests").alias("digest"), F.col("l.lent").alias("chunk"))
    borrowed = wanted.join(lenders, "digest").groupBy("key").agg(F.collect_list(F.struct("pos", "chunk")).alias("borrowed"))  # at most one medium's chunks
    rest = map_arrow(part.join(borrowed, "key").select("key", "media_sha", "sizes", "have", "own", "borrowed"), _complete, FEATURES_DDL)
    return whole.unionByName(rest)


def op1_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    lists = chunk_lists(docs)
    store = chunk_store(docs, lists)
    release(spark)
    return lists.select("key", "doc_id", "n_bytes").join(read_media(store), "key").drop("key")
