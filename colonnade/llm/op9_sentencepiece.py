"""SentencePiece encoding and decoding by a streaming Viterbi search over a public vocabulary.

The best segmentation has the greatest sum of piece scores (ties: the longest last piece). Text is
read code point by code point. Only positions at most one piece length back can still start a
piece, so the search keeps a window of that many scores. When the backpointer paths from all of
them meet at one boundary, everything before it is final: its ids are committed and forgotten.

A code point that no piece covers costs the vocabulary's least score less 10 and becomes its UTF-8
bytes' pieces. As in the model's own rules a blank becomes U+2581 and one is put before the text;
nothing else is normalised, so decoding gives the text back (a U+2581 in it becomes a blank).

No piece holds U+2581 after another character, nor a line end, so paths always meet before a
U+2581 that follows something else, and around a line end. Between such places, segments repeat
over and over: their ids are kept in a bounded cache per Python worker.

Defined cases: a null or empty text has no ids; repeated rows give equal rows; an empty table gives
an empty result; extra columns are not carried.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, blocks, documents, map_arrow

BLANK = "▁"
UNKNOWN_PENALTY = 10.0
#: Segments kept per Python worker; at the bound the cache starts anew. A text of more has its own, for itself alone.
CACHE_SEGMENTS = 600_000
SCHEMA = "doc_id long, n_tokens long, ids_crc32 long, n_bytes long, decoded_sha256 string, round_trip boolean"


class Vocabulary:
    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int]):
        """pieces: id and score of each; byte_ids: the ids of the 256 byte pieces."""
        self.pieces, self.byte_ids = pieces, byte_ids
        self.longest = max(map(len, pieces), default=1)
        self.unknown = min((s for _, s in pieces.values()), default=0.0) - UNKNOWN_PENALTY
        self.trie: dict = {}  # by code points; "" holds a piece's id and score
        for p, found in pieces.items():
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = found
        self.text_of = {i: p.encode() for p, (i, _) in pieces.items()} | {i: bytes([b]) for b, i in enumerate(byte_ids)}
        self.cuts_at_blank = not any(BLANK in p.lstrip(BLANK) for p in pieces)
        self.cuts_at_line_end = not any("\n" in p for p in pieces)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            model = sentencepiece.SentencePieceProcessor(model_proto=f.read())
        normal, of_byte = {}, [0] * 256
        for i in range(model.get_piece_size()):
            if model.is_byte(i):
                of_byte[int(model.id_to_piece(i)[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                normal[model.id_to_piece(i)] = (i, model.get_score(i))
        return cls(normal, of_byte)


class StreamingViterbi:
    """Feed text in parts of any size; ``feed`` and ``finish`` return the ids that became final."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.text = ""  # code points not yet committed
        self.best: list[float] = [0.0]  # best[i]: score of the best path to place i, or -inf
        self.back: list[tuple[int, int]] = [(0, -1)]  # back[i]: start of the last piece on it, and its id (-1: unknown)
        self.read = 0  # places whose outgoing pieces have been tried
        self.widest = 0  # most code points ever held back

    def _reach(self, end: bool) -> None:
        """Try all pieces from each place whose longest piece lies within the text."""
        v, text, best, back = self.v, self.text, self.best, self.back
        trie, longest, unknown = v.trie, v.longest, v.unknown
        n = len(text)
        while len(best) <= n:
            best.append(float("-inf"))
            back.append((0, -1))
        last = n if end else n - longest + 1
        for i in range(self.read, max(last, self.read)):
            score, node, single = best[i], trie, False
            for j in range(i, min(i + longest, n)):
                node = node.get(text[j])
                if node is None:
                    break
                found = node.get("")
                if found is not None:
                    single |= j == i
                    if score + found[1] > best[j + 1]:
                        best[j + 1], back[j + 1] = score + found[1], (i, found[0])
            if not single and score + unknown > best[i + 1]:
                best[i + 1], back[i + 1] = score + unknown, (i, -1)
        self.read = max(last, self.read)

    def _commit(self, places: Iterable[int]) -> list[int]:
        """Ids before the boundary where the paths from all ``places`` meet; drops what they cover."""
        live = sorted(set(places))
        while len(live) > 1:  # replace the furthest place by its predecessor
            at = self.back[live.pop()][0]
            if at not in live:
                live.append(at)
                live.sort()
        cut = at = live[0]
        path = []
        while at > 0:
            start, piece = self.back[at]
            path.append([self.v.byte_ids[b] for b in self.text[start:at].encode("utf-8", "surrogatepass")] if piece < 0 else [piece])
            at = start
        if cut:
            base = self.best[cut]
            self.text = self.text[cut:]
            self.best = [s - base for s in self.best[cut:]]
            self.back = [(a - cut, p) for a, p in self.back[cut:]]
            self.read -= cut
        return [i for ids in reversed(path) for i in ids]

    def feed(self, part: str) -> list[int]:
        self.text += part
        self.widest = max(self.widest, len(self.text))
        if len(self.text) < self.v.longest:  # no place's longest piece lies within the text yet
            return []
        self._reach(False)
        reached = [i for i in range(self.read, min(self.read + self.v.longest, len(self.best))) if self.best[i] != float("-inf")]
        return self._commit(reached) if reached else []

    def finish(self) -> list[int]:
        self._reach(True)
        ids = self._commit([len(self.text)])
        self.__init__(self.v)
        return ids


class Encoder:
    def __init__(self, vocabulary: Vocabulary, most: int = CACHE_SEGMENTS):
        self.v, self.most, self.search = vocabulary, most, StreamingViterbi(vocabulary)
        self.known: dict[str, bytes] = {}
        parts = [f"\n|{BLANK}*[^{BLANK}\n]+|{BLANK}+" if vocabulary.cuts_at_line_end else f"{BLANK}*[^{BLANK}]+|{BLANK}+"]
        self.split = re.compile(parts[0]).findall if vocabulary.cuts_at_blank else lambda text: [text]

    def _search(self, segment: str) -> bytes:
        ids: list[int] = []
        for lo in range(0, len(segment), 256):
            ids += self.search.feed(segment[lo : lo + 256])
        return np.array(ids + self.search.finish(), np.uint32).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        segments = self.split(BLANK + text.replace(" ", BLANK))
        known = self.known
        missing = {s for s in segments if s not in known}
        if len(known) + len(missing) > self.most:
            known.clear()
            missing = set(segments)
            if len(missing) > self.most:
                known = {}  # this text's own
        for s in missing:
            known[s] = self._search(s)
        return np.frombuffer(b"".join(map(known.__getitem__, segments)), np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.v.text_of.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")
        return text.replace(BLANK, " ")[1:]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(Vocabulary.load(path))
    return _encoders[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of each text."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in blocks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([enc.encode(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), encoded, "doc_id long, ids array<int>")


def check_documents(docs: DataFrame, path: str) -> DataFrame:
    """Each text encoded and decoded again: the ids' count and CRC, the decoded text's digest, and whether it is the text."""

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, schema = encoder(path), arrow_schema(SCHEMA)
        for batch in blocks(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = enc.encode(text)
                back = enc.decode(ids) if len(ids) else ""
                raw = back.encode("utf-8", "surrogatepass")
                rows.append((doc_id, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), len(raw), hashlib.sha256(raw).hexdigest(), back == (text or "").replace(BLANK, " ")))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), checked, SCHEMA)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_documents(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
