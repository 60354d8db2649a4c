"""Exact token ids of whole texts by the ``tokenizers`` library, each distinct part encoded once.

The vocabulary's normaliser composes characters, turns white space to a blank and lowers case; its
splitter drops blanks and always cuts between a letter and a mark. So a text's ids are those of its
parts in order, if texts are cut at ASCII white space and between a Latin-1 letter and an ASCII mark,
and lowering ASCII and Latin-1 capitals beforehand changes nothing. Parts are found, hashed and
numbered by numpy over blocks of texts; the library sees each new part once, and its ids stay in a
bounded cache of the Python worker under the part's 64-bit hash. A part of Latin-1 letters only is
one word of the splitter, whose last id alone ends a word: many of them go to the library as one
text. Texts with ``<|``, which may hold a special token, go to the library whole.
"""

from __future__ import annotations

import os

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are parallel already

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from .common import byte_codes, prefix_hash, span_hash, text_bytes

#: Parts kept per Python worker, about 30 bytes each; beyond them the older ones are forgotten.
CACHE_PARTS = 1_200_000
#: Bytes of text that are encoded together; a longer text is cut at white space.
TOKEN_BLOCK = 1 << 20
#: Letter-only parts that go to the library as one text.
_JOINED = 256

_BLANK = np.zeros(256, bool)
_BLANK[list(b" \n\t\r")] = True
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes with ASCII and Latin-1 capitals lowered, whether each byte ends a letter of those)."""
    out = _LOWER[data]
    letter = _LETTER[out]
    second = np.zeros(len(data), bool)
    second[1:] = data[:-1] == 0xC3
    at = np.flatnonzero(second)
    b = out[at]
    out[at[(b >= 0x80) & (b <= 0x9E) & (b != 0x97)]] += 32
    letter[at] = (b >= 0x80) & (b != 0x97) & (b != 0xB7)
    return out, letter


def _rows(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[first[i]:first[i] + size[i]] for all i, one after another."""
    ends = np.cumsum(size)
    return flat[np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


class _Table:
    """Ids of parts: ascending keys, and where each part's ids stand."""

    def __init__(self, keys: np.ndarray, size: np.ndarray, ids: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.size = keys[order], size[order].astype(np.int32)
        self.first, self.ids = (np.cumsum(size) - size)[order], ids

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def with_others(self, more: _Table) -> _Table:
        return _Table(np.concatenate([self.keys, more.keys]), np.concatenate([self.size, more.size]).astype(np.int64), np.concatenate([_rows(t.ids, t.first, t.size) for t in (self, more)]))


_NONE = np.zeros(0, np.uint64)


class WordEncoder:
    def __init__(self, path: str, cache_parts: int = CACHE_PARTS):
        self.tokenizer = Tokenizer.from_file(path)
        self.most = cache_parts
        self.forget()
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def forget(self) -> None:
        self.old = self.new = _Table(_NONE, np.zeros(0, np.int64), np.zeros(0, np.uint32))

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _parts(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each part, all ids) by the library; ``words`` tells the parts of letters only."""
        size = np.zeros(len(start), np.int64)
        out: list[np.ndarray | None] = [None] * len(start)
        joined = np.flatnonzero(words)
        if len(joined):
            length = end[joined] - start[joined] + 1
            text = _rows(np.append(data, np.uint8(32)), start[joined], length)
            stop = np.cumsum(length)
            text[stop - 1] = 32
            cuts = np.append(0, stop[_JOINED - 1 :: _JOINED])
            cuts = cuts if cuts[-1] == stop[-1] else np.append(cuts, stop[-1])
            raw = text.tobytes()
            ids = np.concatenate(self._library([raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]))
            last = np.flatnonzero(self.ends_word[ids]) + 1
            if len(last) != len(joined):
                raise ValueError("the vocabulary does not end each word by one id")
            size[joined] = np.diff(last, prepend=0)
            single = np.flatnonzero(~words)
        else:
            ids, single = np.zeros(0, np.uint32), np.arange(len(start))
        if len(single):
            content = data.tobytes()
            found = self._library([content[a:b].decode("utf-8", "replace") for a, b in zip(start[single].tolist(), end[single].tolist(), strict=True)])
            size[single] = [len(f) for f in found]
            first = np.zeros(len(start), np.int64)
            own = size[joined]
            first[joined] = np.cumsum(own) - own
            own = size[single]
            first[single] = len(ids) + np.cumsum(own) - own
            ids = _rows(np.concatenate([ids, *found]), first, size)
        return size, ids

    def _ids(self, keys: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, size, ids): the ids of each distinct key, whose part stands at start to end."""
        first, size, flat, have = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), [], 0
        open_ = np.arange(len(keys))
        for table in (self.old, self.new):
            at = table.find(keys[open_])
            hit = at >= 0
            at, own = at[hit], open_[hit]
            size[own] = table.size[at]
            first[own] = have + np.cumsum(size[own]) - size[own]
            flat.append(_rows(table.ids, table.first[at], table.size[at]))
            have += len(flat[-1])
            open_ = open_[~hit]
        if len(open_):
            size[open_], ids = self._parts(data, start[open_], end[open_], words[open_])
            first[open_] = have + np.cumsum(size[open_]) - size[open_]
            flat.append(ids)
            fresh = _Table(keys[open_], size[open_], ids)
            self.new = self.new.with_others(fresh)
            if 8 * len(self.new.keys) > self.most:
                fits = len(self.old.keys) + len(self.new.keys) <= self.most
                self.old = self.old.with_others(self.new) if fits else self.new
                self.new = _Table(_NONE, np.zeros(0, np.int64), np.zeros(0, np.uint32))
        return first, size, np.concatenate(flat)

    def _encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data, letter = lowered(raw)
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        solid = ~_BLANK[data]
        cut = edge.copy()
        cut[1:n] |= letter[:-1] & _MARK[data[1:]]
        left = np.concatenate([[False], solid[:-1]])[:n]
        right = np.concatenate([solid[1:], [False]])[:n]
        start = np.flatnonzero(solid & (~left | cut[:-1]))
        end = np.flatnonzero(solid & (~right | cut[1:])) + 1
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        numbered = pa.array(span_hash(prefix_hash(byte_codes(data)), start, end)).dictionary_encode()
        at, keys = numbered.indices.to_numpy(), numbered.dictionary.to_numpy()
        place = np.empty(len(keys), np.int64)
        place[at[::-1]] = np.arange(len(at))[::-1]  # where each distinct part stands first
        other = ~letter
        other[:-1] &= ~((data[:-1] == 0xC3) & letter[1:])
        others = np.append(0, np.cumsum(other, dtype=np.int32))
        s, e = start[place], end[place]
        first, size, flat = self._ids(keys, data, s, e, others[e] == others[s])
        ends = np.concatenate([[0], np.cumsum(size[at])])
        return _rows(flat, first[at], size[at]), ends[np.searchsorted(start, offsets)]

    def encode_block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another as uint32, offsets); a null text is empty."""
        raw, offsets = text_bytes(texts)
        n = len(raw)
        if n <= TOKEN_BLOCK:
            ids, bounds = self._encode(raw, offsets)
        else:
            may_cut = np.flatnonzero(_BLANK[raw])
            parts, bounds, at, have = [], np.zeros(len(offsets), np.int64), 0, 0
            while at < n:
                i = int(np.searchsorted(may_cut, at + TOKEN_BLOCK, side="right")) - 1  # the last place that keeps the bound, or else the next
                if i < 0 or may_cut[i] < at:
                    i += 1
                end = n if at + TOKEN_BLOCK >= n or i == len(may_cut) else int(may_cut[i]) + 1
                lo, hi = np.searchsorted(offsets, at, side="left"), np.searchsorted(offsets, end, side="left")
                inner = offsets[lo:hi] - at
                ids, own = self._encode(raw[at:end], np.concatenate([[0], inner, [end - at]]))
                bounds[lo:hi] = have + own[1:-1]
                parts.append(ids)
                at, have = end, have + len(ids)
            bounds[np.searchsorted(offsets, n, side="left") :] = have
            ids = np.concatenate(parts)
        special = np.flatnonzero((raw[:-1] == 0x3C) & (raw[1:] == 0x7C)) if n else np.zeros(0, np.int64)
        if len(special):
            return self._whole(ids, bounds, raw, offsets, np.unique(np.searchsorted(offsets, special, side="right") - 1))
        return ids, bounds

    def _whole(self, ids: np.ndarray, bounds: np.ndarray, raw: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same with the texts of ``which`` encoded by the library as they are."""
        out = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        texts = [raw[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace") for i in which]
        for i, own in zip(which.tolist(), self._library(texts), strict=True):
            out[i] = own
        return np.concatenate(out), np.concatenate([[0], np.cumsum([len(o) for o in out])])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        return ids_of(self, pa.array(texts, pa.large_string()))


def ids_of(enc: WordEncoder, texts: pa.Array) -> list[np.ndarray]:
    """Ids of each text of an Arrow column."""
    ids, ends = enc.encode_block(texts)
    return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a vocabulary file; it outlives a task, so its cache does too."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
