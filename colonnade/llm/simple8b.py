"""Simple-8b word-aligned coding of token ids, vectorised.

A 64-bit word holds a 4-bit selector in its top bits and 60 bits of data: selector s stores
``COUNTS[s]`` ids of ``WIDTHS[s]`` bits each, the first in the lowest bits. Selector 15 is the
escape: its word holds one id of up to 60 bits in place of a packed group, so any id below 2**60
fits. Unused places of the last word of a block are zero; the block index says how many ids count.

File layout (little-endian): magic ``S8BF``, u32 version, u64 number of documents, u64 number of
blocks, i64 start of the file within its range; per document i64 doc_id, u8 null flag and u64 ids;
per block u64 ids and u64 first word; then the words of all blocks. A block has at most
``BLOCK_IDS`` ids and can be decoded by itself.
"""

from __future__ import annotations

import numpy as np

# Fixed values of the format: ids a word and bits an id, by selector 2 to 15.
COUNTS = np.array([0, 0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
BLOCK_IDS = 1 << 16
MAGIC, VERSION = b"S8BF", 1
_U = np.uint64


def encode_block(ids: np.ndarray) -> np.ndarray:
    """Words that hold ``ids`` in order; each word takes as many ids as fit."""
    ids = np.asarray(ids, _U)
    n = len(ids)
    if n and int(ids.max()) >> 60:
        raise ValueError("ids must be below 2**60")
    if not n:
        return np.zeros(0, _U)
    # bits of each id, then for each place the best selector: the first whose ids all fit (or the end comes first)
    limits = _U(1) << WIDTHS[2:].astype(_U)
    need = WIDTHS[2:].astype(np.uint8)[np.searchsorted(limits, ids, side="right")]
    best = np.full(n, 15, np.int8)
    open_ = np.ones(n, bool)
    tail = np.concatenate([need, np.zeros(60, np.uint8)])
    widest: dict[int, np.ndarray] = {}
    have, size = tail, 1
    for c in sorted(set(COUNTS[2:].tolist())):  # running maxima over c ids, each from the shorter one
        while size < c:
            step = min(size, c - size)
            have = np.maximum(have[:-step], have[step:])
            size += step
        widest[c] = have
    for s in range(2, 16):
        fits = open_ & (widest[int(COUNTS[s])][:n] <= WIDTHS[s])
        best[fits] = s
        open_ &= ~fits
    # walk the word starts; then pack all words of a selector at once
    step = COUNTS[best].tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += step[at]
    starts = np.array(starts)
    selector = best[starts].astype(np.int64)
    words = selector.astype(_U) << _U(60)
    padded = np.concatenate([ids, np.zeros(60, _U)])
    for s in np.unique(selector):
        rows = np.flatnonzero(selector == s)
        c, w = int(COUNTS[s]), int(WIDTHS[s])
        group = padded[starts[rows][:, None] + np.arange(c)]
        words[rows] |= np.bitwise_or.reduce(group << (np.arange(c, dtype=_U) * _U(w)), axis=1)
    return words


def decode_block(words: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of a block, as uint64."""
    words = np.asarray(words, _U)
    selector = (words >> _U(60)).astype(np.int64)
    if len(selector) and selector.min() < 2:
        raise ValueError("unknown selector")
    at = np.concatenate([[0], np.cumsum(COUNTS[selector])]).astype(np.int64)
    out = np.zeros(int(at[-1]), _U)
    data = words & _U((1 << 60) - 1)
    for s in np.unique(selector):
        rows = np.flatnonzero(selector == s)
        c, w = int(COUNTS[s]), int(WIDTHS[s])
        out[at[rows][:, None] + np.arange(c)] = (data[rows][:, None] >> (np.arange(c, dtype=_U) * _U(w))) & _U((1 << w) - 1)
    if len(out) < n:
        raise ValueError("block is too short")
    return out[:n]


def encode_file(doc_ids: list[int | None], ids: list[np.ndarray], start: int) -> bytes:
    """One file of whole documents in the given order."""
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    packed, index, first = [], [], 0
    for at in range(0, len(flat), BLOCK_IDS):
        part = flat[at : at + BLOCK_IDS]
        words = encode_block(part)
        index.append((len(part), first))
        first += len(words)
        packed.append(words)
    docs = np.zeros(len(doc_ids), np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u8")]))
    docs["id"] = [d or 0 for d in doc_ids]
    docs["null"] = [d is None for d in doc_ids]
    docs["n"] = [len(i) for i in ids]
    head = MAGIC + np.uint32(VERSION).tobytes() + np.array([len(docs), len(index), start], "<i8").tobytes()
    return head + docs.tobytes() + np.array(index, "<u8").tobytes() + b"".join(w.astype("<u8").tobytes() for w in packed)


def decode_file(content: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents as records id, null, n; all ids as uint32; start of the file within its range)."""
    if content[:4] != MAGIC or int(np.frombuffer(content, "<u4", 1, 4)[0]) != VERSION:
        raise ValueError("not a token file")
    n_docs, n_blocks, start = (int(x) for x in np.frombuffer(content, "<i8", 3, 8))
    kind = np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u8")])
    docs = np.frombuffer(content, kind, n_docs, 32)
    at = 32 + n_docs * kind.itemsize
    index = np.frombuffer(content, "<u8", 2 * n_blocks, at).reshape(-1, 2).astype(np.int64)
    words = np.frombuffer(content, "<u8", -1, at + 16 * n_blocks) if len(content) > at + 16 * n_blocks else np.zeros(0, _U)
    ends = np.append(index[1:, 1], len(words))
    parts = [decode_block(words[first:end], n) for (n, first), end in zip(index, ends, strict=True)]
    return docs, (np.concatenate(parts) if parts else np.zeros(0, _U)).astype(np.uint32), start
