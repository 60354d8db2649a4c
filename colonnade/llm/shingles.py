"""Word shingles of whole texts as sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np

from .common import byte_codes, prefix_hash, span_hash

WORDS = 5
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end of each word; first word of each text and one past the last).

    A word is a longest run of bytes other than blank, tab and line ends; A-Z count as a-z.
    """
    solid = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    left = np.concatenate([[False], solid[:-1]])[: len(data)]
    right = np.concatenate([solid[1:], [False]])[: len(data)]
    start = np.flatnonzero(solid & (~left | edge[:-1]))
    end = np.flatnonzero(solid & (~right | edge[1:])) + 1
    prefix = prefix_hash(byte_codes(_LOWER[data]))
    return span_hash(prefix, start, end), start, end, np.searchsorted(start, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """Each text's distinct shingles, ascending; a text of fewer words has one, of all its words; none without words."""
    h, _, _, first = word_hashes(data, offsets)
    prefix = prefix_hash(h)
    n = len(h)
    grams = span_hash(prefix, np.arange(max(n - words + 1, 0)), np.arange(words, n + 1)) if n >= words else np.zeros(0, np.uint64)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(grams[a : b - words + 1]))
        elif b > a:
            out.append(span_hash(prefix, np.array([a]), np.array([b])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
