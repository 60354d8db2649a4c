"""Enhanced suffix array of a batch of byte strings, and its common-prefix interval tree."""

from __future__ import annotations

import numpy as np

_LEVELS = (8, 16, 32, 64, 128, 256, 512, 1024)


class SuffixArray:
    """Suffixes that start at ``starts`` of the strings laid one after another; none runs past its string.

    ``order`` lists the starts in lexicographic order, equal suffixes by place; ``lcp[i]`` is the length
    of the common prefix of the i-th and the one before it (``lcp[0]`` is 0). Ranks of prefixes of
    8, 16, ... 1,024 bytes come from doubling, so whole suffixes are ordered: strings may be at most
    1,000 bytes long.
    """

    def __init__(self, strings: list[bytes], starts: np.ndarray):
        sizes = np.array([len(s) for s in strings], np.int64)
        if len(sizes) and sizes.max() > 1000:
            raise ValueError("a string is too long")
        self.text = np.frombuffer(b"".join(strings), np.uint8)
        n = len(self.text)
        self.ends = np.cumsum(sizes)
        self.stop = np.repeat(self.ends, sizes)  # end of the string that holds each place
        places = np.arange(n)
        word = np.zeros(n, np.uint64)
        for i in range(8):
            inside = places + i < self.stop
            word = (word << np.uint64(8)) | np.where(inside, self.text[np.minimum(places + i, n - 1)], 0).astype(np.uint64)
        first = self._dense(word)
        if (self.text == 0).any():  # tell a zero byte from the string's end
            first = self._dense(first.astype(np.uint64) * np.uint64(9) + np.minimum(self.stop - places, 8).astype(np.uint64))
        self.ranks = [first]
        for length in _LEVELS[:-1]:
            low = self.ranks[-1]
            at = np.minimum(places + length, n - 1)
            high = np.where(places + length < self.stop, low[at] + 1, 0)
            self.ranks.append(self._dense(low.astype(np.uint64) * np.uint64(n + 2) + high.astype(np.uint64)))
        starts = np.asarray(starts, np.int64)
        self.order = starts[np.lexsort((starts, self.ranks[-1][starts]))]
        self.lcp = np.zeros(len(starts), np.int64)
        if len(starts) > 1:
            self.lcp[1:] = self._common(self.order[:-1], self.order[1:])

    @staticmethod
    def _dense(keys: np.ndarray) -> np.ndarray:
        order = np.argsort(keys)
        step = np.zeros(len(keys), np.int64)
        step[1:] = keys[order][1:] != keys[order][:-1]
        out = np.empty(len(keys), np.int64)
        out[order] = np.cumsum(step)
        return out

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = len(self.text)
        most = np.minimum(self.stop[a] - a, self.stop[b] - b)
        done = np.zeros(len(a), np.int64)
        for length, rank in zip(_LEVELS[::-1], self.ranks[::-1], strict=True):
            same = (done < most) & (rank[np.minimum(a + done, n - 1)] == rank[np.minimum(b + done, n - 1)])
            done += np.where(same, length, 0)
        for _ in range(7):
            same = (done < most) & (self.text[np.minimum(a + done, n - 1)] == self.text[np.minimum(b + done, n - 1)])
            done += same
        return np.minimum(done, most)

    def intervals(self, least: int) -> list[tuple[int, int, int]]:
        """The interval tree's nodes (lcp, first, last in ``order``) of lcp ``least`` and more, children before parents."""
        out = []
        lcp = self.lcp
        deep = np.flatnonzero(lcp >= least)
        if not len(deep):
            return out
        breaks = np.flatnonzero(np.diff(deep) > 1) + 1
        for run in np.split(deep, breaks):  # each run of deep neighbours is a tree by itself
            first = int(run[0]) - 1
            stack: list[tuple[int, int]] = []
            for i, value in enumerate(lcp[run].tolist()):
                left = first + i
                while stack and stack[-1][0] > value:
                    depth, left = stack.pop()
                    out.append((depth, left, first + i))
                if not stack or stack[-1][0] < value:
                    stack.append((value, left))
            for depth, left in reversed(stack):
                out.append((depth, left, int(run[-1])))
        return out

    def maximal_repeats(self, least: int, left_open: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(length, all places) of every repeat that neither a byte more on the right nor one on the left keeps together.

        A node's suffixes differ on the right by construction. They are diverse on the left if their
        preceding bytes are not all equal; at ``left_open`` places that byte is unknown, so differs.
        """
        before = np.where(left_open[self.order], -1 - self.order, self.text[self.order - 1])
        changes = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])])
        return [(depth, self.order[a : b + 1]) for depth, a, b in self.intervals(least) if changes[b] > changes[a]]
