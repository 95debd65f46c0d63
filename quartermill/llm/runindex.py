"""A run-length index of a few megabytes of text: run-compressed Burrows-Wheeler transform with samples.

The text is a list of strings (contexts). Suffixes end at their string's end; equal ones
are ordered by string, so that stepping to the preceding letter keeps their order. Kept
are the runs of the transform, the number of each letter before each run, the row of each
string's last stretch of `length` letters, and, sampled where the first `length` letters of neighbouring rows differ,
the earliest start among the rows of that stretch. The suffix array itself is dropped.
"""

from __future__ import annotations

import numpy as np


class RunLengthIndex:
    def __init__(self, strings: list[bytes], length: int):
        sizes = np.array([len(s) for s in strings], np.int64)
        # letters are 1 to 256; 0 closes each string
        text = np.zeros(int(sizes.sum()) + len(strings), np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        self.ends = self.starts + sizes
        inside = np.ones(len(text), bool)
        inside[self.ends] = False
        text[inside] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + 1
        close = np.repeat(self.ends, sizes + 1)
        order, stretch = self._sorted(text, close, int(sizes.max()) + 1, length)

        before = np.where(order > 0, text[order - 1], 0)
        heads = np.flatnonzero(np.diff(before, prepend=-1))
        self.run_start, self.run_letter = heads, before[heads]
        run_length = np.diff(heads, append=len(order))
        # where a run's first row goes: letters smaller than its own, then the same letter's earlier runs
        by_letter = np.argsort(self.run_letter, kind="stable")
        target = np.zeros(len(heads), np.int64)
        target[by_letter] = np.cumsum(run_length[by_letter]) - run_length[by_letter]
        self.run_target = target
        row = np.empty(len(order), np.int64)
        row[order] = np.arange(len(order))
        self.last_rows = row[np.maximum(self.ends - length, self.starts)]
        self.length = length
        self.stretch_start = np.flatnonzero(np.diff(stretch, prepend=-1))
        self.order_for_samples = order  # until sampled() is called

    @staticmethod
    def _sorted(text: np.ndarray, close: np.ndarray, longest: int, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows in suffix order, and for each row the rank of its first `length` letters."""
        n, at = len(text), np.arange(len(text))

        def ranked(key):
            order = np.argsort(key)
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.diff(key[order], prepend=key[order[0]]) != 0)
            return rank

        key, depth = np.zeros(n, np.int64), 7
        for k in range(depth):
            key = key * 257 + text[np.minimum(at + k, close)]
        rank = ranked(key)
        exact = None
        while depth < longest:
            if exact is None and 2 * depth >= length:
                exact = ranked(rank * n + rank[np.minimum(at + length - depth, close)])
            rank = ranked(rank * n + rank[np.minimum(at + depth, close)])
            depth *= 2
        order = np.argsort(rank * n + at)
        return order, (rank if exact is None else exact)[order]

    def sampled(self, allowed: np.ndarray, worth: np.ndarray) -> None:
        """Keeps, for each stretch, the smallest worth among the allowed starts; drops the suffix array."""
        order = self.order_for_samples
        value = np.where(allowed[order], worth[order], np.iinfo(np.int64).max)
        self.earliest = np.minimum.reduceat(value, self.stretch_start)
        del self.order_for_samples

    def back(self, rows: np.ndarray) -> np.ndarray:
        """Rows of the suffixes one letter longer."""
        run = np.searchsorted(self.run_start, rows, "right") - 1
        return self.run_target[run] + rows - self.run_start[run]

    def stream(self):
        """Walks all strings together from their last window of `length` letters to their starts.

        Yields (strings still walking, the window's offset, earliest worth among equal windows).
        """
        rows, left = self.last_rows.copy(), self.ends - self.starts - self.length
        live = np.flatnonzero(left >= 0)
        while len(live):
            stretch = np.searchsorted(self.stretch_start, rows[live], "right") - 1
            yield live, left[live], self.earliest[stretch]
            left[live] -= 1
            live = live[left[live] >= 0]
            rows[live] = self.back(rows[live])
