"""Values of distinct words, computed once in a worker and remembered up to a bound."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from . import textkernel

#: Words whose values a worker remembers.
LIMIT = 600_000


class WordTable:
    """compute: from a list of distinct words in UTF-8 to a matrix with one row of values each."""

    def __init__(self, compute: Callable[[list[bytes]], np.ndarray], lower: bool = False):
        self.compute, self.lower = compute, lower
        self._forget()

    def _forget(self) -> None:
        self.keys, self.checks, self.values = np.zeros(0, np.uint64), np.zeros(0, np.uint64), None

    def _of(self, w: textkernel.Words) -> tuple[np.ndarray, np.ndarray]:
        """Values of the distinct words of a chunk, and for each word its place among them.

        A word is known by its hash and by a second one; where only the first is that of a known word, it is computed
        for itself.
        """
        keys, first, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
        if len(self.keys) > LIMIT:
            self._forget()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        new, checks = np.flatnonzero(~known), w.checks()
        if len(new) or self.values is None:
            made = self.compute([w.word(i) for i in first[new]])
            self.values = np.insert(self.values, at[new], made, axis=0) if self.values is not None else made
            self.keys, self.checks = np.insert(self.keys, at[new], keys[new]), np.insert(self.checks, at[new], checks[first[new]])
            at = np.searchsorted(self.keys, keys)
        values, other = self.values[at], np.flatnonzero(self.checks[at][inverse] != checks)
        if len(other):
            inverse[other] = len(values) + np.arange(len(other))
            values = np.concatenate([values, self.compute([w.word(i) for i in other])])
        return values, inverse

    def sums(self, column: pa.Array) -> np.ndarray:
        """One row for each text: the number of its words and the sums of their values."""
        parts: list[np.ndarray] = []
        for w in textkernel.words(column, lower=self.lower):
            values, inverse = self._of(w)
            counts = np.diff(w.row_offsets)
            out = np.zeros((w.last - w.first, values.shape[1] + 1))
            out[:, 0] = counts
            filled = np.flatnonzero(counts)
            if len(filled):
                out[filled, 1:] = np.add.reduceat(values[inverse], w.row_offsets[:-1][filled], axis=0)
            parts.append(out)
        return np.concatenate(parts) if parts else np.zeros((0, 1))

    def counts(self, w: textkernel.Words, rows: np.ndarray) -> Iterator[tuple[bytes, int]]:
        """Distinct words of the chosen rows of a chunk, with their numbers."""
        chosen = np.repeat(rows, np.diff(w.row_offsets))
        at = np.flatnonzero(chosen)
        pairs = np.empty(len(at), "u8,u8")
        pairs["f0"], pairs["f1"] = w.hashes[at], w.checks(at)
        order = np.lexsort((pairs["f1"], pairs["f0"]))
        new = np.flatnonzero(np.concatenate(([True], pairs[order][1:] != pairs[order][:-1])) if len(at) else np.zeros(0, bool))
        for i, k in zip(at[order[new]], np.diff(np.append(new, len(at))).tolist(), strict=True):
            yield w.word(i), k
