"""Words of many texts as 64-bit hashes, computed over whole Arrow buffers.

A word is a run of bytes other than space and the control characters 9 to 13, lower-cased A to Z. Its hash starts from
its length and takes in eight bytes at a time, each time by a mixture that isn't linear in them; words longer than
LANES * 8 bytes are hashed by BLAKE2. Two different words have one hash with a chance of about 2^-64; tables that must
not mistake one word for another look at a second, independent hash as well (Words.checks). Texts are taken in chunks
of about CHUNK bytes, so temporary arrays stay small; a longer text is a chunk of its own, whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Words of more blocks of eight bytes are hashed one by one.
LANES = 32
#: The bytes of a block that belong to the word, by their number.
_OWN = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: The fifth and further multipliers of mixtures of several hashes.
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 1) -> np.ndarray:
    """Hashes of the words at data[start:end]."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    blocks = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from every place on
    length = end - start
    out, step = mix(length.astype(np.uint64) * _STEP + np.uint64(seed)), np.uint64((2 * seed + 1) * int(_STEP) & (1 << 64) - 1)
    at, lane = np.flatnonzero(length <= 8 * LANES), 0
    while len(at):
        left = length[at] - 8 * lane
        own = blocks[start[at] + 8 * lane] & _OWN[np.minimum(left, 8)]
        out[at] = mix((out[at] ^ own) * step + np.uint64(lane))
        at, lane = at[left > 8], lane + 1
    for i in np.flatnonzero(length > 8 * LANES):
        told = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, key=seed.to_bytes(8, "little")).digest()
        out[i] = int.from_bytes(told, "little")
    return out


@dataclass
class Words:
    """Words of rows first to last (exclusive): hashes, byte ranges in data, where each row's words and bytes begin."""

    first: int
    last: int
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    row_offsets: np.ndarray
    row_bytes: np.ndarray

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def checks(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Second hashes of words, independent of the first."""
        return word_hashes(self.data, self.start[at], self.end[at], seed=2)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about CHUNK bytes each."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        yield at, min(to, n)
        at = to


def words(column: pa.Array, lower: bool = True) -> Iterator[Words]:
    data, offsets = buffers(column)
    for first, last in chunks(offsets):
        own = data[offsets[first] : offsets[last]]
        own = _LOWER[own] if lower else own
        rows = offsets[first : last + 1] - offsets[first]
        n = len(own)
        if not n:
            none = np.zeros(0, np.int64)
            yield Words(first, last, own, none, none, np.zeros(0, np.uint64), np.zeros(last - first + 1, np.int64), rows)
            continue
        inside = ~_SPACE[own]
        before = np.empty(n, dtype=bool)
        before[0] = False
        before[1:] = inside[:-1]
        before[rows[:-1][rows[:-1] < n]] = False
        after = np.empty(n, dtype=bool)
        after[-1] = False
        after[:-1] = inside[1:]
        after[rows[1:][rows[1:] > 0] - 1] = False
        start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        yield Words(first, last, own, start, end, word_hashes(own, start, end), np.searchsorted(start, rows), rows)


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """The hash of a sequence from the hashes of its members, element by element."""
    out = np.zeros_like(parts[0])
    for x in parts:
        out = out * _STEP + x
    return mix(out + np.uint64(len(parts)))


def shingle_sets(w: Words, size: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its runs of `size` words; of all its words if they are fewer."""
    n = len(w.hashes)
    runs = combine([w.hashes[i : n - size + 1 + i] for i in range(size)]) if n >= size else None
    offsets = w.row_offsets.tolist()
    for a, b in zip(offsets, offsets[1:], strict=False):
        if b - a >= size:
            x = np.sort(runs[a : b - size + 1])
            yield x[np.concatenate(([True], x[1:] != x[:-1]))]
        elif b > a:
            yield combine([w.hashes[i : i + 1] for i in range(a, b)])
        else:
            yield w.hashes[:0]
