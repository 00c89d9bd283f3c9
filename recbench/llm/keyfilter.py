"""A filter of 64-bit keys of a bounded size, to be sent to all tasks: never no for a key that is in the set."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released

#: A filter of keys is SLICES parts of up to 2 ** PART bits, about 16 bits a key where that is less. It lets some other
#: keys through.
SLICES, PART = 16, 24


class Keys:
    """Whether keys may be in a set: never no for one that is."""

    def __init__(self, bits: np.ndarray, part: int):
        self.bits, self.part = bits, part

    @staticmethod
    def probes(keys: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray]:
        own = np.uint64((1 << part) - 1)
        return (keys & own).astype(np.int64), (keys >> np.uint64(part) & own).astype(np.int64)

    def may_have(self, keys: np.ndarray) -> np.ndarray:
        first, out = (keys >> np.uint64(60)).astype(np.int64) << self.part, np.ones(len(keys), bool)
        for at in self.probes(keys, self.part):
            at |= first
            out &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out


def _marked(part: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            keys = batch.column(0).to_numpy().view(np.uint64)
            own = keys >> np.uint64(60)
            for i in np.unique(own).tolist():
                bits = held.setdefault(i, np.zeros(1 << part, bool))
                for at in Keys.probes(keys[own == i], part):
                    bits[at] = True
        for i, bits in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()])], ["part", "bits"])

    return run


def key_filter(df: DataFrame) -> Keys:
    """The filter of the column key, of a bounded size.

    Beyond some 10^8 keys its bits are nearly all set and it lets almost everything through; what a filter saves is then
    lost, and nothing else.
    """
    part = min(PART, max(10, (df.count() * 16 // SLICES).bit_length()))
    parts = df.select("key").repartition(SLICES, F.shiftrightunsigned("key", 60)).mapInArrow(released(_marked(part)), "part int, bits binary").toArrow()
    size = 1 << part - 3
    bits = np.zeros(SLICES * size, np.uint8)
    for i, x in zip(parts.column(0).to_pylist(), parts.column(1), strict=True):
        bits[i * size : (i + 1) * size] = np.frombuffer(x.as_buffer(), np.uint8)
    return Keys(bits, part)
