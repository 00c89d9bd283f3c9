"""Operator 7, packing documents into sequences: bounded-space online best fit with open windows in each partition."""

from __future__ import annotations

import bisect
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel
from .common import Tables

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Distinct chunks of text whose ids a worker remembers.
CACHE = 1_500_000
#: Partitions whose leftovers are merged in one task.
MERGED = 16
#: White space as the pre-tokenizer has it (fixed values).
_SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_RUNS = re.compile(f"({_SPACE}{{2,}})")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of whole texts by a byte-level BPE of the tokenizers library.

    The pre-tokenizer of these files never joins what stands before a single space or line break to what follows, so
    a text's ids are those of its chunks in order: each distinct chunk is encoded once by the library and remembered.
    A run of several white-space characters is a chunk up to its last character, as the pre-tokenizer has it.

    A chunk's key is its word if a space leads it, "\n" and the word if a line break does, and "\n\n" and the word if
    nothing does; no word holds a line break.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.line = self._ids("\n")
        self._forget()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _forget(self) -> None:
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # of hashes, sorted
        self.checks = np.zeros(0, np.uint64)
        self.ends = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.used = 0

    @staticmethod
    def _chunks(part: str, lead: str, out: list[str]) -> None:
        """Keys of a text without runs of white space; lead: what marks its first word."""
        for line in part.split("\n"):
            words = line.split(" ")
            words[0] = lead + words[0]
            out += words
            lead = "\n"

    def chunks(self, text: str) -> list[str]:
        parts, out = _RUNS.split(text), []
        self._chunks(parts[0], "\n\n", out)
        for run, part in zip(parts[1::2], parts[2::2], strict=True):
            if not part:
                out.append("\n\n" + run)
            else:
                out.append("\n\n" + run[:-1])
                if run[-1] not in " \n":
                    out.append("\n\n" + run[-1])
                self._chunks(part, {" ": "", "\n": "\n"}.get(run[-1], "\n\n"), out)
        return out

    def _encoded(self, keys: list[str]) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
        """(place of each key, ends, ids) of distinct chunks: ordinary ones are encoded as the lines of one text, which
        leaves each as it is; the rest one by one."""
        spaced, led, odd = [], [], []
        for key in keys:
            if key and key[0] != "\n":
                (spaced if not (key[0].isspace() or key[-1].isspace()) else odd).append(key)
            elif len(key) > 1 and key[1] != "\n" and not (key[1].isspace() or key[-1].isspace()):
                led.append(key)
            else:
                odd.append(key)
        text = "".join(["\n " + k for k in spaced]) + "".join(led)
        ids = np.array(self._ids(text), np.uint32)
        cuts = np.flatnonzero(ids == self.line[0])
        if len(self.line) != 1 or len(cuts) != len(spaced) + len(led):  # a line break doesn't stand alone here
            odd, spaced, led = spaced + led + odd, [], []
            ids, cuts = ids[:0], cuts[:0]
        length = np.diff(np.append(cuts, len(ids)))
        length[: len(spaced)] -= 1  # the line break belongs to the chunks that one leads
        ids = np.delete(ids, cuts[: len(spaced)])
        found: list[list[int]] = []
        for key in odd:
            bare = key[:2] == "\n\n"
            text = key[2:] if bare else key[1:] if key[:1] == "\n" else " " + key
            found.append(([] if bare or key[:1] != "\n" else self.line) + (self._ids(text) if text else []))
        place, at = {}, 0
        for part in (spaced, led, odd):
            place.update(zip(part, range(at, at + len(part)), strict=True))
            at += len(part)
        length = np.concatenate([length, np.array([len(x) for x in found], np.int64)])
        return place, np.concatenate([[0], np.cumsum(length)]), np.concatenate([ids, np.fromiter(itertools.chain.from_iterable(found), np.uint32)])

    @staticmethod
    def _gather(at: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of the chunks at these places, one after the other."""
        length = ends[at + 1] - ends[at]
        upto = np.cumsum(length)
        return ids[np.repeat(ends[at] - upto + length, length) + np.arange(upto[-1] if len(upto) else 0)], length

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Texts of any kind, without remembering their chunks."""
        keys = [self.chunks(t) for t in texts]
        if not keys:
            return []
        place, ends, ids = self._encoded(list(set(itertools.chain.from_iterable(keys))))
        return [self._gather(np.array([place[k] for k in ks], np.int64), ends, ids)[0] for ks in keys]

    def _plain(self, w: textkernel.Words) -> np.ndarray:
        """Which rows are words with one space or line break between two of them and no other white space."""
        count, data = np.diff(w.row_offsets), w.data
        plain = count > 0
        inner = np.add.reduceat(w.end - w.start, w.row_offsets[:-1][plain]) if plain.any() else np.zeros(0, np.int64)
        size = np.diff(w.row_bytes)[plain]
        first, last = w.row_offsets[:-1][plain], w.row_offsets[1:][plain] - 1
        plain[plain] = (inner + count[plain] - 1 == size) & (w.start[first] == w.row_bytes[:-1][plain]) & (w.end[last] == w.row_bytes[1:][plain])
        before = data[np.maximum(w.start - 1, 0)]
        led = np.ones(len(w.start), bool)
        led[w.row_offsets[:-1][count > 0]] = False
        bad = w.start[led & (before != 32) & (before != 10)]
        high = np.flatnonzero(data >= 0xC2)
        a, b = data[high], data[np.minimum(high + 1, len(data) - 1)]
        # Beginnings of the characters of more bytes that are white space.
        bad = np.concatenate([bad, high[(a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) | (a == 0xE2) & ((b == 0x80) | (b == 0x81)) | (a == 0xE3) & (b == 0x80)]])
        plain[np.searchsorted(w.row_bytes, bad, "right") - 1] = False
        return plain

    def columns(self, column: pa.Array) -> Iterator[list[np.ndarray]]:
        """The ids of each text of a column, in lists of some texts at a time.

        In plain rows chunks are told apart by hash, so that no string is made for a chunk that is known. A chunk is a
        known one only if a second hash says so too; a row where it doesn't is encoded without the table.
        """
        for w in textkernel.words(column, lower=False):
            plain = self._plain(w)
            count = np.diff(w.row_offsets)
            mine = np.flatnonzero(np.repeat(plain, count))
            before = w.data[np.maximum(w.start[mine] - 1, 0)]
            lead = np.where(before == 32, np.uint64(1), np.uint64(2))
            lead[np.searchsorted(mine, w.row_offsets[:-1][plain])] = np.uint64(3)
            hashes, checks = textkernel.mix(w.hashes[mine] + lead), textkernel.mix(w.checks(mine) + lead)
            distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            if self.used > CACHE:
                self._forget()
            at = np.searchsorted(self.keys, distinct)
            known = np.zeros(len(distinct), bool)
            inside = at < len(self.keys)
            known[inside] = self.keys[at[inside]] == distinct[inside]
            new = np.flatnonzero(~known)
            if len(new):
                marks = ("", "", "\n", "\n\n")
                strings = [marks[k] + w.word(i).decode() for i, k in zip(mine[first[new]], lead[first[new]].tolist(), strict=True)]
                place, ends, ids = self._encoded(strings)
                places = np.array([place[x] for x in strings], np.int64) + self.used
                self.keys, self.place = np.insert(self.keys, at[new], distinct[new]), np.insert(self.place, at[new], places)
                self.checks = np.insert(self.checks, at[new], checks[first[new]])
                self.ends, self.ids = np.concatenate([self.ends, self.ends[-1] + ends[1:]]), np.concatenate([self.ids, ids])
                self.used += len(strings)
                at = np.searchsorted(self.keys, distinct)
            ids, length = self._gather(self.place[at][inverse] if len(distinct) else np.zeros(0, np.int64), self.ends, self.ids)
            cuts = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(count[plain])])]
            out: list = [None] * len(plain)
            for k, row in enumerate(np.flatnonzero(plain)):
                out[row] = ids[cuts[k] : cuts[k + 1]]
            mistaken = np.searchsorted(w.row_offsets, mine[self.checks[at][inverse] != checks] if len(distinct) else mine, "right") - 1
            rest = np.union1d(np.flatnonzero(~plain), mistaken)
            for row, x in zip(rest, self.encode([t or "" for t in column.slice(w.first, w.last - w.first).take(pa.array(rest)).to_pylist()]), strict=True):
                out[row] = x
            yield out


#: One for each vocabulary in a worker, which serves several tasks.
_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Packer:
    """Open windows of one partition; pieces are (doc, start, ids, doc_tokens)."""

    def __init__(self, size: int, windows: int, first_id: int):
        self.size, self.windows, self.next_id = size, windows, first_id
        self.free: list[tuple[int, int]] = []  # (free tokens, window), sorted
        self.held: dict[int, list[tuple]] = {}
        self.made = 0

    def _emit(self, pieces: list[tuple]) -> Iterator[tuple]:
        at = 0
        for doc, start, ids, total in pieces:
            yield doc, start, len(ids), ids, total, self.next_id, at
            at += len(ids)
        self.next_id += 1

    def add(self, doc, ids: np.ndarray, start: int, total: int) -> Iterator[tuple]:
        """Place a piece; the rows of the sequences that this closes."""
        while len(ids) >= self.size:
            yield from self._emit([(doc, start, ids[: self.size], total)])
            ids, start = ids[self.size :], start + self.size
        while len(ids):
            at = bisect.bisect_left(self.free, (len(ids), -1))
            if at < len(self.free):
                free, window = self.free.pop(at)
                n = len(ids)
            elif len(self.free) < self.windows:
                free, window, n = self.size, self.made, len(ids)
                self.held[window] = []
                self.made += 1
            else:  # none fits: the fullest is filled up and goes
                free, window = self.free.pop(0)
                n = free
            self.held[window].append((doc, start, ids[:n], total))
            ids, start = ids[n:], start + n
            if free == n:
                yield from self._emit(self.held.pop(window))
            else:
                bisect.insort(self.free, (free - n, window))

    def rest(self) -> list[list[tuple]]:
        return [self.held[w] for _, w in self.free]


def _table(rows: list[tuple], extra: list[list]) -> pa.RecordBatch:
    doc, start, length, ids, total, sequence, offset = zip(*rows, strict=True) if rows else [()] * 7
    binary = pa.array([np.ascontiguousarray(x, np.dtype("<u4")).tobytes() for x in ids], pa.binary())
    long = lambda x: pa.array(x, pa.int64())
    return pa.RecordBatch.from_arrays([long(doc), long(start), long(length), binary, long(total), long(sequence), long(offset), *map(long, extra)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "part", "window"][: 7 + len(extra)])


def _pack(path: str, size: int, windows: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        packer = Packer(size, windows, part << 32)
        for batch in batches:
            docs = iter(batch.column(0).to_pylist())
            for texts in encoder(path).columns(batch.column(1)):
                rows: list[tuple] = []
                for ids in texts:
                    ids = np.append(ids, np.uint32(end))
                    rows.extend(packer.add(next(docs), ids, 0, len(ids)))
                if rows:
                    yield _table(rows, [[None] * len(rows)] * 2)
        rows, parts, held = [], [], []
        for window, pieces in enumerate(packer.rest()):
            for at, (doc, start, ids, total) in enumerate(pieces):
                rows.append((doc, start, len(ids), ids, total, -1, at))
                parts.append(part)
                held.append(window)
        if rows:
            yield _table(rows, [parts, held])

    return run


def _merge(size: int, windows: int):
    def run(key, table):  # without hints, which would be read as another kind of function
        table = table.sort_by([(c, "ascending") for c in ("part", "window", "offset")])
        packer = Packer(size, windows, ((1 << 30) + key[0].as_py()) << 32)
        rows: list[tuple] = []
        cols = (table.column(c).to_pylist() for c in ("doc_id", "ids", "start", "doc_tokens"))
        pieces = [(doc, np.frombuffer(ids, "<u4"), start, total) for doc, ids, start, total in zip(*cols, strict=True)]
        for doc, ids, start, total in pieces:
            rows.extend(packer.add(doc, ids, start, total))
        # What is still open is cut to fill one window after the other; only the last stays short.
        last = Packer(size, 1, packer.next_id)
        for window in packer.rest():
            for doc, start, ids, total in window:
                rows.extend(last.add(doc, ids, start, total))
        for window in last.rest():
            rows.extend(last._emit(window))
        return pa.Table.from_batches([_table(rows, [])])

    return run


def pack(docs: DataFrame, tables: Tables, size: int = 1024, windows: int = 64, end: int = 0, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset.

    A document is its ids and then the id `end`. Each partition keeps at most `windows` open windows. Whole windows of
    a long document close at once; what is left of it goes where it fits best. Where it fits nowhere, a new window
    opens if there is room; otherwise the fullest is filled up with the head of the piece and closed, and the tail is
    placed in turn. The windows open at the end of a partition, with their ids, are merged in groups of partitions in
    the same way, with cuts, so that one short sequence is left in a group. Memory is bounded by the open windows and
    a batch of texts. Sequences shorter than `size` are padded by who reads them; a length that is a power of two
    needs no padding.

    Null or empty text: the end id alone. A null id is kept. Rows that repeat an id are documents of their own, whose
    pieces share the id. Empty table: no rows. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = tables.write(rows.mapInArrow(_pack(tokenizer or default_tokenizer(), size, windows, end), f"{SCHEMA}, part long, window long"), "pieces")
    left = pieces.filter("part is not null").withColumn("group", F.floor(F.col("part") / MERGED).cast("long"))
    merged = left.groupBy("group").applyInArrow(_merge(size, windows), SCHEMA)
    return pieces.filter("part is null").drop("part", "window").unionByName(merged)
