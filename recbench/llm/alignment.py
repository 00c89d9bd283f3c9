"""Operator 12, alignment of two tokenizers: what their tokens stand for in common, and how often over the corpus."""

from __future__ import annotations

import hashlib
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
from .common import Tables, released, sliced, text_of

#: Rows of texts at a time, and distinct chunks that a worker remembers.
ROWS, CACHE = 500, 400_000
#: Links of a group that are made one by one.
SMALL = 64
#: Links gathered before they go out as postings; rows that one posting list speaks of at most.
HELD, BLOCK = 3_000_000, 1 << 16
#: An id whose postings are over this share of all is dealt out over several tasks. So at most so many ids are.
HOT = 1024
#: Contributions gathered in a task before they are added up by document.
ADDED = 2_000_000
#: White space of a word's end, and the mark that stands for a space in pieces (fixed values).
_SPACE, _MARK = re.compile(r"\s"), "▁"


def _byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Tokens of both vocabularies for whole texts, and the groups between common ends.

    Neither tokenizer joins a character that isn't white space to white space after it: for the byte-level pre-tokenizer
    this follows from its pattern; for the pieces it is looked up in the vocabulary, and where there is such a piece, texts
    aren't cut before that white space. So a text is cut there into chunks, each distinct chunk is encoded once, and a text's tokens are those of its
    chunks. Both end a token at the end of a chunk, so groups lie inside chunks.
    """

    def __init__(self, byte_level: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        of = _byte_of_character()
        self.a_bytes = {i: bytes(of[c] for c in token) if all(c in of for c in token) else token.encode() for token, i in self.a.get_vocab().items()}
        self.b_bytes, joined = [], set()
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(_MARK, " ").encode())
            shown = piece.replace(_MARK, " ")
            joined |= {y for x, y in itertools.pairwise(shown) if _SPACE.match(y) and (not _SPACE.match(x) or x == " " != y)}
        a_bytes = [self.a_bytes.get(i, b"") for i in range(max(self.a_bytes) + 1)]
        self.a_size, self.b_size = (np.array([len(x) for x in of], np.int64) for of in (a_bytes, self.b_bytes))
        #: An id with the mark after it: within its side of a group, and at the side's end.
        self.said = [np.array([f"{i}{mark}" for i in range(n) for mark in (",", end)], object) for n, end in ((len(a_bytes), "|"), (len(self.b_bytes), ";"))]
        space = "".join(sorted({*"\t\n\x0b\x0c\r ", "\x85", "\xa0"} - joined))
        self.cut = re.compile(f"(?<=[^\\s])(?=[{re.escape(space)}])")
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.told: list[str] = []
        self.counts = np.zeros((0, 4), np.int64)  # tokens of A and of B, groups, links
        self.ends, self.pairs, self.times = np.zeros(1, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def chunks(self, text: str) -> list[str]:
        """Chunks of a text with a space before it; a chunk without a leading space begins with other white space."""
        return self.cut.split(" " + text)

    def _tokens(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both for chunks one after the other, or None if either doesn't give back their bytes. Chunks but the last
        end with what isn't white space; B leads a text with a mark by itself."""
        text = "".join(chunks)
        a = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids
        bare = text[1:] if text[0] == " " else text
        b = self.b.encode(bare, num_threads=1) if bare else [self.b.piece_to_id(_MARK)]
        if bare is text:
            b = b[1:]  # the mark alone, as nothing joins it to other white space
        want = text.encode()
        same = b"".join(map(self.a_bytes.__getitem__, a)) == want == b"".join(map(self.b_bytes.__getitem__, b))
        return (np.array(a, np.int64), np.array(b, np.int64)) if same else None

    def _learn(self, chunks: list[str]) -> None:
        """Chunks go to the tokenizers together; where their bytes don't come back, in halves, down to one."""
        found = self._tokens(chunks)
        if found is not None:
            self._keep(chunks, *found)
        elif len(chunks) > 1:
            self._learn(chunks[: len(chunks) // 2])
            self._learn(chunks[len(chunks) // 2 :])
        else:
            self._put(np.array([[-1, 0, 0, 0]]), [""], np.zeros(1, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))  # texts that hold it have no tokens

    def _keep(self, chunks: list[str], a: np.ndarray, b: np.ndarray) -> None:
        over = np.cumsum([len(c.encode()) for c in chunks])  # where chunks end
        ends_a, ends_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        of_a, of_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        n_a, n_b = np.bincount(of_a, minlength=len(common)), np.bincount(of_b, minlength=len(common))
        chunk = np.searchsorted(over, common)
        count = lambda n: np.bincount(chunk, weights=n, minlength=len(chunks)).astype(np.int64)
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        # Every token of A with every token of B of its group; large groups by the numbers of each id instead.
        small = n_a * n_b <= SMALL
        repeat = np.where(small[of_a], n_b[of_a], 0)
        upto = np.cumsum(repeat)
        at_b = np.repeat(first_b[of_a] - upto + repeat, repeat) + np.arange(upto[-1])
        group, pair = [np.repeat(of_a, repeat)], [np.repeat(a, repeat) << 32 | b[at_b]]
        times = [np.ones(len(at_b), np.int64)]
        for g in np.flatnonzero(~small).tolist():
            x, nx = np.unique(a[first_a[g] : first_a[g] + n_a[g]], return_counts=True)
            y, ny = np.unique(b[first_b[g] : first_b[g] + n_b[g]], return_counts=True)
            pair.append((x[:, None] << 32 | y).reshape(-1))
            times.append((nx[:, None] * ny).reshape(-1))
            group.append(np.full(len(pair[-1]), g))
        own = chunk[np.concatenate(group)]
        order = np.argsort(own, kind="stable")
        # Words of the groups: ids of A, a bar, ids of B; the last id of a side is followed by the mark after it.
        told = np.empty(len(a) + len(b), object)
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[first_a + n_a - 1] = last_b[first_b + n_b - 1] = True
        told[np.arange(len(a)) + first_b[of_a]] = self.said[0][2 * a + last_a]
        told[np.arange(len(b)) + (first_a + n_a)[of_b]] = self.said[1][2 * b + last_b]
        cuts = np.concatenate([[0], np.cumsum(count(n_a + n_b))]).tolist()
        told = told.tolist()
        words = ["".join(told[i:j])[:-1] for i, j in itertools.pairwise(cuts)]
        counts = np.stack([count(n_a), count(n_b), count(np.ones(len(common))), count(n_a * n_b)], axis=1)
        self._put(counts, words, np.bincount(own, minlength=len(chunks)), np.concatenate(pair)[order].astype(np.uint64), np.concatenate(times)[order])

    def _put(self, counts: np.ndarray, told: list[str], size: np.ndarray, pairs: np.ndarray, times: np.ndarray) -> None:
        self.told += told
        self.counts = np.concatenate([self.counts, counts])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(size)])
        self.pairs = np.concatenate([self.pairs, pairs])
        self.times = np.concatenate([self.times, times])

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(counts of each text, its groups in words, and rows, pairs and their number of links in the texts)."""
        if len(self.told) > CACHE:
            self._forget()
        split = [self.chunks(t) if t else [] for t in texts]
        new = list(dict.fromkeys(c for s in split for c in s if c not in self.place))
        whole = [c for c in new if not c[-1].isspace()]
        for part in [*(whole[at : at + 20_000] for at in range(0, len(whole), 20_000)), *([c] for c in new if c[-1].isspace())]:
            self._learn(part)
            self.place.update(zip(part, range(len(self.place), len(self.place) + len(part)), strict=True))
        length = np.array([len(s) for s in split], np.int64)
        places = np.fromiter((self.place[c] for s in split for c in s), np.int64, int(length.sum()))
        row = np.repeat(np.arange(len(texts)), length)
        bad = np.zeros(len(texts), bool)
        bad[row[self.counts[places, 0] < 0]] = True
        good = ~bad[row]
        places, row = places[good], row[good]
        counts = np.zeros((len(texts), 4), np.int64)
        for k in range(4):
            counts[:, k] = np.bincount(row, weights=self.counts[places, k], minlength=len(texts))
        cuts, told = np.searchsorted(row, np.arange(len(texts) + 1)).tolist(), []
        mine = [self.told[p] for p in places.tolist()]
        for a, b in itertools.pairwise(cuts):
            told.append(";".join(mine[a:b]))
        n = self.ends[places + 1] - self.ends[places]
        upto = np.cumsum(n)
        at = np.repeat(self.ends[places] - upto + n, n) + np.arange(upto[-1] if len(upto) else 0)
        return counts, told, np.repeat(row, n), self.pairs[at], self.times[at]


#: One for each pair of vocabularies in a worker, which serves several tasks.
_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(byte_level: str, pieces: str) -> Aligner:
    if (byte_level, pieces) not in _ALIGNERS:
        _ALIGNERS[byte_level, pieces] = Aligner(byte_level, pieces)
    return _ALIGNERS[byte_level, pieces]


_DOCUMENT = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_POSTING = "a int, b int, base long, n int, at binary, times binary"


def _summed(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of several columns, the first of which sorts first, and the sums of their values."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    return [k[first] for k in keys], [np.add.reduceat(v[order], first) if len(first) else v for v in values]


def _postings(base: int, rows: list[np.ndarray], pairs: list[np.ndarray], times: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """One row for each id pair: the rows of a block that hold it, from base on, and their numbers of links."""
    (pair, row), (n,) = _summed([np.concatenate(pairs), np.concatenate(rows)], [np.concatenate(times)])
    wide = n > 255
    for part in (~wide, wide):  # numbers of one byte, or of eight
        key, at, number = pair[part], row[part].astype("<u2"), n[part].astype("<i8" if part is wide else "u1")
        if not len(key):
            continue
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        cuts = np.append(first, len(key))
        lists = [pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((cuts * x.itemsize).astype(np.int32)), pa.py_buffer(x.tobytes())]) for x in (at, number)]
        a, b = (key[first] >> np.uint64(32)).astype(np.int32), (key[first] & np.uint64((1 << 32) - 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(first), base, np.int64)), pa.array(np.diff(cuts).astype(np.int32)), *lists], ["a", "b", "base", "n", "at", "times"])


def _encode(byte_level: str, pieces: str):
    """Rows of documents and of postings, either with nulls for the other, from (doc_id, text)."""
    names = [x.split()[0] for x in f"{_DOCUMENT}, {_POSTING}".split(", ")]
    kinds = [pa.int64()] * 6 + [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = dict(zip(batch.schema.names, batch.columns, strict=True))
        return pa.RecordBatch.from_arrays([own.get(x, pa.nulls(batch.num_rows, kind)) for x, kind in zip(names, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, base, upto, size = aligner(byte_level, pieces), TaskContext.get().partitionId() << 36, 0, 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal size
            if held:
                for x in _postings(base, *zip(*held, strict=True)):
                    for y in sliced(x, 5_000):
                        yield whole(y)
            held.clear()
            size = 0

        for batch in batches:
            _, offsets = textkernel.buffers(batch.column(1))
            cuts = sorted({batch.num_rows, *range(0, batch.num_rows, ROWS), *(x for x, _ in textkernel.chunks(offsets))})
            for first, last in itertools.pairwise(cuts):
                if upto + last - first > BLOCK:
                    yield from out()
                    base, upto = base + upto, 0
                counts, told, row, pair, times = both.align([t or "" for t in batch.column(1).slice(first, last - first).to_pylist()])
                (row, pair), (times,) = _summed([row, pair], [times])
                held.append((row + upto, pair, times))
                size += len(row)
                sha = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in told]
                numbers = pa.array(base + upto + np.arange(last - first))
                yield whole(pa.RecordBatch.from_arrays([numbers, batch.column(0).slice(first, last - first), *map(pa.array, counts.T), pa.array(sha, pa.string())], names[:7]))
                upto += last - first
                if size > HELD:
                    yield from out()
                    base, upto = base + upto, 0
        yield from out()

    return run


def _contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (base, at, n_best, count_sum) from the streams of ids of A, sorted by (a, salt, b), the numbers of documents of
    each pair (base -1) before the postings. Only the numbers of one id are kept, at most one for each id of B. A row holds
    what this task adds to the rows of one block, packed."""
    carried: list[np.ndarray] = [np.zeros(0, np.int64)] * 2
    held: list[list[np.ndarray]] = []
    size = 0

    def added() -> list[np.ndarray]:
        """What is held, summed by (base, at)."""
        keys, sums = _summed(*([np.concatenate([h[k] for h in held]) for k in own] for own in ((0, 1), (2, 3))))
        return [*keys, *sums]

    def out() -> Iterator[pa.RecordBatch]:
        base, at, *sums = added()
        first = np.flatnonzero(np.concatenate(([True], base[1:] != base[:-1])))
        cuts = np.append(first, len(base))
        blobs = [[x[i:j].tobytes() for i, j in itertools.pairwise(cuts.tolist())] for x in (at.astype("<u2"), *(y.astype("<i8") for y in sums))]
        yield from sliced(pa.RecordBatch.from_arrays([pa.array(base[first]), *(pa.array(x, pa.binary()) for x in blobs)], ["base", "at", "n_best", "count_sum"]), 50)

    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, base, n = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1, 2, 3))
        count = base < 0
        key, number = np.concatenate([carried[0], (a << 32 | b)[count]]), np.concatenate([carried[1], n[count]])
        if len(key):
            order = np.argsort(key, kind="stable")
            key, number = key[order], number[order]
            new = np.concatenate(([True], key[1:] != key[:-1]))  # an id dealt out brings its numbers several times
            key, number = key[new], number[new]
            side = key >> 32
            first = np.flatnonzero(np.concatenate(([True], side[1:] != side[:-1])))
            most = np.repeat(np.maximum.reduceat(number, first), np.diff(np.append(first, len(key))))
            carried = [x[side == a[-1]] for x in (key, number)]
        post = np.flatnonzero(~count)
        if not len(post):
            continue
        place = np.searchsorted(key, (a << 32 | b)[post])
        at = np.frombuffer(b"".join(batch.column(4).take(pa.array(post)).to_pylist()), "<u2").astype(np.int64)
        times = np.concatenate([np.frombuffer(x, "u1" if len(x) == k else "<i8").astype(np.int64) for x, k in zip(batch.column(5).take(pa.array(post)).to_pylist(), n[post].tolist(), strict=True)])
        held.append([np.repeat(base[post], n[post]), at, times * np.repeat(number[place] == most[place], n[post]), times * np.repeat(number[place], n[post])])
        size += len(at)
        if size > ADDED:
            held[:] = [added()]
            size = len(held[0][0])
            if size > ADDED // 2:
                yield from out()
                held.clear()
                size = 0
    if held:
        yield from out()


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, n_best, count_sum) from rows of _contributions sorted by base: one block's sums are kept at a time."""
    now, sums = None, np.zeros((0, 2), np.int64)

    def out() -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(sums.any(axis=1))
        yield from sliced(pa.RecordBatch.from_arrays([pa.array(now + at), pa.array(sums[at, 0]), pa.array(sums[at, 1])], ["row", "n_best", "count_sum"]))

    for batch in batches:
        for base, at, *more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if base != now:
                if now is not None:
                    yield from out()
                now, sums = base, np.zeros((BLOCK, 2), np.int64)
            at = np.frombuffer(at, "<u2")
            for k, x in enumerate(more):
                sums[at, k] += np.frombuffer(x, "<i8")
    if now is not None:
        yield from out()


def align_tokenizers(docs: DataFrame, tables: Tables, byte_level: str | None = None, pieces: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A (a byte-level BPE of the tokenizers library) encodes a space and the text, B (pieces of sentencepiece) the text,
    which it leads with a space. Where tokens of both end at one byte, the text is cut into groups; every token of A is
    linked with every one of B in its group. A pair's count is the number of rows that hold it linked. n_best: links whose
    count is the largest of their A id, ties included; count_sum: the sum of the counts of all links.

    1. One pass encodes every text. Each task gathers for each id pair which of its rows hold it, and how often: posting
       lists of at most BLOCK rows, so a pair that most rows hold makes a few short rows for each task.
    2. The counts of pairs are sums of the lists' lengths.
    3. Postings are shuffled by A id and sorted by Spark, the counts of an id before its postings. Ids with more than a
       HOTth of all postings, so at most HOT of them, are dealt out over several tasks, each of which gets the id's
       counts. A task reads one stream: it takes an id's counts, finds their maximum, and adds up what postings
       contribute to each row as far as it has come; that goes out packed, by blocks of rows.
    4. Contributions are shuffled by block and added up by row.

    Texts null, empty, or that either tokenizer doesn't give back byte for byte (such as one with the mark that stands
    for a space): zeros and an empty groups_sha256. Null ids and repeated rows keep their rows; repeated rows count
    each. Empty table: no rows. Other columns are ignored.
    """
    import public_tokenizers

    byte_level, pieces = byte_level or public_tokenizers.path("byte_bpe_50k.json"), pieces or public_tokenizers.path("piece_bpe_32k.model")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(F.col(text_col)).alias("text"))
    made = tables.write(rows.mapInArrow(released(_encode(byte_level, pieces)), f"{_DOCUMENT}, {_POSTING}"), "encoded")
    documents = made.filter("row is not null").select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    postings = made.filter("a is not null").select("a", "b", "base", "n", "at", "times")
    counts = tables.write(postings.groupBy("a", "b").agg(F.sum("n").alias("n")), "counts")
    sides = tables.write(counts.groupBy("a").agg(F.sum("n").alias("entries")), "sides")
    total = sides.agg(F.sum("entries")).first()[0] or 0
    hot = sides.filter(F.col("entries") * HOT > total).select("a", F.ceil(F.col("entries") * HOT / F.lit(max(total, 1))).cast("int").alias("parts"))
    dealt = postings.join(F.broadcast(hot), "a", "left").withColumn("salt", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("base", "b"), F.col("parts"))).cast("int"))
    told = counts.join(F.broadcast(hot), "a", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    told = told.select("a", "b", F.lit(-1).cast("long").alias("base"), "n", F.lit(None).cast("binary").alias("at"), F.lit(None).cast("binary").alias("times"), "salt")
    stream = told.unionByName(dealt.select("a", "b", "base", F.col("n").cast("long").alias("n"), "at", "times", "salt"))
    stream = stream.withColumn("posting", F.col("base") >= 0).repartition("a", "salt").sortWithinPartitions("a", "salt", "posting", "b")
    stream = stream.select("a", "b", "base", "n", "at", "times")
    added = stream.mapInArrow(released(_contributions), "base long, at binary, n_best binary, count_sum binary")
    added = tables.write(added, "contributions").repartition("base").sortWithinPartitions("base")
    added = tables.write(added.mapInArrow(released(_by_document), "row long, n_best long, count_sum long"), "added")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return documents.join(added, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
