"""Operator 13, phrase collocations: count tries of each shard, merged by ranges of prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel
from .common import Tables, released, sliced, text_of
from .keyfilter import key_filter

#: Words of the longest phrase; a phrase with fewer occurrences is none.
DEPTH, LEAST = 4, 30
#: Least share of a phrase's occurrences, in percent, inside one longer phrase that makes it a part of that.
INSIDE = 80
#: Rows for each language, and parts in which its phrases are ranked before.
FIRST, PARTS = 2000, 32
#: Numbers gathered in a task before they are counted and sent on.
HELD = 6_000_000
#: What texts are read as, byte by byte: A to Z lower-cased, and what ends a piece as a line break (fixed values).
_READ = np.arange(256, dtype=np.uint8)
_READ[65:91] += 32
_READ[list(b".,;:!?\n\x0b\x0c\r")] = 10
_PATH = [f"k{i}" for i in range(1, DEPTH + 1)]


def _words(lang: pa.Array, column: pa.Array) -> Iterator[tuple[textkernel.Words, np.ndarray, np.ndarray]]:
    """(words, their keys, whether a word goes on in the piece of the one before) of chunks of rows (language's hash, text).

    A key is a hash of the language's hash and the word.
    """
    data, offsets = textkernel.buffers(column)
    read = pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(offsets), pa.py_buffer(_READ[data]))
    lang = lang.to_numpy(zero_copy_only=False).view(np.uint64)
    for w in textkernel.words(read, lower=False):
        if not len(w.hashes):
            continue
        row = np.repeat(np.arange(w.first, w.last), np.diff(w.row_offsets))
        piece = np.concatenate([[0], np.cumsum(w.data == 10)])[w.start]
        on = np.concatenate([[False], (row[1:] == row[:-1]) & (piece[1:] == piece[:-1])])
        yield w, textkernel.combine([lang[row], w.hashes]), on


def _pair_keys(keys: np.ndarray, on: np.ndarray) -> np.ndarray:
    """For each word the key of it and the word before; 0 where that isn't in its piece."""
    return np.where(on, textkernel.combine([np.concatenate([keys[:1], keys[:-1]]), keys]), np.uint64(0))


def _ahead(x: np.ndarray, by: int) -> np.ndarray:
    """What stands so many places on in x, 0 beyond its end."""
    out = np.zeros_like(x)
    out[: max(0, len(x) - by)] = x[by:]
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (size, key, n): occurrences of words (size 1) and pairs (size 2), and of all words of a language (size 0)."""
    held: dict[int, list[np.ndarray]] = {1: [], 2: []}
    totals: dict[int, int] = {}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for kind, parts in held.items():
            if parts:
                key, n = np.unique(np.concatenate(parts), return_counts=True)
                yield from sliced(pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key.view(np.int64)), pa.array(n)], ["size", "key", "n"]))
            parts.clear()

    for batch in batches:
        for w, keys, on in _words(batch.column(0), batch.column(1)):
            own = batch.column(0).slice(w.first, w.last - w.first).to_numpy(zero_copy_only=False)
            for lang, n in zip(*(x.tolist() for x in (own, np.diff(w.row_offsets))), strict=True):
                totals[lang] = totals.get(lang, 0) + n
            pairs = _pair_keys(keys, on)
            held[1].append(keys)
            held[2].append(pairs[on])
            size += len(keys) + int(on.sum())
            if size > HELD:
                yield from out()
                size = 0
    yield from out()
    if totals:
        langs, n = (pa.array(np.array(list(x), np.int64)) for x in (totals.keys(), totals.values()))
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(totals), np.int32)), langs, n], ["size", "key", "n"])


def _tries(sent):
    """Rows (k1, ..., n, lang, word) of the tries of a task.

    A path is the words from a place on that go on in pairs that may be frequent, at least two of them and DEPTH at most,
    0 beyond; n: the number of places. Paths are sorted, so that they are the trie in preorder. Rows with a word say
    what a key stands for, and have no path beyond k1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        known = np.zeros(0, np.uint64)
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                columns = [np.concatenate(x) for x in zip(*held, strict=True)]
                _, first, n = np.unique(textkernel.combine(columns), return_index=True, return_counts=True)
                columns = [x[first] for x in columns]
                order = np.lexsort([x.view(np.int64) for x in columns[::-1]])
                none = [pa.nulls(len(first), pa.int64()), pa.nulls(len(first), pa.string())]
                yield from sliced(pa.RecordBatch.from_arrays([*(pa.array(x[order].view(np.int64)) for x in columns), pa.array(n[order]), *none], [*_PATH, "n", "lang", "word"]))
            held.clear()

        for batch in batches:
            for w, keys, on in _words(batch.column(0), batch.column(1)):
                on[on] = sent.value.may_have(_pair_keys(keys, on)[on])
                # How many words go on from each: on[i] says that i goes on from i - 1.
                follow = [_ahead(on, i) for i in range(1, DEPTH)]
                columns, more = [keys], np.ones(len(keys), bool)
                for i, f in enumerate(follow, 1):
                    more = more & f
                    columns.append(np.where(more, _ahead(keys, i), np.uint64(0)))
                begin = follow[0]
                held.append([x[begin] for x in columns])
                size += DEPTH * int(begin.sum())
                used = np.flatnonzero(begin | on)
                key, first = np.unique(keys[used], return_index=True)
                new = ~np.isin(key, known, assume_unique=True)
                if new.any():
                    at, n = used[first[new]], int(new.sum())
                    row = np.searchsorted(w.row_offsets, at, "right") - 1 + w.first
                    words = pa.array([w.word(i).decode("utf-8", "replace") for i in at.tolist()], pa.string())
                    zero = pa.array(np.zeros(n, np.int64))
                    yield from sliced(pa.RecordBatch.from_arrays([pa.array(key[new].view(np.int64)), *[zero] * DEPTH, batch.column(0).take(pa.array(row)), words], [*_PATH, "n", "lang", "word"]))
                    known = np.union1d(known, key[new]) if len(known) < HELD else key[new]
                if size > HELD:
                    yield from out()
                    size = 0
        yield from out()

    return run


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k1, ..., size, n) of the nodes of a sorted stream of paths: phrases of two words or more and their numbers.

    Equal paths of several shards stand together, and a node's paths do. Nodes with fewer than LEAST are left out, but for
    those that a batch begins or ends in, whose other paths may be in the batch or the range before or after.
    """
    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(DEPTH)]
        n, differs = batch.column(DEPTH).to_numpy(zero_copy_only=False), np.zeros(batch.num_rows, bool)
        differs[:1] = True
        for depth, column in enumerate(columns, 1):
            differs[1:] |= column[1:] != column[:-1]
            at = np.flatnonzero(differs)
            if depth == 1 or not len(at):
                continue
            total = np.add.reduceat(n, at)
            keep = total >= LEAST
            keep[[0, -1]] = True
            keep &= column[at] != 0
            at, total = at[keep], total[keep]
            path = [pa.array(x[at] if k < depth else np.zeros(len(at), np.int64)) for k, x in enumerate(columns)]
            yield from sliced(pa.RecordBatch.from_arrays([*path, pa.array(np.full(len(at), depth, np.int32)), pa.array(total)], [*_PATH, "size", "n"]))


def collocations(docs: DataFrame, tables: Tables, first: int = FIRST, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """For each language its first phrases by score: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A to Z), cut at `.,;:!?` and line ends into pieces, and these at spaces and tabs into words. A
    phrase is two to DEPTH words of a piece with a >= LEAST occurrences in its language; its score is the lowest of
    floor(2000000 * a / (l + r)) over its cuts in two, which occur l and r times, the shortest first part at ties. A phrase
    that stands inside a longer one with at least INSIDE percent of its occurrences is left out. n: words of the language.

    1. Words and neighbouring pairs are counted. A phrase can't be frequent unless all its pairs are, so a filter of the
       frequent pairs, of a bounded size, goes to all tasks; what it lets through beyond them costs work only.
    2. Each task builds count tries of depth DEPTH over what follows each word in frequent pairs, and writes them sorted.
    3. Ranges of paths are dealt to tasks and sorted, which merges the tries; a walk over a range sums its nodes.
       Ranges end anywhere, also inside a frequent word's paths, so no prefix comes to one task; nodes that lie in two
       ranges are added up after.
    4. The trie's links are joins on paths: a node's first parts are the nodes above it, its last parts those that its
       suffix links lead to.

    Null texts count as empty, null languages as "und". Repeated rows count each. An empty table, or one without frequent
    phrases, gives no rows. Other columns are ignored. Words and phrases are known by 64-bit hashes.
    """
    language = F.coalesce(F.col(lang_col), F.lit("und"))
    rows = docs.select(F.xxhash64(language).alias("h"), text_of(F.col(text_col)).alias("text"))
    names = tables.write(docs.select(language.alias("lang"), F.xxhash64(language).alias("h")).distinct(), "languages")
    counts = rows.mapInArrow(released(_counts), "size int, key long, n long").groupBy("size", "key").agg(F.sum("n").alias("n"))
    counts = tables.write(counts.filter(f"n >= {LEAST} or size = 0"), "counts")
    totals = counts.filter("size = 0").select(F.col("key").alias("h"), F.col("n").alias("total"))
    sent = docs.sparkSession.sparkContext.broadcast(key_filter(counts.filter("size = 2").select("key")))
    path = ", ".join(f"{k} long" for k in _PATH)
    tries = tables.write(rows.mapInArrow(released(_tries(sent)), f"{path}, n long, lang long, word string"), "tries")
    paths = tries.filter("word is null").select(*_PATH, "n")
    nodes = paths.repartitionByRange(*_PATH).sortWithinPartitions(*_PATH).mapInArrow(released(_walk), f"{path}, size int, n long")
    nodes = tables.write(nodes.groupBy(*_PATH, "size").agg(F.sum("n").alias("n")).filter(f"n >= {LEAST}"), "nodes")
    words = tables.write(tries.filter("word is not null").groupBy(F.col("k1").alias("key")).agg(F.min("lang").alias("h"), F.min("word").alias("word")), "words")

    part = lambda first, last: F.array(*[F.col(k) for k in _PATH[first:last]], *[F.lit(0).cast("long")] * (DEPTH - last + first))
    singles = counts.filter("size = 1").select(F.array(F.col("key"), *[F.lit(0).cast("long")] * (DEPTH - 1)).alias("part"), "n")
    parts = nodes.select(F.array(*_PATH).alias("part"), "n").unionByName(singles)

    def sub(size: int, first: int, last: int):
        return F.when(F.col("size") == size, F.struct(F.lit(first).alias("k"), part(0, first).alias("left"), part(first, last).alias("right")))

    cuts = F.array_compact(F.array(*[sub(m, k, m) for m in range(2, DEPTH + 1) for k in range(1, m)]))
    cut = nodes.select(*_PATH, "size", F.col("n").alias("a"), F.explode(cuts).alias("c")).select(*_PATH, "size", "a", "c.*")
    cut = cut.join(parts.toDF("left", "l"), "left").join(parts.toDF("right", "r"), "right")
    exact = lambda c: c.cast("decimal(38,0)")
    cut = cut.withColumn("_score", F.expr("(cast(2000000 as decimal(38,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    lowest = F.min_by(F.struct("_score", "l", "r"), F.struct("_score", "k"))
    scored = cut.groupBy(*_PATH, "size", "a").agg(lowest.alias("c")).select(*_PATH, "size", "a", "c.l", "c.r", F.col("c._score").alias("score"))
    inner = F.array_compact(F.array(*[F.when(F.col("size") == m, part(i, j)) for m in range(3, DEPTH + 1) for i in range(m) for j in range(i + 2, m + 1) if j - i < m]))
    outer = nodes.filter("size > 2").select(F.explode(inner).alias("part"), "n").groupBy("part").agg(F.max("n").alias("_most"))
    scored = scored.withColumn("part", F.array(*_PATH)).join(outer, "part", "left")
    scored = scored.filter(F.col("_most").isNull() | (100 * exact(F.col("_most")) < INSIDE * exact(F.col("a"))))
    scored = scored.join(words.select(F.col("key").alias("k1"), "h", F.col("word").alias("w1")), "k1")
    for i in range(2, DEPTH + 1):
        scored = scored.join(words.select(F.col("key").alias(f"k{i}"), F.col("word").alias(f"w{i}")), f"k{i}", "left")
    scored = scored.withColumn("phrase", F.concat_ws(" ", *[f"w{i}" for i in range(1, DEPTH + 1)])).select("h", "phrase", "a", "l", "r", "score")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # A language's first are among the first of its parts, so few rows come together however many phrases it has.
    some = tables.write(scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))), "scored")
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("h", "part").orderBy(*order))).filter(F.col("rank") <= first)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("h").orderBy(*order))).filter(F.col("rank") <= first)
    out = best.join(names, "h").join(totals, "h")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
