"""Operator 4, language-model scoring by a probabilistic suffix tree over words."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel
from .common import Tables, held_out, released, sliced
from .keyfilter import key_filter

#: The token after each text's last word.
END = np.uint64(0x5851F42D4C957F2D)
#: Words and grams with at least these shares of all training tokens are sent to all workers; all others are joined.
#: So at most WORDS words and HOT grams of each length are sent. What is sent makes no difference to any score.
WORDS, HOT = 4_000_000, 1_000_000
#: Counts below which a context or an entry says nothing.
LEAST_CONTEXT, LEAST_NEXT = 8, 2
DISCOUNT = 0.5
#: Numbers gathered in a task before they are counted and sent on; keys of one packed row; tokens of a bucket of keys.
HELD, PACKED, BUCKET = 2_400_000, 256, 1 << 21
#: Context lengths counted in one reading of the texts, from the fourth on.
DEEP = 4
#: Values of a bucket that are looked up in one process's memory; and what tells the kinds of rows on the way apart.
ASKED = 1 << 18
VALUES, GRAMS, WORDS_ASKED, TOLD = range(4)
#: Marks the keys of words where they are looked up beside those of grams.
WORD_MARK = 0x2545F4914F6CDD1D


def _tokens(w: textkernel.Words) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of a chunk with the end tokens, and where each row's tokens begin."""
    return np.insert(w.hashes, w.row_offsets[1:], END), w.row_offsets + np.arange(len(w.row_offsets))


def _before(x: np.ndarray) -> np.ndarray:
    """x of the token before; what stands there at the first token has no meaning."""
    return np.concatenate((x[:1], x[:-1]))


def _longer(grams: np.ndarray) -> np.ndarray:
    """Hashes of the runs of one more token from those that end at each token: of all but the last and all but the first."""
    return textkernel.combine([_before(grams), grams])


def _places_in_text(rows: np.ndarray) -> np.ndarray:
    return np.arange(rows[-1]) - np.repeat(rows[:-1], np.diff(rows))


def _grams(first: int, last: int, sent):
    """(key, ctx, suf) of runs of a context and the next token, for contexts of first to last tokens: all but the last,
    all but the first token.

    sent: filters of contexts and of suf; or only one, of contexts of first - 1 tokens, which those of the first length
    must end with. Longer ones are taken wherever those of the first length are.
    """

    def run(tokens: np.ndarray, rows: np.ndarray) -> Iterator[list[np.ndarray]]:
        shorter, grams, places = None, tokens, _places_in_text(rows)
        for _ in range(first - 1):
            shorter, grams = grams, _longer(grams)
        context, nexts = sent.value
        at = np.flatnonzero(places >= first)
        at = at[context.may_have((grams if nexts else shorter)[at - 1])]
        if nexts:
            at = at[nexts.may_have(grams[at])]
        for length in range(first, last + 1):
            if length > first:
                grams, at = _longer(grams), at[places[at] >= length]
            ctx, suf = grams[at - 1], grams[at]
            yield [textkernel.combine([ctx, suf]), ctx, suf]

    return run


def _distinct(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(columns of one row for each key, the sorted keys' first places, the order) by the first column."""
    key = columns[0]
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return [x[order[first]] for x in columns], first, order


def _packed(keys_of, bits: int):
    """Rows (level, bucket, keys) of training texts: PACKED keys of one bucket at most, packed, with their numbers.

    A key's leading bits are its bucket. keys_of yields the columns of each level, the key first.
    """

    def packed(level: int, held: list[list[np.ndarray]]) -> pa.RecordBatch:
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        held.clear()
        size = len(columns[0])
        columns, first, _ = _distinct(columns)
        n = np.diff(np.append(first, size)).astype(np.int32)
        cuts = np.searchsorted(columns[0], np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
        cuts = np.unique(np.concatenate([cuts, np.arange(0, len(n), PACKED), [len(n)]]))
        cuts = cuts[: np.searchsorted(cuts, len(n)) + 1]
        own = columns[1:] or columns
        blobs = [b"".join([*(x[i:j].tobytes() for x in own), n[i:j].tobytes()]) for i, j in zip(cuts, cuts[1:], strict=False)]
        buckets = (columns[0][cuts[:-1]] >> np.uint64(64 - bits)).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(blobs), level, np.int32)), pa.array(buckets), pa.array(blobs, pa.binary())], ["level", "bucket", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[list[np.ndarray]]] = {}
        size = 0
        for batch in batches:
            for w in textkernel.words(batch.column(0)):
                for level, columns in enumerate(keys_of(*_tokens(w))):
                    held.setdefault(level, []).append(columns)
                    size += sum(map(len, columns))
                if size > HELD:
                    for level, columns in held.items():
                        yield from sliced(packed(level, columns), 1_000)
                    held, size = {}, 0
        for level, columns in held.items():
            yield from sliced(packed(level, columns), 1_000)

    return run


def _unpacked(width: int, names: list[str], least: int):
    """Rows (level, names, n) of the keys that occur at least so often, from rows of _packed sorted by (level, bucket)."""

    def merged(level: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = [[] for _ in range(width + 1)]
        for blob in blobs:
            k = len(blob) // (8 * width + 4)
            for i in range(width):
                parts[i].append(np.frombuffer(blob, np.uint64, k, 8 * k * i))
            parts[width].append(np.frombuffer(blob, np.int32, k, 8 * k * width))
        blobs.clear()
        columns = [np.concatenate(x) for x in parts]
        key = columns[0] if width == 1 else textkernel.combine(columns[:width])
        _, first, order = _distinct([key])
        n = np.add.reduceat(columns[width][order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        kept = n >= least
        out = [pa.array(x[order[first[kept]]].view(np.int64)) for x in columns[:width]]
        yield from sliced(pa.RecordBatch.from_arrays([pa.array(np.full(int(kept.sum()), level, np.int32)), *out, pa.array(n[kept])], ["level", *names, "n"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for batch in batches:
            levels, buckets = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for of, blob in zip(zip(levels, buckets, strict=True), batch.column(2), strict=True):
                if of != now and blobs:
                    yield from merged(now[0], blobs)
                    blobs = []
                now = of
                blobs.append(blob.as_py())
        if blobs:
            yield from merged(now[0], blobs)

    return run


def _counted(train: DataFrame, keys_of, names: list[str], bits: int, least: int = 1) -> DataFrame:
    """(level, names, n): keys with their numbers over all training texts, if at least so many.

    Tasks count what they have read and send packed keys by bucket, of about BUCKET tokens each; a bucket is merged at
    a time.
    """
    packed = train.mapInArrow(released(_packed(keys_of, bits)), "level int, bucket int, keys binary")
    packed = packed.repartition("level", "bucket").sortWithinPartitions("level", "bucket")
    return packed.mapInArrow(released(_unpacked(len(names), names, least)), f"level int, {' long, '.join(names)} long, n long")


def _with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key = textkernel.combine([batch.column(i).to_numpy().view(np.uint64) for i in (0, 1)])
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *batch.columns], ["key", *batch.schema.names])


def _tested(entries: DataFrame, total: int) -> DataFrame:
    """Entries (ctx, suf, n, nc, q) with key, p, v, rest and kept; q: the probability of the entry after the shorter context.

    A context is kept if the divergence of its distribution from the shorter context's, times its count, exceeds what
    its entries cost, half the logarithm of the training tokens each. v: log10(p / q / rest).
    """
    whole = Window.partitionBy("ctx")
    share = (F.col("n") - DISCOUNT) / F.col("nc")
    out = entries.withColumn("rest", 1 - F.sum(share).over(whole)).withColumn("p", share + F.col("rest") * F.col("q"))
    left = F.col("rest") * F.greatest(F.lit(1e-12), 1 - F.sum("q").over(whole)) * F.log("rest")
    gain = (F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))).over(whole) + left) * F.col("nc")
    out = out.withColumn("kept", gain > 0.5 * math.log(total + 1) * F.count(F.lit(1)).over(whole))
    out = out.withColumn("v", F.log10(F.col("p") / F.col("q")) - F.log10("rest"))
    columns = "ctx long, suf long, n long, nc long, p double, v double, rest double, kept boolean"
    return out.select(*(x.split()[0] for x in columns.split(", "))).mapInArrow(released(_with_key), f"key long, {columns}")


def _values(states: DataFrame) -> DataFrame:
    """(key, n, v) of the entries and contexts of states: what each occurrence of a gram adds to the log10 of a text's score.

    The probability of a token after a state is a factor times that after the state's suffix: p / q for an entry, rest
    for any other token. So a state adds log10(rest) wherever it stands, and an entry log10(p / q / rest).
    """
    contexts = states.groupBy(F.col("ctx").alias("key")).agg(F.first("nc").alias("n"), F.log10(F.first("rest")).alias("v"))
    return states.select("key", "n", "v").unionByName(contexts)


def _levels(train: DataFrame, words: DataFrame, total: int, distinct: int, bits: int, tables: Tables) -> list[DataFrame]:
    """For contexts of one, two, ... tokens the values of what stays in the tree. The entries of a level go once the next has them.

    From the fourth length on, DEEP lengths are counted in one reading of the texts.
    """
    spark, values, deep, upto = train.sparkSession, [], None, 0
    grams = words.select("key", "n", ((F.col("n") + 1) / (total + distinct + 1)).alias("p"))
    while True:
        length = len(values) + 1
        able = grams.filter(F.col("n") >= LEAST_CONTEXT)
        if length > upto:
            filters = (key_filter(able), key_filter(grams.filter(F.col("n") >= LEAST_NEXT))) if length <= 2 else (key_filter(grams.filter("kept").select(F.col("ctx").alias("key")).distinct()), None)
            sent, first, upto = spark.sparkContext.broadcast(filters), length, length if length <= 3 else length + DEEP - 1
            deep = _counted(train, _grams(first, upto, sent), ["ctx", "suf"], bits, LEAST_NEXT if length <= 2 else 1)
            deep = tables.write(deep, f"counts-{first}")
            tables.settle()
        entries = deep.filter(F.col("level") == length - first).drop("level")
        shorter = grams.select(F.col("key").alias("suf"), F.col("p").alias("q"))
        if length <= 2:
            entries = entries.join(shorter, "suf").join(able.select(F.col("key").alias("ctx"), F.col("n").alias("nc")), "ctx")
        else:
            entries = entries.withColumn("nc", F.sum("n").over(Window.partitionBy("ctx"))).filter((F.col("n") >= LEAST_NEXT) & (F.col("nc") >= LEAST_CONTEXT))
            entries = entries.join(shorter.join(grams.filter("kept").select(F.col("key").alias("suf")), "suf"), "suf")
        before, grams = grams, tables.write(_tested(entries, total), f"entries-{length}")
        if length == 2:  # every suffix of a state is a state; longer states extend states
            pairs = grams.filter("kept").select(F.col("ctx").alias("key")).distinct()
            suffixes = before.join(pairs, "key", "left_semi").select(F.col("suf").alias("ctx"))
            one = before.join(before.filter("kept").select("ctx").unionByName(suffixes).distinct(), "ctx", "left_semi")
            values[0] = tables.write(_values(one), "values-1")
        values.append(tables.write(_values(grams.filter("kept")), f"values-{length}") if length > 1 else None)
        if length > 1:
            tables.drop(f"entries-{length - 1}")
        done = length > 1 and grams.filter("kept").isEmpty()
        if length == upto or done:
            sent.destroy()
            tables.drop(f"counts-{first}")
        tables.settle()
        if done:
            tables.drop(f"entries-{length}")
            return values


class Lookup:
    """Values by key, in one process's memory; its hash table is made where it is first used."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values, self._index = keys, values, None

    def __getstate__(self) -> tuple:
        return self.keys, self.values

    def __setstate__(self, state: tuple) -> None:
        self.keys, self.values, self._index = *state, None

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Places of wanted, -1 where absent."""
        if self._index is None:
            self._index = pd.Index(self.keys)
        return self._index.get_indexer(wanted)


def _bucketed(bits: int, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Buckets of keys by their leading bits, with the places of each one's keys."""
    own = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    order = np.argsort(own, kind="stable")
    cuts = np.flatnonzero(np.diff(own[order])) + 1
    for i, j in zip([0, *cuts], [*cuts, len(own)], strict=True):
        if j > i:
            yield int(own[order[i]]), order[i:j]


MESSAGE = "bucket int, kind int, chunk long, body binary"


def _messages(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "kind", "chunk", "body"])


def _offered(bits: int):
    """Messages of the values (key, more, base) by bucket, some PACKED in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, more, base = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            rows = [(bucket, VALUES, 0, keys[at].tobytes() + more[at].tobytes() + base[at].tobytes()) for bucket, at in _bucketed(bits, keys)]
            if rows:
                yield from sliced(_messages(rows))

    return run


def _score(sent, longest: int, bits: int, unknown: float):
    """Messages of each chunk of texts: what is known of its texts here, and which keys are to be looked up for which text.

    longest: tokens of the longest gram with a value; unknown: log10 of the base of a word never seen.
    """

    def asked(kind: int, chunk: int, rows: np.ndarray, keys: np.ndarray) -> list[tuple[int, int, int, bytes]]:
        out = []
        for bucket, at in _bucketed(bits, keys):
            for i in range(0, len(at), PACKED):
                part = at[i : i + PACKED]
                out.append((bucket, kind, chunk, keys[part].tobytes() + rows[part].astype(np.int32).tobytes()))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (words, seen, valued, hot), chunk = sent.value, TaskContext.get().partitionId() << 33
        for batch in batches:
            for w in textkernel.words(batch.column(2)):
                tokens, rows = _tokens(w)
                n, at = w.last - w.first, words.find(tokens)
                base = np.where(at >= 0, words.values[at], 0.0) if len(words.keys) else np.zeros(len(at))
                more, cold, places = np.zeros(len(tokens)), [], _places_in_text(rows)
                rare, row_of = np.flatnonzero(at < 0), np.repeat(np.arange(n), np.diff(rows))
                may = seen.may_have(tokens[rare])
                base[rare[~may]] = unknown
                messages = asked(WORDS_ASKED, chunk, row_of[rare[may]], tokens[rare[may]] ^ np.uint64(WORD_MARK))
                grams, may = tokens, np.ones(len(tokens), bool)
                for length in range(1, longest + 1):
                    # A gram with a value is a state, as is then its suffix, or an entry of one, which is all but its last token.
                    here = np.flatnonzero((may | _before(may)) & (places >= length - 1))
                    grams = grams if length == 1 else _longer(grams)
                    here = here[valued.may_have(grams[here])]
                    may = np.zeros(len(tokens), bool)
                    may[here] = True
                    found = hot.find(grams[here])
                    more[here[found >= 0]] += hot.values[found[found >= 0]] if len(hot.keys) else 0.0
                    here = here[found < 0]
                    cold.append((here, grams[here]))
                cold_at, cold_keys = (np.concatenate(x) for x in zip(*cold, strict=True))
                messages += asked(GRAMS, chunk, row_of[cold_at], cold_keys)
                sums = [pa.array(np.add.reduceat(x, rows[:-1])) for x in ((at >= 0).astype(np.int64), base, more)]
                told = [batch.column(0).slice(w.first, n), batch.column(1).slice(w.first, n), pa.array(np.diff(rows)), *sums]
                body = pa.RecordBatch.from_arrays(told, ["doc_id", "held_out", "n_tokens", "n_known", "base", "more"])
                stream = pa.BufferOutputStream()
                with pa.ipc.new_stream(stream, body.schema) as out:
                    out.write_batch(body)
                # Told rows ride along in any bucket.
                messages.append((chunk % (1 << bits), TOLD, chunk, stream.getvalue().to_pybytes()))
                yield from sliced(_messages(messages), 1_000)
                chunk += 1

    return run


def _answered(unknown: float):
    """From messages sorted by (bucket, kind), values first: told ones as they are, asked ones as sums for their texts."""

    def answer(chunk: int, kind: int, body: bytes, values: Lookup, base: np.ndarray) -> tuple[int, int, int, bytes]:
        k = len(body) // 12
        keys, rows = np.frombuffer(body, np.uint64, k), np.frombuffer(body, np.int32, k, 8 * k)
        at = values.find(keys)
        found = at >= 0
        own, where = np.unique(rows, return_inverse=True)
        known = found & (kind == WORDS_ASKED)
        total = lambda x: np.bincount(where, weights=x, minlength=len(own))
        if len(values.keys):
            more, logs = np.where(found, values.values[at], 0.0), np.where(found, base[at], unknown)
        else:
            more, logs = np.zeros(k), np.full(k, unknown)
        sums = [total(more), total(logs if kind == WORDS_ASKED else np.zeros(k)), total(known)]
        return 0, GRAMS, chunk, own.tobytes() + b"".join(x.tobytes() for x in sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, values, base = None, [], None, None
        for batch in batches:
            out = []
            for bucket, kind, chunk, body in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if bucket != now:
                    now, parts, values = bucket, [], None
                if kind == VALUES:
                    parts.append(body)
                    continue
                if kind == TOLD:
                    out.append((0, TOLD, chunk, body))
                    continue
                if values is None:
                    sizes = [len(x) // 24 for x in parts]
                    columns = [np.concatenate([np.frombuffer(x, kind_, k, 8 * k * i) for x, k in zip(parts, sizes, strict=True)] or [np.zeros(0, kind_)]) for i, kind_ in enumerate((np.uint64, np.float64, np.float64))]
                    values, base, parts = Lookup(columns[0], columns[1]), columns[2], []
                out.append(answer(chunk, kind, body, values, base))
            if out:
                yield _messages(out)

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of each chunk with all sums, from messages sorted by (chunk, kind), what was told last."""
    now, bodies = None, []
    for batch in batches:
        for kind, chunk, body in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            if chunk != now:
                now, bodies = chunk, []
            if kind != TOLD:
                bodies.append(body)
                continue
            told = pa.ipc.open_stream(body).read_all().combine_chunks().to_batches()[0]
            n_known, base, more = (told.column(i).to_numpy().astype(np.float64) for i in (3, 4, 5))
            for x in bodies:
                k = len(x) // 28
                own = np.frombuffer(x, np.int32, k)
                for i, column in enumerate((more, base, n_known)):
                    column[own] += np.frombuffer(x, np.float64, k, 4 * k + 8 * k * i)
            yield pa.RecordBatch.from_arrays([*told.columns[:3], pa.array(n_known.astype(np.int64)), pa.array(base), pa.array(base + more)], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])


def _gathered(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and values of a table whose size has a proven bound."""
    table = df.toArrow()
    keys, values = table.column(0).to_numpy().view(np.uint64), table.column(1).to_numpy()
    order = np.argsort(keys)
    return keys[order], values[order]


def score_texts(docs: DataFrame, tables: Tables, modulus: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words and one end token. Counts are taken over all training texts (crc32 of the id as text, modulo
    `modulus`, isn't 2). Contexts that occur LEAST_CONTEXT times are candidates, however large the corpus: all of one
    and two words, and longer ones as long as they extend a context that stayed; their next words that occur LEAST_NEXT
    times are entries. A candidate stays as a state of the tree if its distribution diverges enough from that of its
    suffix. A state gives each entry its discounted share and leaves the rest to its suffix, down to the base model, so
    each state's distribution sums to one. A token is scored from the longest suffix of what stands before it that is a
    state.

    Words, contexts and entries are written tables. What is sent to all workers is filters of a set size and the most
    frequent words and grams (see WORDS, HOT); all others are looked up by a shuffled join on their keys. Null text:
    empty, the end token alone. Null id: a training row. Repeated rows count as often as they stand there. No training
    rows: the base of an empty corpus, log10(1) for each token. Empty table: no rows. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col), modulus).alias("held_out"), F.col(text_col).alias("text"))
    train = rows.filter("not held_out").select("text")
    size = train.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = min(20, max(6, (size // 6 // BUCKET).bit_length()))
    words = tables.write(_counted(train, lambda tokens, rows: [[tokens]], ["key"], bits).drop("level"), "words")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    scale = math.log10(total + distinct + 1)
    levels = _levels(train, words, total, distinct, bits, tables)
    values = functools.reduce(DataFrame.unionByName, levels)
    values = tables.write(values.repartition("key").groupBy("key").agg(F.max("n").alias("n"), F.sum("v").alias("v")), "values")
    tables.drop(*(f"values-{i + 1}" for i in range(len(levels))))
    tables.settle()
    often, much = F.col("n") >= max(1, math.ceil(total / WORDS)), F.col("n") >= total / HOT
    frequent, n = _gathered(words.filter(often))
    hot, v = _gathered(values.filter(much).select("key", "v"))
    seldom = words.filter(~often)
    sent = rows.sparkSession.sparkContext.broadcast((Lookup(frequent, np.log10(n + 1.0) - scale), key_filter(seldom), key_filter(values), Lookup(hot, v)))
    seldom = seldom.select(F.col("key").bitwiseXOR(F.lit(WORD_MARK)).alias("key"), F.lit(0.0).alias("more"), (F.log10(F.col("n") + 1) - F.lit(scale)).alias("base"))
    offered = seldom.unionByName(values.filter(~much).select("key", F.col("v").alias("more"), F.lit(0.0).alias("base")))
    bits = (offered.count() // ASKED).bit_length()
    asked = rows.mapInArrow(released(_score(sent, len(levels) + 1, bits, -scale)), MESSAGE).unionByName(offered.mapInArrow(released(_offered(bits)), MESSAGE))
    answers = asked.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(released(_answered(-scale)), MESSAGE)
    answers = tables.write(answers, "answers")
    tables.settle()
    whole = answers.repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(released(_summed), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    out = tables.write(whole, "scored")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")
