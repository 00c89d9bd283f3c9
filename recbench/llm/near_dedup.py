"""Operator 10, MinHash near-duplicates by tensored banding, with exact confirmation of every link."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel
from .common import Tables, released, sliced
from .components import connected_components

#: MinHash values of a key.
DEPTH = 3
#: Most probable shares of pairs at the very threshold that meet in no table, and that the signature filter drops.
UNMET, DROPPED = 4e-4, 1e-6
#: Buckets of more classes bring 32-bit shingle hashes along when they are searched whole, so that only pairs that are
#: links, but for a chance collision of hashes, come out to be confirmed.
SMALL = 8
#: Orders of the classes, one of which names a bucket's pivot; so buckets of the same classes have few pivots among them.
PIVOTS = 4
#: A bucket that is searched whole is dealt into blocks of half so many members and shingles on average; a task unit is
#: a pair of blocks. A block holds more than so many members with a chance of less than 1e-70.
BLOCK, BLOCK_SHINGLES = 4096, 1 << 20


@dataclass(frozen=True)
class Shape:
    """Two collections of `side` keys of DEPTH MinHash values each; every pair of keys, one from either, is a table.

    So side * side tables cost 2 * side * DEPTH MinHash values. Pairs that agree in fewer than `least` of these aren't
    confirmed.
    """

    side: int
    least: int

    @property
    def values(self) -> int:
        return 2 * self.side * DEPTH


@functools.cache
def shape(percent: int) -> Shape:
    """For links at a similarity of percent / 100: a pair meets in no table with a probability of
    2 * (1 - similarity ** DEPTH) ** side, and agrees in a binomial number of values, of which one byte
    each is compared.
    """
    s, side = percent / 100, 1
    if not 0 < s < 1:
        raise ValueError(f"percent must be within 1..99: {percent}")
    while 2 * (1 - s**DEPTH) ** side > UNMET:
        side += 1
    n, least, below, s = 2 * side * DEPTH, 0, 0.0, s + (1 - s) / 256
    while (below := below + math.comb(n, least) * s**least * (1 - s) ** (n - least)) <= DROPPED:
        least += 1
    return Shape(side, least)


@functools.cache
def _random(values: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240602)
    return rng.integers(0, 1 << 64, size=values, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 64, size=values, dtype=np.uint64)


#: Makes the second half of a set's fingerprint differ from the first.
_FINGER = _random(2 * 9 * DEPTH)[1][0]


def signature(x: np.ndarray, values: int) -> np.ndarray:
    """The MinHash values of a set of hashes; a large set goes in slices."""
    (times, plus), out = _random(values), None
    for i in range(0, len(x), 4096):
        part = (x[i : i + 4096, None] * times + plus).min(axis=0)
        out = part if out is None else np.minimum(out, part)
    return out


def half_keys(values: np.ndarray) -> np.ndarray:
    """(rows, 2 * side) keys from (rows, 2 * side * DEPTH) MinHash values."""
    parts = values.reshape(len(values), -1, DEPTH)
    return textkernel.combine([parts[:, :, i] for i in range(DEPTH)])


def table_keys(halves: np.ndarray) -> np.ndarray:
    """(rows, side * side) keys: every pair of a key of the first collection and one of the second."""
    side = halves.shape[1] // 2
    at = np.arange(side * side, dtype=np.uint64)
    left, right = np.repeat(halves[:, :side], side, axis=1), np.tile(halves[:, side:], (1, side))
    return textkernel.combine([left, right, np.broadcast_to(at, left.shape)])


def _sketch(size: int, of: Shape):
    count = of.values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, fa, fb, sigs = batch.column(0), [], [], [], []
            for w in textkernel.words(batch.column(1)):
                for x in textkernel.shingle_sets(w, size):
                    n.append(len(x))
                    fa.append(int(x.sum(dtype=np.uint64)))
                    fb.append(int(textkernel.mix(x ^ _FINGER).sum(dtype=np.uint64)))
                    sigs.append(signature(x, count) if len(x) else np.zeros(count, np.uint64))
            if not n:
                continue
            values = np.array(sigs, dtype=np.uint64)
            halves = half_keys(values)
            low = np.ascontiguousarray(values & np.uint64(255)).astype(np.uint8)
            binary = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
            u64 = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), u64(fa), u64(fb), binary(halves), binary(low)], ["doc_id", "n_shingles", "fa", "fb", "halves", "low"])

    return run


def _buckets(side: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (cid, key, at) of every table, from (cid, halves)."""
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                halves = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint64).reshape(part.num_rows, 2 * side)
                keys = table_keys(halves)
                cid = np.repeat(part.column(0).to_numpy(zero_copy_only=False), side * side)
                yield from sliced(pa.RecordBatch.from_arrays([pa.array(cid), pa.array(keys.reshape(-1).view(np.int64))], ["cid", "key"]))

    return run


def _agreeing(of: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows (b, a, low_a, low_b) the pairs that agree in enough MinHash values."""
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, of.values) for i in (2, 3))
            pairs = pa.RecordBatch.from_arrays([batch.column(1), batch.column(0)], ["a", "b"])
            yield pairs.filter(pa.array((x == y).sum(axis=1) >= of.least))

    return run


def _grams(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in textkernel.words(batch.column(1)):
                fa, fb, grams, short = [], [], [], []
                for x in textkernel.shingle_sets(w, size):
                    short.append((x >> np.uint64(32)).astype(np.uint32).tobytes())
                    fa.append(int(x.sum(dtype=np.uint64)))
                    fb.append(int(textkernel.mix(x ^ _FINGER).sum(dtype=np.uint64)))
                    grams.append(x.tobytes())
                u64 = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([u64(fa), u64(fb), pa.array(grams, pa.binary()), pa.array(short, pa.binary())], ["fa", "fb", "grams", "short"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                if 100 * len(x) < percent * len(y):
                    keep.append(False)
                    continue
                both = np.concatenate([x, y])
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _block_pairs(percent: int, key: int, cid: np.ndarray, component: np.ndarray, role: np.ndarray, halves: np.ndarray, low: np.ndarray, short: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members of two blocks, role 0 and 1, or of one (role 2) whose components differ and that meet here first.

    Where shingle hashes came along, only pairs similar enough by these.
    """
    side, least = shape(percent).side, shape(percent).least
    first = int((table_keys(halves[:1])[0] == np.uint64(key & (1 << 64) - 1)).argmax())
    if short[0]:
        sets = [np.frombuffer(x, np.uint32) for x in short]
        size = np.array([len(x) for x in sets])
        distinct, at = np.unique(np.concatenate(sets), return_inverse=True)
        starts, marked = np.cumsum(size) - size, np.zeros(len(distinct), bool)
    out: list[tuple[np.ndarray, np.ndarray]] = [(cid[:0], cid[:0])]
    order = np.lexsort((cid, role))
    others = order[role[order] > 0]
    for i in order[role[order] != 1]:
        m = others[component[others] != component[i]]
        m = m[(role[i] == 0) | (cid[m] > cid[i])]
        m = m[(low[m] == low[i]).sum(axis=1) >= least]
        same = halves[m] == halves[i]
        m = m[same[:, :side].argmax(axis=1) * side + same[:, side:].argmax(axis=1) == first]
        if short[0] and len(m):
            marked[at[starts[i] : starts[i] + size[i]]] = True
            if len(m) < len(cid) // 16:
                common = np.array([np.count_nonzero(marked[at[starts[j] : starts[j] + size[j]]]) for j in m])
            else:
                common = np.add.reduceat(marked[at], starts, dtype=np.int64)[m]
            marked[at[starts[i] : starts[i] + size[i]]] = False
            m = m[100 * common >= percent * (size[i] + size[m] - common)]
        out.append((np.full(len(m), cid[i]), cid[m]))
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def _cross_pairs(percent: int):
    """Pairs (a, b) of the units of rows (key, unit, cid, component, role, halves, low, short) sorted by (key, unit)."""

    def pairs(t: pa.Table) -> pa.RecordBatch:
        n = t.num_rows
        key, unit, cid, component, role = (t.column(i).to_numpy() for i in range(5))
        halves = np.frombuffer(b"".join(t.column(5).to_pylist()), np.uint64).reshape(n, -1)
        low = np.frombuffer(b"".join(t.column(6).to_pylist()), np.uint8).reshape(n, -1)
        cut = np.flatnonzero((key[1:] != key[:-1]) | (unit[1:] != unit[:-1])) + 1
        short = t.column(7).to_pylist()
        found = [_block_pairs(percent, int(key[i]), cid[i:j], component[i:j], role[i:j], halves[i:j], low[i:j], short[i:j]) for i, j in zip([0, *cut], [*cut, n], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[i] for f in found])) for i in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key, unit = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cut = np.flatnonzero((key[1:] != key[:-1]) | (unit[1:] != unit[:-1])) + 1
            first = int(cut[0]) if len(cut) else batch.num_rows
            last = int(cut[-1]) if len(cut) else batch.num_rows
            if kept and (kept[-1].column(0)[-1].as_py(), kept[-1].column(1)[-1].as_py()) != (int(key[0]), int(unit[0])):
                yield pairs(pa.Table.from_batches(kept))
                kept = []
            if not len(cut):
                kept.append(batch)
                continue
            yield pairs(pa.Table.from_batches([*kept, batch.slice(0, first)]))
            if last > first:
                yield pairs(pa.Table.from_batches([batch.slice(first, last - first)]))
            kept = [batch.slice(last)]
        if kept:
            yield pairs(pa.Table.from_batches(kept))

    return run


def deal(placed: DataFrame) -> DataFrame:
    """Members (key, n, cid, component, size) of the buckets with several components, for each unit that they belong to.

    A bucket's largest component and all its other members are dealt into blocks; a unit is a pair of blocks of the
    others, or one of the others and one of the largest component. So each pair of members of different components
    comes together in one unit, and a unit holds two blocks, however large the bucket is.
    """
    parts = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_size"))
    most = F.max(F.struct("_n", "component", "_size"))
    mixed = parts.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), most.alias("m"), F.sum("_n").alias("_n"), F.sum("_size").alias("_size")).filter("parts > 1")

    def blocks(n, size):
        full = (n > BLOCK) | (size > BLOCK_SHINGLES)
        return F.when(full, F.greatest(F.ceil(2 * n / BLOCK), F.ceil(2 * size / BLOCK_SHINGLES))).otherwise(1).cast("int")

    mixed = mixed.select("key", F.col("m.component").alias("largest"), blocks(F.col("m._n"), F.col("m._size")).alias("most"), blocks(F.col("_n") - F.col("m._n"), F.col("_size") - F.col("m._size")).alias("rest"))
    unit = lambda i, j, role: F.struct((F.shiftleft(i.cast("long"), 32) + j.cast("long")).alias("unit"), role.cast("int").alias("role"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    in_most, own = F.col("component") == F.col("largest"), lambda n: F.pmod(F.xxhash64("cid"), n).cast("int")
    a, rest, c = own(F.col("rest")), F.col("rest"), own(F.col("most"))
    of_most = F.transform(upto(rest), lambda i: unit(i, rest + c, F.lit(1)))
    with_rest = F.transform(upto(rest), lambda i: unit(F.least(i, a), F.greatest(i, a), F.when(i == a, 2).when(a < i, 0).otherwise(1)))
    with_most = F.transform(upto(F.col("most")), lambda j: unit(a, rest + j, F.lit(0)))
    dealt = placed.join(mixed, "key").withColumn("x", F.explode(F.when(in_most, of_most).otherwise(F.concat(with_rest, with_most))))
    return dealt.select("key", "n", "x.unit", "cid", "component", "x.role")


def near_dedup(docs: DataFrame, tables: Tables, shingle: int = 5, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    1. One pass makes each document's shingle set, a 128-bit fingerprint of it and its half keys. Documents of equal
       sets become one class; all further work is on classes.
    2. In every bucket of every table each class is paired with one member, its first in one of a few orders. Pairs whose
       MinHash values agree often enough are confirmed on the full sets, and components are formed.
    3. Buckets that still hold several components are searched whole: each member outside the bucket's largest
       component is compared with all members of other components, in units of two blocks of bounded size (see deal).
       The pairs that agree often enough, each in the first table it meets in, are confirmed on the full sets. So no
       bucket is capped, and within a component no more pairs are made than step 2 made. A bucket of n members of many
       small components takes at most 2 * n * n / BLOCK rows beyond its own n.

    A link is 100 * intersection >= percent * union. Null and empty texts, and texts without words, have an empty set
    and are linked with nothing. A null id is never the smallest; a component without any id has a null component_id
    and is kept. Rows that repeat an id get the same result. Empty table: no rows. Other columns are ignored.
    """
    of = shape(percent)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = tables.write(rows.mapInArrow(released(_sketch(shingle, of)), "doc_id long, n_shingles long, fa long, fb long, halves binary, low binary"), "sketch")
    full = sketch.filter("n_shingles > 0")
    least = full.groupBy("fa", "fb").agg(F.min("doc_id").alias("rep"))
    least = least.select(F.col("fa").alias("_fa"), F.col("fb").alias("_fb"), "rep")
    met = full.join(least, (F.col("fa") == F.col("_fa")) & (F.col("fb") == F.col("_fb")) & F.col("doc_id").eqNullSafe(F.col("rep")))
    classes = met.dropDuplicates(["fa", "fb"]).select(F.monotonically_increasing_id().alias("cid"), "rep", "fa", "fb", F.col("n_shingles").alias("size"), "halves", "low")
    classes = tables.write(classes, "classes")
    keyed = classes.select("cid", "halves").mapInArrow(released(_buckets(of.side)), "cid long, key long")
    # Most keys are of one class, so nothing is summed before the shuffle, which the count and the join share.
    keyed = tables.write(keyed, "keyed").repartition("key")
    order = F.xxhash64(F.pmod(F.col("key"), F.lit(PIVOTS)))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("cid").bitwiseXOR(order)).alias("m")).filter("n > 1").select("key", "n", F.col("m").bitwiseXOR(order).alias("pivot"))
    members = tables.write(keyed.join(shared, "key"), "members")
    tables.drop("keyed")

    low = classes.select("cid", "low")
    first = members.filter("cid != pivot").select(F.least("cid", "pivot").alias("a"), F.greatest("cid", "pivot").alias("b")).distinct()
    agreeing = first.join(low.toDF("a", "low_a"), "a").join(low.toDF("b", "low_b"), "b").mapInArrow(released(_agreeing(of)), "a long, b long")
    some = members.select("cid").distinct().join(classes.select("cid", "rep", "fa", "fb"), "cid")
    text = rows.join(some.select(F.col("rep").alias("_rep")).distinct(), F.col("doc_id").eqNullSafe(F.col("_rep"))).select("doc_id", "text")
    grams = text.mapInArrow(released(_grams(shingle)), "fa long, fb long, grams binary, short binary")
    sets = tables.write(grams.join(some.select("cid", "fa", "fb"), ["fa", "fb"]).dropDuplicates(["cid"]).select("cid", "grams", "short"), "sets")

    full_sets = sets.select("cid", "grams")

    def confirmed(pairs: DataFrame) -> DataFrame:
        both = pairs.join(full_sets.toDF("a", "grams_a"), "a").join(full_sets.toDF("b", "grams_b"), "b").select("a", "b", "grams_a", "grams_b")
        return both.mapInArrow(released(_confirm(percent)), "a long, b long")

    links = tables.write(confirmed(agreeing), "links")
    first_labels = connected_components(links, tables, "first")
    labels = first_labels.withColumnRenamed("node", "cid")
    labels = classes.select("cid", "size").join(labels, "cid", "left").select("cid", "size", F.coalesce("component", "cid").alias("component"))
    dealt = tables.write(deal(tables.write(members.select("key", "n", "cid").join(labels, "cid"), "placed")).join(classes.select("cid", "halves", "low"), "cid"), "dealt")
    columns = ["key", "unit", "cid", "component", "role", "halves", "low", "short"]
    dealt = dealt.filter(F.col("n") <= SMALL).withColumn("short", F.lit(b"")).select(*columns).unionByName(dealt.filter(F.col("n") > SMALL).join(sets.select("cid", "short"), "cid").select(*columns))
    dealt = dealt.repartition("key", "unit").sortWithinPartitions("key", "unit")
    second = dealt.mapInArrow(released(_cross_pairs(percent)), "a long, b long")
    more = tables.write(confirmed(second), "more-links")
    tables.drop("members", "placed", "dealt", "sets", "links")
    tables.settle()
    labels = connected_components(more, tables, "final", first_labels).withColumnRenamed("node", "cid")

    least = classes.select("cid", "fa", "fb", "rep").join(labels, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = tables.write(least, "labelled")
    ids = least.groupBy("component").agg(F.min("rep").alias("component_id"))
    least = least.join(ids, "component").select("fa", "fb", "component_id", F.lit(True).alias("_has"))
    out = sketch.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("fa")).alias("fa"), "fb").join(least, ["fa", "fb"], "left")
    component = F.when(F.col("_has"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
