"""Every user with every item, by products of blocks; what leaves a task is all of its cells, or the first n of each user."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import global_rank, written

#: Users and items of a block; a pair of blocks is one product of matrices.
BLOCK = 1024
#: Users of a block whose cells are made at a time.
ROWS = 64
#: Entries of a block of a sparse matrix, which has fewer rows than BLOCK where they are full; keys taken at a time in a product.
ENTRIES, KEYS = 1 << 17, 2048
#: Items of a group that is searched by boxes, items of a box, and those that come first by their keys.
GROUP, BOX, HEAD = 1 << 15, 32, 256
#: From the vectors of users and of items, a row each, to a matrix of scores.
Score = Callable[[np.ndarray, np.ndarray], np.ndarray]


def first_of(predicted: DataFrame, n: int) -> DataFrame:
    """The first n rows of each user by (prediction falling, item); tasks send on n rows a user at most."""
    best = Window.partitionBy("user").orderBy(F.col("prediction").desc(), F.col("item"))
    return predicted.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n).drop("rank")


def blocks(rows: DataFrame, key: str, vector: str, name: str, size: int = BLOCK) -> DataFrame:
    """One row for each block of about so many rows: their keys, rising, and their vectors one after the other. Counts the
    rows as it is called."""
    rows = rows.select(F.struct(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector")).alias("x"))
    n = max(1, -(-rows.count() // size))
    dealt = rows.groupBy(F.pmod(F.xxhash64("x.key"), F.lit(n)).alias("_block")).agg(F.array_sort(F.collect_list("x")).alias("x"))
    return dealt.select(F.col("x.key").alias(f"{name}s"), F.flatten("x.vector").alias(f"{name}_vectors"))


def ordered(rows: DataFrame, key: str, vector: str, name: str, first: tuple[str, ...] = ()) -> DataFrame:
    """As blocks, but a block is a range of the keys' order, or of that of first and the keys, however many are equal in first."""
    rows = rows.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    ranked = global_rank(rows, [*map(F.col, first), F.col("key")], "place")
    dealt = ranked.groupBy(F.floor((F.col("place") - 1) / BLOCK).alias("_block")).agg(F.array_sort(F.collect_list(F.struct("place", "key", "vector"))).alias("x"))
    return dealt.select(F.col("x.key").alias(f"{name}s"), F.flatten("x.vector").alias(f"{name}_vectors"))


def alike(rows: DataFrame, key: str, vector: str, name: str) -> DataFrame:
    """As ordered, by vectors, so that keys of equal vectors are together and cells of equal scores, too, which a file holds as
    one score and how often it comes."""
    return ordered(rows, key, vector, name, ("vector",))


def pairs(users: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs of blocks of users and of items, written, as more than one pass reads them: (users, user_vectors, items, item_vectors)."""
    return written(users, "blocks", 1).crossJoin(written(items, "blocks", 1)).select("users", "user_vectors", "items", "item_vectors")


def _matrices(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    users, u, items, v = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in range(4))
    return users, u.reshape(len(users), -1), items, v.reshape(len(items), -1)


def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(users, their vectors, items, their vectors) of each pair of blocks."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield _matrices(batch, i)


def distinct(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors without those equal to the one before, and the place there of each."""
    new = np.ones(len(vectors), bool)
    new[1:] = (vectors[1:] != vectors[:-1]).any(axis=1)
    return vectors[new], np.cumsum(new) - 1


def first_keys(rows: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """The n least keys of each group."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(key))).filter(F.col("_rank") <= n).drop("_rank")


def ends(of: DataFrame, score: Score) -> tuple[float | None, float | None]:
    """The least and the largest score of all cells, of which a task sends on two numbers for each pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                _, u, _, v = _matrices(batch, i)
                scores = score(u, v)
                yield pa.RecordBatch.from_arrays([pa.array([scores.min()]), pa.array([scores.max()])], ["lo", "hi"])

    return tuple(of.mapInArrow(run, "lo double, hi double").agg(F.min("lo"), F.max("hi")).first())


def _rows(users: np.ndarray, items: np.ndarray, scores: np.ndarray, n: int | None, *more: np.ndarray) -> list[pa.Array]:
    """Users, items, scores and more of all cells, or of the first n of each user; items are in order, so that of ties the first stay."""
    if n is None or n >= len(items):
        return [pa.array(np.repeat(users, len(items))), pa.array(np.tile(items, len(users))), *[pa.array(x.reshape(-1)) for x in (scores, *more)]]
    least = np.partition(scores, len(items) - n, axis=1)[:, len(items) - n, None]
    above, ties = scores > least, scores == least
    kept = above | (ties & (np.cumsum(ties, axis=1, dtype=np.int32) <= n - above.sum(axis=1)[:, None]))
    best = np.nonzero(kept)[1].reshape(len(users), n)
    return [pa.array(np.repeat(users, n)), pa.array(items[best.reshape(-1)]), *[pa.array(x[kept]) for x in (scores, *more)]]


def cells(of: DataFrame, score: Score, n: int | None = None) -> DataFrame:
    """(user, item, prediction) of all cells of pairs of blocks, or the first n of each user by (prediction falling, item).
    Equal vectors that are together are scored once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                users, u, items, v = _matrices(batch, i)
                (u, who), (v, what) = distinct(u), distinct(v)
                for at in range(0, len(users), ROWS):
                    own = who[at : at + ROWS]
                    scores = score(u[own[0] : own[-1] + 1], v)[(own - own[0])[:, None], what]
                    yield pa.RecordBatch.from_arrays(_rows(users[at : at + ROWS], items, scores, n), ["user", "item", "prediction"])

    out = of.mapInArrow(run, "user long, item long, prediction double")
    return out if n is None else first_of(out, n)


def _boxes(v: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """Rows in boxes of at most BOX, halved where they lie widest."""
    todo, out = [rows] if len(rows) else [], []
    while todo:
        own = todo.pop()
        if len(own) <= BOX:
            out.append(np.sort(own))
            continue
        x = v[own]
        by = np.argpartition(x[:, np.argmax(np.ptp(x, axis=0))], len(own) // 2)
        todo += [own[by[: len(own) // 2]], own[by[len(own) // 2 :]]]
    return out


def search(u: np.ndarray, items: np.ndarray, v: np.ndarray, score: Score, reach: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and items of the first n of each user by (score falling, item), -inf where there are fewer.

    Items lie in boxes. reach says what no score of a box exceeds, from its least and largest components and sums of them; a box is scored for
    the users only who may find one of their first n there.
    """
    best, which = np.full((len(u), n), -np.inf), np.full((len(u), n), np.iinfo(np.int64).max)

    def look(users: np.ndarray, own: np.ndarray) -> None:
        for at in range(0, len(users), 8 * ROWS):
            some = users[at : at + 8 * ROWS]
            scores = score(u[some], v[own])
            last, key = best[some, -1, None], which[some, -1, None]
            better = ((scores > last) | ((scores == last) & (items[own] < key))).any(axis=1)
            some, scores = some[better], scores[better]
            if not len(some):
                continue
            scores = np.concatenate([best[some], scores], axis=1)
            keys = np.concatenate([which[some], np.broadcast_to(items[own], (len(some), len(own)))], axis=1)
            first = np.lexsort((keys, -scores), axis=1)[:, :n]
            best[some], which[some] = np.take_along_axis(scores, first, 1), np.take_along_axis(keys, first, 1)

    everyone = np.arange(len(u))
    look(everyone, np.arange(min(HEAD, len(items))))  # items are in order
    boxes = _boxes(v, np.arange(HEAD, len(items)))
    if boxes:
        v_sum = np.column_stack([v, v.sum(axis=1)])
        most = np.asfortranarray(reach(u, np.array([v_sum[b].min(axis=0) for b in boxes]), np.array([v_sum[b].max(axis=0) for b in boxes])))
        least = np.array([items[b[0]] for b in boxes])
        wanted = lambda at, users: users[(most[users, at] > best[users, -1]) | ((most[users, at] == best[users, -1]) & (least[at] < which[users, -1]))]
        highest, seen = most.argmax(axis=1), np.zeros(most.shape, bool)
        for at in np.unique(highest):  # where a user may find most comes first, so that little else is left to be looked at
            users = wanted(at, np.flatnonzero(highest == at))
            seen[users, at] = True
            if len(users):
                look(users, boxes[at])
        for at in np.argsort(-most.mean(axis=0)):
            users = wanted(at, np.flatnonzero(~seen[:, at]))
            if len(users):
                look(users, boxes[at])
    return best, which


def searched(of: DataFrame, score: Score, reach: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], n: int) -> DataFrame:
    """(user, item, prediction) of the first n of each user, as cells with n, without the scores of all cells: see search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for users, u, items, v in matrices(batches):
            best, which = search(u, items, v, score, reach, n)
            there = best.reshape(-1) > -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(x.reshape(-1)[there]) for x in (np.repeat(users, n), which, best)], ["user", "item", "prediction"])

    return first_of(of.mapInArrow(run, "user long, item long, prediction double"), n)


def first_with_defaults(items: DataFrame, evidence: Callable[[DataFrame | None], DataFrame], defaults: DataFrame, n: int) -> DataFrame:
    """The first n of each user of all cells, where cells without evidence have the user's default.

    evidence: from some users (user), or None for all, to their (user, item, prediction) cells; defaults: (user, default).
    Only users with fewer than n predictions above their default need others. The first n items without evidence are
    among the user's first n plus as many as have some, so no more items than that come up for these users.
    """
    first = written(first_of(evidence(None), n), "first")
    above = first.join(defaults, "user").filter(F.col("prediction") > F.col("default")).groupBy("user").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= n)
    lacking = written(defaults.join(above, "user", "left_anti").select("user", "default"), "lacking")
    if lacking.isEmpty():
        return first
    known = written(evidence(lacking.select("user")).select("user", "item"), "known")
    sizes = known.groupBy("user").agg(F.count(F.lit(1)).alias("n"))
    places = lacking.join(sizes, "user", "left").select("user", "default", F.explode(F.sequence(F.lit(1).cast("long"), n + F.coalesce("n", F.lit(0)))).alias("place"))
    others = places.join(global_rank(items.select("item").distinct(), [F.col("item")], "place"), "place").join(known, ["user", "item"], "left_anti")
    values = [F.col("default").alias(c) for c in first.columns if c not in ("user", "item")]
    return first_of(first.unionByName(others.select("user", "item", *values)), n)


def sparse_blocks(keys: DataFrame, entries: DataFrame, name: str) -> DataFrame:
    """Blocks of a sparse matrix, written: a row for each range of keys (key, base), with all of their entries (key, k, x).

    A block has about BLOCK keys, or ENTRIES entries, if that is less. Columns: of each entry its key, the key's base (a
    number, or an array of so many for each key), k and x (null for a key without entries), and the least and largest k.
    Each block is a file, so that a task reads a few.
    """
    base = F.col("base").cast("array<double>" if keys.schema["base"].dataType.typeName() == "array" else "double")
    ranked = written(global_rank(keys.select(F.col("key").cast("long").alias("key"), base.alias("base")), [F.col("key")], "place"), "keys")
    entries = entries.select(F.col("key").cast("long").alias("key"), F.col("k").cast("long").alias("k"), F.col("x").cast("double").alias("x"))
    sizes = ranked.agg(F.count(F.lit(1)).alias("all")).crossJoin(entries.agg(F.count(F.lit(1)).alias("entries")))
    count = sizes.select("all", F.greatest(F.ceil(F.col("all") / BLOCK), F.ceil(F.col("entries") / ENTRIES), F.lit(1)).alias("blocks"))
    ranked = ranked.crossJoin(F.broadcast(count)).select("key", "base", F.floor((F.col("place") - 1) * F.col("blocks") / F.col("all")).alias("_block"))
    dealt = ranked.join(entries, "key", "left").groupBy("_block").agg(F.array_sort(F.collect_list(F.struct("key", "base", "k", "x"))).alias("e"), F.min("k").alias(f"{name}_low"), F.max("k").alias(f"{name}_high"))
    return written(dealt.select(*[F.col(f"e.{c}").alias(f"{name}_{c}") for c in ("key", "base", "k", "x")], f"{name}_low", f"{name}_high"), "blocks", 1)


def _sparse(batch: pa.RecordBatch, at: int, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block its keys, their bases, and the entries as place of the key, k, x."""
    key, base, k, x = (batch.column(at + c)[i].values for c in range(4))
    there = pc.is_valid(k).to_numpy(zero_copy_only=False)
    keys, first, place = np.unique(key.to_numpy(), return_index=True, return_inverse=True)
    of = lambda a: a.filter(pa.array(there)).to_numpy(zero_copy_only=False)
    bases = base.flatten().to_numpy(zero_copy_only=False).reshape(len(base), -1) if pa.types.is_list(base.type) else base.to_numpy(zero_copy_only=False)
    return keys, bases[first], place[there], of(k), of(x)


def _dense(shape: tuple[int, int], rows: np.ndarray, columns: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.zeros(shape)
    out[rows, columns] = x
    return out


def weighted(users: DataFrame, items: DataFrame, similar: str, value: Callable[..., np.ndarray], fill: bool, n: int | None = None, places: int | None = None, exact: bool = False, of_items: bool = False) -> DataFrame:
    """(user, item, prediction) from two sparse matrices over a shared key k, by products of blocks of them.

    users, items: sparse_blocks named "user" and "item"; similar: which of them has the similarities, the other one has
    ratings. value: from the users' bases (a column), the sums over k of rating times similarity, and of absolute
    similarities, to predictions, NaN: null; of_items: from the items' bases (a row) too, as a fourth. fill: cells without any similarity too; else pairs of blocks whose keys lie
    apart aren't made. n: only the first n items of each user. places: predictions are rounded to so many; exact: with
    what they were before, in a column of its own. Neither matrix nor any sum is shuffled by cell.
    """
    if not fill:
        of = users.join(items, (F.col("user_low") <= F.col("item_high")) & (F.col("item_low") <= F.col("user_high")))
    else:
        of = users.crossJoin(items)
    of = of.select(*[f"{name}_{c}" for name in ("user", "item") for c in ("key", "base", "k", "x")])

    def sums(u, v) -> tuple[np.ndarray, np.ndarray]:
        (users, _, up, uk, ux), (items, _, vp, vk, vx) = u, v
        up_sum, down = np.zeros((len(users), len(items))), np.zeros((len(users), len(items)))
        shared = np.intersect1d(uk, vk)
        for at in range(0, len(shared), KEYS):
            keys = shared[at : at + KEYS]
            ui, vi = (np.minimum(np.searchsorted(keys, k), len(keys) - 1) for k in (uk, vk))
            uh, vh = keys[ui] == uk, keys[vi] == vk
            a, b = (len(users), len(keys)), (len(keys), len(items))
            up_sum += _dense(a, up[uh], ui[uh], ux[uh]) @ _dense(b, vi[vh], vp[vh], vx[vh])
            weights = (np.abs(ux[uh]), np.ones(vh.sum())) if similar == "user" else (np.ones(uh.sum()), np.abs(vx[vh]))
            down += _dense(a, up[uh], ui[uh], weights[0]) @ _dense(b, vi[vh], vp[vh], weights[1])
        return up_sum, down

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                u, v = _sparse(batch, 0, i), _sparse(batch, 4, i)
                up, down = sums(u, v)
                with np.errstate(divide="ignore", invalid="ignore"):
                    predicted = value(u[1][:, None], up, down, *([v[1][None]] if of_items else []))
                some = np.ones(down.shape, bool) if fill else down > 0
                for at in range(0, len(u[0]), ROWS):
                    scores, there = predicted[at : at + ROWS], some[at : at + ROWS]
                    shown = scores if places is None else np.round(scores, places)
                    columns = _rows(u[0][at : at + ROWS], v[0], shown if fill else np.where(there, shown, -np.inf), n, *([scores] if exact else []))
                    if not fill:
                        kept = pa.array(columns[2].to_numpy() > -np.inf) if n is not None and n < len(v[0]) else pa.array(there.reshape(-1))
                        columns = [c.filter(kept) for c in columns]
                    prediction = columns[2].to_numpy(zero_copy_only=False)
                    columns[2] = pa.array(prediction, mask=np.isnan(prediction))
                    yield pa.RecordBatch.from_arrays(columns, ["user", "item", "prediction", "exact"][: len(columns)])

    out = of.mapInArrow(run, "user long, item long, prediction double" + (", exact double" if exact else ""))
    return out if n is None else first_of(out, n)
