"""Neighbourhood recommenders on sparse similarities.

Similarities are sums over a self-join on the shared key, aggregated before any further join. In the dense matrix every
pair without a common key has similarity 0 and changes no sum, so only pairs with a common key are made; the cells they
leave out get the default value when asked for.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clamp
from ..shared import written
from . import blocks, panels


#: Rows of one shared key that meet in one task; more are dealt into blocks, and pairs of blocks into tasks.
HEAVY = 2048
#: Cells that a task makes of all users with all items, while that takes no more than so many tasks.
CELLS, TASKS = 1 << 21, 4096


def pairs_by_key(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """left and right joined on k, each pair once; keys with many rows are split, whatever share of all rows they hold.

    The rows of keys are counted as this is called; where no key has many, the join is a plain one.
    """
    sizes = left.groupBy("k").agg(F.count(F.lit(1)).alias("_n")).unionByName(right.groupBy("k").agg(F.count(F.lit(1)).alias("_n")))
    heavy = written(sizes.groupBy("k").agg(F.ceil(F.max("_n") / HEAVY).cast("int").alias("_blocks")).filter("_blocks > 1"), "heavy")
    if heavy.isEmpty():
        return left.join(right, "k")

    def dealt(rows: DataFrame, by: str, own: str, other: str) -> DataFrame:
        blocks = F.coalesce("_blocks", F.lit(1))
        return rows.join(heavy, "k", "left").withColumn(own, F.pmod(F.xxhash64(by), blocks)).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), (blocks - 1).cast("long")))).drop("_blocks")

    return dealt(left, a, "_i", "_j").join(dealt(right, b, "_j", "_i"), ["k", "_i", "_j"]).drop("_i", "_j")


def co_rated_cosine(ratings: DataFrame, of: str, over: str) -> DataFrame:
    """(a, b, similarity): cosine of two values of `of` over the keys `over` that both have; 0 where a norm is 0.

    Only pairs with a <= b are made and summed, then turned round.
    """
    left = ratings.select(F.col(over).alias("k"), F.col(of).alias("a"), F.col("rating").alias("x"))
    right = ratings.select(F.col(over).alias("k"), F.col(of).alias("b"), F.col("rating").alias("y"))
    sums = pairs_by_key(left, right, "a", "b").filter("a <= b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    half = sums.select("a", "b", F.coalesce(F.try_divide("xy", F.sqrt(F.col("xx") * F.col("yy"))), F.lit(0.0)).alias("similarity"))
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return half.select(F.explode(F.when(F.col("a") == F.col("b"), F.slice(both, 1, 1)).otherwise(both)).alias("p"), "similarity").select("p.a", "p.b", "similarity")


def bounds(ratings: DataFrame) -> DataFrame:
    """One row: low, high."""
    return ratings.agg(F.min("rating").alias("low"), F.max("rating").alias("high"))


def all_cells(ratings: DataFrame) -> DataFrame:
    """Every user with every item: as large as their product, dealt out into tasks of about CELLS, or TASKS larger ones, as the
    driver keeps something of each. Users and items are written and counted as this is called."""
    users, items = (written(ratings.select(c).distinct(), f"{c}s") for c in ("user", "item"))
    n, m = users.count(), items.count()
    parts = max(1, min(n, m) // CELLS)  # of the fewer, all of which meet each task of the others
    tasks = max(1, min(n * m // CELLS + 1, max(n, m), TASKS // parts))
    if n >= m:
        users, items = users.repartition(tasks, "user"), items.coalesce(parts)
    else:
        users, items = users.coalesce(parts), items.repartition(tasks, "item")
    return users.crossJoin(items)


def _deviations(train: DataFrame) -> tuple[DataFrame, DataFrame]:
    means = train.groupBy("user").agg(F.avg("rating").alias("mean"))
    return means, train.join(means, "user").select("user", "item", (F.col("rating") - F.col("mean")).alias("residual"))


def _low_high(train: DataFrame) -> tuple[float, float]:
    low, high = bounds(train).first()
    return (0.0, 0.0) if low is None else (low, high)


def _clamped(ends: tuple[float, float]) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    return lambda base, up, down: np.clip(base + np.where(down > 0, up / down, 0.0), *ends)


def _kept(train: DataFrame) -> DataFrame:
    """The ratings as a table, as they are read several times."""
    return written(train.select("user", "item", F.col("rating").cast("double").alias("rating")), "train")


def _of_users(train: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(users' means, similarities of users as blocks, residuals by item as blocks)."""
    means, residuals = _deviations(train)
    means = written(means, "means")
    similar = written(co_rated_cosine(train, "user", "item").filter("similarity != 0"), "similar")
    items = train.select(F.col("item").alias("key"), F.lit(0.0).alias("base")).distinct()
    left = blocks.sparse_blocks(means.select(F.col("user").alias("key"), F.col("mean").alias("base")), similar.select(F.col("a").alias("key"), F.col("b").alias("k"), F.col("similarity").alias("x")), "user")
    right = blocks.sparse_blocks(items, residuals.select(F.col("item").alias("key"), F.col("user").alias("k"), F.col("residual").alias("x")), "item")
    return means, left, right


def user_user(train: DataFrame, fill: bool = True, n: int | None = None, places: int = 9) -> DataFrame:
    """Mean of the user plus the similarity-weighted residuals of the users who rated the item, in the range of ratings.

    fill: cells without any similar user get the user's mean; else they are left out. n: only the first n items of each
    user, by predictions in so many decimal places and by item; cells without similar users come up for users only who
    need them. Ratings and similarities are written as this is called.
    """
    train = _kept(train)
    ends = _low_high(train)
    means, left, right = _of_users(train)

    def evidence(users: DataFrame | None, n: int | None, fill: bool = False) -> DataFrame:
        of = left if users is None else _having(left, users)
        return blocks.weighted(of, right, "user", _clamped(ends), fill, n, places if n else None)

    if n is None:
        return evidence(None, None, fill)
    if not fill:
        return evidence(None, n)
    defaults = means.select("user", F.round(clamp(F.col("mean"), F.lit(ends[0]), F.lit(ends[1])), places).alias("default"))
    return blocks.first_with_defaults(train, lambda users: evidence(users, n if users is None else None), defaults, n)


def user_user_plain(train: DataFrame, fill: bool = True) -> DataFrame:
    """As user_user, without the range; null where no similar user rated the item."""
    _, left, right = _of_users(_kept(train))
    return blocks.weighted(left, right, "user", lambda base, up, down: base + np.where(down > 0, up / down, np.nan), fill)


def _having(of: DataFrame, users: DataFrame) -> DataFrame:
    """Blocks of users, cut down to some users."""
    names = ["key", "base", "k", "x"]
    rows = of.select(F.monotonically_increasing_id().alias("_block"), "user_low", "user_high", F.explode(F.arrays_zip(*[f"user_{c}" for c in names])).alias("e"))
    rows = rows.join(users.select(F.col("user").cast("long").alias("_user")), F.col("e.user_key") == F.col("_user"), "left_semi")
    rows = rows.groupBy("_block", "user_low", "user_high").agg(F.array_sort(F.collect_list("e")).alias("e"))
    return written(rows.select(*[F.col(f"e.user_{c}").alias(f"user_{c}") for c in names], "user_low", "user_high"), "blocks", 1)


def item_item(train: DataFrame, fill: bool = True, n: int | None = None, places: int = 9, exact: bool = False) -> DataFrame:
    """Similarity-weighted mean of the user's ratings of other items, in the range of ratings; 0 before that where all
    similarities are 0. fill, n, places: as in user_user. exact: with n, the predictions before rounding in a column exact."""
    train = _kept(train)
    ends = _low_high(train)
    return panels.predicted(train, ends, fill, n, places if n else None, exact and n is not None)
