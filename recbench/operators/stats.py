"""Statistics of data sets, and nearest neighbours by correlation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import global_rank, written
from .knn import pairs_by_key


def dataset_stats(*parts: DataFrame) -> DataFrame:
    """Users, items, ratings, their range, mean, population deviation and variance, and density as a fraction."""
    if not parts:
        raise TypeError("no interactions given")
    rows = reduce(DataFrame.unionByName, parts)
    r = "rating"
    out = rows.agg(
        F.countDistinct("user").alias("users"), F.countDistinct("item").alias("items"), F.count(F.lit(1)).alias("ratings"), F.min(r).alias("rating_min"),
        F.max(r).alias("rating_max"), F.avg(r).alias("rating_mean"), F.stddev_pop(r).alias("rating_stdev"), F.var_pop(r).alias("rating_variance"),
    )
    return out.withColumn("density", F.try_divide(F.col("ratings").cast("double"), (F.col("users") * F.col("items")).cast("double")))


def completeness(rows: DataFrame) -> DataFrame:
    """Mean ratings of a user and of an item, and the share of filled cells to four places."""
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user").alias("u"), F.countDistinct("item").alias("i"))
    return n.select((F.col("n") / F.col("u")).alias("per_user"), (F.col("n") / F.col("i")).alias("per_item"), F.round(F.col("n") / (F.col("u") * F.col("i")), 4).alias("completeness"))


def item_means(rows: DataFrame) -> DataFrame:
    return rows.groupBy("item").agg(F.avg("rating").alias("mean"), F.count(F.lit(1)).alias("n"))


def activity(rows: DataFrame, by: str, of: str) -> DataFrame:
    """Events and distinct partners of each key."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("events"), F.countDistinct(of).alias("partners"))


def quartile(rows: DataFrame, column: str, share: float = 0.75) -> DataFrame:
    """Percentile with linear interpolation: of two neighbours in the order of all values, found by ranges."""
    ranked = global_rank(rows.filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("_x")), [F.col("_x")], "_place")
    at = ranked.agg((1 + F.lit(share) * (F.count(F.lit(1)) - 1)).alias("_at"))
    near = ranked.crossJoin(F.broadcast(at)).filter((F.col("_place") == F.floor("_at")) | (F.col("_place") == F.ceil("_at")))
    weight = F.when(F.floor("_at") == F.ceil("_at"), 1.0).otherwise(1 - F.abs(F.col("_place") - F.col("_at")))
    return near.agg(F.sum(F.col("_x") * weight).alias("quartile"))


def histogram(rows: DataFrame, column: str, bins: int, low: float, high: float, log: bool = False) -> DataFrame:
    """(bin, n) with bins of equal width from 1 to bins; 0 and bins + 1 hold what lies outside."""
    x = F.log10(column) if log else F.col(column).cast("double")
    return rows.select(F.width_bucket(x, F.lit(float(low)), F.lit(float(high)), F.lit(bins)).cast("long").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def share_above(rows: DataFrame, column: str, least: float) -> DataFrame:
    return rows.agg(F.sum(F.when(F.col(column) > least, 1).otherwise(0)).alias("above"), F.count(F.lit(1)).alias("all"), F.avg((F.col(column) > least).cast("double")).alias("share"))


def able_pairs(left: DataFrame, right: DataFrame, of: str, over: str, common: int) -> DataFrame:
    """(id1, id2) of the values id1 < id2 of `of` that may share `common` keys `over`: all that do, and few others.

    Two values that share so many keys share one besides the common - 1 most frequent keys of either, as all keys stand
    in one order. So pairs are made of the other, rarer keys only, and the most frequent keys, which make most pairs,
    make none unless a value has few others.
    """
    if common < 1:
        raise ValueError(f"common must be 1 or more: {common}")
    a, b = (rows.select(F.col(of).alias("id"), F.col(over).alias("k")).distinct() for rows in (left, right))
    often = a.unionByName(b).groupBy("k").agg(F.count(F.lit(1)).alias("f"))

    def rarer(rows: DataFrame, name: str) -> DataFrame:
        most = Window.partitionBy("id").orderBy(F.col("f").desc(), F.col("k").desc())
        top = rows.join(often, "k").withColumn("rank", F.row_number().over(most)).filter(F.col("rank") <= common - 1).select("id", "k")
        return rows.join(top, ["id", "k"], "left_anti").select("k", F.col("id").alias(name))

    return pairs_by_key(rarer(a, "id1"), rarer(b, "id2"), "id1", "id2").filter("id1 < id2").select("id1", "id2").distinct()


def close_pearson(left: DataFrame, right: DataFrame, of: str, over: str, least: float = 0.5, common: int = 5, places: int = 9) -> DataFrame:
    """close_pairs of pearson, correlations in so many places, with moments of the pairs alone that may share enough keys.

    The keys of an able pair are found by a join on its first value and one on (second value, key); nothing else is made.
    Each (value, key) is on one row of a side. Pairs are written as this is called.
    """
    able = written(able_pairs(left, right, of, over, common), "able")
    a = left.select(F.col(of).alias("id1"), F.col(over).alias("k"), F.col("rating").alias("x"))
    b = right.select(F.col(of).alias("id2"), F.col(over).alias("k"), F.col("rating").alias("y"))
    found = _correlated(able.join(a, "id1").join(b, ["id2", "k"]))
    return close_pairs(found.withColumn("corr", F.round("corr", places)), least, common)


def pearson(left: DataFrame, right: DataFrame, of: str, over: str) -> DataFrame:
    """(id1, id2, corr, n) of values id1 < id2 of `of` that share keys `over`; correlation 0 where a side is constant.

    Moments are summed in one pass over the shared keys.
    """
    a = left.select(F.col(over).alias("k"), F.col(of).alias("id1"), F.col("rating").alias("x"))
    b = right.select(F.col(over).alias("k"), F.col(of).alias("id2"), F.col("rating").alias("y"))
    return _correlated(pairs_by_key(a, b, "id1", "id2").filter("id1 < id2"))


def _correlated(shared: DataFrame) -> DataFrame:
    """(id1, id2, corr, n) of rows (id1, id2, x, y), one for each shared key."""
    x, y = F.col("x"), F.col("y")
    m = shared.groupBy("id1", "id2").agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * y).alias("sxy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"))
    n = F.col("n")
    cov = n * F.col("sxy") - F.col("sx") * F.col("sy")
    var = (n * F.col("sxx") - F.col("sx") * F.col("sx")) * (n * F.col("syy") - F.col("sy") * F.col("sy"))
    return m.select("id1", "id2", F.when(var > 0, F.try_divide(cov, F.sqrt(F.greatest(var, F.lit(0.0))))).otherwise(F.lit(0.0)).alias("corr"), "n")


def close_pairs(pairs: DataFrame, least: float = 0.5, common: int = 5) -> DataFrame:
    return pairs.filter((F.col("corr") > least) & (F.col("n") >= common))


def nearest_neighbours(pairs: DataFrame, k: int = 20) -> DataFrame:
    """(id, neighbour, corr, n, rank): the k best neighbours of either side of each pair, by (corr, n) falling."""
    both = pairs.select(F.col("id1").alias("id"), F.col("id2").alias("neighbour"), "corr", "n").unionByName(pairs.select(F.col("id2").alias("id"), F.col("id1").alias("neighbour"), "corr", "n"))
    best = Window.partitionBy("id").orderBy(F.col("corr").desc(), F.col("n").desc(), F.col("neighbour"))
    return both.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def neighbour_prediction(train: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Mean of the user plus the correlation-weighted residuals of the neighbours who rated the item."""
    means = train.groupBy("user").agg(F.avg("rating").alias("mean"))
    residuals = train.join(means, "user").select(F.col("user").alias("neighbour"), "item", (F.col("rating") - F.col("mean")).alias("r"))
    sums = neighbours.join(residuals, "neighbour").groupBy(F.col("id").alias("user"), "item").agg(F.sum(F.col("corr") * F.col("r")).alias("up"), F.sum(F.abs("corr")).alias("down"))
    return sums.join(means, "user").select("user", "item", (F.col("mean") + F.coalesce(F.try_divide("up", "down"), F.lit(0.0))).alias("prediction"))
