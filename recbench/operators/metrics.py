"""Quality metrics over predictions (user, item, prediction) and interactions (user, item, rating).

Every metric is a frame of one row, so that a suite of them is one plan. Where nothing is left to average, the value is
null, and precision is 0. Ranks break ties by the smaller item.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import half_even, log2_floored, prob_by_rank
from ..functions.vectors import cosine, cosine_distance, norm, not_zero, total
from ..shared import global_rank, scratch


def _apart(rows: DataFrame) -> DataFrame:
    """rows, to be joined by a shuffle: files of vectors are far smaller than the rows, which would pass through the driver."""
    return rows.hint("merge")


def _matched(actual: DataFrame, predicted: DataFrame) -> DataFrame:
    return predicted.join(actual, ["user", "item"])


def rmse(actual: DataFrame, predicted: DataFrame) -> DataFrame:
    error = F.col("prediction") - F.col("rating")
    return _matched(actual, predicted).agg(F.sqrt(F.avg(error * error)).alias("rmse"))


def mae(actual: DataFrame, predicted: DataFrame) -> DataFrame:
    return _matched(actual, predicted).agg(F.avg(F.abs(F.col("prediction") - F.col("rating"))).alias("mae"))


def rmse_by_all(actual: DataFrame, predicted: DataFrame) -> DataFrame:
    """Squared errors of matched cells over the number of all actual ones."""
    error = F.col("prediction") - F.col("rating")
    return actual.join(predicted, ["user", "item"], "left").agg(F.sqrt(F.try_divide(F.sum(error * error), F.count(F.lit(1)))).alias("rmse"))


def rmse_of_arrays(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """For each row the error between two arrays of one length."""
    squares = F.zip_with(actual, predicted, lambda a, b: (a - b) * (a - b))
    return rows.withColumn("rmse", F.sqrt(F.try_divide(total(squares), F.size(actual))))


def label_scores(pairs: DataFrame) -> DataFrame:
    """(label, precision, recall, fscore, support) for each label of (actual, predicted)."""
    cells = pairs.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = cells.select(F.col("actual").alias("label"), hit.alias("tp"), F.col("n").alias("support"), F.lit(0).alias("told"))
    sides = sides.unionByName(cells.select(F.col("predicted").alias("label"), F.lit(0).alias("tp"), F.lit(0).alias("support"), F.col("n").alias("told")))
    sums = sides.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("told").alias("told"))
    zero = F.lit(0.0)
    precision, recall = F.coalesce(F.try_divide("tp", "told"), zero), F.coalesce(F.try_divide("tp", "support"), zero)
    scored = sums.select("label", precision.alias("precision"), recall.alias("recall"), F.col("support").cast("long").alias("support"))
    f = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), zero)
    return scored.select("label", "precision", "recall", f.alias("fscore"), "support")


def rounded_pairs(actual: DataFrame, predicted: DataFrame) -> DataFrame:
    """(actual, predicted) of matched cells as whole numbers, halves to even."""
    return _matched(actual, predicted).select(half_even(F.col("rating")).cast("int").alias("actual"), half_even(F.col("prediction")).cast("int").alias("predicted"))


def macro_scores(actual: DataFrame, predicted: DataFrame) -> DataFrame:
    """Unweighted means over labels of rounded ratings."""
    return label_scores(rounded_pairs(actual, predicted)).agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "fscore")])


def weighted_scores(pairs: DataFrame) -> DataFrame:
    """Accuracy, and means over labels weighted by support."""
    weighted = lambda c: F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(f"weighted_{c}")
    scores = label_scores(pairs).agg(*[weighted(c) for c in ("precision", "recall", "fscore")])
    return pairs.agg(F.avg((F.col("actual") == F.col("predicted")).cast("double")).alias("accuracy")).crossJoin(scores)


def ranked(predicted: DataFrame, by: str = "prediction") -> DataFrame:
    best = Window.partitionBy("user").orderBy(F.col(by).desc(), F.col("item"))
    return predicted.withColumn("rank", F.row_number().over(best))


def top_n(predicted: DataFrame, n: int) -> DataFrame:
    return ranked(predicted).filter(F.col("rank") <= n).drop("rank")


def precision_at(actual: DataFrame, predicted: DataFrame, n: int) -> DataFrame:
    """Hits among the first n of each user, over n times all users with actual ratings."""
    users = actual.agg(F.countDistinct("user").alias("users"))
    hits = _matched(actual, top_n(predicted, n)).agg(F.count(F.lit(1)).alias("hits"))
    return hits.crossJoin(users).select(F.coalesce(F.try_divide(F.col("hits").cast("double"), (F.col("users") * n).cast("double")), F.lit(0.0)).alias("pred_n"))


def category_diversity(predicted: DataFrame, content: DataFrame) -> DataFrame:
    """Mean vector sum of the predictions times the items' mean vector sum, over the number of components."""
    sums = content.select("item", total(F.col("vector")).alias("s"), F.size("vector").alias("components"))
    items = sums.agg(F.avg("s").alias("mean_s"))
    over = predicted.join(_apart(sums), "item").agg(F.avg("s").alias("p"), F.max("components").alias("components"))
    return over.crossJoin(items).select((F.col("p") * F.col("mean_s") / F.col("components")).alias("cat_diversity"))


def intra_list(predicted: DataFrame, content: DataFrame) -> DataFrame:
    """Mean over users of the mean cosine distance between the items of their list; 0 for a list of one item."""
    listed = predicted.join(_apart(content), "item").select("user", "item", "vector")
    other = listed.select("user", F.col("item").alias("other"), F.col("vector").alias("w"))
    pairs = listed.join(other, "user").filter("item < other").groupBy("user").agg(F.avg(cosine_distance(F.col("vector"), F.col("w"))).alias("d"))
    users = listed.select("user").distinct().join(pairs, "user", "left")
    return users.agg(F.avg(F.coalesce("d", F.lit(0.0))).alias("ils"))


def _distinct(rows: DataFrame, column: str, name: str) -> DataFrame:
    return rows.agg(F.countDistinct(column).alias(name))


def _percent(up: str, down) -> F.Column:
    return F.try_divide(100.0 * F.col(up), (F.col(down) if isinstance(down, str) else down).cast("double"))


def catalog_coverage(train: DataFrame, test: DataFrame, predicted: DataFrame) -> DataFrame:
    both = train.select("user", "item").unionByName(test.select("user", "item"))
    cells = both.agg(F.countDistinct("user").alias("users"), F.countDistinct("item").alias("items"))
    return predicted.agg(F.count(F.lit(1)).alias("n")).crossJoin(cells).select(_percent("n", F.col("users") * F.col("items")).alias("cat_coverage"))


def item_coverage(train: DataFrame, test: DataFrame, content: DataFrame, predicted: DataFrame) -> DataFrame:
    known = train.select("item").unionByName(test.select("item")).unionByName(content.select("item"))
    return _distinct(predicted, "item", "n").crossJoin(_distinct(known, "item", "all")).select(_percent("n", "all").alias("item_coverage"))


def user_coverage(train: DataFrame, test: DataFrame, predicted: DataFrame) -> DataFrame:
    known = train.select("user").unionByName(test.select("user"))
    return _distinct(predicted, "user", "n").crossJoin(_distinct(known, "user", "all")).select(_percent("n", "all").alias("user_coverage"))


def prediction_coverage(test: DataFrame, predicted: DataFrame) -> DataFrame:
    hits = _matched(test, predicted).agg(F.count(F.lit(1)).alias("n"))
    return hits.crossJoin(test.agg(F.count(F.lit(1)).alias("all"))).select(_percent("n", "all").alias("pred_coverage"))


def item_popularity(train: DataFrame, test: DataFrame) -> DataFrame:
    """(item, popularity): 1 for the item of the best mean rating, 0 for the last."""
    means = train.select("item", "rating").unionByName(test.select("item", "rating")).groupBy("item").agg(F.avg("rating").alias("mean"))
    places = global_rank(means, [F.col("mean").desc(), F.col("item")], "place")
    n = places.agg(F.count(F.lit(1)).alias("n"))
    return places.crossJoin(F.broadcast(n)).select("item", prob_by_rank(F.col("place"), F.col("n")).alias("popularity"))


def _both_means(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Mean over rows, and mean over users of their means."""
    users = rows.groupBy("user").agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    return users.agg(F.try_divide(F.sum("s"), F.sum("n")).alias(f"overall_{name}"), F.avg(F.try_divide("s", "n")).alias(name))


def serendipity(train: DataFrame, test: DataFrame, predicted: DataFrame, least: float = 1.0, compat: bool = True, popularity: DataFrame | None = None) -> DataFrame:
    """How much higher relevant hits rank for the user than for all: (overall_serendipity, serendipity).

    compat: hits are ranked by their actual rating, as first published with this data; otherwise by their prediction.
    """
    hits = _matched(test.filter(F.col("rating") >= least), predicted)
    hits = ranked(hits, "rating" if compat else "prediction").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("user")))
    own = prob_by_rank(F.col("rank"), F.col("n"))
    rows = hits.join(item_popularity(train, test) if popularity is None else popularity, "item").select("user", F.greatest(own - F.col("popularity"), F.lit(0.0)).alias("v"))
    return _both_means(rows, "v", "serendipity")


def novelty(train: DataFrame, test: DataFrame, predicted: DataFrame, popularity: DataFrame | None = None) -> DataFrame:
    """Mean log2 of popularity, never above 0: (overall_novelty, novelty)."""
    rows = predicted.join(item_popularity(train, test) if popularity is None else popularity, "item").select("user", log2_floored(F.col("popularity")).alias("v"))
    return _both_means(rows, "v", "novelty")


def content_serendipity(actual: DataFrame, predicted: DataFrame, content: DataFrame) -> DataFrame:
    """Least cosine distance of each predicted item to the user's actual ones: overall mean, mean over users.

    Each user's items meet with their vectors, and only the least distances leave a task.
    """
    vectors = _apart(content.select("item", "vector", norm(F.col("vector")).alias("norm")))
    own = actual.select("user", "item").join(vectors, "item").select("user", F.col("vector").alias("w"), F.col("norm").alias("w_norm"))
    listed = predicted.select("user", "item").join(vectors, "item")
    distance = 1.0 - cosine(F.col("vector"), F.col("w"), F.col("norm"), F.col("w_norm"))
    rows = _apart(own).join(listed, "user").groupBy("user", "item").agg(F.min(distance).alias("v"))
    return _both_means(rows, "v", "content_serendipity")


def relevant_ranks(actual: DataFrame, predicted: DataFrame) -> DataFrame:
    """Means over users of the least, mean and greatest rank of their hits."""
    hits = ranked(predicted).join(actual.select("user", "item"), ["user", "item"])
    users = hits.groupBy("user").agg(F.min("rank").alias("a"), F.avg("rank").alias("b"), F.max("rank").alias("c"))
    return users.agg(F.avg("a").alias("avg_highest_rank"), F.avg("b").alias("avg_mean_rank"), F.avg("c").alias("avg_lowest_rank"))


def suite(train: DataFrame, test: DataFrame, predicted: DataFrame, content: DataFrame, n: int, popularity: DataFrame | None = None) -> DataFrame:
    """All metrics in one row, on the first n predictions of each user and content without zero vectors.

    What several metrics read is written once: the lists, both parts of the interactions, and the items' popularity, unless
    that is given, as where many suites share it; the interactions are then tables already. Errors, hits and ranks are one
    aggregate over the lists' hits.
    """
    spark = predicted.sparkSession

    def written(rows: DataFrame, name: str) -> DataFrame:
        path = scratch(spark, name)
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    content = content.filter(not_zero(F.col("vector")))
    train, test = train.select("user", "item", "rating"), test.select("user", "item", "rating")
    if popularity is None:
        train, test = written(train, "train"), written(test, "test")
        popularity = written(item_popularity(train, test), "popularity")
    lists = written(ranked(predicted.select("user", "item", "prediction")).filter(F.col("rank") <= n), "lists")
    cut = lists.drop("rank")
    error = F.col("prediction") - F.col("rating")
    hits = _matched(test, lists).groupBy("user").agg(F.sum(error * error).alias("squares"), F.sum(F.abs(error)).alias("errors"), F.count(F.lit(1)).alias("n"), F.min("rank").alias("a"), F.avg("rank").alias("b"), F.max("rank").alias("c"))
    hits = hits.agg(F.sqrt(F.try_divide(F.sum("squares"), F.sum("n"))).alias("rmse"), F.try_divide(F.sum("errors"), F.sum("n")).alias("mae"), F.coalesce(F.sum("n"), F.lit(0)).alias("hits"), F.avg("a").alias("avg_highest_rank"), F.avg("b").alias("avg_mean_rank"), F.avg("c").alias("avg_lowest_rank"))
    held = test.agg(F.countDistinct("user").alias("users"), F.count(F.lit(1)).alias("all"))
    precision = F.coalesce(F.try_divide(F.col("hits").cast("double"), (F.col("users") * n).cast("double")), F.lit(0.0)).alias("pred_n")
    hits = hits.crossJoin(held).select("rmse", "mae", precision, _percent("hits", "all").alias("pred_coverage"), "avg_highest_rank", "avg_mean_rank", "avg_lowest_rank")
    parts = [
        category_diversity(cut, content), intra_list(cut, content), catalog_coverage(train, test, cut), item_coverage(train, test, content, cut), user_coverage(train, test, cut),
        serendipity(train, test, cut, popularity=popularity).select("serendipity"), content_serendipity(test, cut, content).select("content_serendipity"), novelty(train, test, cut, popularity).select("novelty"),
    ]
    out = reduce(DataFrame.crossJoin, [hits, *parts])  # rows of one each
    first, last = ["rmse", "mae", "pred_n", "cat_diversity", "ils", "cat_coverage", "item_coverage", "user_coverage", "pred_coverage"], ["avg_highest_rank", "avg_mean_rank", "avg_lowest_rank"]
    return out.select(*first, "serendipity", "content_serendipity", "novelty", *last)
