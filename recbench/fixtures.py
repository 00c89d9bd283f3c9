"""Inputs of the engine made from the driver's tables, whole; used by the registered queries, the bench and the tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.vectors import one_hot
from .operators import blocks
from .shared import written

#: Part types and brands, the vocabulary of the genre vectors.
TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
BRANDS = [f"Brand#{i}" for i in range(1, 26)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def purchases(spark: SparkSession, sf_dir: str, user: str = "customer", item: str = "part") -> DataFrame:
    """(user, item, l_quantity) of all line items; users: customers, or markets (nation and segment)."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey" if item == "part" else "l_suppkey").alias("item"), "l_quantity")
    rows = lines.join(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user")), F.col("l_orderkey") == F.col("o_orderkey"))
    if user == "market":
        market = (F.col("c_nationkey").cast("long") * 26 + F.ascii("c_mktsegment") - 65).alias("market")
        rows = rows.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user"), market), "user").select(F.col("market").alias("user"), "item", "l_quantity")
    return rows.select("user", "item", "l_quantity")


def ratings(spark: SparkSession, sf_dir: str, user: str = "customer", item: str = "part") -> DataFrame:
    """One rating from 1 to 5 for each user and item: the largest quantity, in steps of ten."""
    rated = F.least(F.lit(5.0), 1 + F.floor((F.col("l_quantity") - 1) / 10).cast("double"))
    return purchases(spark, sf_dir, user, item).groupBy("user", "item").agg(F.max(rated).alias("rating"))


def counts(spark: SparkSession, sf_dir: str, user: str = "customer", item: str = "part") -> DataFrame:
    return purchases(spark, sf_dir, user, item).groupBy("user", "item").agg(F.count(F.lit(1)).cast("double").alias("rating"))


def is_test() -> Column:
    """The held-out tenth, fixed by the keys, so that reruns and other engines agree."""
    return (F.col("user") * 31 + F.col("item") * 17) % 10 == 0


def split(interactions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(train, test)"""
    return interactions.filter(~is_test()), interactions.filter(is_test())


def genre_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("item"), F.concat(one_hot(F.col("p_type"), TYPES), one_hot(F.col("p_brand"), BRANDS)).alias("vector"))


def dense_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").cast("array<double>").alias("vector"))


def mean_predictions(train: DataFrame, n: int | None = None) -> DataFrame:
    """A cheap predictor for all cells: halfway between the user's and the item's mean. n: only the first n items of each
    user, from products of blocks; the interactions are then written as this is called."""
    train = train if n is None else written(train.select("user", "item", "rating"), "train")
    users = train.groupBy("user").agg(F.avg("rating").alias("mu"))
    items = train.groupBy("item").agg(F.avg("rating").alias("mi"))
    if n is not None:
        of = blocks.pairs(blocks.blocks(users.withColumn("mu", F.array("mu")), "user", "mu", "user"), blocks.blocks(items.withColumn("mi", F.array("mi")), "item", "mi", "item"))
        return blocks.cells(of, lambda u, v: (u + v.T) / 2, n)
    return users.crossJoin(items).select("user", "item", ((F.col("mu") + F.col("mi")) / 2).alias("prediction"))


def ratings_sql(user: str = "customer", item: str = "part") -> str:
    """CTEs ratings, counts, train and test."""
    market = "c_nationkey::bigint * 26 + ascii(c_mktsegment) - 65"
    who = market if user == "market" else "o_custkey"
    what = "l_partkey" if item == "part" else "l_suppkey"
    more = "join customer on o_custkey = c_custkey" if user == "market" else ""
    return f"""
bought as (select {who} as "user", {what} as item, l_quantity from lineitem join orders on l_orderkey = o_orderkey {more}),
ratings as (select "user", item, max(least(5.0, 1 + floor((l_quantity - 1) / 10)))::double as rating from bought group by 1, 2),
counts as (select "user", item, count(*)::double as rating from bought group by 1, 2),
train as (select * from ratings where ("user" * 31 + item * 17) % 10 <> 0),
test as (select * from ratings where ("user" * 31 + item * 17) % 10 = 0)"""


GENRE_SQL = f"""
content as (
    select p_partkey as item,
           list_concat(list_transform({TYPES!r}, lambda x: (p_type = x)::double),
                       list_transform({BRANDS!r}, lambda x: (p_brand = x)::double)) as vector
    from part)"""
DENSE_SQL = "content as (select vec_id as item, embedding::double[] as vector from embeddings)"
MEANS_SQL = """
predicted as (
    select "user", item, (mu + mi) / 2 as prediction
    from (select "user", avg(rating) as mu from train group by 1), (select item, avg(rating) as mi from train group by 1))"""
