"""Operator 9, mixing sources to target weights: weighted fair queueing over shuffled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import global_rank
from .common import WORD, Tables, text_of


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _running(df: DataFrame, keys: list[str], order: list[Column], value: str, name: str, tables: Tables) -> DataFrame:
    """df with the running sum of value in this order inside keys.

    Rows are sorted into ranges of (keys, order) and written; a row's sum is that of the earlier ranges plus its own in
    its range. So no task holds all rows of a key, and where the ranges begin makes no difference to any sum.
    """
    dealt = tables.write(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), name)
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each key and range
    sums = dealt.groupBy(*keys, "_range").agg(F.sum(value).alias("_sum")).select(*keys, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).cast("double").alias("_base"))
    within = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.join(sums, [*keys, "_range"]).withColumn(name, F.col("_base") + F.sum(value).over(within)).drop("_base", "_range")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], most: int, tables: Tables) -> DataFrame:
    """Rows (source_is, source, source_size) with weight and target added.

    Sources by code point, null last, take the weights in turn. All sizes together are shared by weight; a source
    stops at most times its size and what is over is shared among the rest, again and again until none is above.
    Each round is one sum over the sources; only its two numbers come to the driver.
    """
    ranked = global_rank(sizes, [F.col("source").asc_nulls_last()], "_nth")
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.col("_nth") - 1) % len(weights) + 1).cast("int"))).drop("_nth")
    ranked = tables.write(ranked.withColumn("_stop", most * F.col("source_size") / F.col("weight")), "sources")
    total, level = ranked.agg(F.sum("source_size")).first()[0] or 0, -1.0
    while True:
        full = F.col("_stop") <= F.lit(level)
        done, left = ranked.agg(F.sum(F.when(full, most * F.col("source_size")).otherwise(0)), F.sum(F.when(~full, F.col("weight")))).first()
        if left is None or level == (total - done) / left:
            break
        level = (total - done) / left
    return ranked.withColumn("target", F.when(full, (most * F.col("source_size")).cast("double")).otherwise(F.col("weight") * F.lit(level))).drop("_stop")


def mix(docs: DataFrame, tables: Tables, weights: tuple[float, ...] = (5, 2, 1), most: int = 3, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: _row, doc_id, size, source, source_size, target, text_hash (of Spark's xxhash64), taken.

    Every document enters its source's queue up to most times, in shuffled order (an MD5 of seed and id, ties by id
    and text). The virtual finish time of an entry is the running number of tokens of its source, divided by the
    source's weight. All entries in the order of finish times are taken until the total budget (the sum of all
    sizes) is used up; taken is size times the number of entries taken. A source whose entries run out is over at
    most times its size, so the others go on in proportion to their weights: these are the targets.

    Both orders are sorts into ranges over all rows (see _running), so neither a source with most rows nor an id that
    most rows share comes to one task. Null text: size 0, taken 0. Null source: a source of its own, the last. Rows
    alike in id, text and source are alike in size; each gets its own row and _row number. Empty table: no rows. Reruns
    agree: the order depends on the rows alone, never on partitions.
    """
    told = F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.unhex(F.md5(told)).alias("_h"), F.xxhash64(text_of(F.col(text_col))).alias("_t"))
    rows = rows.withColumn("source_is", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")))
    rows = tables.write(rows.withColumn("_row", F.monotonically_increasing_id()), "sized")
    sizes = source_targets(rows.groupBy("source_is", "source").agg(F.sum("size").cast("long").alias("source_size")), weights, most, tables).drop("source")
    queued = _running(rows, ["source_is"], [F.col("_h"), F.col("doc_id"), F.col("_t"), F.col("_row")], "size", "_cum", tables)
    queued = queued.join(sizes, "source_is").select("_row", "doc_id", "source", "size", "source_size", "weight", "target", "_h", "_t", "_cum")
    queued = tables.write(queued, "queued")
    finish = lambda e: F.struct(e.alias("epoch"), ((e * F.col("source_size") + F.col("_cum")) / F.col("weight")).alias("finish"))
    entries = queued.filter("size > 0").select("_row", "size", "_h", "_t", "doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), finish)).alias("_e")).select("*", "_e.*").drop("_e")
    order = [F.col("finish"), F.col("_h"), F.col("doc_id"), F.col("_t"), F.col("epoch"), F.col("_row")]
    budget = queued.agg(F.sum("size")).first()[0] or 0
    taken = _running(entries, [], order, "size", "_all", tables).filter(F.col("_all") <= F.lit(float(budget))).groupBy("_row").agg(F.count(F.lit(1)).alias("_times"))
    return queued.join(taken, "_row", "left").select("_row", "doc_id", "size", "source", "source_size", "target", F.col("_t").alias("text_hash"), (F.col("size") * F.coalesce("_times", F.lit(0))).cast("long").alias("taken"))
