"""Operator 6, line deduplication: overlapping windows of three lines, repeated windows found over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, text_of


def line_dedup(docs: DataFrame, tables: Tables, window: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, text (without the lines removed), n_lines, n_removed, removed_lines.

    Every run of `window` consecutive lines is hashed (128 bits). The first occurrence of a window, in the order
    (doc_id, text, line), stays; each later one covers its lines, and the union of the covered lines of a document is
    removed. An occurrence that overlaps the first one in the same document covers only lines after it. Windows of
    blank lines alone don't count. Window rows carry a hash, a document key and a position, never text; the first
    occurrence is a partial aggregate, so a passage that every document holds costs one row per task, and the join
    back to its occurrences is an ordinary sort-merge join, which adaptive execution splits when skewed.

    Null text: empty, n_lines 1. A text of fewer lines than the window is never changed; a text whose lines are all
    covered becomes empty. A null id sorts last and keeps its row. Rows that repeat both id and text are one
    document and all get its result. Empty table: no rows. Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(F.col(text_col)).alias("_t"))
    rows = rows.withColumn("_k", F.unhex(F.md5(F.concat(F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("null")), F.lit("\n"), "_t"))))
    rows = rows.withColumn("_l", F.split("_t", "\n", -1))
    size = F.size("_l")

    def hashed(i):
        lines = F.slice("_l", i, window)
        filled = F.exists(lines, lambda x: F.trim(x) != "")
        return F.when(filled, F.struct(F.xxhash64(F.lit(0), lines).alias("a"), F.xxhash64(F.lit(7919), lines, F.lit(1)).alias("b")))

    windows = rows.filter(size >= window).select("doc_id", "_k", F.posexplode(F.transform(F.sequence(F.lit(1), size - (window - 1)), hashed)).alias("_p", "_w"))
    windows = tables.write(windows.filter("_w is not null").select("doc_id", "_k", "_p", "_w.*").distinct(), "windows")
    first = windows.groupBy("a", "b").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_k").alias("k"), F.col("_p").alias("p"))).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    later = windows.join(first, ["a", "b"]).filter(~((F.col("_first.k") == F.col("_k")) & (F.col("_first.p") == F.col("_p"))))
    start = F.when(F.col("_first.k") == F.col("_k"), F.greatest(F.col("_p"), F.col("_first.p") + window)).otherwise(F.col("_p"))
    covered = later.select("_k", F.explode(F.sequence(start, F.col("_p") + (window - 1))).alias("_at")).filter(F.col("_at") >= start).groupBy("_k").agg(F.array_sort(F.collect_set("_at")).alias("removed_lines"))
    merged = rows.select("doc_id", "_k", "_t").join(covered, "_k", "left")
    lines = F.split("_t", "\n", -1)
    gone = F.coalesce("removed_lines", F.array().cast("array<int>"))
    # Membership by a map of the covered lines: linear in the lines of a text.
    held = F.map_from_arrays(gone, F.transform(gone, lambda x: F.lit(True)))
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.map_contains_key(held, i)), "\n")
    return merged.select("doc_id", F.when(F.size(gone) == 0, F.col("_t")).otherwise(kept).alias("text"), F.size(lines).cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_removed"), gone.alias("removed_lines"))
