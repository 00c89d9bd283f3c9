"""Operator 8, exact deduplication: 128-bit content hash, then the bytes themselves as grouping key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are grouped by (128-bit hash, bytes): the hash leads the key, and the aggregation's own key comparison
    looks at the bytes, so two texts that collide in the hash stay apart. Partial aggregation leaves one row for
    each task and text before the shuffle, however large a group of copies is. The second pass carries no text:
    each row finds its group by the hash and the SHA-256 of its text.

    keep names the end of the id range that stays: "min" or "max". Null texts equal empty ones. A null id never
    stays while another row of the group has an id; where all ids of a group are null, keep_id is null and all its
    rows are kept. Rows that repeat the id that stays are all kept. An empty table gives no rows; other columns of
    the input are ignored, whatever their names.
    """
    if keep not in ("min", "max"):
        raise ValueError(f"keep: {keep!r}")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(F.col(text_col)).alias("_t")).withColumn("_h", F.unhex(F.md5("_t")))
    groups = (
        rows.groupBy("_h", "_t")
        .agg(F.count(F.lit(1)).alias("group_size"), (F.min if keep == "min" else F.max)("doc_id").alias("keep_id"))
        .select("_h", F.sha2("_t", 256).alias("text_sha256"), "group_size", "keep_id")
    )
    slim = rows.select("doc_id", "_h", F.sha2("_t", 256).alias("text_sha256"))
    return slim.join(groups, ["_h", "text_sha256"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
