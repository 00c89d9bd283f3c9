"""A training corpus from documents in five stages; each calls one operator of recbench.llm and acts on what it says.

Every stage is written as Parquet and read again by the next. All but the last return the columns of documents, and
any further columns of the input, whatever their names. Documents that share an id but not their text stay or go
together in the near-duplicate stage; elsewhere each counts for itself. Null texts count as empty and are rejected by
the first stage, as are texts without a letter. Null ids are ids like others, the least of all where one of several
documents stays by its id. A stage that keeps nothing, or an empty table, gives the next ones nothing to do; the result is
then empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recbench.llm.common import Tables, dropped_after, text_of
from recbench.llm.exact_dedup import exact_dedup
from recbench.llm.language_id import identify_languages
from recbench.llm.mixing import mix
from recbench.llm.near_dedup import near_dedup
from recbench.llm.packing import pack

#: Least share of the likeliest language; below it, or without a letter, a document is rejected.
LEAST_SHARE = 0.5
#: Similarity of near-duplicates in percent.
NEAR = 80


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model tells apart from the others."""
    said = identify_languages(docs, Tables(spark), carry=True)
    return said.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).select("row.*")


def _rows(docs: DataFrame, **keys: Column) -> DataFrame:
    """Whole rows beside keys of their own, so that no name of the input can clash with them."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[key.alias(name) for name, key in keys.items()])


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text: the largest id."""
    kept = exact_dedup(docs, keep="max").filter("kept").select(F.col("doc_id").alias("kept_id"), "text_sha256").distinct()
    rows = _rows(docs, id=F.col("doc_id"), sha256=F.sha2(text_of(F.col("text")), 256))
    rows = rows.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("sha256") == F.col("text_sha256")), "left_semi")
    return rows.dropDuplicates(["id", "sha256"]).select("row.*")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: of five-word shingle sets with a similarity of 0.8 or more."""
    kept = near_dedup(docs, Tables(spark), percent=NEAR).filter("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return _rows(docs, id=F.col("doc_id")).join(kept, F.col("id").eqNullSafe(F.col("kept_id")), "left_semi").select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes."""
    taken = mix(docs, Tables(spark)).filter("taken > 0").select(F.col("doc_id").alias("taken_id"), F.col("text_hash").alias("taken_hash"), (F.col("taken") / F.col("size")).cast("int").alias("times"))
    taken = taken.groupBy("taken_id", "taken_hash").agg(F.sum("times").cast("int").alias("times"), F.count(F.lit(1)).alias("alike"))
    rows = _rows(docs, id=F.col("doc_id"), hash=F.xxhash64(text_of(F.col("text"))))
    rows = rows.join(taken, F.col("id").eqNullSafe(F.col("taken_id")) & (F.col("hash") == F.col("taken_hash")))
    # Rows alike in id and text share their copies, rounded up, so these may come to a little more than the mix takes.
    nth = F.expr("sequence(1, greatest(1, int(ceil(times / alike))))")
    return rows.withColumn("nth", F.explode(nth)).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1,024 tokens."""
    out = pack(docs, Tables(spark))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", identified), ("exact_dedup", without_copies), ("near_dedup", without_near_copies), ("mixing", mixed), ("packing", packed)]
#: SQL can't express the language models, MinHash tables and tokenizers; tests hold run() against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tables = spark.read.parquet(f"{sf_dir}/documents.parquet"), Tables(spark)
    for name, stage in STAGES:
        with dropped_after():
            docs = tables.write(stage(spark, docs, sf_dir), name)
    return docs
