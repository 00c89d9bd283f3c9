"""The pipeline's stages keep the columns of documents and act on what the operators say."""

import collections

from oracle import DATA
from test_free import brute_components

import corpus_pipeline
from recbench.llm.common import Tables


def test_stages(spark):
    docs, tables = spark.read.parquet(f"{DATA}/documents.parquet"), Tables(spark)
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, tables.write(stage(spark, docs, DATA), name)
        seen[name] = (before.collect(), docs.collect())
        assert name == "packing" or docs.columns == columns
    before, after = seen["exact_dedup"]
    largest = {}
    for r in before:
        largest[r["text"]] = max(largest.get(r["text"], -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in after) == sorted(largest.values())
    before, after = seen["near_dedup"]
    assert sorted(r["doc_id"] for r in after) == sorted(i for i, _, c in brute_components([(r["doc_id"], r["text"]) for r in before], corpus_pipeline.NEAR) if i == c)
    before, after = seen["mixing"]
    assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
    times = collections.Counter(r["doc_id"] for r in after)
    assert max(times.values()) <= 3
    size = lambda rows: sum(len(r["text"].split()) for r in rows)
    assert abs(size(after) - size(before)) <= max(len(r["text"].split()) for r in before)
    _, packed = seen["packing"]
    whole = {r["doc_id"]: r["doc_tokens"] for r in packed}
    assert sum(r["length"] for r in packed) == sum(whole[i] * n for i, n in times.items())


def test_rejected_documents_go(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(10**9, None, None, None, 0), (10**9 + 1, "123 !!", "en", "s", 6)], docs.schema)
    kept = corpus_pipeline.identified(spark, docs.unionByName(odd), DATA)
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
