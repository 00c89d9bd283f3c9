"""Operators on DataFrame functions only: SQL on the smallest tables, and small cases of every kind."""

import hashlib

import pytest
from oracle import DATA, compare
from pyspark.sql import functions as F

from recbench.llm import chat, exact_dedup, line_dedup, mixing, queries

DOCS = "doc_id long, text string, lang string, source string"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    compare(queries.QUERIES[name](spark, DATA), queries.SQL[name])


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s) for i, t, s in rows], DOCS)


def test_exact_dedup(spark):
    rows = [(1, "a", "s"), (2, "a", "s"), (3, None, "s"), (4, "", "s"), (None, "b", "s"), (5, "b", "s"), (None, "c", "s"), (6, "A", "s"), (7, "x" * 300_000, "s"), (8, "x" * 300_000, "s")]
    got = {(r["doc_id"], r["text_sha256"]): (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(docs(spark, rows), keep="max").collect()}
    h = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1, h("a")] == (2, 2, False) and got[2, h("a")] == (2, 2, True)
    assert got[3, h("")] == (4, 2, False) and got[4, h("")] == (4, 2, True)
    assert got[None, h("b")] == (5, 2, False) and got[None, h("c")] == (None, 1, True)
    assert got[6, h("A")] == (6, 1, True) and got[7, h("x" * 300_000)] == (8, 2, False)
    assert {r["keep_id"] for r in exact_dedup.exact_dedup(docs(spark, rows[:2])).collect()} == {1}
    clash = docs(spark, rows).withColumn("kept", F.lit(1)).withColumn("_h", F.lit(1)).withColumn("group_size", F.lit("x"))
    assert exact_dedup.exact_dedup(clash).count() == len(rows)
    assert exact_dedup.exact_dedup(docs(spark, rows).limit(0)).count() == 0
    with pytest.raises(ValueError):
        exact_dedup.exact_dedup(docs(spark, rows), keep="some")


def test_line_dedup(spark, tables):
    block = "one\ntwo\nthree\nfour"
    rows = [(1, f"a\n{block}\nb", "s"), (2, f"c\n{block}\nd", "s"), (3, "one\ntwo", "s"), (4, None, "s"), (5, "x\nx\nx\nx\nx", "s"), (6, "\n\n\n\n\n", "s"), (7, f"{block}", "s"), (None, f"q\n{block}", "s")]
    out = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.line_dedup(docs(spark, rows), tables).collect()}
    assert out[1] == (f"a\n{block}\nb", 6, 0)
    assert out[2] == ("c\nd", 6, 4)
    assert out[3] == ("one\ntwo", 2, 0) and out[4] == ("", 1, 0)
    assert out[5] == ("x\nx\nx", 5, 2) and out[6] == ("\n\n\n\n\n", 6, 0)
    assert out[7] == ("", 4, 4) and out[None] == ("q", 5, 4)
    assert line_dedup.line_dedup(docs(spark, rows).limit(0), tables).count() == 0


def threads(spark, rows):
    return spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")


def test_reply_trees_are_ranked_by_score(spark, tables):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "good", 2.0), (1, 3, 1, "assistant", "bad", 1.0), (1, 4, 3, "user", "but", 0.5), (2, 1, 99, "user", "orphan", None), (3, 1, 2, "user", "x", 1.0), (3, 2, 1, "user", "y", 1.0)]
    out = {(r["tree"], r["path"]): r for r in chat.format_reply_trees(threads(spark, rows), tables, top=2).collect()}
    assert set(out) == {(1, 1), (1, 2), (2, 1)}  # the third tree is a cycle
    assert out[1, 1]["formatted"] == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\ngood<|im_end|>\n"
    assert out[1, 2]["n_turns"] == 3 and out[2, 1]["n_turns"] == 1


def test_a_deep_thread_and_what_it_reads_back(spark, tables):
    said = ["<|im_end|>", "<\\|x", "<\\\\|", "a\nb", "", None, "<|im_start|>assistant\nhi", "\\n", "é😀"]
    n = 70
    rows = [(None, i, i - 1 if i else None, ["user", "assistant", "tool\nx", None, "a\\nb"][i % 5], said[i % len(said)], 0.0) for i in range(n)]
    r = chat.format_reply_trees(threads(spark, rows), tables).withColumn("turns", chat.read_back(F.col("formatted"))).collect()
    assert len(r) == 1 and r[0]["n_turns"] == n and r[0]["tree"] is None
    assert [tuple(t) for t in r[0]["turns"]] == [(x[3] or "", x[4] or "") for x in rows]
    text = r[0]["formatted"]
    spans = [text[m["start"] : m["start"] + m["length"]] for m in r[0]["loss_mask"]]
    back = spark.createDataFrame([(i, s) for i, s in enumerate(spans)], "i int, s string").orderBy("i").select(chat.unescape(F.col("s"))).collect()
    assert [b[0] for b in back] == [x[4] or "" for x in rows if x[3] == "assistant"]
    assert chat.format_reply_trees(threads(spark, rows).limit(0), tables).count() == 0


def test_mix_meets_its_targets(spark, tables):
    rows = [(i, "w " * (1 + i % 7), ["a", "b", "c", None][i % 4]) for i in range(400)] + [(1000 + i, "big words here " * 5, "a") for i in range(300)] + [(2000, None, "b"), (2001, " \t", "c"), (None, "x y", "c"), (7, "w", "a")]
    out = mixing.mix(docs(spark, rows), tables).collect()
    assert len(out) == len(rows)
    total, by = sum(r["size"] for r in out), {}
    for r in out:
        assert r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        s = by.setdefault(r["source"], [0, 0, r["target"], r["source_size"]])
        s[0] += r["size"]
        s[1] += r["taken"]
    assert sum(s[2] for s in by.values()) == pytest.approx(total)
    for size, taken, target, told in by.values():
        assert size == told and target <= 3 * size + 1e-9 and abs(taken - target) <= 16
    again = mixing.mix(docs(spark, rows).repartition(7), tables).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["taken"])
    assert sorted(map(key, out)) == sorted(map(key, again))
    assert mixing.mix(docs(spark, rows).limit(0), tables).count() == 0
    assert [r["taken"] for r in mixing.mix(docs(spark, [(1, None, None)]), tables).collect()] == [0]
