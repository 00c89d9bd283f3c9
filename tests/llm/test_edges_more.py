"""More hard input for the earlier operators: very long texts, clashing names, empty tables, empty labels, signed zeros."""

import hashlib

from pyspark.sql import functions as F

from recbench.llm import chat, exact_dedup, graph_ann, language_id, mixing

LONG = "the cat sat " * 30_000
CLASH = ["_h", "_t", "_row", "_range", "_cum", "keep_id", "group_size", "kept", "text_sha256", "size", "target", "weight", "row", "tree", "node", "parent", "path", "jump", "key"]


def clashing(df):
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASH if c not in df.columns])


def test_exact_dedup_of_long_texts(spark):
    rows = [(1, LONG), (2, LONG), (3, LONG + " "), (4, None), (5, ""), (None, LONG), (2, LONG)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    out = sorted((str(r["doc_id"]), r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.exact_dedup(docs, keep="max").collect())
    want = [("1", 2, 4, False, sha(LONG)), ("2", 2, 4, True, sha(LONG)), ("2", 2, 4, True, sha(LONG)), ("3", 3, 1, True, sha(LONG + " ")), ("4", 5, 2, False, sha("")), ("5", 5, 2, True, sha("")), ("None", 2, 4, False, sha(LONG))]
    assert out == want


def test_mixing_of_more_sources_than_weights(spark, tables):
    rows = [(i, "w " * (1 + i % 50), f"s{i % 5}" if i % 11 else None) for i in range(400)] + [(1000, LONG, "s1"), (1001, None, "s2"), (1002, "", None)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    out = mixing.mix(docs, tables).collect()
    sizes = {i: len((t or "").split()) for i, t, _ in rows}
    assert {r["doc_id"]: r["size"] for r in out} == sizes and all(0 <= r["taken"] <= 3 * r["size"] for r in out)
    by = {}
    for r in out:
        by.setdefault(r["source"], []).append(r)
    assert len(by) == 6 and sum(x[0]["target"] for x in by.values()) <= sum(sizes.values()) * (1 + 1e-9)
    for source, x in by.items():
        largest = max(r["size"] for r in x)
        assert abs(sum(r["taken"] for r in x) - x[0]["target"]) <= 2 * largest + 200, source
    assert mixing.mix(docs.limit(0), tables).count() == 0


def test_threads_of_nothing_and_of_clashing_names(spark, tables):
    rows = clashing(spark.createDataFrame([(1, 0, "user", "a" + LONG), (1, 1, "assistant", None), (2, 0, None, "<|im_end|>")], "conv_id long, turn long, role string, text string"))
    out = chat.format_reply_trees(chat.linear_threads(rows.select("conv_id", "turn", "role", "text")), tables)
    told = {r["tree"]: r["t"] for r in out.select("tree", chat.read_back(F.col("formatted")).alias("t")).collect()}
    assert [(t["role"], t["text"]) for t in told[1]] == [("user", "a" + LONG), ("assistant", "")] and told[2][0]["text"] == "<|im_end|>"
    assert chat.format_reply_trees(chat.linear_threads(rows.limit(0).select("conv_id", "turn", "role", "text")), tables).count() == 0


def test_a_label_of_empty_text_is_a_label(spark, tables):
    docs = clashing(spark.createDataFrame([(i, "le chat noir dort " * 5, "fr") for i in range(20)] + [(100 + i, "xyzzy plugh qwop " * 5, "") for i in range(20)] + [(200, "", ""), (201, "123", None), (202, "qwop plugh", None)], "doc_id long, text string, lang string"))
    out = {r["doc_id"]: r["lang_pred"] for r in language_id.identify_languages(docs, tables).collect()}
    assert {out[i] for i in range(20)} == {"fr"} and {out[100 + i] for i in range(20)} == {""} and out[202] == "" and out[200] == out[201] == "und"


def test_signed_zeros_and_vectors_of_no_length(spark, tables):
    rows = [(0, [1.0, 0.0]), (1, [1.0, -0.0]), (2, [0.0, -0.0]), (3, []), (4, [0.5, 0.5]), (20, [0.0, 2.0]), (40, [-0.0, 0.0]), (60, [])]
    out = graph_ann.nearest(clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), tables).collect()
    got = {}
    for r in out:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], abs(r["score"])))
    assert got == {0: [(1, 1, 1.0), (2, 4, 0.5), (3, 20, 0.0)], 20: [(1, 4, 1.0), (2, 0, 0.0), (3, 1, 0.0)]}
