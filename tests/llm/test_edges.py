"""Hard input: words made to collide, blocks and shards of larger groups, clashing names, empty tables, huge values."""

import collections
import random

import numpy as np
import pytest
from oracle import DATA
from pyspark.sql import functions as F
from test_free import brute_components

import corpus_pipeline
from recbench.llm import chat, graph_ann, language_id, line_dedup, mixing, near_dedup, packing, suffix_tree_lm, textkernel, token_counts

#: Columns of no meaning, named as operators name their own.
CLASH = ["row", "ids", "part", "window", "start", "fa", "fb", "cid", "key", "rare", "carried0", "best", "top", "total", "letters", "_h", "_t", "_k", "_row", "_range", "_id", "_sha256", "_hash", "_times", "_nth", "id", "hash", "nth", "rep", "size", "n"]
ROWS = [(1, "one two three four five six"), (2, None), (3, ""), (None, "one two three four five six"), (4, "word " * 40_000), (4, "word " * 40_000), (5, "x" * 300_000)]


def thue_morse(a: str, b: str) -> str:
    return "".join(b if bin(i).count("1") % 2 else a for i in range(2048))


def clashing(spark, rows=ROWS):
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASH])


def test_words_in_a_self_similar_order_stay_apart(spark, tables):
    import pyarrow as pa
    from tokenizers import Tokenizer

    pair = [thue_morse("a", "b"), thue_morse("b", "a")]
    (w,) = textkernel.words(pa.array([" ".join(pair)]))
    assert len(set(w.hashes.tolist())) == len(set(w.checks().tolist())) == 2
    whole = Tokenizer.from_file(packing.default_tokenizer())
    encoder = packing.Encoder(packing.default_tokenizer())
    got = [x.tolist() for part in encoder.columns(pa.array([f"so {p}" for p in pair])) for x in part]
    assert got == [whole.encode(f"so {p}", add_special_tokens=False).ids for p in pair] and got[0] != got[1]
    made = spark.createDataFrame([(i, p) for i, p in enumerate(pair)], "doc_id long, text string")
    assert {r["component_id"] for r in near_dedup.near_dedup(made, tables).collect()} == {0, 1}


def test_a_known_word_is_told_from_another_of_the_same_hash(monkeypatch):
    """All words have one hash here, and only the second tells them apart."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    from recbench.llm.wordtable import WordTable

    hashes = textkernel.word_hashes
    monkeypatch.setattr(textkernel, "word_hashes", lambda data, start, end, seed=1: hashes(data, start, end, seed) if seed == 2 else np.full(len(start), 5, np.uint64))
    rows = ["a bb ccc", "dddd a a", "bb"]
    table = WordTable(lambda words: np.array([[len(w)] for w in words], float).reshape(len(words), 1))
    for _ in range(2):
        assert table.sums(pa.array(rows)).tolist() == [[3, 6], [3, 6], [1, 2]]
    (w,) = textkernel.words(pa.array(rows))
    assert collections.Counter(dict(table.counts(w, np.ones(3, bool)))) == {b"a": 3, b"bb": 2, b"ccc": 1, b"dddd": 1}
    whole = Tokenizer.from_file(packing.default_tokenizer())
    assert [x.tolist() for part in packing.Encoder(packing.default_tokenizer()).columns(pa.array(rows)) for x in part] == [whole.encode(t, add_special_tokens=False).ids for t in rows]


def template(n: int, seed: int = 11) -> list[tuple[int, str]]:
    """Texts alike at about 0.71, below the threshold; a few are linked."""
    rng = random.Random(seed)
    base, rows = [f"w{rng.randrange(10_000)}" for _ in range(300)], []
    for i in range(n):
        words = list(base)
        for at in rng.sample(range(300), 5):
            words[at] = f"v{rng.randrange(10**6)}"
        if i % 50 == 49:
            words = rows[-1][1].split()
            words[rng.randrange(300)] = "changed"
        rows.append((i, " ".join(words)))
    return rows


def test_near_dedup_over_several_blocks_equals_brute_force(spark, tables, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rows = template(220)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), tables).collect()}
    want = {i: c for i, _, c in brute_components(rows)}
    assert got == want and len(set(want.values())) < len(rows)


@pytest.mark.parametrize("one", [0, 3000])
def test_blocks_are_bounded_and_every_pair_meets_once(spark, monkeypatch, one):
    """One bucket of small components, beside a large one or not."""
    monkeypatch.setattr(near_dedup, "BLOCK", 1024)
    rows = [(7, 5000, i, -1 if i < one else i // 2, 300) for i in range(one + 2000)]
    dealt = near_dedup.deal(spark.createDataFrame(rows, "key long, n long, cid long, component long, size long")).collect()
    units = collections.defaultdict(lambda: ([], [], []))
    for r in dealt:
        units[r["unit"]][r["role"]].append((r["cid"], r["component"]))
    assert max(sum(map(len, u)) for u in units.values()) <= 2 * near_dedup.BLOCK
    assert len(dealt) <= len(rows) * 2 * 2000 / near_dedup.BLOCK * 2
    met = collections.Counter()
    for left, right, own in units.values():
        assert not own or not (left or right)
        for a in left:
            met.update((min(a, b), max(a, b)) for b in right if a[1] != b[1] and 0 in (a[0] % 97, b[0] % 97))
        for i, a in enumerate(own):
            met.update((min(a, b), max(a, b)) for b in own[:i] if a[1] != b[1] and 0 in (a[0] % 97, b[0] % 97))
    members = [(i, -1 if i < one else i // 2) for i in range(one + 2000)]
    want = sum(1 for i, a in enumerate(members) for b in members[:i] if a[1] != b[1] and 0 in (a[0] % 97, b[0] % 97))
    assert len(met) == want and set(met.values()) == {1}


def test_members_of_a_template_corpus_grow_in_proportion(spark, tables, monkeypatch):
    monkeypatch.setattr(tables, "drop", lambda *names: None)
    sizes = {}
    for n in (750, 1500, 3000):
        near_dedup.near_dedup(spark.createDataFrame(template(n), "doc_id long, text string"), tables)
        dealt = spark.read.parquet(f"{tables.root}/dealt")
        sizes[n] = dealt.count()
        assert dealt.groupBy("key", "unit").count().agg(F.max("count")).first()[0] <= 2 * near_dedup.BLOCK
    assert sizes[3000] <= 2.3 * sizes[1500] <= 5.3 * sizes[750]


def test_nearest_over_several_shards(spark, tables):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100_000 + 20 * i, [1e100 * (i + 1), 1e-100]) for i in range(4)] + [(200_020, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cid", F.lit("clash")).withColumn("shard", F.lit(1))
    got = collections.defaultdict(list)
    for r in graph_ann.nearest(df, tables, shard=800, block=60).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hit = 0
    for q in range(0, 3000, 20):
        scores = (x * x[q]).sum(axis=1)
        assert all(s == pytest.approx(scores[i], rel=1e-12) for i, s in got[q])
        hit += len({i for i, _ in got[q]} & set([i for i in np.argsort(-scores) if i != q][:20]))
    assert hit >= 0.95 * 20 * 150
    assert [i for i, _ in got[100_000]] == [100_060, 100_040, 100_020]  # another dimension, beyond what a float holds
    assert 200_020 not in got and len(got) == 150 + 4


def test_labels_in_several_passes(spark, tables, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    told = lambda: {r["doc_id"]: (r["lang_pred"], round(r["score"], 9)) for r in language_id.identify_languages(docs, tables).collect()}
    want = told()
    monkeypatch.setattr(language_id, "LABELS", 1)
    assert told() == want and len({x for x, _ in want.values()}) > 2


def test_mix_with_one_id_on_all_rows(spark, tables):
    rows = [(None if i % 2 else 7, "w " * (1 + i % 5), "ab"[i % 3 == 0]) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", *[F.lit("clash").alias(c) for c in CLASH])
    out = mixing.mix(df, tables).collect()
    assert len(out) == 900
    for source in "ab":
        mine = [r for r in out if r["source"] == source]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 5 and all(r["taken"] <= 3 * r["size"] for r in mine)
    assert [r["taken"] for r in mixing.mix(spark.createDataFrame([(1, " ", "a"), (2, None, None)], "doc_id long, text string, source string"), tables).collect()] == [0, 0]
    assert mixing.mix(df.limit(0), tables).count() == 0


def test_roles_of_any_characters_are_read_back(spark, tables):
    roles = ["a\x00b", "\\", "\\\\n", "a\\\nb", "\\n\n", "<|im_end|>", "x" * 100_000]
    rows = [(1, i, i - 1 if i else None, r, "said " * (30_000 if i == 2 else 1), 0.0) for i, r in enumerate(roles)]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double").select("*", *[F.lit("clash").alias(c) for c in ("_tree", "path", "position", "up", "depth", "_turn")])
    turns = chat.format_reply_trees(df.unionByName(df), tables).select(chat.read_back(F.col("formatted")).alias("t")).first()["t"]
    assert [t["role"] for t in turns] == roles and [t["text"] for t in turns] == [r[4] for r in rows]


def test_names_that_clash_empty_tables_and_long_texts(spark, tables):
    docs = clashing(spark)
    for run in (
        lambda d: token_counts.token_counts(d, tables), lambda d: language_id.identify_languages(d, tables, carry=True), lambda d: suffix_tree_lm.score_texts(d, tables), lambda d: line_dedup.line_dedup(d, tables), lambda d: near_dedup.near_dedup(d, tables),
    ):
        assert len(run(docs).collect()) == len(ROWS)
        assert run(docs.limit(0)).count() == 0
    assert {r["doc_id"] for r in packing.pack(docs, tables).collect()} == {i for i, _ in ROWS}
    counts = {r["doc_id"]: r["n_words"] for r in token_counts.token_counts(docs, tables).collect()}
    assert counts == {1: 6, 2: 0, 3: 0, None: 6, 4: 40_000, 5: 1}


def test_pipeline_keeps_clashing_columns_and_takes_empty_tables(spark, tables):
    docs = clashing(spark, [*ROWS, (6, "uno dos tres"), (6, "uno dos tres")])
    for rows in (docs, docs.limit(0), docs.filter("text is null")):
        now = rows
        for name, stage in corpus_pipeline.STAGES:
            now = tables.write(stage(spark, now, ""), name + str(random.random()))
            assert name == "packing" or now.columns == docs.columns
        assert (now.count() > 0) == (rows is docs)
    assert {r["doc_id"] for r in now.collect()} <= {1, 4, 5, 6, None}
