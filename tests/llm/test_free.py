"""The other operators against brute force, round trips and held-out accuracy."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from oracle import DATA
from pyspark.sql import functions as F

from recbench.llm import graph_ann, language_id, near_dedup, packing, queries, suffix_tree_lm, textkernel, token_counts

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
ODD = [(9001, None), (9002, ""), (9003, " \n\t"), (9004, "12 34 !!"), (9005, "Word " * 30_000), (9005, "Word " * 30_000), (9006, "a" * 40_000), (None, "the und de la"), (9007, "émile ß 　x"), (9008, "one two three")]


@pytest.fixture(scope="module")
def documents(spark):
    """The smallest documents, odd cases, and near copies around the threshold."""
    base = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source")
    rng, made = random.Random(5), []
    long = [f"w{rng.randrange(10_000)}" for _ in range(300)]
    for k in range(60):
        words = list(long)
        for _ in range(rng.randrange(0, 7)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(1000)}"
        made.append((8000 + k, " ".join(words)))
    more = spark.createDataFrame([(i, t, None, None) for i, t in ODD + made], base.schema)
    return base.unionByName(more).withColumn("kept", F.lit("clash")).withColumn("score", F.lit("clash")).cache()


def texts(documents):
    return [(r["doc_id"], (r["text"] or "")) for r in documents.collect()]


def words(text):
    return text.encode().translate(LOWER).split()


def test_kernel_splits_as_bytes_do():
    import pyarrow as pa

    rng = random.Random(1)
    rows = ["".join(rng.choice(["a", "B", " ", "\n", "\x0b", "é", "\x1c", "zz"]) for _ in range(rng.randrange(12))) for _ in range(500)] + [None]
    table: dict[bytes, int] = {}
    for chunk in textkernel.words(pa.array(rows)):
        for i, row in enumerate(range(chunk.first, chunk.last)):
            a, b = chunk.row_offsets[i], chunk.row_offsets[i + 1]
            want = words(rows[row] or "")
            assert [chunk.word(j) for j in range(a, b)] == want
            for w, h in zip(want, chunk.hashes[a:b].tolist(), strict=True):
                assert table.setdefault(w, h) == h
    assert len(set(table.values())) == len(table)


def test_token_counts_equal_a_plain_search(spark, documents, tables):
    model = token_counts.Unigram(token_counts.default_vocabulary())

    def plain(word):
        best = [(0.0, 0)] + [(-math.inf, 0)] * len(word)
        for i in range(1, len(word) + 1):
            for j in range(max(0, i - 40), i):
                if (s := model.pieces.get(word[j:i])) is not None:
                    best[i] = max(best[i], (best[j][0] + s, -(-best[j][1] + 1)))
            if best[i][0] == -math.inf:
                n = len(word[i - 1].encode())
                best[i] = (best[i - 1][0] + n * model.byte, best[i - 1][1] - n)
        return -best[-1][1], best[-1][0]

    known: dict[str, tuple] = {}
    got = collections.Counter((r["doc_id"], r["n_words"], r["n_tokens"], round(r["log_prob"], 4)) for r in token_counts.token_counts(documents, tables).collect())
    want = collections.Counter()
    for i, t in texts(documents):
        parts = [known.get(w) or known.setdefault(w, plain(token_counts.MARK + w)) for w in (x.decode() for x in t.encode().split())]
        want[i, len(parts), sum(p[0] for p in parts), round(sum(p[1] for p in parts), 4)] += 1
    assert {k[:3] for k in got} == {k[:3] for k in want} and got.total() == want.total()
    assert sum(k[3] for k in got) == pytest.approx(sum(k[3] for k in want), abs=0.1)


def test_language_id(spark, documents, tables):
    out = language_id.identify_languages(documents, tables).collect()
    assert len(out) == documents.count()
    lang = {r["doc_id"]: r["lang"] for r in documents.collect() if r["lang"]}
    held = [r for r in out if r["doc_id"] in lang and r["held_out"]]
    assert held and sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)
    by = {r["doc_id"]: r for r in out}
    assert all(by[i]["lang_pred"] == "und" for i in (9001, 9002, 9003, 9004))
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    assert language_id.identify_languages(documents.limit(0), tables).count() == 0
    carried = language_id.identify_languages(documents.limit(5), tables, train=documents, carry=True)
    assert carried.select("row.*").columns == documents.columns


def test_all_segmentations_are_summed():
    pieces, p = ["a", "b", "ab", "ba", "aba"], np.array([[0.3, 0.1], [0.2, 0.4], [0.2, 0.1], [0.2, 0.2], [0.1, 0.2]])
    model = language_id.Marginal(pieces, p)

    def total(word, k):
        if not word:
            return 1.0
        out = sum(p[i][k] * total(word[len(x) :], k) for i, x in enumerate(pieces) if word.startswith(x))
        return out + (language_id.UNKNOWN * total(word[1:], k) if word[0] not in pieces else 0.0)

    for word in ("ab", "abab", "xaba", "ba" * 6):
        want = [math.log(total(word, k)) for k in (0, 1)]
        assert model._group([word])[0] == pytest.approx(want)
        assert model._long(word) == pytest.approx(want)
    assert np.isfinite(model._long("ab" * 3000)).all()


def test_sums_hold_for_large_corpora():
    """Counts of up to 1e13 in one language, so that a piece it never showed has a share of 5e-14, at any length and by either way."""
    from decimal import Decimal, getcontext

    getcontext().prec = 60
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "abab", "漢", "字", "漢字", "b" * 16]
    counts = np.array([[1e13, 5], [3e12, 2], [1e9, 1], [7e8, 9], [2, 4], [0, 1], [0, 3], [0, 50], [0, 70], [0, 20], [0, 2]]) + language_id.ADDED
    model = language_id.Marginal(pieces, counts / counts.sum(axis=0))
    texts = [*("▁" + x for x in ("a", "ab" * 9, "漢字" * 18, "漢" * 37, "b" * 37, "?" * 37, "a?漢" * 12)), "▁" + "漢字" * 40, "▁" + "ab字?" * 60, "▁" + "b" * 500]
    for text in texts:
        want = []
        for k in range(2):
            p = {x: Decimal(float(v)) for x, v in zip(pieces, (counts / counts.sum(axis=0))[:, k], strict=True)}
            sums = [Decimal(1)]
            for i in range(1, len(text) + 1):
                parts = [sums[j] * p[text[j:i]] for j in range(max(0, i - 16), i) if text[j:i] in p]
                if text[i - 1] not in p:
                    parts.append(sums[i - 1] * Decimal(language_id.UNKNOWN))
                sums.append(sum(parts))
            want.append(float(sums[-1].ln()))
        for got in (model._group([text, text])[1], model._long(text)):
            assert np.isfinite(got).all() and got == pytest.approx(want, rel=1e-9, abs=1e-9)
    assert model.scores(["漢".encode() * 37, b"a" * 3]).shape == (2, 2) and np.isfinite(model.scores(["漢".encode() * 37])).all()


def test_lm_scores(spark, documents, tables):
    out = suffix_tree_lm.score_texts(documents, tables).collect()
    tokens = [(i, [*words(t), None]) for i, t in texts(documents)]
    counts = collections.Counter()
    for i, w in tokens:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    want = collections.Counter((i, len(w), sum(counts[x] > 0 for x in w), round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 3)) for i, w in tokens)
    got = collections.Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 3)) for r in out)
    assert {k[:3] for k in got} == {k[:3] for k in want}
    assert sum(k[3] * m for k, m in got.items()) == pytest.approx(sum(k[3] * m for k, m in want.items()), rel=1e-6)
    assert all(r["train_tokens"] == n and r["score"] <= 0 for r in out)
    held = [r for r in out if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert suffix_tree_lm.score_texts(documents.limit(0), tables).count() == 0


def brute_components(rows, percent=85):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    least: dict[int, int | None] = {}
    for k, (i, _) in enumerate(rows):
        r = root(k)
        least[r] = i if least.get(r) is None else least[r] if i is None else min(least[r], i)
    return [(i, len(sets[k]), least[root(k)]) for k, (i, _) in enumerate(rows)]


def test_near_dedup_equals_brute_force(spark, documents, tables):
    rows = texts(documents)
    out = near_dedup.near_dedup(documents, tables).collect()
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(key((r["doc_id"], r["n_shingles"], r["component_id"])) for r in out) == sorted(map(key, brute_components(rows)))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)
    assert len({r["component_id"] for r in out if r["doc_id"] and 8000 <= r["doc_id"] < 8060}) < 60
    assert near_dedup.near_dedup(documents.limit(0), tables).count() == 0


def test_packing(spark, documents, tables):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_tokenizer())
    whole.encode_special_tokens = True
    out = packing.pack(documents.repartition(5), tables, windows=4).collect()
    pieces, used = collections.defaultdict(list), collections.defaultdict(list)
    for r in out:
        pieces[r["doc_id"]].append(r)
        used[r["sequence_id"]].append(r)
    want = collections.defaultdict(list)
    for i, t in texts(documents):
        want[i].append([*whole.encode(t, add_special_tokens=False).ids, 0])
    assert pieces.keys() == want.keys()
    for i, all_ids in want.items():
        assert sum(r["length"] for r in pieces[i]) == sum(map(len, all_ids))
        if len(all_ids) == 1:
            rows = sorted(pieces[i], key=lambda r: r["start"])
            assert np.concatenate([np.frombuffer(r["ids"], "<u4") for r in rows]).tolist() == all_ids[0]
            assert [r["start"] for r in rows] == np.cumsum([0, *[r["length"] for r in rows]]).tolist()[:-1]
    fills = []
    for rows in used.values():
        rows = sorted(rows, key=lambda r: r["offset"])
        assert [r["offset"] for r in rows] == np.cumsum([0, *[r["length"] for r in rows]]).tolist()[:-1]
        fills.append(sum(r["length"] for r in rows))
    assert max(fills) <= 1024 and sum(f < 1024 for f in fills) <= 1
    assert packing.pack(documents.limit(0), tables).count() == 0


def test_encoder_equals_the_library_on_odd_white_space():
    import pyarrow as pa
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_tokenizer())
    whole.encode_special_tokens = True
    rng = random.Random(2)
    parts = [" ", "  ", "\n", "\t", "\r\n", "a", "foo", "Don't", "'s", "12", "é", "　", "\xa0", "\x1c", "\x85", "<|endoftext|>", "!!", "x\ty", " \n "]
    rows = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(4000)]
    want = [whole.encode(t, add_special_tokens=False).ids for t in rows]
    encoder = packing.Encoder(packing.default_tokenizer())
    assert [x.tolist() for x in encoder.encode(rows)] == want
    assert [x.tolist() for part in encoder.columns(pa.array(rows)) for x in part] == want


def test_nearest(spark, tables):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[200:420] = x[0]  # a vector that many rows share
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16), (5060, [1.0, None] * 8), (5080, [1.0, 2.0]), (20, x[20].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = collections.defaultdict(list)
    for r in graph_ann.nearest(df, tables).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    wide, hit, queries_ = x.astype(np.float64), 0, range(0, 1500, 20)
    assert sorted(got) == list(queries_)
    for q in queries_:
        scores = wide @ wide[q]
        best = [i for i in np.lexsort((np.arange(1500), -scores)) if i != q][:20]
        assert [r for r, _, _ in got[q]] == list(range(1, 21))
        assert all(abs(scores[i] - s) < 1e-9 for _, i, s in got[q])
        hit += len({i for _, i, _ in got[q]} & set(best))
    assert hit >= 0.9 * 20 * len(queries_)
    assert [i for _, i, _ in got[200]] == [0, *range(201, 220)]  # ties: the smaller id
    few = graph_ann.nearest(df.filter("vec_id < 5"), tables).collect()
    assert [(r["query_id"], r["rank"]) for r in sorted(few, key=lambda r: r["rank"])] == [(0, 1), (0, 2), (0, 3), (0, 4)]
    assert graph_ann.nearest(df.limit(0), tables).count() == 0


def test_registered_queries_cover_the_operators():
    assert [int(name[2:].split("_")[0]) for name in queries.QUERIES] == list(range(1, 14))


def test_components(spark, tables):
    from recbench.llm.components import connected_components

    rng = random.Random(6)
    chain = [(i, i + 1) for i in range(300)]
    links = chain + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(180)] + [(2000, 2000)]
    later = [(150, 1003), (2000, 2001), (2001, 2002), (1500, 3000)]

    def brute(pairs):
        near = collections.defaultdict(set)
        for a, b in pairs:
            near[a].add(b)
            near[b].add(a)
        out = {}
        for x in sorted(near):
            stack = [] if x in out else [x]
            while stack:
                y = stack.pop()
                if y not in out:
                    out[y] = x
                    stack += near[y]
        return out

    first = connected_components(spark.createDataFrame(links, "a long, b long"), tables, "one")
    assert {r["node"]: r["component"] for r in first.collect()} == brute(links)
    both = connected_components(spark.createDataFrame(later, "a long, b long"), tables, "two", first)
    assert {r["node"]: r["component"] for r in both.collect()} == brute(links + later)
    assert connected_components(spark.createDataFrame([], "a long, b long"), tables, "none").count() == 0
