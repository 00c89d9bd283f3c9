"""Operators 11 to 13 against brute force, literal cases and edges."""

import hashlib
import itertools
import random
import re
from collections import Counter

import pytest

from recbench.llm import alignment, phrases, quality, queries
from oracle import compare

DATA = "/root/testdata/sf0.001"
CLASH = "1 as row, 2 as a, 3 as b, 'x' as label, 4 as h, 5 as n, 6 as part"
ODD = ["", None, " ", "  ", "a ", " a", "\n\n a", "a\r\nb;\r\n c\t\td \t e", "▁x y", "<s> </s> <0x41> <|endoftext|> x", "a\x00b \x1c c", "x　y　 z", "aaaa" * 500, "\xa0\xa0 a\xa0b \x85 c", "é́ ﬁ", "日本語 テスト\n中文", "don't we'll  I'm", "🙂 👩‍👩‍👧 x"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


# Operator 11


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def test_base_measures_equal_brute_force(spark, tables):
    random.seed(1)
    texts = [*ODD, "a b c d e f g h " * 3, "x\nx\n x\n\n\nx", "|#x\n|#x"] + ["".join(random.choice(["ab ", "c ", "\n", "é$ ", "a b c d e f g h i "]) for _ in range(random.randrange(60))) for _ in range(200)]
    docs = frame(spark, [(i, t, "en") for i, t in enumerate(texts)]).unionByName(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang").filter("doc_id > 300"))
    out = quality.quality_rules(docs, spark.createDataFrame([], "doc_id long, quality int"), tables)
    want = {(r.doc_id, base(r.text)) for r in docs.collect()}
    rows = out.collect()
    assert {(r.doc_id, tuple(r)[1:7]) for r in rows} == want
    assert all(r.kept == (not r.base_failed) and r.prob is None for r in rows)  # no labels, so no model


def test_quality_on_rows_that_did_not_train(spark, tables):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    train, rest = labels.filter("doc_id % 3 != 0"), labels.filter("doc_id % 3 = 0")
    out = quality.quality_rules(docs, train, tables).join(rest, "doc_id").filter("not base_failed").collect()
    good, bad = [r.kept for r in out if r.quality], [r.kept for r in out if not r.quality]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.35 * len(bad) and len(bad) > 5
    assert all(0 <= r.prob <= 1 for r in out)


def test_quality_edges(spark, tables):
    texts = [None, "", " \n ", "word " * 30, "w" * 100_000, " ".join(f"w{i}" for i in range(60_000))]
    docs = frame(spark, [(i, t, "en") for i, t in enumerate(texts)] + [(None, "no id", None), (5, texts[5], "en")]).selectExpr("*", "1 as label", "2 as prob", "3 as features", "4 as _id")
    labels = spark.createDataFrame([(3, 0), (5, 1), (None, 1), (4, None), (3, 1)], "doc_id long, quality int")
    rows = quality.quality_rules(docs, labels, tables).collect()
    assert len(rows) == 8 and all(r.base_failed for r in rows if r.doc_id != 5) and sum(r.n_words == 60_000 for r in rows) == 2
    assert quality.quality_rules(docs.limit(0), labels, tables).count() == 0


# Operator 12


@pytest.fixture(scope="module")
def both():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def tokens_of(both, text):
    a, b = both
    of = alignment._byte_of_character()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    return ids_a, [bytes(of[c] for c in a.id_to_token(i)) for i in ids_a], ids_b, [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]


def aligned(both, texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, sha) of whole texts, all at once."""
    told, links, held = [], [], Counter()
    for text in texts:
        ids_a, bytes_a, ids_b, bytes_b = tokens_of(both, text) if text else ([], [], [], [])
        groups = []
        if text and b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            ends = set(itertools.accumulate(map(len, bytes_a))) & set(itertools.accumulate(map(len, bytes_b)))
            sides = []
            for ids, parts in ((ids_a, bytes_a), (ids_b, bytes_b)):
                cut, at = [[]], 0
                for i, x in zip(ids, parts, strict=True):
                    cut[-1].append(i)
                    at += len(x)
                    if at in ends:
                        cut.append([])
                sides.append(cut[:-1])
            groups = list(zip(*sides, strict=True))
        else:
            ids_a = ids_b = []
        own = Counter((x, y) for p, q in groups for x in p for y in q)
        held.update(own.keys())
        links.append(own)
        words = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in groups)
        told.append((len(ids_a), len(ids_b), len(groups), words and hashlib.sha256(words.encode()).hexdigest()))
    most = Counter()
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    return [(*t[:3], sum(own.values()), sum(n for p, n in own.items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in own.items()), t[3]) for t, own in zip(told, links, strict=True)]


@pytest.mark.parametrize("dealt", [False, True])
def test_alignment_equals_brute_force(spark, tables, both, monkeypatch, dealt):
    if dealt:  # small blocks, and most ids dealt out over several tasks
        for name, value in (("HELD", 2_000), ("BLOCK", 40), ("ROWS", 7), ("ADDED", 500), ("HOT", 40_000)):
            monkeypatch.setattr(alignment, name, value)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").repartition(3)
    docs = docs.unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")).selectExpr("*", *CLASH.split(", "))
    rows = docs.collect()
    want = dict(zip([r.doc_id for r in rows], aligned(both, [r.text for r in rows]), strict=True))
    got = alignment.align_tokenizers(docs, tables).collect()
    assert len(got) == len(rows) and {r.doc_id: tuple(r)[1:] for r in got} == want


def test_alignment_edges(spark, tables, both):
    texts = ["the cat " * 20_000, "the cat", "the cat", None, "é" * 30_000]
    docs = spark.createDataFrame([(1, texts[0]), (2, texts[1]), (2, texts[2]), (None, texts[3]), (None, texts[4])], "doc_id long, text string")
    got = alignment.align_tokenizers(docs, tables).collect()
    key = lambda x: (str(x[0]), *x[1:])
    assert sorted((tuple(r) for r in got), key=key) == sorted(((i, *w) for i, w in zip([1, 2, 2, None, None], aligned(both, texts), strict=True)), key=key)
    assert alignment.align_tokenizers(docs.limit(0), tables).count() == 0


def test_postings_of_many_links_are_wide(both):
    import public_tokenizers

    aligner = alignment.aligner(*map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model")))
    counts, told, row, pair, times = aligner.align(["x" + " the" * 300])
    (row, pair), (times,) = alignment._summed([row, pair], [times])
    out = list(alignment._postings(5, [row], [pair], [times]))
    assert {len(t) for b in out for t in b.column(5).to_pylist()} == {1, 8} and times.sum() == counts[0, 3]


# Operator 13


def mined(docs):
    """Rows of collocations by counting every run of words."""
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 5):
                f.update((lang, tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    f = {k: v for k, v in f.items() if v >= 30}
    most = Counter()
    for (lang, p), a in f.items():
        for i in range(len(p)):
            for j in range(i + 2, len(p) + 1):
                if j - i < len(p):
                    most[lang, p[i:j]] = max(most[lang, p[i:j]], a)
    out = {}
    for (lang, p), a in f.items():
        if len(p) > 1 and not 100 * most[lang, p] >= 80 * a:
            score, _, l, r = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return {(lang, i, p.decode(), -a, l, r, n[lang], -score) for lang, rows in out.items() for i, (score, a, p, l, r) in enumerate(sorted(rows)[:2000], 1)}


def test_collocations_equal_sql(spark):
    compare(queries.op13_collocations(spark, "/root/testdata/sf0.01"), queries.OP13_SQL, "/root/testdata/sf0.01")


@pytest.mark.parametrize("held", [None, 300])
def test_collocations_equal_brute_force(spark, tables, monkeypatch, held):
    if held:
        monkeypatch.setattr(phrases, "HELD", held)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    random.seed(2)
    words = ["the", "of", "Cat", "é", "日本", "x" * 300, "a|b", "’tis"]
    rows = [(i, "".join(random.choice(words[: 2 + i % 7]) + random.choice([" ", " ", " ", "\t ", ". ", "\n", ",", "\x0b", "\xa0"]) for _ in range(random.randrange(80))), [None, "en", "und", "fr"][i % 4]) for i in range(300)]
    rows += [(None, None, "en"), (1, "", None), *rows[:20]]
    docs = frame(spark, rows).selectExpr("*", *CLASH.split(", ")).repartition(3)
    try:
        out = phrases.collocations(docs, tables).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = mined([(t, lang) for _, t, lang in rows])
    assert {tuple(r) for r in out} == want and len(out) == len(want) > 40


def test_collocation_edges(spark, tables):
    docs = frame(spark, [(1, "a b " * 20_000 + "w" * 100_000, "en"), (2, "a b", "en"), (3, "... ,,\n", "xx")])
    rows = {tuple(r) for r in phrases.collocations(docs, tables).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}
    assert rows == mined([(r.text, r.lang) for r in docs.collect()]) and rows
    assert phrases.collocations(docs.limit(0), tables).count() == 0
    assert phrases.collocations(docs.filter("doc_id > 1"), tables).count() == 0
