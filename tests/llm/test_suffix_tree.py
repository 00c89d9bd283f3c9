"""The suffix tree against brute force at any depth, and rare contexts of a larger corpus."""

import collections
import math
import random
import zlib

import pytest

from recbench.llm import suffix_tree_lm


def brute_scores(rows, modulus=7):
    """The tree of score_texts over tuples."""
    texts = [(i, (*t.split(), "</s>")) for i, t in rows]
    train = [t for i, t in texts if zlib.crc32(str(i).encode()) % modulus != 2]
    count = lambda k: collections.Counter(t[j : j + k] for t in train for j in range(len(t) - k + 1))
    n = {1: count(1)}
    total = sum(n[1].values())
    size = total + len(n[1]) + 1
    states, p, k = {}, {g: (c + 1) / size for g, c in n[1].items()}, 1
    kept = None
    while True:
        n[k + 1], by, new = count(k + 1), collections.defaultdict(dict), {}
        for g, c in n[k + 1].items():
            if c >= 2 and n[k][g[:-1]] >= 8 and (k < 3 or g[1:-1] in kept):
                by[g[:-1]][g[-1]] = c
        passed = {}
        for s, nexts in by.items():
            share = {w: (c - 0.5) / n[k][s] for w, c in nexts.items()}
            rest = 1 - sum(share.values())
            q = {w: p[(*s[1:], w)] for w in nexts}
            gain = 0.0
            for w in nexts:
                new[*s, w] = share[w] + rest * q[w]
                gain += new[*s, w] * math.log(new[*s, w] / q[w])
            gain += rest * max(1e-12, 1 - sum(q.values())) * math.log(rest)
            states[s] = (share, rest)
            if gain * n[k][s] > 0.5 * math.log(total + 1) * len(nexts):
                passed[s] = 1
        p |= new
        keeps = set(passed) | (keeps if k > 1 else set())
        kept, k = passed, k + 1
        if not by or (k > 2 and not passed):
            break
    keeps |= {s[1:] for s in keeps if len(s) == 2}

    def prob(s, w):
        if not s:
            return (n[1][(w,)] + 1) / size
        shorter = prob(s[1:], w)
        if s not in keeps:
            return shorter
        share, rest = states[s]
        return share.get(w, 0.0) + rest * shorter

    out = {i: sum(math.log10(prob(t[max(0, j - k) : j], t[j])) for j in range(len(t))) for i, t in texts}
    return out, max(map(len, keeps))


@pytest.mark.parametrize("hot", [1_000_000, 200])
def test_tree_equals_brute_force(spark, tables, monkeypatch, hot):
    monkeypatch.setattr(suffix_tree_lm, "HOT", hot)
    rng, rows = random.Random(8), []
    for i in range(400):
        t = [rng.randrange(2) for _ in range(3)]
        while len(t) < 60:
            t.append((t[-1] ^ t[-2] ^ t[-3]) if rng.random() < 0.97 else rng.randrange(3))  # three words back
        rows.append((i, " ".join(f"w{x}" for x in t)))
    want, deepest = brute_scores(rows)
    assert deepest >= 3
    got = suffix_tree_lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), tables).collect()
    assert {r["doc_id"]: r["score"] for r in got} == pytest.approx(want, abs=1e-6)


def test_counts_do_not_rise_with_the_corpus(spark, tables):
    """Ten occurrences make a context, among ten and among 1.5 million tokens."""
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    others = [i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 7 != 2]
    rows = [(held, "seldom met"), *((i, "seldom met") for i in others[:10]), (others[10], "a b c d " * 375_000)]
    out = suffix_tree_lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), tables).filter(f"doc_id = {held}").first()
    assert out["score"] > out["base_score"] + 5
