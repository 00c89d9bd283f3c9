"""The near-duplicate stage of the pipeline against brute force at its own threshold."""

import random

import pytest
from test_free import brute_components

import corpus_pipeline
from recbench.llm import near_dedup


def test_stage_links_from_80_percent(spark):
    rng, rows = random.Random(7), []
    for k in range(40):
        own = [f"w{rng.randrange(10_000)}" for _ in range(300)]
        rows.append((10 * k, " ".join(own)))
        for j in range(1, 4):
            words = list(own)
            for i in rng.sample(range(5, 295), rng.randrange(4, 8)):
                words[i] = f"v{rng.randrange(1000)}"
            rows.append((10 * k + j, " ".join(words)))
    want, tighter = (sorted(i for i, _, c in brute_components(rows, percent) if i == c) for percent in (80, 85))
    assert want != tighter
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.without_near_copies(spark, docs, "").collect()) == want


@pytest.mark.parametrize("percent", [70, 80, 85, 90])
def test_shape_keeps_links_at_the_threshold(percent):
    shape = near_dedup.shape(percent)
    assert 2 * (1 - (percent / 100) ** near_dedup.DEPTH) ** shape.side <= near_dedup.UNMET
    assert percent != 85 or shape.side == 9


def test_filter_keeps_links_at_the_threshold():
    assert near_dedup.shape(85).least <= 32
