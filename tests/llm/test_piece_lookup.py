"""Pieces are found by the first bits of their hashes, wherever they crowd."""

import numpy as np
import pytest

from recbench.llm import language_id


@pytest.mark.parametrize("crowded", [False, True])
def test_find(crowded):
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << (40 if crowded else 63), 5000, dtype=np.uint64))
    model = language_id.Marginal(["a", "b"], np.full((2, 1), 0.5))
    other = language_id.Marginal.__new__(language_id.Marginal)
    other.__dict__ |= model.__dict__
    other.index(keys)
    asked = np.concatenate([keys[::3], rng.integers(0, 1 << 63, 2000, dtype=np.uint64), np.array([0, (1 << 64) - 1], np.uint64)])
    at = np.searchsorted(keys, asked).clip(max=len(keys) - 1)
    assert (other._find(asked) == np.where(keys[at] == asked, at, -1)).all()
