"""Items' neighbourhoods by panels: the same numbers as sums over pairs, of which none is shuffled."""

import numpy as np
import pytest

from recbench.operators import knn, panels


def _dense(rows):
    users, items = sorted({u for u, _, _ in rows}), sorted({i for _, i, _ in rows})
    x = np.zeros((len(users), len(items)))
    for u, i, r in rows:
        x[users.index(u), items.index(i)] = r
    there = (x != 0).astype(float)
    norms = np.sqrt((x * x).T @ there * (there.T @ (x * x)))
    s = np.divide(x.T @ x, norms, out=np.zeros_like(norms), where=norms > 0)
    np.fill_diagonal(s, 0)
    up, down = x @ s, there @ np.abs(s)
    return users, items, np.clip(np.divide(up, down, out=np.zeros_like(up), where=down > 0), min(r for *_, r in rows), max(r for *_, r in rows)), down


@pytest.mark.parametrize("lowest", [1, -2])
def test_several_panels_and_blocks(spark, monkeypatch, lowest):
    for name, value in (("CELLS", 100), ("LEAST", 20), ("TASKS", 3), ("PAIRS", 7)):
        monkeypatch.setattr(panels, name, value)
    rows = [(u, i, float(lowest + (u * i) % 5) or 0.5) for u in range(30) for i in range(40) if (u * 7 + i * 3) % 4 == 0 and i % 7 != u % 3] + [(90, 99, 2.0)]
    train = spark.createDataFrame(rows, "user long, item long, rating double")
    users, items, scores, down = _dense(rows)
    got = {(r["user"], r["item"]): r["prediction"] for r in knn.item_item(train).collect()}
    assert len(got) == len(users) * len(items)
    assert all(got[u, i] == pytest.approx(scores[k, m], abs=1e-9) for k, u in enumerate(users) for m, i in enumerate(items))
    assert knn.item_item(train, fill=False).count() == (down > 0).sum()
    shown = np.round(scores, 9)
    want = {(u, items[m]) for k, u in enumerate(users) for m in np.lexsort((np.array(items), -shown[k]))[:4]}
    first = knn.item_item(train, n=4)
    assert {(r["user"], r["item"]) for r in first.collect()} == want and first.count() == 4 * len(users)


def test_no_pair_is_shuffled(spark):
    """600 users rated all of 80 items: 1.9 million pairs of ratings, and 0.05 million ratings."""
    train = spark.range(600 * 80).selectExpr("id % 600 as user", "id div 600 as item", "double(id % 5 + 1) as rating")
    context = spark.sparkContext

    def stages():
        java = context._jvm
        found = context._jsc.sc().statusStore().stageList(java.java.util.ArrayList(), False, False, context._gateway.new_array(java.double, 0), java.java.util.ArrayList())
        return {found.apply(k).stageId(): found.apply(k).shuffleWriteRecords() for k in range(found.size())}

    before = stages()
    assert knn.item_item(train, n=2).count() == 1200
    assert max(n for stage, n in stages().items() if stage not in before) <= 600 * 80
