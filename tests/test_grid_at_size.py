"""What the grid keeps and sends: the first items of each user, no vectors by the driver, no cell made twice."""

import pytest

from recbench import fixtures as X
from recbench.operators import metrics
from recbench.plans.experiment import Experiment
from recbench.queries import grid


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_of_means_are_those_of_all_cells(spark):
    train = spark.range(3000).selectExpr("id % 60 as user", "(id * 7) % 1500 as item", "double(id % 5 + 1) as rating")
    want = metrics.top_n(X.mean_predictions(train), 3).collect()
    assert sorted(map(tuple, X.mean_predictions(train, 3).collect())) == sorted(map(tuple, want))
    assert "MapInArrow" in plan(X.mean_predictions(train, 3))  # blocks, of which n rows a user leave a task


def test_vectors_are_not_broadcast(spark):
    rows = spark.range(50).selectExpr("id % 5 as user", "id as item", "double(id) as prediction", "double(id) as rating")
    content = spark.range(50).selectExpr("id as item", "array(double(id), 1D) as vector")
    for df in (metrics.content_serendipity(rows, rows, content), metrics.intra_list(rows, content), metrics.category_diversity(rows, content)):
        assert "SortMergeJoin [item" in plan(df) and "BroadcastHashJoin [item" not in plan(df)


def test_predictions_are_as_long_as_lists_and_results_are_made_once(spark, monkeypatch):
    experiment = grid._experiment(spark, "/root/testdata/sf0.001")
    experiment.run()
    kept = experiment.predict("ratings", "means")
    assert kept.groupBy("user").count().agg({"count": "max"}).first()[0] <= grid.N
    monkeypatch.setattr(Experiment, "evaluate", lambda *_: 1 / 0)
    monkeypatch.setitem(experiment.more, "means", lambda *_: 1 / 0)
    experiment.run()
    experiment.predict("ratings", "means")


def test_cells_run_at_a_time_and_share_what_a_user_vector_has(spark, tmp_path, monkeypatch):
    import threading

    ratings = spark.range(400).selectExpr("id % 20 as user", "(id * 7) % 40 as item", "double(id % 5 + 1) as rating").dropDuplicates(["user", "item"])
    content = spark.range(40).selectExpr("id as item", "array(double(id % 3), 1D) as vector")
    together, asked, real = threading.Barrier(2, timeout=120), [], metrics.item_popularity

    def own(train):
        together.wait()  # ends by an error if one recommender waits for the other to end
        return X.mean_predictions(train)

    monkeypatch.setattr(metrics, "item_popularity", lambda *parts: asked.append(parts) or real(*parts))
    grid = Experiment(spark, "both", {"ratings": ratings}, {"flags": content}, str(tmp_path / "x"), ["one", "two"], [], (3, 5), split=X.split, more={"one": own, "two": own})
    got = grid.run().collect()
    assert len(got) == 4 and len(asked) == 1
    want = metrics.suite(*X.split(ratings), X.mean_predictions(X.split(ratings)[0]), content, 3).first()
    assert all(r[c] == pytest.approx(want[c], abs=1e-9) for r in got if r["N"] == 3 for c in ("rmse", "mae", "novelty", "ils", "serendipity"))
