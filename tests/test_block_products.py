"""Cells by products of blocks: what a plan shuffles doesn't grow with the cells."""

import pytest

from recbench.operators import bayes, factor, knn


@pytest.fixture(scope="module")
def train(spark):
    return spark.range(4000).selectExpr("id % 400 as user", "(id * 7 + id div 400) % 50 as item", "double(id % 5 + 1) as rating").dropDuplicates(["user", "item"])


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_of_neighbourhoods_are_not_shuffled(train):
    for df in (knn.item_item(train), knn.user_user(train), knn.user_user_plain(train)):
        assert "Exchange hash" not in plan(df)
        assert df.count() == train.select("user").distinct().count() * train.select("item").distinct().count()


def test_bayes_cells_are_made_in_blocks(train):
    assert "MapInArrow" in plan(bayes.first(train, "map"))
    rows = bayes.all_components(train)
    assert rows.count() == 5 * bayes.all_components(train, 5.0).count() == 5 * bayes.first(train, "mae").count()


def test_users_of_the_same_shares_are_scored_once(spark):
    train = spark.range(3000).selectExpr("id % 1000 as user", "id div 1000 + 3 * (id % 2) as item", "double(id % 2 * 4 + 1) as rating")
    got = bayes.first(train, "map", 2)
    assert got.count() == 2000
    want = {(r["user"], r["item"], r["prediction"]) for r in bayes.first(train, "map").collect()}
    assert {tuple(r) for r in got.select("user", "item", "prediction").collect()} <= want


def test_rounded_order_and_exact_prediction(train):
    first = knn.item_item(train, n=3, exact=True).collect()
    cells = {(r["user"], r["item"]): r["prediction"] for r in knn.item_item(train).collect()}
    assert all(abs(cells[r["user"], r["item"]] - r["exact"]) < 1e-12 and round(r["exact"], 9) == pytest.approx(r["prediction"], abs=1e-12) for r in first)


def test_factors_meet_in_blocks(train):
    assert "Exchange hash" not in plan(factor.als(train))
    assert factor.als(train).count() == train.select("user").distinct().count() * train.select("item").distinct().count()
