"""Hand-computed answers and invariants of recommenders and metrics."""

import math

import pytest
from pyspark.sql import functions as F

from recbench.functions import vectors
from recbench.operators import bayes, content_based, factor, knn, metrics, stats

RATINGS = [(1, 1, 5.0), (1, 2, 3.0), (2, 1, 4.0), (2, 3, 1.0), (3, 2, 2.0), (3, 3, 5.0)]


@pytest.fixture(scope="module")
def train(spark):
    return spark.createDataFrame(RATINGS, "user long, item long, rating double").cache()


def cells(df, value="prediction"):
    return {(r["user"], r["item"]): r[value] for r in df.collect()}


def brute_user_user():
    r = {(u, i): x for u, i, x in RATINGS}
    users, items = sorted({u for u, _ in r}), sorted({i for _, i in r})
    mean = {u: sum(x for (v, _), x in r.items() if v == u) / sum(v == u for v, _ in r) for u in users}

    def sim(a, b):
        both = [i for i in items if (a, i) in r and (b, i) in r]
        if not both:
            return 0.0
        return sum(r[a, i] * r[b, i] for i in both) / math.sqrt(sum(r[a, i] ** 2 for i in both) * sum(r[b, i] ** 2 for i in both))

    out = {}
    for u in users:
        for i in items:
            raters = [v for v in users if (v, i) in r]
            down = sum(abs(sim(u, v)) for v in raters)
            up = sum(sim(u, v) * (r[v, i] - mean[v]) for v in raters)
            out[u, i] = max(1.0, min(5.0, mean[u] + (up / down if down else 0.0)))
    return out


def test_user_user_equals_the_dense_formula(train):
    got = cells(knn.user_user(train))
    want = brute_user_user()
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_item_item_leaves_out_the_item_itself(train):
    got = cells(knn.item_item(train))
    # user 1 rated items 1 and 2; item 1's only other similar item of theirs is 2
    assert got[1, 1] == pytest.approx(3.0)
    assert len(got) == 9 and all(1.0 <= p <= 5.0 for p in got.values())


def test_bayes_shares_of_a_user_sum_to_one(train):
    parts = bayes.components(train)
    p = bayes._shares(train, "user", train.agg(F.array_sort(F.collect_set("rating")).alias("domain")))
    assert all(sum(r["p_user"]) == pytest.approx(1.0) for r in p.collect())
    assert cells(bayes.most_likely(parts)).keys() == {(u, i) for u in (1, 2, 3) for i in (1, 2, 3)}


def test_bayes_ties_go_to_the_lowest(spark):
    parts = spark.createDataFrame([(1, 1, [(1.0, 0.5), (2.0, 0.5), (3.0, 0.1)])], "user long, item long, parts array<struct<rating: double, p: double>>")
    assert bayes.most_likely(parts).first()["prediction"] == 1.0
    assert bayes.least_squares(parts).first()["prediction"] == pytest.approx(1.8)
    assert bayes.least_squares(parts, normalize=True).first()["prediction"] == pytest.approx(1.8 / 1.1)


def test_blend_ends_and_range(spark):
    a = spark.createDataFrame([(1, 1, 2.0)], "user long, item long, prediction double")
    b = spark.createDataFrame([(1, 1, 4.0), (1, 2, 5.0)], "user long, item long, prediction double")
    assert cells(factor.blend(a, b, 0)) == {(1, 1): 2.0}
    assert cells(factor.blend(a, b, 1)) == {(1, 1): 4.0, (1, 2): 5.0}
    assert cells(factor.blend(a, b, 0.25)) == {(1, 1): 2.5}
    with pytest.raises(ValueError):
        factor.blend(a, b, 1.5)


def test_random_of_zeros_fails(spark):
    with pytest.raises(ValueError):
        factor.random(spark.createDataFrame([(1, 1, 0.0)], "user long, item long, rating double"))


def test_als_stays_in_range(train):
    assert all(1.0 <= p <= 5.0 for p in cells(factor.als(train, rank=2)).values())


def test_cosine_distance_of_the_documented_pair(spark):
    row = spark.range(1).select(vectors.cosine_distance(F.array(*map(F.lit, [0.0, 1.0, 1.0, 1.0])), F.array(*map(F.lit, [0.0, 1.0, 0.0, 1.0]))).alias("d")).first()
    assert row["d"] == pytest.approx(0.1835, abs=1e-4)


def test_one_item_list_has_no_distance(spark):
    content = spark.createDataFrame([(1, [1.0, 0.0])], "item long, vector array<double>")
    one = spark.createDataFrame([(1, 1, 3.0)], "user long, item long, prediction double")
    assert metrics.intra_list(one, content).first()["ils"] == 0.0


def test_mae_is_at_most_rmse_and_empty_is_null(train, spark):
    predicted = knn.user_user(train)
    assert metrics.mae(train, predicted).first()["mae"] <= metrics.rmse(train, predicted).first()["rmse"]
    none = spark.createDataFrame([], "user long, item long, prediction double")
    assert metrics.rmse(train, none).first()["rmse"] is None
    assert metrics.precision_at(train, none, 5).first()["pred_n"] == 0.0


def test_profile_of_equal_sums_is_zero(spark):
    content = spark.createDataFrame([(1, [1.0, 1.0])], "item long, vector array<double>")
    rated = spark.createDataFrame([(1, 1, 3.0)], "user long, item long, rating double")
    assert content_based.profiles(rated, content).first()["profile"] == [0.0, 0.0]


def test_pearson_of_a_constant_side_is_zero(spark):
    rows = spark.createDataFrame([(1, 1, 2.0), (1, 2, 2.0), (2, 1, 1.0), (2, 2, 5.0)], "user long, item long, rating double")
    assert stats.pearson(rows, rows, "user", "item").first()["corr"] == 0.0
    with pytest.raises(TypeError):
        stats.dataset_stats()
