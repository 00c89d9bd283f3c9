"""Vectorizers by the name of a data set, polygons by grid cells, and heavy keys in blocks."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from recbench.functions import sparse
from recbench.operators import bayes, blocks, content, content_based, factor, geo, knn, metrics, stats
from recbench.plans.vectorizers import VECTORIZERS, vectorizer, vectors


def test_names(spark):
    assert vectorizer("movielens_1m") is vectorizer("movielens_20m") is VECTORIZERS["movielens*"]
    assert vectorizer("git") is VECTORIZERS["git"] and vectorizer("osm_x") is VECTORIZERS["osm*"]
    for name in ("gitx", "", "books"):
        with pytest.raises(ValueError, match="known"):
            vectorizer(name)
    rows = spark.createDataFrame([(1, 2, 4.0), (1, 3, 1.0)], "user_id long, joke_id long, rating double")
    users, contents = vectors("jester", {"ratings": rows}, ["ratings", "pos_ratings"], [])
    assert (users["ratings"].count(), users["pos_ratings"].count(), contents) == (2, 2, {})
    with pytest.raises(ValueError, match="known"):
        vectors("jester", {"ratings": rows}, ["none such"], [])


POLYGON = "index int, polygon array<struct<x: double, y: double>>"


def test_polygons_of_all_sizes_equal_testing_each(spark):
    """Against in_polygon for every pair: stars, slivers, boxes over cell borders, huge, tiny and degenerate ones."""
    rng = np.random.default_rng(3)
    shapes = [[(float(i), 0.0), (i + 2.0, 0.0), (i + 2.0, 1.0), (float(i), 1.0)] for i in range(7)]
    for size in (1e-9, 1e-3, 0.7, 5.0, 64.0, 3e4):
        for _ in range(12):
            x, y = rng.uniform(-40, 40, 2)
            turn = np.sort(rng.uniform(0, 2 * np.pi, rng.integers(3, 30)))
            reach = size * rng.uniform(0.2, 1, len(turn))
            shapes.append([(float(x + r * np.cos(t)), float(y + r * np.sin(t))) for t, r in zip(turn, reach, strict=True)])
    shapes += [[(0.0, 0.0), (30.0, 1e-7), (0.0, 2e-7)], [(1.0, 1.0)], [(1.0, 1.0), (4.0, 4.0)], [], [(8.0, 8.0), (12.0, 8.0), (12.0, 12.0), (8.0, 12.0)], [(1e15, 1e15), (1e15 + 8, 1e15), (1e15, 1e15 + 8)]]
    order = rng.permutation(len(shapes))
    polygons = spark.createDataFrame([(i, shapes[k]) for i, k in enumerate(order.tolist())] + [(len(shapes), [(None, 0.0), (1.0, 1.0), (0.0, 1.0)])], POLYGON)
    corners = [p for s in shapes for p in s]
    places = [*corners[:150], *[(float(a), float(b)) for a, b in rng.uniform(-45, 45, (300, 2))], *[(float(a), float(b)) for a, b in rng.integers(-9, 13, (100, 2))], (1e15 + 1, 1e15 + 1), (1e300, 0.0), (-0.0, 0.5), (0.0, 0.5)]
    places += places[:20] + [(None, 1.0), (float("nan"), 1.0), (float("inf"), 1.0)]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "id int, lon double, lat double")
    pairs = points.crossJoin(polygons.filter(~F.exists("polygon", lambda p: p["x"].isNull()))).filter(geo.in_polygon(F.col("lon"), F.col("lat"), F.col("polygon"))).filter("not isnan(lon) and abs(lon) < double('inf')")
    want = {r["id"]: r["m"] for r in pairs.groupBy("id").agg(F.min("index").alias("m")).collect()}
    out = geo.divisions(points, polygons, one_hot=False)
    got = [(r["id"], r["division"]) for r in out.collect()]
    assert sorted(got) == [(i, want.get(i)) for i in range(len(places))] and len(want) > 200 and out.columns == ["id", "lon", "lat", "division"]


def test_no_step_of_points_with_polygons(spark, capsys):
    polygons = spark.range(50_000).select(F.col("id").cast("int").alias("index"), F.expr("array(struct(id % 250 * 2.0 as x, id div 250 * 2.0 as y), struct(id % 250 * 2.0 + 1.5 as x, id div 250 * 2.0 as y), struct(id % 250 * 2.0 as x, id div 250 * 2.0 + 1.5 as y))").alias("polygon"))
    points = spark.range(20_000).select("id", (F.col("id") % 500 + 0.25).alias("lon"), (F.col("id") % 400 + 0.25).alias("lat"))
    out = geo.divisions(points, polygons, one_hot=False)
    want = F.when((F.floor("lon") % 2 == 0) & (F.floor("lat") % 2 == 0), F.floor("lat") / 2 * 250 + F.floor("lon") / 2)
    assert out.filter(~F.col("division").eqNullSafe(want.cast("int"))).count() == 0 and out.count() == 20_000
    out.explain("formatted")
    assert not re.search("Nested|Cartesian", capsys.readouterr().out)
    assert geo.cover(polygons).count() < 100 * 50_000


def test_one_hots_of_no_polygons_are_empty(spark):
    points = spark.createDataFrame([(0.5, 0.5)], "lon double, lat double")
    assert geo.divisions(points, spark.createDataFrame([], POLYGON)).first()["division_vector"] == []


def test_heavy_keys_in_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(u, i, float(1 + (u * i) % 5)) for u in range(30) for i in range(4) if i == 0 or (u + i) % 3], "user long, item long, rating double")
    plain = lambda df: sorted(tuple(round(v, 9) for v in r) for r in df.collect())
    want = plain(knn.co_rated_cosine(rows, "user", "item")), plain(stats.pearson(rows, rows, "user", "item"))
    monkeypatch.setattr(knn, "HEAVY", 4)
    assert (plain(knn.co_rated_cosine(rows, "user", "item")), plain(stats.pearson(rows, rows, "user", "item"))) == want
    assert {(a, b) for a, b, _ in want[0]} == {(b, a) for a, b, _ in want[0]} and len(want[0]) == 900


def test_expected_ratings_by_columns_and_by_arrays(spark, monkeypatch):
    train = spark.createDataFrame([(u, i, float((u + i) % 4)) for u in range(6) for i in range(5) if (u * i) % 3], "user long, item long, rating double")
    by = lambda df: {(r["user"], r["item"]): round(r["prediction"], 9) for r in df.collect()}
    for normalize in (False, True):
        want = by(bayes.least_squares(bayes.components(train), normalize))
        assert by(bayes.expected(train, normalize=normalize)) == want
        monkeypatch.setattr(bayes, "COLUMNS", 2)
        assert by(bayes.expected(train, normalize=normalize)) == want
        monkeypatch.undo()
    some = train.select("user", "item").limit(3)
    assert by(bayes.expected(train, some)).items() <= by(bayes.expected(train)).items()


def test_cosines_over_several_blocks(spark, monkeypatch):
    users = spark.createDataFrame([(i, [float(i), 1.0, float(i % 3)]) for i in range(9)] + [(99, [0.0] * 3)], "user long, profile array<double>")
    items = spark.createDataFrame([(i, [1.0, float(i % 4), 0.5]) for i in range(11)] + [(99, [0.0] * 3)], "item long, vector array<double>")
    want = content_based._scored(users, items).collect()
    monkeypatch.setattr(blocks, "BLOCK", 3)
    key = lambda rows: sorted((r["user"], r["item"], round(r["score"], 9)) for r in rows)
    assert key(content_based._scored(users, items).collect()) == key(want) and len(want) == 99
    assert content_based._scored(users.limit(0), items).count() == 0


@pytest.mark.parametrize("n", [1, 3, 50])
def test_first_items_are_those_of_the_dense_table(spark, monkeypatch, n):
    """For users who rated much and little, items that nobody alike rated, and many ties; over one block and several."""
    rows = [(u, i, float(1 + (u * i) % 5)) for u in range(12) for i in range(14) if (u * 7 + i * 3) % 4 == 0 and i % 7 != u % 3] + [(50, 90, 4.0), (51, 91, 2.0), (51, 3, 5.0), (52, 92, 1.0)]
    train = spark.createDataFrame(rows, "user long, item long, rating double")
    vectors_of = spark.createDataFrame([(i, [float(i % 2), float(i % 3), 1.0]) for i in [*range(14), 90, 91]] + [(92, [0.0] * 3)], "item long, vector array<double>")
    parts = bayes.components(train)
    tied = parts.withColumn("parts", F.transform("parts", lambda x: F.struct(x["rating"].alias("rating"), F.round(x["p"], 12).alias("p"))))
    cases = {
        "item_item": (knn.item_item(train), lambda: knn.item_item(train, n=n)), "item_item_bare": (knn.item_item(train, fill=False), lambda: knn.item_item(train, fill=False, n=n)),
        "user_user": (knn.user_user(train), lambda: knn.user_user(train, n=n)), "user_user_bare": (knn.user_user(train, fill=False), lambda: knn.user_user(train, fill=False, n=n)),
        "cosine": (content_based.predict(train, vectors_of), lambda: content_based.predict(train, vectors_of, n)),
        "map": (bayes.most_likely(tied), lambda: bayes.first(train, "map", n)), "mse": (bayes.least_squares(parts), lambda: bayes.first(train, "mse", n)), "mae": (bayes.least_absolute(tied), lambda: bayes.first(train, "mae", n)),
    }
    key = lambda df: sorted((r["user"], r["item"], round(r["prediction"], 8)) for r in df.collect())
    monkeypatch.setattr(blocks, "BLOCK", 5)
    for name, (dense, first) in cases.items():
        assert key(first()) == key(metrics.top_n(dense.withColumn("prediction", F.round("prediction", 9)), n)), name
    dense, first = (factor.als(train, seed=1, n=k).collect() for k in (10**6, n))
    assert {(r["user"], r["item"]): round(r["prediction"], 4) for r in dense} == {(r["user"], r["item"]): round(r["prediction"], 4) for r in factor.als(train, seed=1).collect()}
    order = sorted(dense, key=lambda r: (r["user"], -r["prediction"], r["item"]))
    want = [r for k, r in enumerate(order) if k < n or order[k - n]["user"] != r["user"]]
    assert sorted(map(tuple, first)) == sorted(map(tuple, want))
    assert knn.item_item(train.limit(0), n=n).count() == 0


def test_sparse_vectors_equal_dense_ones(spark):
    """Attribute vectors, profiles with negative ratings or full rows, and cosines of the pairs that share an index."""
    books = spark.createDataFrame([(i, f"a{i % 4}" if i % 5 else None, i % 3, f"only{i}") for i in range(40)] + [(40, None, None, "x"), (3, "a1", 2, "again")], "id int, author string, year int, title string")
    want = sorted((i, [float(f"a{k}" == (f"a{i % 4}" if i % 5 else None)) for k in range(4)] + [float(i % 3 == k) for k in range(3)]) for i in range(40)) + [(3, [0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0])]
    columns = ["author", "year", "title"]
    assert sorted((r["item"], r["vector"]) for r in content.attribute_vectors(books, "id", columns).collect()) == sorted(want)
    wide = content.sparse_attribute_vectors(books, "id", columns)
    assert {len(r["vector"]["indices"]) for r in wide.collect()} == {1, 2} and wide.first()["vector"]["size"] == 7
    dense = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate([[1, 0, 2, 0], [0, 3, 0, 0], [0, 0, 0, 5], [1, 1, 1, 1], [0, 0, 0, 0]])], "item long, vector array<double>")
    thin = dense.select("item", sparse.from_dense(F.col("vector")).alias("vector"))
    assert sorted(map(repr, thin.select("item", sparse.to_dense(F.col("vector")).alias("vector")).collect())) == sorted(map(repr, dense.collect()))
    rated = spark.createDataFrame([(1, 0, 4.0), (1, 1, 2.0), (2, 0, -3.0), (2, 2, 1.0), (3, 3, 5.0), (4, 0, 1.0), (4, 3, 2.0), (4, 1, -1.0), (5, 4, 3.0)], "user long, item long, rating double")
    cells = {(r["user"], r["item"]): round(r["score"], 9) for r in content_based._scored(content_based.profiles(rated, dense), dense).collect()}
    got = {(r["user"], r["item"]): round(r["score"], 9) for r in content_based.sparse_scores(rated, thin).collect()}
    assert got and all(cells[k] == pytest.approx(v, abs=1e-8) for k, v in got.items())
    assert all(v == pytest.approx(0, abs=1e-8) for k, v in cells.items() if k not in got and k[0] == 1)
    assert content.attribute_vectors(books.limit(0), "id", columns).count() == 0


def test_few_pairs_are_made_of_frequent_keys(spark):
    """All users share three items that make nearly all pairs; no close pair is lost without them."""
    rng = np.random.default_rng(6)
    rows = {(u, i) for u in range(120) for i in (0, 1, 2)} | {(u, 10 + (u // 6) * 5 + k) for u in range(120) for k in range(5)} | {(int(u), int(i)) for u, i in zip(rng.integers(0, 120, 200), rng.integers(200, 400, 200), strict=True)} | {(500, 0), (501, 1)}
    rated = spark.createDataFrame([(u, i, float(1 + (u * i * 7 + u) % 5)) for u, i in rows], "user long, item long, rating double")
    for common in (1, 4, 5):
        want = stats.close_pairs(stats.pearson(rated, rated, "user", "item").withColumn("corr", F.round("corr", 9)), 0.1, common)
        got = stats.close_pearson(rated, rated, "user", "item", 0.1, common)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 20
    whole = stats.pearson(rated, rated, "user", "item").count()
    assert whole > 7000 and stats.able_pairs(rated, rated, "user", "item", 5).count() < whole / 10


def test_quartile_is_that_of_all_values(spark):
    rows = spark.createDataFrame([(float(x),) for x in (5, 1, 9, 9, 2, 7)] + [(None,)], "v double")
    for share in (0.0, 0.25, 0.6, 0.75, 1.0):
        want = rows.agg(F.percentile("v", share)).first()[0]
        assert stats.quartile(rows, "v", share).first()["quartile"] == pytest.approx(want)
