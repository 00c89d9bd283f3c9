"""The experiment grid end to end, vectorizers by name, models with a random part by what must hold of them, docstrings."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions.vectors import one_hot, total
from ..operators import bayes, blocks, code, content_based, embeddings, factor, metrics
from ..operators import content as C
from ..plans import explore
from ..plans.experiment import Experiment, consolidate
from ..plans.vectorizers import vectors
from ..shared import scratch, written
from ..sources import readers
from . import query
from .data import PRESENCE_SQL, _objects
from .evaluation import N
from .recommend import MARKETS, SUPPLIERS, _train, rounded


def _tilted(train, content, n):
    """The user's mean, a little higher for items with more marks; the first n items of each user."""
    means = train.groupBy("user").agg(F.array(F.avg("rating")).alias("mean"))
    marks = content.select("item", F.array(total(F.col("vector")) / 100).alias("more"))
    return blocks.cells(blocks.pairs(blocks.blocks(means, "user", "mean", "user"), blocks.blocks(marks, "item", "more", "item")), lambda u, v: u + v.T, n)


def _experiment(spark, d) -> Experiment:
    rated = written(X.ratings(spark, d, *MARKETS), "ratings")
    brands = X.table(spark, d, "part").select(F.col("p_partkey").alias("item"), one_hot(F.col("p_brand"), X.BRANDS[:10]).alias("vector"))
    more = {"means": lambda train: X.mean_predictions(train, N), "tilted": _tilted}
    return Experiment(spark, "parts", {"ratings": rated, "liked": rated.filter("rating > 2")}, {"genres": X.genre_content(spark, d), "brands": brands}, scratch(spark, "grid"), ["means"], ["tilted"], (N,), split=X.split, more=more)


GRID_SQL = f"""with {X.ratings_sql(*MARKETS)},
uv as (select 'ratings' as uv, * from ratings union all select 'liked', * from ratings where rating > 2),
tr as (select * from uv where ("user" * 31 + item * 17) % 10 <> 0), te as (select * from uv where ("user" * 31 + item * 17) % 10 = 0),
mu as (select uv, "user", avg(rating) as mu from tr group by 1, 2), mi as (select uv, item, avg(rating) as mi from tr group by 1, 2),
marks as (select 'genres' as cv, p_partkey as item, (p_type in {tuple(X.TYPES)!r})::int + (p_brand in {tuple(X.BRANDS)!r})::int as s from part union all select 'brands', p_partkey, (p_brand in {tuple(X.BRANDS[:10])!r})::int from part),
preds as (
    select uv, '' as cv, 'means' as alg, "user", item, (mu + mi) / 2 as prediction from mu join mi using (uv)
    union all select uv, cv, 'tilted', "user", item, mu + s::double / 100 from mu cross join marks),
cut as (select * from (select *, row_number() over (partition by uv, cv, alg, "user" order by prediction desc, item) as rank from preds) where rank <= {N}),
hits as (select uv, cv, alg, count(*) as n, sqrt(avg((prediction - rating) ** 2)) as rmse, avg(abs(prediction - rating)) as mae from cut join te using (uv, "user", item) group by all),
sizes as (select uv, count(*) as ratings, count(distinct "user") as users, count(distinct item) as items from uv group by 1),
held as (select uv, count(*) as n, count(distinct "user") as users from te group by 1),
cells as (select uv, cv, alg, count(*) as n, count(distinct "user") as users from cut group by all)
select 'parts' as dataset, uv as user_vector, cv as content_vector, alg as alg_type, case when cv = '' then 'CF' else 'CB' end as "CF_CB", {N} as "N", round(rmse, 6) as rmse, round(mae, 6) as mae,
       round(coalesce(h.n, 0)::double / (t.users * {N}), 6) as pred_n, round(100.0 * coalesce(h.n, 0) / t.n, 6) as pred_coverage, round(100.0 * c.n / (s.users * s.items), 6) as cat_coverage, round(100.0 * c.users / s.users, 6) as user_coverage, s.ratings
from cells c left join hits h using (uv, cv, alg) join sizes s using (uv) join held t using (uv)"""
GRID_KEYS = ["dataset", "user_vector", "content_vector", "alg_type", "CF_CB", "N"]
GRID_VALUES = ["rmse", "mae", "pred_n", "pred_coverage", "cat_coverage", "user_coverage"]


@query("z1_z8_grid", GRID_SQL)
def z1_z8_grid(spark, d):
    """Two user vectors, two content vectors, a recommender of either kind: prepared, predicted, evaluated, gathered."""
    grid = _experiment(spark, d)
    grid.run()
    return rounded(grid.results().select(*GRID_KEYS, *GRID_VALUES, "ratings"), *GRID_VALUES)


@query("z8_consolidated_csv", GRID_SQL)
def z8_consolidated_csv(spark, d):
    """The gathered results as one CSV table, read back with its types."""
    grid, path = _experiment(spark, d), scratch(spark, "consolidated")
    consolidate(rounded(grid.run().select(*GRID_KEYS, *GRID_VALUES, "ratings"), *GRID_VALUES), path)
    out = readers.results_csv(spark, path, line_sep="\n").fillna({"content_vector": ""})
    return out.withColumns({c: F.col(c).cast("long") for c in ("N", "ratings")})


@query("k6_k7_artifacts", "select unnest(['uv_train_ratings', 'uv_test_ratings', 'uv_train_liked', 'uv_test_liked', 'cv_genres', 'cv_brands', 'predictions_ratings_means', 'predictions_liked_genres_tilted', 'results_ratings_means_10', 'results_liked_brands_tilted_10']) as name, true as there")
def k6_k7_artifacts(spark, d):
    """Artifacts under their names, after two runs that make each once."""
    from ..sources import store

    grid = _experiment(spark, d)
    grid.run()
    grid.run()
    names = [("uv_train", "ratings"), ("uv_test", "ratings"), ("uv_train", "liked"), ("uv_test", "liked"), ("cv", "genres"), ("cv", "brands"), ("predictions", "ratings", "means"), ("predictions", "liked", "genres", "tilted"), ("results", "ratings", "means", "10"), ("results", "liked", "brands", "tilted", "10")]
    return spark.createDataFrame([("_".join(x), store.exists(spark, f"{grid.root}/parts_{'_'.join(x)}/_SUCCESS")) for x in names], "name string, there boolean")


@query("z3_vectorizer", f"with {X.ratings_sql()} select 'liked' as kind, \"user\", item, rating from ratings where rating > 3 union all select 'flags', null, p_partkey, (p_size % 2)::double from part")
def z3_vectorizer(spark, d):
    """Of a data set that is known by how its name begins."""
    part, flag = X.table(spark, d, "part"), F.col("p_size") % 2 == 1
    movies = part.select(F.col("p_partkey").alias("movie_id"), *[(flag if name == "drama" else F.lit(False)).alias(f"genre_{name}") for _, name in C.GENRES])
    frames = {"ratings": X.ratings(spark, d).withColumnsRenamed({"user": "user_id", "item": "movie_id"}), "movies": movies}
    users, contents = vectors("movielens_20m", frames, ["pos_ratings"], ["genre"])
    rows = contents["genre"].select(F.lit("flags").alias("kind"), F.lit(None).cast("long").alias("user"), "item", total(F.col("vector")).alias("rating"))
    return users["pos_ratings"].select(F.lit("liked").alias("kind"), "user", "item", "rating").unionByName(rows)


@query("c10_osm_presence_and_divisions", f"with {PRESENCE_SQL} select item, list_concat(vector, list_transform([0, 1, 2], lambda k: (item % 4 = k)::double)) as vector from presence")
def c10_osm_presence_and_divisions(spark, d):
    where = _objects(spark, d).withColumn("lon", (F.col("id").cast("long") % 4 + 0.5).cast("string")).withColumn("lat", F.lit("0.5"))
    squares = spark.createDataFrame([(i, [(float(i), 0.0), (i + 1.0, 0.0), (i + 1.0, 1.0), (float(i), 1.0)]) for i in range(3)], "index int, polygon array<struct<x: double, y: double>>")
    return C.osm_presence_and_divisions(where, squares).select("item", "vector")


@query("v4_configurable_axes", "select 'axis' as kind, row_number() over (order by n_name) - 1 as id, n_name as raw from nation where n_nationkey % 2 = 0 union all select 'group', row_number() over (order by n_name) - 1, n_name from nation where n_nationkey % 3 = 0")
def v4_configurable_axes(spark, d):
    nation = X.table(spark, d, "nation")
    labels = nation.select(F.col("n_name").alias("raw"), F.col("n_name").alias("label"), (F.col("n_nationkey") % 2 == 0).alias("axes"), (F.col("n_nationkey") % 3 == 0).alias("groups"))
    axes, groups = explore.configurable(labels)
    return axes.select(F.lit("axis").alias("kind"), "id", "raw").unionByName(groups.select(F.lit("group").alias("kind"), "id", "raw"))


@query("e5_docstrings", "select doc_id, unnest(['', 'f', 'A', 'm']) as name, unnest(['Of ' || lang, lang || chr(10) || source, 'A class.', 'A method of ' || source]) as docstring from documents")
def e5_docstrings(spark, d):
    q = '"""'
    source = F.concat(F.lit(f"{q}Of "), "lang", F.lit(f"{q}\n\ndef f():\n    {q}"), "lang", F.lit("\n    "), "source", F.lit(f"{q}\n\nclass A:\n    {q}A class.{q}\n\n    def m(self):\n        {q}A method of "), "source", F.lit(f"{q}\n\n    def bare(self):\n        return 1\n"))
    return code.docstrings_of(X.table(spark, d, "documents").select("doc_id", source.alias("source")), "doc_id")


CELLS = "(select count(distinct \"user\") * count(distinct item) from train)"


def _ends(train):
    return train.agg(F.min("rating").alias("low"), F.max("rating").alias("high"), F.avg("rating").alias("mean"))


#: Keys of items that one bitmap covers.
SPAN = 1 << 15


def _bitmaps(predicted):
    """(user, part, bits, n, least, most): which items of a part of all keys a user has, by batches of cells."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            user, item, score = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("user", "item", "prediction"))
            order = np.lexsort((item, user))
            user, item, score = user[order], item[order], score[order]
            part = item // SPAN
            starts = np.flatnonzero(np.concatenate([[True], (user[1:] != user[:-1]) | (part[1:] != part[:-1])]))
            bits = []
            for at, to in zip(starts, [*starts[1:], len(user)], strict=True):
                flags = np.zeros(SPAN, np.uint8)
                flags[item[at:to] - part[at] * SPAN] = 1
                bits.append(zlib.compress(np.packbits(flags).tobytes(), 1))
            sizes = np.diff([*starts, len(user)])
            columns = [user[starts], part[starts], pa.array(bits, pa.binary()), sizes, np.minimum.reduceat(score, starts), np.maximum.reduceat(score, starts)]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], ["user", "part", "bits", "n", "least", "most"])

    return predicted.select("user", "item", "prediction").mapInArrow(run, "user long, part long, bits binary, n long, least double, most double")


def _counted(predicted):
    """One row: number of cells, number of different ones, least and largest prediction. Cells aren't shuffled, but bitmaps of them."""

    def count(batches):
        for batch in batches:
            found = [int(np.unpackbits(np.bitwise_or.reduce([np.frombuffer(zlib.decompress(b), np.uint8) for b in bits])).sum()) for bits in batch.column("bits").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), *[batch.column(c) for c in ("n", "least", "most")]], ["different", "n", "least", "most"])

    parts = _bitmaps(predicted).groupBy("user", "part").agg(F.collect_list("bits").alias("bits"), F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
    counts = parts.mapInArrow(count, "different long, n long, least double, most double")
    return counts.agg(F.sum("n").alias("cells"), F.sum("different").alias("distinct_cells"), F.min("least").alias("least"), F.max("most").alias("most"))


def _inside():
    return (F.col("least") >= F.col("low") - 1e-9) & (F.col("most") <= F.col("high") + 1e-9)


def _plain(train, test):
    return metrics.rmse(test, test.select("user", "item").crossJoin(F.broadcast(_ends(train).select(F.col("mean").alias("prediction"))))).withColumnRenamed("rmse", "plain")


def _errors(predicted, train, test):
    return metrics.rmse(test, predicted).crossJoin(_plain(train, test))


@query("r1_als_holds", f"with {X.ratings_sql(*MARKETS)} select {CELLS} as cells, {CELLS} as distinct_cells, true as in_range, true as finite")
def r1_als_holds(spark, d):
    """ALS says something finite, within the range of ratings, for every user and item, once."""
    train, test = (written(x, name) for x, name in zip(X.split(X.ratings(spark, d, *MARKETS)), ("train", "test"), strict=True))
    model = factor.fit(train)
    errors = metrics.rmse(test, factor.at(test, *model))
    return _counted(factor.everywhere(*model)).crossJoin(_ends(train)).crossJoin(errors).select("cells", "distinct_cells", _inside().alias("in_range"), (F.col("rmse") < 1e6).alias("finite"))


@query("r1_als_planted", "select count(*) > 0 as beats_mean, count(*) > 0 as close from lineitem")
def r1_als_planted(spark, d):
    """Of the pairs that customers bought, rated 5 where both keys are even or both odd and 1 elsewhere, ALS finds the rule."""
    rated = X.ratings(spark, d, *MARKETS).withColumn("rating", F.when((F.col("user") + F.col("item")) % 2 == 0, 5.0).otherwise(1.0))
    train, test = X.split(rated)
    found = _errors(factor.als(train, test, rank=3), train, test)
    return found.select((F.col("rmse") < F.col("plain") / 2).alias("beats_mean"), (F.col("rmse") < 1).alias("close"))


@query("r12_kmeans_tight", "select 10::bigint as clusters, count(*)::bigint as items, true as tighter from part")
def r12_kmeans_tight(spark, d):
    """Ten clusters of the items leave less than nine tenths of the squared distances to the centre of all; clusters at random wouldn't."""
    content = X.genre_content(spark, d)
    spread = lambda key: F.sum(F.col("ss")).alias(key)
    rows = content.join(content_based.cluster(content, 10), "item").select("item", "cluster", F.posexplode("vector").alias("at", "x"))
    within = lambda *keys: rows.groupBy(*keys, "at").agg((F.sum(F.col("x") * F.col("x")) - F.sum("x") * F.sum("x") / F.count(F.lit(1))).alias("ss"))
    sizes = rows.agg(F.countDistinct("cluster").alias("clusters"), F.countDistinct("item").alias("items"))
    return sizes.crossJoin(within("cluster").agg(spread("own"))).crossJoin(within().agg(spread("whole"))).select("clusters", "items", (F.col("own") < 0.9 * F.col("whole")).alias("tighter"))


@query("r15_random_holds", f"with {X.ratings_sql(*SUPPLIERS)} select {CELLS} as cells, true as in_range, true as mean_near_middle, true as same_again")
def r15_random_holds(spark, d):
    """Uniform predictions for every cell, the same ones from the same seed."""
    train, _ = X.split(X.ratings(spark, d, *SUPPLIERS))
    fixed = F.sum(F.floor(F.col("prediction") * 10000))  # whole numbers, whose sum doesn't hang on the order of tasks
    one = factor.random(train).agg(F.count(F.lit(1)).alias("cells"), F.min("prediction").alias("least"), F.max("prediction").alias("most"), F.avg("prediction").alias("mean"), fixed.alias("a"))
    both = one.crossJoin(factor.random(train).agg(fixed.alias("b"))).crossJoin(_ends(train).select("low", "high"))
    return both.select("cells", _inside().alias("in_range"), (F.abs(F.col("mean") - 3) < 0.05).alias("mean_near_middle"), (F.col("a") == F.col("b")).alias("same_again"))


MULTINOMIAL_SQL = f"""with {X.ratings_sql(*MARKETS)},
classes as (select rating, count(*) as n, sum("user")::double as u, sum(item)::double as i from train group by 1),
logs as (select rating, ln((n + 1.0) / (select count(*) + count(distinct rating) from train)) as prior, ln((u + 1) / (u + i + 2)) as lu, ln((i + 1) / (u + i + 2)) as li from classes),
cells as (select * from (select distinct "user" from train) cross join (select distinct item from train))
select "user", item, arg_max(rating, prior + "user" * lu + item * li) as prediction from cells cross join logs group by 1, 2"""


@query("r6_multinomial_exact", MULTINOMIAL_SQL)
def r6_multinomial_exact(spark, d):
    return bayes.multinomial(_train(spark, d, MARKETS))


@query("r12_kmeans_holds", f"with {X.ratings_sql(*MARKETS)} select count(distinct \"user\") as users, true as lists_are_short, true as in_range from train")
def r12_kmeans_holds(spark, d):
    """Each user gets a list, of no more items than the quotas' rounding allows, within the range of ratings."""
    train, _ = X.split(X.ratings(spark, d, *MARKETS))
    out = content_based.predict_by_cluster(train, X.dense_content(spark, d), 10)
    lists = out.groupBy("user").agg(F.count(F.lit(1)).alias("n"), F.min("prediction").alias("lo"), F.max("prediction").alias("hi"))
    return lists.agg(F.count(F.lit(1)).alias("users"), F.min(F.col("n") <= 15).alias("lists_are_short"), F.min((F.col("lo") >= 1 - 1e-9) & (F.col("hi") <= 5 + 1e-9)).alias("in_range"))


WORDS_SQL = r"with words as (select unnest(regexp_extract_all(lower(regexp_replace(text, '[^\x00-\x7f]', 'x', 'g')), '\w+')) as word from documents) select word, {size} as size, true as finite from words group by 1 having count(*) >= {least}"


def _sizes(vectors):
    return vectors.select("word", F.size("vector").alias("size"), (~F.exists("vector", F.isnan)).alias("finite"))


@query("e3_word2vec_holds", WORDS_SQL.format(size=50, least=25))
def e3_word2vec_holds(spark, d):
    """A vector for each word that is frequent enough, and for no other."""
    words = X.table(spark, d, "documents").withColumn("text", F.regexp_replace("text", r"[^\x00-\x7f]", "x"))
    return _sizes(embeddings.train_on_code(words, "text"))


@query("e4_docstring_word2vec_holds", WORDS_SQL.format(size=50, least=20))
def e4_docstring_word2vec_holds(spark, d):
    """As e3, over docstrings; here of lower-case text."""
    docs = X.table(spark, d, "documents").withColumn("docstring", F.lower(F.regexp_replace("text", r"[^\x00-\x7f]", "x")))
    return _sizes(embeddings.train_on_docstrings(docs))


@query("z10_rank_search_holds", "select unnest([3, 5, 7]) as rank, true as has_error")
def z10_rank_search_holds(spark, d):
    found = factor.best_rank(*X.split(X.ratings(spark, d, *SUPPLIERS)))
    return found.select("rank", (F.col("rmse") > 0).alias("has_error"))


@query("p1_p3_random_parts_hold", f"with {X.ratings_sql()} select count(*) as n, 0 as both, true as tenth, true as half, true as same_again from ratings")
def p1_p3_random_parts_hold(spark, d):
    """A random split loses and repeats no row, in about the shares asked for; a sample is about half, the same from the same seed."""
    rows, path = X.ratings(spark, d), scratch(spark, "files")
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    train, test = rows.randomSplit([0.9, 0.1], 41)
    json = scratch(spark, "files")
    rows.write.json(json)
    half, again = (readers.json_lines(spark, json, rows.schema, sample=0.5) for _ in range(2))
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    out = n(train.unionByName(test), "n").crossJoin(n(train.join(test, ["user", "item"]), "both")).crossJoin(n(test, "t")).crossJoin(n(half, "h")).crossJoin(n(half.join(again, ["user", "item"]), "s"))
    share = lambda c, of: F.abs(F.col(c) / F.col("n") - of) < 0.05
    return out.select("n", "both", share("t", 0.1).alias("tenth"), share("h", 0.5).alias("half"), (F.col("s") == F.col("h")).alias("same_again"))
