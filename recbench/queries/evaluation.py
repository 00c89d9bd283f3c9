"""Metrics, statistics and questions to results over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..operators import metrics as M
from ..operators import stats
from ..plans import experiment, explore
from ..shared import written
from . import query
from .recommend import MARKETS, rounded

N = 10
BASE = f"{X.ratings_sql(*MARKETS)}, {X.MEANS_SQL}"
CUT = f"""{BASE},
ranked as (select *, row_number() over (partition by "user" order by prediction desc, item) as rank from predicted),
cut as (select * from ranked where rank <= {N})"""
CONTENT = f"""{CUT}, {X.GENRE_SQL}"""
POPULARITY = f"""{CUT},
popular as (
    select item, case when n = 1 then 1.0 else (n - rank)::double / (n - 1) end as popularity
    from (select item, row_number() over (order by avg(rating) desc, item) as rank, count(*) over () as n from ratings group by item))"""


def parts(spark, d):
    train, test = X.split(X.ratings(spark, d, *MARKETS))
    return train, test, X.mean_predictions(train)


def cut(spark, d):
    train, test = X.split(written(X.ratings(spark, d, *MARKETS), "ratings"))
    return train, test, X.mean_predictions(train, N)


@query("m1_rmse", f"with {BASE} select round(sqrt(avg((prediction - rating) ** 2)), 6) as rmse from predicted join test using (\"user\", item)")
def m1_rmse(spark, d):
    _, test, predicted = parts(spark, d)
    return rounded(M.rmse(test, predicted), "rmse")


@query("m2_mae", f"with {BASE} select round(avg(abs(prediction - rating)), 6) as mae from predicted join test using (\"user\", item)")
def m2_mae(spark, d):
    _, test, predicted = parts(spark, d)
    return rounded(M.mae(test, predicted), "mae")


@query("m19_rmse_by_all", f"with {CUT} select round(sqrt(sum((prediction - rating) ** 2) / count(*)), 6) as rmse from test left join cut using (\"user\", item)")
def m19_rmse_by_all(spark, d):
    _, test, predicted = cut(spark, d)
    return rounded(M.rmse_by_all(test, predicted), "rmse")


@query(
    "m3_rmse_of_arrays",
    f"""with {BASE},
arrays as (select "user", list(rating order by item) as actual, list(prediction order by item) as predicted from predicted join test using ("user", item) group by 1)
select "user", round(sqrt(list_sum(list_transform(list_zip(actual, predicted), lambda x: (x[1] - x[2]) ** 2)) / len(actual)), 6) as rmse from arrays""",
)
def m3_rmse_of_arrays(spark, d):
    _, test, predicted = parts(spark, d)
    by = predicted.join(test, ["user", "item"]).groupBy("user").agg(F.array_sort(F.collect_list(F.struct("item", "rating", "prediction"))).alias("x"))
    rows = by.select("user", F.col("x.rating").alias("actual"), F.col("x.prediction").alias("predicted"))
    return rounded(M.rmse_of_arrays(rows, "actual", "predicted").select("user", "rmse"), "rmse")


LABELS = f"""{BASE},
pairs as (select round_even(rating, 0)::int as actual, round_even(prediction, 0)::int as predicted from predicted join test using ("user", item)),
labels as (select actual as label from pairs union select predicted from pairs),
counted as (
    select label, (select count(*) from pairs where actual = label and predicted = label) as tp,
           (select count(*) from pairs where actual = label) as support, (select count(*) from pairs where predicted = label) as told from labels),
scores as (select label, coalesce(tp::double / nullif(told, 0), 0) as precision, coalesce(tp::double / nullif(support, 0), 0) as recall, support from counted),
full_scores as (select *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) as fscore from scores)"""


@query("m5_label_scores", f"with {LABELS} select label, round(precision, 6) as precision, round(recall, 6) as recall, round(fscore, 6) as fscore, support from full_scores")
def m5_label_scores(spark, d):
    _, test, predicted = parts(spark, d)
    return rounded(M.label_scores(M.rounded_pairs(test, predicted)), "precision", "recall", "fscore")


@query("m4_macro_scores", f"with {LABELS} select round(avg(precision), 6) as precision, round(avg(recall), 6) as recall, round(avg(fscore), 6) as fscore from full_scores")
def m4_macro_scores(spark, d):
    _, test, predicted = parts(spark, d)
    return rounded(M.macro_scores(test, predicted), "precision", "recall", "fscore")


@query(
    "m20_weighted_scores",
    f"""with {LABELS}
select round((select avg((actual = predicted)::int) from pairs), 6) as accuracy, round(sum(precision * support) / sum(support), 6) as weighted_precision,
       round(sum(recall * support) / sum(support), 6) as weighted_recall, round(sum(fscore * support) / sum(support), 6) as weighted_fscore from full_scores""",
)
def m20_weighted_scores(spark, d):
    _, test, predicted = parts(spark, d)
    return rounded(M.weighted_scores(M.rounded_pairs(test, predicted)), "accuracy", "weighted_precision", "weighted_recall", "weighted_fscore")


@query("m7_top_n", f'with {CUT} select "user", item, round(prediction, 6) as prediction from cut')
def m7_top_n(spark, d):
    return rounded(cut(spark, d)[2], "prediction")


@query("m6_precision_at_n", f'with {CUT} select round((select count(*) from cut join test using ("user", item))::double / ((select count(distinct "user") from test) * {N}), 6) as pred_n')
def m6_precision_at_n(spark, d):
    _, test, predicted = parts(spark, d)
    return rounded(M.precision_at(test, predicted, N), "pred_n")


@query(
    "m8_category_diversity",
    f"""with {CONTENT}
select round((select avg(list_sum(vector)) from cut join content using (item)) * (select avg(list_sum(vector)) from content) / (select max(len(vector)) from content), 6) as cat_diversity""",
)
def m8_category_diversity(spark, d):
    return rounded(M.category_diversity(cut(spark, d)[2], X.genre_content(spark, d)), "cat_diversity")


ILS_SQL = """
listed as (select "user", item, vector from cut join content using (item)),
lists as (select a."user", avg(1 - list_cosine_similarity(a.vector, b.vector)) as dist from listed a join listed b on a."user" = b."user" and a.item < b.item group by 1)"""


@query("m9_intra_list", f"""with {CONTENT}, {ILS_SQL} select round(avg(coalesce(dist, 0)), 6) as ils from (select distinct "user" from listed) left join lists using ("user")""")
def m9_intra_list(spark, d):
    return rounded(M.intra_list(cut(spark, d)[2], X.genre_content(spark, d)), "ils")


@query("m10_catalog_coverage", f'with {CUT} select round(100.0 * (select count(*) from cut) / (select count(distinct "user") * count(distinct item) from ratings), 6) as cat_coverage')
def m10_catalog_coverage(spark, d):
    train, test, predicted = cut(spark, d)
    return rounded(M.catalog_coverage(train, test, predicted), "cat_coverage")


@query("m11_item_coverage", f"with {CUT} select round(100.0 * (select count(distinct item) from cut) / (select count(distinct item) from (select item from ratings union all select p_partkey from part)), 6) as item_coverage")
def m11_item_coverage(spark, d):
    train, test, predicted = cut(spark, d)
    return rounded(M.item_coverage(train, test, X.genre_content(spark, d), predicted), "item_coverage")


@query("m12_user_coverage", f'with {CUT} select round(100.0 * (select count(distinct "user") from cut) / (select count(distinct "user") from ratings), 6) as user_coverage')
def m12_user_coverage(spark, d):
    train, test, predicted = cut(spark, d)
    return rounded(M.user_coverage(train, test, predicted), "user_coverage")


@query("m13_prediction_coverage", f'with {CUT} select round(100.0 * (select count(*) from cut join test using ("user", item)) / (select count(*) from test), 6) as pred_coverage')
def m13_prediction_coverage(spark, d):
    _, test, predicted = cut(spark, d)
    return rounded(M.prediction_coverage(test, predicted), "pred_coverage")


SERENDIPITY = f"""{POPULARITY},
hits as (
    select "user", item, row_number() over (partition by "user" order by rating desc, item) as r, count(*) over (partition by "user") as n
    from cut join test using ("user", item) where rating >= 1),
surprise as (select "user", greatest((case when n = 1 then 1.0 else (n - r)::double / (n - 1) end) - popularity, 0) as v from hits join popular using (item))"""


def _means_sql(rows: str, name: str) -> str:
    return f'select round((select avg(v) from {rows}), 6) as overall_{name}, round((select avg(m) from (select avg(v) as m from {rows} group by "user")), 6) as {name}'


@query("m14_serendipity", f"with {SERENDIPITY} {_means_sql('surprise', 'serendipity')}")
def m14_serendipity(spark, d):
    return rounded(M.serendipity(*cut(spark, d)), "overall_serendipity", "serendipity")


NOVELTY = f"""{POPULARITY},
news as (select "user", log2(greatest(popularity, 1e-100)) as v from cut join popular using (item))"""


@query("m15_novelty", f"with {NOVELTY} {_means_sql('news', 'novelty')}")
def m15_novelty(spark, d):
    return rounded(M.novelty(*cut(spark, d)), "overall_novelty", "novelty")


CONTENT_SERENDIPITY = f"""{CONTENT},
near as (
    select c."user", c.item, min(1 - list_cosine_similarity(a.vector, b.vector)) as v
    from cut c join test t on t."user" = c."user" join content a on a.item = c.item join content b on b.item = t.item group by 1, 2)"""


@query("m16_content_serendipity", f"with {CONTENT_SERENDIPITY} {_means_sql('near', 'content_serendipity')}")
def m16_content_serendipity(spark, d):
    _, test, predicted = cut(spark, d)
    return rounded(M.content_serendipity(test, predicted, X.genre_content(spark, d)), "overall_content_serendipity", "content_serendipity")


RANKS = """
ranks as (select "user", min(rank) as a, avg(rank) as b, max(rank) as c from {rows} join test using ("user", item) group by 1)"""


@query("m17_relevant_ranks", f"with {CUT}, {RANKS.format(rows='ranked')} select round(avg(a), 6) as avg_highest_rank, round(avg(b), 6) as avg_mean_rank, round(avg(c), 6) as avg_lowest_rank from ranks")
def m17_relevant_ranks(spark, d):
    _, test, predicted = parts(spark, d)
    return rounded(M.relevant_ranks(test, predicted), "avg_highest_rank", "avg_mean_rank", "avg_lowest_rank")


KEYS = ["rmse", "mae", "pred_n", "cat_diversity", "ils", "cat_coverage", "item_coverage", "user_coverage", "pred_coverage", "serendipity", "content_serendipity", "novelty", "avg_highest_rank", "avg_mean_rank", "avg_lowest_rank"]
SUITE_SQL = f"""with {SERENDIPITY}, {X.GENRE_SQL}, {ILS_SQL}, {RANKS.format(rows='cut')},
news as (select "user", log2(greatest(popularity, 1e-100)) as v from cut join popular using (item)),
near as (
    select c."user", c.item, min(1 - list_cosine_similarity(a.vector, b.vector)) as v
    from cut c join test t on t."user" = c."user" join content a on a.item = c.item join content b on b.item = t.item group by 1, 2)
select round((select sqrt(avg((prediction - rating) ** 2)) from cut join test using ("user", item)), 6) as rmse,
       round((select avg(abs(prediction - rating)) from cut join test using ("user", item)), 6) as mae,
       round((select count(*) from cut join test using ("user", item))::double / ((select count(distinct "user") from test) * {N}), 6) as pred_n,
       round((select avg(list_sum(vector)) from cut join content using (item)) * (select avg(list_sum(vector)) from content) / (select max(len(vector)) from content), 6) as cat_diversity,
       round((select avg(coalesce(dist, 0)) from (select distinct "user" from listed) left join lists using ("user")), 6) as ils,
       round(100.0 * (select count(*) from cut) / (select count(distinct "user") * count(distinct item) from ratings), 6) as cat_coverage,
       round(100.0 * (select count(distinct item) from cut) / (select count(distinct item) from (select item from ratings union all select p_partkey from part)), 6) as item_coverage,
       round(100.0 * (select count(distinct "user") from cut) / (select count(distinct "user") from ratings), 6) as user_coverage,
       round(100.0 * (select count(*) from cut join test using ("user", item)) / (select count(*) from test), 6) as pred_coverage,
       round((select avg(m) from (select avg(v) as m from surprise group by "user")), 6) as serendipity,
       round((select avg(m) from (select avg(v) as m from near group by "user")), 6) as content_serendipity,
       round((select avg(m) from (select avg(v) as m from news group by "user")), 6) as novelty,
       round((select avg(a) from ranks), 6) as avg_highest_rank, round((select avg(b) from ranks), 6) as avg_mean_rank, round((select avg(c) from ranks), 6) as avg_lowest_rank"""


@query("m18_suite", SUITE_SQL)
def m18_suite(spark, d):
    train, test, predicted = cut(spark, d)
    return rounded(M.suite(train, test, predicted, X.genre_content(spark, d), N), *KEYS)


CUSTOMERS = X.ratings_sql()


@query(
    "d1_dataset_stats",
    f"""with {CUSTOMERS}
select count(distinct "user") as users, count(distinct item) as items, count(*) as ratings, min(rating) as rating_min, max(rating) as rating_max, round(avg(rating), 6) as rating_mean,
       round(stddev_pop(rating), 6) as rating_stdev, round(var_pop(rating), 6) as rating_variance, round(count(*)::double / (count(distinct "user") * count(distinct item)), 6) as density from ratings""",
)
def d1_dataset_stats(spark, d):
    return rounded(stats.dataset_stats(*X.split(X.ratings(spark, d))), "rating_mean", "rating_stdev", "rating_variance", "density")


@query(
    "d2_completeness",
    f"""with {CUSTOMERS}
select round(count(*)::double / count(distinct "user"), 6) as per_user, round(count(*)::double / count(distinct item), 6) as per_item, round(count(*)::double / (count(distinct "user") * count(distinct item)), 4) as completeness from ratings""",
)
def d2_completeness(spark, d):
    return rounded(stats.completeness(X.ratings(spark, d)), "per_user", "per_item")


@query("d3_item_means", f"with {CUSTOMERS} select item, round(avg(rating), 6) as mean, count(*) as n from ratings group by 1")
def d3_item_means(spark, d):
    return rounded(stats.item_means(X.ratings(spark, d)), "mean")


@query("d4_user_activity", "select user_id, count(*) as events, count(distinct event_type) as partners from events group by 1")
def d4_user_activity(spark, d):
    return stats.activity(X.table(spark, d, "events"), "user_id", "event_type")


@query("d5_item_activity", "select event_type, count(*) as events, count(distinct user_id) as partners from events group by 1")
def d5_item_activity(spark, d):
    return stats.activity(X.table(spark, d, "events"), "event_type", "user_id")


@query("d6_quartile", "select round(quantile_cont(n, 0.75), 6) as quartile from (select count(*) as n from events group by user_id)")
def d6_quartile(spark, d):
    return rounded(stats.quartile(stats.activity(X.table(spark, d, "events"), "user_id", "event_type"), "events"), "quartile")


@query(
    "d7_histogram",
    "select case when x < -2 then 0 when x >= 3 then 101 else floor((x + 2) / 5.0 * 100)::bigint + 1 end::bigint as bin, count(*) as n from (select log10(value) as x from events where value > 0) group by 1",
)
def d7_histogram(spark, d):
    return stats.histogram(X.table(spark, d, "events").filter("value > 0"), "value", 100, -2, 3, log=True)


@query("d8_share_above", 'select sum((n > 5)::int)::bigint as above, count(*) as "all", round(avg((n > 5)::int), 6) as share from (select count(*) as n from events group by user_id, event_type)')
def d8_share_above(spark, d):
    pairs = X.table(spark, d, "events").groupBy("user_id", "event_type").count()
    return rounded(stats.share_above(pairs, "count", 5), "share")


RESULTS_SQL = """
results as (
    select n_name as dataset, c_mktsegment as user_vector, case when c_nationkey % 2 = 0 then 'CF' else 'CB' end as "CF_CB", 'alg_' || (c_custkey % 3) as alg_type,
           case when c_custkey % 2 = 0 then 5 else 10 end as "N", case when c_custkey % 50 = 0 then 0 else round(abs(c_acctbal) / 1000, 3) end as rmse, round(abs(c_acctbal) / 1500, 3) as mae
    from customer join nation on n_nationkey = c_nationkey)"""


def results(spark, d):
    """Customers as a table of results: nations are data sets, segments user vectors, balances errors."""
    rows = X.table(spark, d, "customer").join(X.table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return rows.select(
        F.col("n_name").alias("dataset"), F.col("c_mktsegment").alias("user_vector"), F.when(F.col("c_nationkey") % 2 == 0, "CF").otherwise("CB").alias("CF_CB"), F.concat(F.lit("alg_"), (F.col("c_custkey") % 3).cast("string")).alias("alg_type"),
        F.when(F.col("c_custkey") % 2 == 0, 5).otherwise(10).alias("N"), F.when(F.col("c_custkey") % 50 == 0, 0.0).otherwise(F.round(F.abs("c_acctbal") / 1000, 3)).alias("rmse"), F.round(F.abs("c_acctbal") / 1500, 3).alias("mae"),
    )


def _half_up(x: str, places: int) -> str:
    """A double as a decimal number of twelve places, rounded halves up, as the query rounds; a product of doubles leaves halves to chance."""
    return f"round(({x})::decimal(38, 12), {places})::double"


LIKERT_RESULTS = RESULTS_SQL.replace("round(abs(c_acctbal) / 1000, 3)", _half_up("abs(c_acctbal) / 1000", 3)).replace("round(abs(c_acctbal) / 1500, 3)", _half_up("abs(c_acctbal) / 1500", 3))


@query(
    "z9_likert",
    f"""with {LIKERT_RESULTS},
ends as (
    select *, min(rmse) filter (rmse <> 0) over g as rl, max(rmse) filter (rmse <> 0) over g as rh, min(mae) filter (rmse <> 0) over g as ml, max(mae) filter (rmse <> 0) over g as mh
    from results window g as (partition by dataset, user_vector))
select dataset, user_vector, rmse, mae, {_half_up('case when rmse = 0 or rl = rh then 3 else (rh - rmse) * (4 / (rh - rl)) + 1 end', 6)} as rmse_adj,
       {_half_up('case when rmse = 0 or ml = mh then 3 else (mh - mae) * (4 / (mh - ml)) + 1 end', 6)} as mae_adj from ends""",
)
def z9_likert(spark, d):
    out = experiment.likert(results(spark, d)).select("dataset", "user_vector", "rmse", "mae", "rmse_adj", "mae_adj")
    return rounded(rounded(out, "rmse_adj", "mae_adj", places=12), "rmse_adj", "mae_adj")  # twelve places first, so that halves don't hang on the last bit


@query("v1_select_run", f"""with {RESULTS_SQL} select dataset, alg_type, rmse, mae from results where "N" = 10 and "CF_CB" = 'CB' and dataset like '%NATION_1%' and user_vector = 'BUILDING'""")
def v1_select_run(spark, d):
    return explore.select_runs(results(spark, d), 10, "CB", "All NATION_1", "BUILDING").select("dataset", "alg_type", "rmse", "mae")


@query("v2_axes", f"with {RESULTS_SQL} select dataset, alg_type, rmse as x, mae as y from results")
def v2_axes(spark, d):
    return explore.axes(results(spark, d), "RMSE", "MAE", {"RMSE": "rmse", "MAE": "mae"})


@query("v3_choices", f"with {RESULTS_SQL} select distinct user_vector from results")
def v3_choices(spark, d):
    return explore.choices(results(spark, d), "user_vector")


@query("v6_columns", f"with {RESULTS_SQL} select dataset, rmse from results")
def v6_columns(spark, d):
    return explore.answer(results(spark, d), "parallel", ["dataset", "rmse", "missing"])


@query("v7_nested", f"""with {RESULTS_SQL} select alg_type as "group", count(*) as n, round(sum(rmse), 3) as s from results group by 1""")
def v7_nested(spark, d):
    nested = explore.answer(results(spark, d), "radar", ["rmse", "mae"])
    rows = F.from_json("rows", "array<struct<rmse: double, mae: double>>")
    return nested.select("group", F.size(rows).cast("long").alias("n"), F.round(F.aggregate(rows, F.lit(0.0), lambda a, x: a + x["rmse"]), 3).alias("s"))


@query("v8_brush", f"with {RESULTS_SQL} select dataset, rmse, mae from results where rmse between 2 and 6 and mae between 1 and 3")
def v8_brush(spark, d):
    return explore.brush(results(spark, d), {"rmse": (2, 6), "mae": (1, 3)}).select("dataset", "rmse", "mae")


@query("v8_extents", f"with {RESULTS_SQL} select dataset, min(rmse) as low, max(rmse) as high from results group by 1")
def v8_extents(spark, d):
    return explore.extents(results(spark, d), "rmse", "dataset")
