"""All user and content vectors of each data set, made by its name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixtures as X
from ..operators import interactions as I
from ..plans.vectorizers import vectorizer, vectors
from . import SQL, query
from .data import BOOKS, _books, _objects, _revisions, _tags, _words

#: A content vector by the sum of its components, in six places, times their places, from 1.
_MARK = "round(coalesce(list_sum(list_transform(vector, lambda x, i: round(x, 6) * i)), 0), 4) + 0.0"


def _made(dataset: str, frames: dict[str, DataFrame], content: list[str] | None = None) -> DataFrame:
    """(kind, user, item, rating) of every vector of a data set; of content vectors, user is null and rating their mark."""
    known = vectorizer(dataset)
    users, contents = vectors(dataset, frames, list(known.user_vectors), list(known.content_vectors) if content is None else content)
    mark = F.round(F.aggregate(F.transform("vector", lambda x, i: F.round(x, 6) * (i + 1)), F.lit(0.0), lambda a, x: a + x), 4) + 0.0
    rows = [v.select(F.lit(k).alias("kind"), F.col("user").cast("long").alias("user"), F.col("item").cast("long").alias("item"), F.round("rating", 6).alias("rating")) for k, v in users.items()]
    rows += [v.select(F.lit(k).alias("kind"), F.lit(None).cast("long").alias("user"), F.col("item").cast("long").alias("item"), mark.alias("rating")) for k, v in contents.items()]
    return reduce(DataFrame.unionByName, rows)


def _sql(users: dict[str, str], contents: dict[str, str]) -> str:
    told = [f"select '{k}' as kind, \"user\", item, rating from ({sql})" for k, sql in users.items()]
    return " union all ".join([*told, *(f"select '{k}', null, item, {_MARK} from ({sql})" for k, sql in contents.items())])


BOOK_SQL = f"""with {BOOKS}, books as (select i.item, p_brand, p_type, p_size from book_ids i join part on 'b' || p_partkey = book_id),
v as (select {", ".join(f"(select list(x order by x) from (select {c} as x from books group by 1 having count(*) > 5)) as v{k}" for k, c in enumerate(("p_brand", "p_type", "p_size")))}),
vectors as (select item, list_concat(list_transform(coalesce(v0, []), lambda x: (x = p_brand)::double), list_transform(coalesce(v1, []), lambda x: (x = p_type)::double), list_transform(coalesce(v2, []), lambda x: (x = p_size)::double)) as vector from books cross join v)
select * from vectors where list_sum(vector) > 0"""


@query("z3_book_crossing", _sql({"positive_interact": SQL["i4_book_positive"], "interacts": SQL["i5_book_interacts"], "ratings": SQL["i6_book_ratings"]}, {"book_vector": BOOK_SQL}))
def z3_book_crossing(spark, d):
    books = X.table(spark, d, "part").select(F.concat(F.lit("b"), F.col("p_partkey").cast("string")).alias("book_id"), F.col("p_brand").alias("author"), F.col("p_type").alias("publisher"), F.col("p_size").alias("year"))
    return _made("book_crossing", {"ratings": _books(spark, d), "books": books})


@query("z3_jester", _sql({"ratings": SQL["i7_joke_ratings"], "pos_ratings": SQL["i7_joke_pos_ratings"], "ratings_to_interact": SQL["i7_joke_interactions"]}, {"jester_glove": SQL["c4_joke_vectors"]}))
def z3_jester(spark, d):
    ratings = X.ratings(spark, d).select(F.col("user").alias("user_id"), F.col("item").alias("joke_id"), (F.col("rating") - 3).alias("rating"))
    jokes = X.table(spark, d, "documents").select(F.col("doc_id").alias("joke_id"), F.col("text").alias("joke_text"))
    return _made("jester", {"ratings": ratings, "jokes": jokes, "words": _words(spark, d)})


@query("z3_last_fm", _sql({"num_plays": SQL["i8_plays"], "any_interact": SQL["i9_any_plays"], "num_plays_log": SQL["i10_log_plays"]}, {"last_fm_tags": SQL["c5_artist_tags"].replace("limit 20", "limit 150")}))
def z3_last_fm(spark, d):
    plays = X.counts(spark, d, item="supplier").select(F.col("user").alias("user_id"), F.col("item").alias("artist_id"), F.col("rating").alias("plays"))
    return _made("last_fm", {"plays": plays, "applied_tags": _tags(spark, d).select(F.col("movie_id").alias("artist_id"), F.col("tag").alias("tag_id"))})


#: Every source is a top category here, of the labels that its documents have.
CATEGORY_SQL = """with edges as (select distinct source, lang from documents),
tops as (select list(distinct source) as all_sources from documents),
dist as (select l.lang, list((case when e.lang is null then 1e9 else 2.0 end)::double order by 'Category:' || r.source) as m
         from (select distinct lang from edges) l cross join (select distinct source from edges) r left join edges e on e.lang = l.lang and e.source = r.source group by 1)
select doc_id as item, list_transform(m, lambda x: coalesce((list_max(m) - x) / nullif(list_max(m) - list_min(m), 0), 0)) as vector from documents join dist using (lang)"""


@query(
    "z3_wiki",
    _sql({k: SQL[f"i12_wiki_{k}"] for k in ("num_edits", "any_interact", "num_edits_ceil")}, {"category_map": CATEGORY_SQL}),
)
def z3_wiki(spark, d):
    docs = X.table(spark, d, "documents")
    revisions = _revisions(spark, d).withColumn("timestamp", F.regexp_replace("timestamp", "^2024", "2015"))
    edges = docs.select(F.concat(F.lit("Category:"), "source").alias("parent"), F.concat(F.lit("Category:"), "lang").alias("child")).distinct()
    articles = docs.select(F.col("doc_id").alias("article_id"), F.concat(F.lit("[[Category:"), "lang", F.lit("]] "), "text").alias("full_text"))
    tops = docs.select(F.concat(F.lit("Category:"), "source").alias("category")).distinct()
    return _made("wiki_2015", {"revisions": revisions, "latest": articles, "category_edges": edges, "top_categories": tops}, ["category_map"])


@query("z3_osm", _sql({"num_edits": SQL["i19_osm_num_edits"].replace("event_id % 53", "user_id"), "any_interact": SQL["i19_osm_any_interact"].replace("event_id % 53", "user_id"), "num_edits_ceil": SQL["i19_osm_num_edits_ceil"].replace("event_id % 53", "user_id")}, {"osm": f"select * from ({SQL['c9_osm_presence']}) where list_sum(vector) > 0"}))
def z3_osm(spark, d):
    """Here a user's objects are one, named after the user."""
    return _made("osm_local", {"objects": _objects(spark, d).withColumn("uid", F.col("id"))}, ["osm"])


@query("z3_git", _sql({"any_interact": SQL["i13_i15_code_any"], "num_interact": SQL["i15_code_num"]}, {"py2vec": SQL["c8_function_vectors"]}))
def z3_git(spark, d):
    lines = X.table(spark, d, "conversations").select(
        F.lit("repo").alias("repo_name"), F.concat(F.lit("f"), F.col("conv_id").cast("string")).alias("filename"), F.col("turn").alias("line_num"), F.col("role").alias("author"), F.concat("role", F.lit("@x")).alias("author_mail"),
        F.lower(F.regexp_extract("text", r"^\S+", 0)).alias("function"),
    )
    words = _words(spark, d)
    return _made("git", {"line_authors": lines.drop("function"), "line_functions": lines.drop("author", "author_mail"), "functions": I.ids(words.withColumnRenamed("word", "function"), "function"), "words": words})


@query("z3_kaggle", _sql({"any_interact": SQL["i17_script_num"].replace("count(*)::double", "1.0::double"), "num_interact": SQL["i17_script_num"], "forked_interact": SQL["i18_forks"]}, {"py2vec": SQL["c8_function_vectors"]}))
def z3_kaggle(spark, d):
    o, words = X.table(spark, d, "orders"), _words(spark, d)
    s = o.select(F.col("o_orderkey").alias("script"), F.col("o_custkey").alias("author"), F.col("o_orderpriority").alias("function"))
    scripts = o.select(F.col("o_orderkey").alias("Id"), F.col("o_custkey").alias("AuthorUserId"), F.format_string("%.1f", ((F.col("o_orderkey") * 7) % 1231).cast("double")).alias("ForkParentScriptVersionId"), F.col("o_orderkey").cast("string").alias("CurrentScriptVersionId"))
    return _made("kaggle", {"script_authors": s.select("script", "author"), "script_functions": s.select("script", "function"), "scripts": scripts, "functions": I.ids(words.withColumnRenamed("word", "function"), "function"), "words": words})
