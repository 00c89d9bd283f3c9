"""Interaction builders: (user, item, rating) out of each data set's tables. An unknown kind raises ValueError."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ceiling, one_decimal, rating_to_interaction, sign_interaction
from ..shared import global_rank


def _out(rows: DataFrame, user: str | Column, item: str | Column, rating: Column) -> DataFrame:
    as_col = lambda x: F.col(x) if isinstance(x, str) else x
    return rows.select(as_col(user).cast("long").alias("user"), as_col(item).cast("long").alias("item"), rating.cast("double").alias("rating"))


def _unknown(kind: str) -> ValueError:
    return ValueError(f"unknown kind of interaction: {kind!r}")


def ids(values: DataFrame, *columns: str) -> DataFrame:
    """Distinct values with an id from 0 in their order; nulls get none."""
    found = values.select(*columns).distinct()
    for c in columns:
        found = found.filter(F.col(c).isNotNull())
    return global_rank(found, [F.col(c) for c in columns], "id").withColumn("id", F.col("id") - 1)


def counted(rows: DataFrame, user: str, item: str, kind: str) -> DataFrame:
    """num: how often; any: 1; ceil: how often, 5 at most."""
    n = rows.groupBy(user, item).agg(F.count(F.lit(1)).alias("n"))
    ratings = {"num": F.col("n"), "any": F.lit(1.0), "ceil": ceiling(F.col("n"))}
    if kind not in ratings:
        raise _unknown(kind)
    return _out(n, user, item, ratings[kind])


def movies(ratings: DataFrame, kind: str = "ratings") -> DataFrame:
    r = F.col("rating")
    if kind == "ratings":
        return _out(ratings, "user_id", "movie_id", r)
    if kind == "pos_ratings":
        return _out(ratings.filter(r > 3), "user_id", "movie_id", r)
    if kind == "ratings_to_interact":
        return _out(ratings, "user_id", "movie_id", rating_to_interaction(r))
    raise _unknown(kind)


def books(ratings: DataFrame, kind: str = "ratings", book_ids: DataFrame | None = None) -> DataFrame:
    """Book ids are texts and are numbered; ratings of books outside the numbering are left out."""
    book_ids = ids(ratings, "book_id") if book_ids is None else book_ids
    implicit = F.coalesce("implicit", F.lit(False))
    kept = {"positive_interact": implicit | (F.col("rating") > 5), "interacts": implicit, "ratings": F.col("rating").isNotNull()}
    if kind not in kept:
        raise _unknown(kind)
    rows = ratings.filter(kept[kind]).join(book_ids, "book_id")
    return _out(rows, "user_id", "id", F.col("rating") if kind == "ratings" else F.lit(1.0))


def jokes(ratings: DataFrame, kind: str = "ratings") -> DataFrame:
    r = F.col("rating")
    kinds = {"ratings": (ratings, r), "pos_ratings": (ratings.filter(r > 0), r), "ratings_to_interact": (ratings, sign_interaction(r))}
    if kind not in kinds:
        raise _unknown(kind)
    return _out(kinds[kind][0], "user_id", "joke_id", kinds[kind][1])


def plays(rows: DataFrame, kind: str = "num_plays") -> DataFrame:
    kinds = {"num_plays": F.col("plays"), "any_interact": F.lit(1.0), "num_plays_log": F.log10("plays")}
    if kind not in kinds:
        raise _unknown(kind)
    return _out(rows, "user_id", "artist_id", kinds[kind])


def wiki_edits(revisions: DataFrame, year: str = "2015") -> DataFrame:
    """Edits of a year by known users in articles of the main name space that are no redirects."""
    return revisions.filter(F.col("redirect_target").isNull() & (F.col("article_namespace") == 0) & F.col("user_id").isNotNull() & F.col("timestamp").startswith(year))


def wiki(revisions: DataFrame, kind: str = "num_edits", year: str = "2015") -> DataFrame:
    kinds = {"num_edits": "num", "any_interact": "any", "num_edits_ceil": "ceil"}
    if kind not in kinds:
        raise _unknown(kind)
    return counted(wiki_edits(revisions, year), "user_id", "article_id", kinds[kind])


def osm_edits(objects: DataFrame) -> DataFrame:
    return objects.filter("id is not null and uid is not null")


def osm(objects: DataFrame, kind: str = "num_edits") -> DataFrame:
    kinds = {"num_edits": "num", "any_interact": "any", "num_edits_ceil": "ceil"}
    if kind not in kinds:
        raise _unknown(kind)
    return counted(osm_edits(objects), "uid", "id", kinds[kind])


def code(line_authors: DataFrame, line_functions: DataFrame, kind: str = "any_interact") -> DataFrame:
    """Authors and the functions their lines call.

    line_authors: (repo_name, filename, line_num, author, author_mail); line_functions: (repo_name, filename, line_num,
    function). Authors are distinct (name, mail) pairs.
    """
    if kind not in ("any_interact", "num_interact"):
        raise _unknown(kind)
    authors = ids(line_authors, "author", "author_mail").withColumnRenamed("id", "user_id")
    functions = ids(line_functions, "function").withColumnRenamed("id", "function_id")
    rows = line_functions.join(line_authors, ["repo_name", "filename", "line_num"]).join(authors, ["author", "author_mail"]).join(functions, "function")
    return counted(rows, "user_id", "function_id", kind.split("_")[0])


def scripts(script_authors: DataFrame, script_functions: DataFrame, kind: str = "any_interact") -> DataFrame:
    """Authors and the functions their scripts call; script_authors: (script, author), script_functions: (script, function)."""
    if kind not in ("any_interact", "num_interact"):
        raise _unknown(kind)
    functions = ids(script_functions, "function").withColumnRenamed("id", "function_id")
    rows = script_functions.join(script_authors, "script").join(functions, "function")
    return counted(rows, "author", "function_id", kind.split("_")[0])


def forks(scripts_: DataFrame, least: int = 10) -> DataFrame:
    """Authors and the scripts they forked, of parents forked more than `least` times.

    Parents are stored as numbers with one decimal in text; that is matched here.
    """
    children = scripts_.filter("ForkParentScriptVersionId is not null and ForkParentScriptVersionId != ''")
    parents = children.groupBy("ForkParentScriptVersionId").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > least).drop("n")
    known = scripts_.select(one_decimal(F.col("CurrentScriptVersionId").try_cast("double")).alias("ForkParentScriptVersionId"), F.col("Id").alias("parent"))
    rows = children.join(parents, "ForkParentScriptVersionId").select("AuthorUserId", "ForkParentScriptVersionId").join(known, "ForkParentScriptVersionId")
    return _out(rows.select("AuthorUserId", "parent").distinct(), "AuthorUserId", "parent", F.lit(1.0))


def temporal_split(rows: DataFrame, column: str = "timestamp") -> tuple[DataFrame, DataFrame]:
    """(train, test): test are the rows whose ISO time ends in a second of 9."""
    late = F.col(column).like("%9Z")
    return rows.filter(~late), rows.filter(late)
