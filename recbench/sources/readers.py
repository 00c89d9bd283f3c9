"""Readers: each returns the typed rows of one kind of file."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions.scalars import number, truth
from ..functions.text import ascii_only, genre_flags, mail_address, strip_html, title_and_year
from ..shared import global_rank, written


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str | None = None, sample: float | None = None, seed: int = 41) -> DataFrame:
    """JSON lines, with a schema or its saved JSON, inferred without; a sample of them if asked for."""
    if isinstance(schema, str):
        schema = T.StructType.fromJson(json.loads(schema))
    rows = (spark.read.schema(schema) if schema else spark.read).json(path)
    return rows if sample is None else rows.sample(False, sample, seed)


def _csv(spark: SparkSession, path: str, schema: T.StructType, **options) -> DataFrame:
    return spark.read.options(**options).schema(schema).csv(path)


def movie_ratings(spark: SparkSession, path: str, release: str = "20m") -> DataFrame:
    """release: 20m has a header and commas; 10m and 1m have double colons."""
    return _csv(spark, path, S.RATINGS_CSV, header=True) if release == "20m" else _csv(spark, path, S.RATINGS_CSV, sep="::")


def movie_tags(spark: SparkSession, path: str, release: str = "20m") -> DataFrame:
    return _csv(spark, path, S.TAGS_CSV, header=True, escape='"') if release == "20m" else _csv(spark, path, S.TAGS_CSV, sep="::")


def movies(spark: SparkSession, path: str, links: str | None = None, release: str = "20m", encoding: str = "UTF-8") -> DataFrame:
    """Movies with year and genre flags, and the ids of other sites where a file of links is given."""
    options = {"header": True, "escape": '"'} if release == "20m" else {"sep": "::", "encoding": encoding}
    rows = _csv(spark, path, S.MOVIES_CSV, **options)
    title, year = title_and_year(F.col("title"))
    rows = rows.select("movie_id", title.alias("title"), year.alias("year"), *[c.alias(n) for n, c in genre_flags(F.col("genres")).items()])
    if links is None:
        return rows.withColumns({"imdb_id": F.lit(None).cast("int"), "tmdb_id": F.lit(None).cast("int")})
    ids = _csv(spark, links, S.LINKS_CSV, header=True).select("movie_id", number(F.col("imdb_id"), "int").alias("imdb_id"), number(F.col("tmdb_id"), "int").alias("tmdb_id"))
    return rows.join(ids, "movie_id", "left")


def joke_ratings(wide: DataFrame, user_id: str, columns: list[str]) -> DataFrame:
    """(user_id, joke_id, rating) of a wide table with one column per joke; 99 and 0 mean not rated."""
    cells = wide.select(F.col(user_id).cast("int").alias("user_id"), F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("pos", "rating"))
    return cells.filter("rating is not null and rating != 99 and rating != 0").select("user_id", (F.col("pos") + 1).alias("joke_id"), "rating")


def joke_table(spark: SparkSession, path: str) -> DataFrame:
    """The wide ratings as CSV (column 0 is a count), users numbered in the order of the file's rows."""
    raw = spark.read.option("inferSchema", True).csv(path)
    rows = global_rank(raw.withColumn("_order", F.monotonically_increasing_id()), [F.col("_order")], "user_id")
    return joke_ratings(rows, "user_id", raw.columns[1:])


def jokes(spark: SparkSession, path: str) -> DataFrame:
    """(joke_id, joke_text): blocks between blank lines; the first line is the id and a colon, the rest is HTML."""
    lines = numbered_lines(spark, path).withColumn("value", F.replace("value", F.lit("\r"), F.lit("")))
    rows = _gathered(lines, F.col("value").rlike(r"^\s*$"), False)
    rows = rows.withColumn("block", F.trim(F.array_join("lines", "\n"), F.lit(" \n\t"))).filter(F.col("block").rlike(r"^\d+:"))
    text = F.regexp_replace("block", r"^\d+:\s*", "")
    return rows.select(F.regexp_extract("block", r"^(\d+):", 1).cast("int").alias("joke_id"), F.btrim(F.regexp_replace(strip_html(text), r"\s+", " ")).alias("joke_text"))


def _tsv(spark: SparkSession, path: str, schema: T.StructType, encoding: str = "UTF-8") -> DataFrame:
    return _csv(spark, path, schema, sep="\t", header=True, encoding=encoding, quote="")


def artists(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, S.ARTISTS_TSV).select("artist_id", "name")


def artist_plays(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, S.PLAYS_TSV)


def friends(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, S.FRIENDS_TSV)


def artist_tag_names(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, S.ARTIST_TAGS_TSV, "ISO-8859-1")


def applied_tags(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, S.APPLIED_TAGS_TSV)


def _books(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return _csv(spark, path, schema, sep=";", header=True, escape="\\", encoding="ISO-8859-1")


def book_ratings(spark: SparkSession, path: str) -> DataFrame:
    """A rating of 0 is an implicit one."""
    zero = F.col("rating") == 0
    return _books(spark, path, S.BOOK_RATINGS_CSV).select("user_id", "book_id", F.when(~zero, F.col("rating")).alias("rating"), F.when(zero, F.lit(True)).alias("implicit"))


def books(spark: SparkSession, path: str) -> DataFrame:
    return _books(spark, path, S.BOOKS_CSV).select("book_id", "title", "author", number(F.col("year"), "int").alias("year"), "publisher")


def book_users(spark: SparkSession, path: str) -> DataFrame:
    return _books(spark, path, S.BOOK_USERS_CSV).select("user_id", "location", number(F.col("age"), "int").alias("age"))


def book_cleanup(ratings: DataFrame, books_: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(implicit ratings, explicit ratings, users): ratings of known books by known users, and users with any."""
    kept = ratings.join(books_.select("book_id"), "book_id", "left_semi").join(users.select("user_id"), "user_id", "left_semi")
    implicit = F.coalesce("implicit", F.lit(False))
    return kept.filter(implicit), kept.filter(~implicit), users.join(kept.select("user_id"), "user_id", "left_semi")


def kaggle_scripts(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, S.SCRIPTS_CSV, header=True, multiLine=True, escape='"')


def kaggle_versions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.options(header=True, multiLine=True, escape='"').csv(path)


#: Of a page dump.
PAGE_XML = "id int, ns int, title string, redirect struct<_title: string>, revision array<struct<id: int, parentid: int, timestamp: string, contributor: struct<username: string, id: int>, comment: string, minor: string, text: string>>"


def wiki_revisions(spark: SparkSession, path: str, full_text: bool = False) -> DataFrame:
    """One row per revision, with its page's title, id, name space and redirect."""
    pages = spark.read.format("xml").option("rowTag", "page").schema(PAGE_XML).load(path)
    r = pages.select(F.col("title").alias("article_title"), F.col("id").alias("article_id"), F.col("ns").alias("article_namespace"), F.col("redirect._title").alias("redirect_target"), F.posexplode("revision").alias("position", "r"))
    return r.select(
        "article_title", "article_id", "article_namespace", "redirect_target", "position", F.col("r.id").alias("revision_id"), F.col("r.parentid").alias("parent_id"), "r.timestamp", F.col("r.contributor.username").alias("user_name"),
        F.col("r.contributor.id").alias("user_id"), "r.comment", F.col("r.minor").isNotNull().alias("minor"), (F.col("r.text") if full_text else F.lit(None).cast("string")).alias("full_text"),
    )


def latest_revisions(revisions: DataFrame) -> DataFrame:
    """The last revision of each page; of several at one time the first in the dump."""
    best = Window.partitionBy("article_id").orderBy(F.col("timestamp").desc(), "position")
    return revisions.withColumn("_rn", F.row_number().over(best)).filter("_rn = 1").drop("_rn")


def osm_objects(spark: SparkSession, path: str, tags: list[str]) -> DataFrame:
    """Nodes, ways and relations with the tags asked for, all as text. In a tag's column name, colons are underscores."""
    out = None
    for kind in ("node", "way", "relation"):
        shape = "_id string, _lat string, _lon string, _timestamp string, _version string, _changeset string, _visible string, _user string, _uid string, tag array<struct<_k: string, _v: string>>"
        raw = spark.read.format("xml").option("rowTag", kind).schema(shape).load(path)
        found = F.map_from_entries(F.transform(F.coalesce("tag", F.array().cast("array<struct<_k: string, _v: string>>")), lambda t: F.struct(t["_k"].alias("key"), t["_v"].alias("value"))))
        base = [F.col(f"_{c}").alias(c) for c in ("id", "lat", "lon", "timestamp", "version", "changeset", "visible", "user", "uid")]
        rows = raw.select(*base, F.lit(kind).alias("osm_type"), *[F.element_at(found, F.lit(t)).alias(t.replace(":", "_")) for t in tags])
        out = rows if out is None else out.unionByName(rows)
    return out


def osm_changesets(spark: SparkSession, path: str) -> DataFrame:
    shape = ", ".join(f"_{f.name} string" for f in S.OSM_CHANGESETS)
    return spark.read.format("xml").option("rowTag", "changeset").schema(shape).load(path).select(*[F.col(f"_{name}").alias(name) for name in S.OSM_CHANGESETS.names])


def osm_members(spark: SparkSession, path: str) -> DataFrame:
    """(parent, child, parent_type, child_type): the nodes of ways and the members of relations."""
    ways = spark.read.format("xml").option("rowTag", "way").schema("_id string, nd array<struct<_ref: string>>").load(path)
    ways = ways.select(F.col("_id").alias("parent"), F.explode("nd._ref").alias("child"), F.lit("way").alias("parent_type"), F.lit("node").alias("child_type"))
    relations = spark.read.format("xml").option("rowTag", "relation").schema("_id string, member array<struct<_ref: string, _type: string>>").load(path)
    relations = relations.select(F.col("_id").alias("parent"), F.explode("member").alias("m")).select("parent", F.col("m._ref").alias("child"), F.lit("relation").alias("parent_type"), F.col("m._type").alias("child_type"))
    return ways.unionByName(relations)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, part, number, value) of the lines of text files. A large file is read in byte ranges by several tasks: part is
    where a range begins, and number rises inside it in the file's order."""
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select(F.input_file_name().alias("path"), F.expr("input_file_block_start()").alias("part"), F.monotonically_increasing_id().alias("number"), F.regexp_replace("value", r"\r$", "").alias("value"))


def _in_parts(lines: DataFrame) -> DataFrame:
    """lines with a part; lines without one are each file's only part."""
    return lines if "part" in lines.columns else lines.withColumn("part", F.lit(0).cast("long"))


def _upto() -> WindowSpec:
    """Lines of one range up to each."""
    return Window.partitionBy("path", "part").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)


def _before() -> WindowSpec:
    """Ranges of a file before each."""
    return Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)


def _blocks(lines: DataFrame, starts: F.Column) -> DataFrame:
    """lines with `block`, the number of starts in their file up to each. Sums run inside ranges; from range to range goes one row."""
    marked = _in_parts(lines).withColumn("_start", starts.cast("long"))
    sums = marked.groupBy("path", "part").agg(F.sum("_start").alias("_n"))
    sums = sums.select("path", "part", F.coalesce(F.sum("_n").over(_before()), F.lit(0)).alias("_before"))
    return marked.withColumn("block", F.sum("_start").over(_upto())).join(sums, ["path", "part"]).withColumn("block", F.col("block") + F.col("_before")).drop("_start", "_before")


#: What tasks have of a block: its first line's place, its lines, and whether the block begins and ends there for certain.
PIECES = "path string, part long, number long, lines array<string>, begun boolean, ended boolean"


def _pieces(last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of PIECES from lines (path, part, number, value, marked); see _gathered."""

    def rows(place: pa.RecordBatch, offsets: np.ndarray, values: pa.Array, begun: np.ndarray, ended: np.ndarray) -> pa.RecordBatch:
        lines = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)
        return pa.RecordBatch.from_arrays([*place.select(["path", "part", "number"]).columns, lines, pa.array(begun), pa.array(ended)], ["path", "part", "number", "lines", "begun", "ended"])

    def open_piece(held: list[pa.RecordBatch], begun: bool, ended: bool) -> pa.RecordBatch:
        values = pa.concat_arrays([x.column("value") for x in held])
        return rows(held[0].slice(0, 1), np.array([0, len(values)]), values, np.array([begun]), np.array([ended]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, begun, before = [], False, (None, None, None, False)  # the piece that goes on, and the last line's place and mark
        for batch in batches:
            if not batch.num_rows:
                continue
            path = batch.column("path")
            part, number, marked = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "number", "marked"))
            torn = np.empty(len(part), bool)  # the line before isn't the task's line before
            torn[0] = before[:3] != (path[0].as_py(), part[0], number[0] - 1)
            torn[1:] = (number[1:] != number[:-1] + 1) | (part[1:] != part[:-1]) | pc.not_equal(path[1:], path[:-1]).to_numpy(zero_copy_only=False)
            behind = np.concatenate([[before[3]], marked[:-1]])
            begins, ends = (behind & ~torn, behind) if last else (marked, ~torn)  # of a piece at a line, and of the piece before it
            cuts = np.flatnonzero(torn | begins)
            if not len(cuts):
                held.append(batch)
            else:
                if cuts[0]:
                    held.append(batch.slice(0, cuts[0]))
                if held:
                    yield open_piece(held, begun, ends[cuts[0]])
                if len(cuts) > 1:
                    yield rows(batch.take(pa.array(cuts[:-1])), cuts, batch.column("value"), begins[cuts[:-1]], ends[cuts[1:]])
                held, begun = [batch.slice(cuts[-1])], begins[cuts[-1]]
            before = path[-1].as_py(), part[-1], number[-1], marked[-1]
        if held:
            yield open_piece(held, begun, last and before[3])

    return run


def _gathered(lines: DataFrame, marked: F.Column, last: bool) -> DataFrame:
    """(path, lines) of each block of a file's lines, in order; a marked line is the last of its block, or else the first.

    Tasks put blocks together from lines that follow one another in them, and write them as this is called. Only pieces of
    blocks that may go on elsewhere are shuffled, as a task's first and last ones, not the lines.
    """
    rows = _in_parts(lines).select("path", F.col("part").cast("long").alias("part"), F.col("number").cast("long").alias("number"), "value", F.coalesce(marked, F.lit(False)).alias("marked"))
    pieces, whole = written(rows.mapInArrow(_pieces(last), PIECES), "pieces"), F.col("begun") & F.col("ended")
    torn = _blocks(pieces.filter(~whole), F.col("ended" if last else "begun"))
    if last:
        torn = torn.withColumn("block", F.col("block") - F.col("ended").cast("long"))
    torn = torn.groupBy("path", "block").agg(F.array_sort(F.collect_list(F.struct("part", "number", "lines"))).alias("x"))
    return pieces.filter(whole).select("path", "lines").unionByName(torn.select("path", F.flatten("x.lines").alias("lines")))


def _last(lines: DataFrame, value: F.Column, name: str) -> DataFrame:
    """lines with the last value in their file, up to each, that isn't null; handed on as in _blocks."""
    marked = _in_parts(lines).withColumn(name, value)
    ends = marked.groupBy("path", "part").agg(F.max_by(name, F.when(F.col(name).isNotNull(), F.col("number"))).alias("_end"))
    ends = ends.select("path", "part", F.last("_end", True).over(_before()).alias("_before"))
    return marked.withColumn(name, F.last(name, True).over(_upto())).join(ends, ["path", "part"]).withColumn(name, F.coalesce(name, "_before")).drop("_before")


def git_log(lines: DataFrame) -> DataFrame:
    """(author, author_mail, filename, edit_count) out of `git log --name-only` lines (path, part, number, value).

    A commit's header is a line `author<tab>mail` behind the mark "@@"; the files it touched follow.
    """
    marked = F.col("value").startswith("@@")
    rows = _last(lines, F.when(marked, F.split(F.expr("substring(value, 3)"), "\t")), "head").filter(F.col("head").isNotNull() & ~marked & (F.trim("value") != ""))
    author = rows.select(ascii_only(F.col("head")[0]).alias("author"), mail_address(F.get("head", F.lit(1))).alias("author_mail"), F.trim("value").alias("filename"))
    return author.groupBy("author", "author_mail", "filename").agg(F.count(F.lit(1)).alias("edit_count"))


def git_blame(lines: DataFrame) -> DataFrame:
    """One row per line of a file out of `git blame --line-porcelain` lines (path, part, number, value).

    A block ends with the line's text behind a tab; its first line is the commit and line numbers, the others are
    pairs of name and value.
    """
    text = lambda x: x.startswith("\t")
    rows = _gathered(lines, text(F.col("value")), True).select("path", F.filter("lines", lambda x: x != "").alias("lines"))
    rows = rows.filter(text(F.get("lines", F.size("lines") - 1)) & ~text(F.get("lines", F.lit(0))))
    key = lambda x: F.when(text(x), F.lit("line")).otherwise(F.substring_index(x, " ", 1))
    value = lambda x: F.when(text(x), F.substring(x, 2, F.length(x))).otherwise(F.regexp_replace(x, r"^\S+ ?", ""))
    blocks = rows.select("path", F.get("lines", F.lit(0)).alias("first"), F.map_from_entries(F.transform("lines", lambda x: F.struct(key(x).alias("k"), value(x).alias("v")))).alias("m"))
    m = lambda k: F.element_at("m", F.lit(k))
    head = F.split("first", " ")
    return blocks.select(
        "path", head[0].alias("commit_id"), ascii_only(m("author")).alias("author"), mail_address(m("author-mail")).alias("author_mail"), m("author-time").try_cast("int").alias("author_time"), m("author-tz").try_cast("int").alias("author_timezone"),
        ascii_only(m("committer")).alias("committer"), mail_address(m("committer-mail")).alias("committer_mail"), m("committer-time").try_cast("int").alias("committer_time"), m("committer-tz").try_cast("int").alias("committer_timezone"),
        ascii_only(m("summary")).alias("comment"), m("filename").alias("filename"), F.get(head, F.lit(2)).try_cast("int").alias("line_num"), ascii_only(m("line")).alias("line"),
    )


def category_edges(spark: SparkSession, path: str) -> DataFrame:
    """(parent, child) of the triples that say a category is narrower than another."""
    pattern = r"^<[^>]*/(Category:[^>]*)> <[^>]*core#broader> <[^>]*/(Category:[^>]*)>"
    rows = spark.read.text(path).filter(F.col("value").rlike(pattern))
    return rows.select(F.regexp_extract("value", pattern, 2).alias("parent"), F.regexp_extract("value", pattern, 1).alias("child"))


def word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a word and its numbers."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), " ").alias("p")).filter(F.size("p") > 1)
    return parts.select(F.col("p")[0].alias("word"), F.transform(F.slice("p", 2, F.size("p") - 1), lambda x: x.cast("double")).alias("vector"))


def word_vectors_json(spark: SparkSession, path: str) -> DataFrame:
    """One object of words and arrays."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, array<double>>")).alias("word", "vector"))


def libsvm(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("libsvm").load(path)


def labels(spark: SparkSession, path: str) -> DataFrame:
    """Names of result columns, and whether each is an axis or a group."""
    return _csv(spark, path, S.LABELS_CSV, header=True).select("raw", "label", truth(F.col("axes")).alias("axes"), truth(F.col("groups")).alias("groups"))


def results_csv(spark: SparkSession, path: str, text_columns: list[str] | None = None, line_sep: str = "\r") -> DataFrame:
    """A table of results: axes and groups as truth values, other columns as numbers, null where a cell is none.

    text_columns stay text, by default the names that tell results apart.
    """
    kept = {"dataset", "user_vector", "content_vector", "alg_type", "CF_CB", "raw", "label"} if text_columns is None else set(text_columns)
    raw = spark.read.options(header=True, lineSep=line_sep).csv(path)
    trimmed = {c: F.btrim(F.col(c), F.lit("\r\n")) for c in raw.columns}
    return raw.select(*[(truth(x) if c in ("axes", "groups") else x if c in kept else x.try_cast("double")).alias(c) for c, x in trimmed.items()])
