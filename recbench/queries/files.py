"""Readers: each query writes a file of the kind from the driver's tables, whole, and reads it back."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import text
from ..functions.text import GENRES
from ..shared import scratch
from ..sources import readers, store
from . import query

RATINGS = X.ratings_sql()


def _csv(rows: DataFrame, **options) -> str:
    path = scratch(rows.sparkSession, "files")
    rows.write.options(**options).csv(path)
    return path


def _lines(rows: DataFrame, line: Column, encoding: str | None = None) -> str:
    """One line, or several with line ends between them, for each row, in whatever encoding."""
    path, rows = scratch(rows.sparkSession, "files"), rows.select(line.alias("value"))
    if encoding:
        rows.write.options(sep="\u0001", quote="", encoding=encoding).csv(path)
    else:
        rows.write.text(path)
    return path


#: XML elements of a file.
ELEMENTS = 1 << 14


def _dump(rows: DataFrame, element: Column, root: str) -> str:
    """Files of about ELEMENTS XML elements, four at least, in a root element each."""
    path, n = scratch(rows.sparkSession, "files"), max(4, -(-rows.count() // ELEMENTS))
    parts = rows.select(element.alias("x")).groupBy(F.pmod(F.xxhash64("x"), F.lit(n)).alias("part")).agg(F.array_join(F.collect_list("x"), "\n").alias("all"))
    parts.select("part", F.concat(F.lit(f"<{root}>\n"), "all", F.lit(f"\n</{root}>")).alias("value")).write.partitionBy("part").text(path)
    return path


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def _rated(spark: SparkSession, d: str) -> DataFrame:
    return X.ratings(spark, d).select(F.col("user").cast("int").alias("userId"), F.col("item").cast("int").alias("movieId"), "rating", (F.col("item") + 1_000_000).cast("int").alias("timestamp"))


RATED_SQL = f'with {RATINGS} select "user"::int as user_id, item::int as movie_id, rating, (item + 1000000)::int as timestamp from ratings'


@query("s3_movie_ratings_csv", RATED_SQL)
def s3_movie_ratings_csv(spark, d):
    return readers.movie_ratings(spark, _csv(_rated(spark, d), header=True)).withColumn("rating", F.col("rating").cast("double"))


@query("s4_movie_ratings_colons", RATED_SQL)
def s4_movie_ratings_colons(spark, d):
    rows = _rated(spark, d)
    return readers.movie_ratings(spark, _lines(rows, F.concat_ws("::", *rows.columns)), "10m").withColumn("rating", F.col("rating").cast("double"))


def _tagged(spark: SparkSession, d: str, tag: Column) -> DataFrame:
    return X.table(spark, d, "part").select(F.col("p_size").cast("int").alias("userId"), F.col("p_partkey").cast("int").alias("movieId"), tag.alias("tag"), F.lit(7).alias("timestamp"))


@query("s5_movie_tags_csv", """select p_size::int as user_id, p_partkey::int as movie_id, p_name || ', "' || p_brand || '"' as tag, 7 as timestamp from part""")
def s5_movie_tags_csv(spark, d):
    return readers.movie_tags(spark, _csv(_tagged(spark, d, F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"'))), header=True, escape='"'))


@query("s5_movie_tags_colons", "select p_size::int as user_id, p_partkey::int as movie_id, p_name || ' : ' || p_brand as tag, 7 as timestamp from part")
def s5_movie_tags_colons(spark, d):
    rows = _tagged(spark, d, F.concat("p_name", F.lit(" : "), "p_brand"))
    return readers.movie_tags(spark, _lines(rows, F.concat_ws("::", *rows.columns)), "1m")


def _titled(spark: SparkSession, d: str, title: str) -> DataFrame:
    genres = F.when(F.col("p_size") % 3 == 0, "(no genres listed)").when(F.col("p_size") % 3 == 1, "Action|Sci-Fi").otherwise("Film-Noir|Western")
    whole = F.concat(F.lit(title), "p_name", F.when(F.col("p_size") % 2 == 0, "").otherwise(F.concat(F.lit(" ("), (F.col("p_size") + 1950).cast("string"), F.lit(")"))))
    return X.table(spark, d, "part").select(F.col("p_partkey").cast("int").alias("movieId"), whole.alias("title"), genres.alias("genres"))


def _movies_sql(title: str, more: str) -> str:
    marks = {"action": 1, "scifi": 1, "filmnoir": 2, "western": 2}
    flags = [f"{f'p_size % 3 = {marks[name]}' if name in marks else 'false'} as genre_{name}" for _, name in GENRES]
    return f"select p_partkey::int as movie_id, '{title}' || p_name as title, case when p_size % 2 = 1 then 1950 + p_size end as year, {', '.join(flags)}, p_size % 3 = 0 as genre_none, {more} from part"


@query("s6_movies_and_links", _movies_sql("An Odd, ", "case when p_partkey % 5 <> 0 then (p_partkey + 100)::int end as imdb_id, case when p_partkey % 5 > 1 then p_partkey::int end as tmdb_id"))
def s6_movies_and_links(spark, d):
    part = X.table(spark, d, "part").filter("p_partkey % 5 != 0")
    links = part.select(F.col("p_partkey").alias("movieId"), F.lpad((F.col("p_partkey") + 100).cast("string"), 9, "0").alias("imdbId"), F.when(F.col("p_partkey") % 5 > 1, F.col("p_partkey")).alias("tmdbId"))
    return readers.movies(spark, _csv(_titled(spark, d, "An Odd, "), header=True, escape='"'), _csv(links, header=True))


@query("s7_movies_latin1", _movies_sql("Café ", "null::int as imdb_id, null::int as tmdb_id"))
def s7_movies_latin1(spark, d):
    rows = _titled(spark, d, "Café ")
    return readers.movies(spark, _lines(rows, F.concat_ws("::", *rows.columns), "ISO-8859-1"), release="1m", encoding="ISO-8859-1")


@query("s10_joke_table", """
with users as (select *, row_number() over (order by c_custkey)::int as user_id from customer),
cells as (select user_id, 1 as joke_id, case when c_custkey % 4 = 0 then 99.0 else c_custkey % 7 - 3.5 end as rating from users union all select user_id, 2, case when c_custkey % 3 = 0 then 0.0 else c_nationkey - 9.25 end from users)
select user_id, joke_id, rating::double as rating from cells where rating not in (0, 99)""")  # fmt: skip
def s10_joke_table(spark, d):
    k = F.col("c_custkey")
    rows = X.table(spark, d, "customer").select(k, F.lit(2), F.when(k % 4 == 0, 99.0).otherwise(k % 7 - 3.5), F.when(k % 3 == 0, 0.0).otherwise(F.col("c_nationkey") - 9.25))
    return readers.joke_table(spark, _csv(rows.coalesce(1).sortWithinPartitions("c_custkey").drop("c_custkey")))  # users are numbered by the order of one file


@query("s12_joke_texts", "select p_partkey::int as joke_id, p_name || ' & <' || p_brand || '> said \"' || p_type || '\"' as joke_text from part")
def s12_joke_texts(spark, d):
    joke = F.concat(_text("p_partkey"), F.lit(":\n<p>"), "p_name", F.lit("\n&amp;   &lt;"), "p_brand", F.lit("&gt;<br/> said\r\n<script>x()</script>&quot;"), "p_type", F.lit("&quot;</p>\n"))
    return readers.jokes(spark, _lines(X.table(spark, d, "part"), joke))


def _tsv(rows: DataFrame, encoding: str = "UTF-8") -> str:
    return _csv(rows, sep="\t", header=True, encoding=encoding, quote="")


@query("s13_artists", "select s_suppkey::int as artist_id, s_name || ' \"live\"' as name from supplier")
def s13_artists(spark, d):
    return readers.artists(spark, _tsv(X.table(spark, d, "supplier").select("s_suppkey", F.concat("s_name", F.lit(' "live"')).alias("name"), F.lit("http://u").alias("url"), F.lit("http://p").alias("picture"))))


@query("s13_plays", f'with {X.ratings_sql(item="supplier")} select "user"::int as user_id, item::int as artist_id, rating::int as plays from counts')
def s13_plays(spark, d):
    return readers.artist_plays(spark, _tsv(X.counts(spark, d, item="supplier").withColumn("rating", F.col("rating").cast("int"))))


@query("s13_friends", "select c_custkey::int as user_id, c_nationkey::int as friend_user_id from customer")
def s13_friends(spark, d):
    return readers.friends(spark, _tsv(X.table(spark, d, "customer").select("c_custkey", "c_nationkey")))


@query("s13_tag_names", "select p_partkey::int as tag_id, 'naïve ' || p_name as name from part")
def s13_tag_names(spark, d):
    return readers.artist_tag_names(spark, _tsv(X.table(spark, d, "part").select("p_partkey", F.concat(F.lit("naïve "), "p_name").alias("name")), "ISO-8859-1"))


@query("s13_applied_tags", "select o_custkey::int as user_id, o_orderkey::int as artist_id, 3 as tag_id, day(o_orderdate)::int as day, month(o_orderdate)::int as month, year(o_orderdate)::int as year from orders")
def s13_applied_tags(spark, d):
    on = F.col("o_orderdate")
    return readers.applied_tags(spark, _tsv(X.table(spark, d, "orders").select("o_custkey", "o_orderkey", F.lit(3).alias("tag"), F.dayofmonth(on).alias("day"), F.month(on).alias("month"), F.year(on).alias("year"))))


def _books(rows: DataFrame) -> str:
    return _csv(rows, sep=";", header=True, quoteAll=True, escape="\\", encoding="ISO-8859-1", nullValue="NULL")


@query("s14_book_ratings", f"""with {RATINGS} select "user"::int as user_id, 'b' || item as book_id, case when rating > 1 then rating::int end as rating, case when rating = 1 then true end as implicit from ratings""")
def s14_book_ratings(spark, d):
    told = F.when(F.col("rating") > 1, F.col("rating").cast("int")).otherwise(0)
    return readers.book_ratings(spark, _books(X.ratings(spark, d).select("user", F.concat(F.lit("b"), _text("item")), told.alias("rating"))))


@query("s14_books", """select 'b' || p_partkey as book_id, 'Ünder; "' || p_name || '"' as title, p_brand as author, case when p_size % 4 > 0 then 1900 + p_size end as year, p_type as publisher from part""")
def s14_books(spark, d):
    year = F.when(F.col("p_size") % 4 == 0, "n/a").otherwise((F.col("p_size") + 1900).cast("string"))
    rows = X.table(spark, d, "part").select(F.concat(F.lit("b"), _text("p_partkey")).alias("id"), F.concat(F.lit('Ünder; "'), "p_name", F.lit('"')).alias("title"), "p_brand", year.alias("year"), "p_type", *[F.lit(f"http://{x}").alias(x) for x in "sml"])
    return readers.books(spark, _books(rows))


@query("s14_book_users", "select c_custkey::int as user_id, c_mktsegment || ', here' as location, case when c_nationkey % 2 = 0 then 20 + c_nationkey::int end as age from customer")
def s14_book_users(spark, d):
    age = F.when(F.col("c_nationkey") % 2 == 0, (F.col("c_nationkey") + 20).cast("string"))
    return readers.book_users(spark, _books(X.table(spark, d, "customer").select("c_custkey", F.concat("c_mktsegment", F.lit(", here")).alias("l"), age.alias("age"))))


@query("s16_kaggle_scripts", """select o_orderkey::int as "Id", o_custkey::int as "AuthorUserId", o_orderpriority || chr(10) || 'say "' || o_orderstatus || '"' as "UrlSlug", (o_orderkey % 9)::int as "TotalVotes", case when o_orderkey % 2 = 0 then (o_orderkey - 1)::varchar end as "ForkParentScriptVersionId" from orders""")
def s16_kaggle_scripts(spark, d):
    k, none = F.col("o_orderkey"), F.lit(None).cast("string")
    slug = F.concat("o_orderpriority", F.lit('\nsay "'), "o_orderstatus", F.lit('"'))
    rows = X.table(spark, d, "orders").select(k.alias("Id"), none.alias("ScriptProjectId"), F.col("o_custkey").alias("AuthorUserId"), none.alias("CurrentScriptVersionId"), slug.alias("UrlSlug"), (k % 9).alias("TotalVotes"), none.alias("TotalViews"), F.when(k % 2 == 0, k - 1).alias("ForkParentScriptVersionId"), *[none.alias(x) for x in ("FirstScriptVersionId", "IsProjectLanguageTemplate", "ForumTopicId")])
    return readers.kaggle_scripts(spark, _csv(rows, header=True, escape='"')).select("Id", "AuthorUserId", "UrlSlug", "TotalVotes", "ForkParentScriptVersionId")


@query("s16_kaggle_versions", """select o_orderkey::varchar as "Id", 'import x' || chr(10) || 'print("' || o_orderstatus || '", 1)' as "ScriptContent" from orders""")
def s16_kaggle_versions(spark, d):
    code = F.concat(F.lit('import x\nprint("'), "o_orderstatus", F.lit('", 1)'))
    return readers.kaggle_versions(spark, _csv(X.table(spark, d, "orders").select(F.col("o_orderkey").alias("Id"), code.alias("ScriptContent")), header=True, escape='"'))


def _escaped(column: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        column = F.replace(column, F.lit(char), F.lit(name))
    return column


@query("s17_wiki_revisions", """
select 'Page & ' || c_name as article_title, c_custkey::int as article_id, (c_nationkey % 3)::int as article_namespace, case when c_nationkey % 5 = 0 then 'Else' end as redirect_target,
       (row_number() over (partition by c_custkey order by o_orderkey) - 1)::int as position, o_orderkey::int as revision_id, strftime(o_orderdate, '%Y-%m-%dT00:00:00Z') as timestamp,
       case when o_orderkey % 3 > 0 then 'u<' || o_orderstatus || '>' end as user_name, case when o_orderkey % 3 > 0 then (o_orderkey % 50)::int end as user_id, o_orderkey % 2 = 0 as minor, o_orderpriority || ' & more' as full_text
from customer join orders on o_custkey = c_custkey""")  # fmt: skip
def s17_wiki_revisions(spark, d):
    k = F.col("o_orderkey")
    who = F.when(k % 3 == 0, "<ip>1.2.3.4</ip>").otherwise(F.concat(F.lit("<username>u&lt;"), "o_orderstatus", F.lit("&gt;</username><id>"), (k % 50).cast("string"), F.lit("</id>")))
    revision = F.concat(F.lit("<revision><id>"), k.cast("string"), F.lit("</id><timestamp>"), F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00'Z'"), F.lit("</timestamp><contributor>"), who, F.lit("</contributor>"), F.when(k % 2 == 0, "<minor/>").otherwise(""), F.lit("<text>"), _escaped(F.concat("o_orderpriority", F.lit(" & more"))), F.lit("</text></revision>"))
    orders = X.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("o_orderkey", revision.alias("r"))))["r"], "\n").alias("all"))
    head = F.concat(F.lit("<page>\n<title>"), _escaped(F.concat(F.lit("Page & "), "c_name")), F.lit("</title><ns>"), (F.col("c_nationkey") % 3).cast("string"), F.lit("</ns><id>"), _text("c_custkey"), F.lit("</id>"), F.when(F.col("c_nationkey") % 5 == 0, '<redirect title="Else"/>').otherwise(""))
    pages = X.table(spark, d, "customer").join(orders, "c_custkey")
    return readers.wiki_revisions(spark, _dump(pages, F.concat(head, "all", F.lit("\n</page>")), "mediawiki"), full_text=True).drop("parent_id", "comment")


def _map_dump(spark: SparkSession, d: str) -> str:
    """Suppliers as nodes, orders as ways through two of them, customers as relations of an order each."""
    a = lambda name, value: F.concat(F.lit(f' {name}="'), value.cast("string"), F.lit('"'))
    k, o, c = F.col("s_suppkey"), F.col("o_orderkey"), F.col("c_custkey")
    node = F.concat(F.lit("<node"), a("id", k), a("lat", k % 90), a("lon", F.col("s_nationkey")), a("uid", k % 7), F.lit(' timestamp="t" version="1"><tag k="addr:city" v="C '), "s_name", F.lit('"/><tag k="other" v="x"/></node>'))
    way = F.concat(F.lit("<way"), a("id", o), a("uid", F.col("o_custkey")), F.lit(' timestamp="t"><nd'), a("ref", o % 5), F.lit("/><nd"), a("ref", o % 7), F.lit("/></way>"))
    relation = F.concat(F.lit("<relation"), a("id", c), F.lit(' timestamp="t"><member type="way"'), a("ref", c + 1), F.lit(' role=""/><member type="node"'), a("ref", F.col("c_nationkey")), F.lit("/></relation>\n<changeset"), a("id", c), a("num_changes", F.col("c_nationkey")), F.lit(' open="false"/>'))
    rows = X.table(spark, d, "supplier").select(node.alias("x")).unionByName(X.table(spark, d, "orders").select(way.alias("x"))).unionByName(X.table(spark, d, "customer").select(relation.alias("x")))
    return _dump(rows, F.col("x"), "osm")


@query("s19_map_objects", """
select s_suppkey::varchar as id, 'node' as osm_type, (s_suppkey % 90)::varchar as lat, s_nationkey::varchar as lon, (s_suppkey % 7)::varchar as uid, 'C ' || s_name as addr_city from supplier
union all select o_orderkey::varchar, 'way', null, null, o_custkey::varchar, null from orders union all select c_custkey::varchar, 'relation', null, null, null, null from customer""")  # fmt: skip
def s19_map_objects(spark, d):
    return readers.osm_objects(spark, _map_dump(spark, d), ["addr:city"]).select("id", "osm_type", "lat", "lon", "uid", "addr_city")


@query("s19_map_members", """
select o_orderkey::varchar as parent, (o_orderkey % 5)::varchar as child, 'way' as parent_type, 'node' as child_type from orders union all select o_orderkey::varchar, (o_orderkey % 7)::varchar, 'way', 'node' from orders
union all select c_custkey::varchar, (c_custkey + 1)::varchar, 'relation', 'way' from customer union all select c_custkey::varchar, c_nationkey::varchar, 'relation', 'node' from customer""")  # fmt: skip
def s19_map_members(spark, d):
    return readers.osm_members(spark, _map_dump(spark, d))


@query("s19_changesets", "select c_custkey::varchar as id, c_nationkey::varchar as num_changes, 'false' as open from customer")
def s19_changesets(spark, d):
    return readers.osm_changesets(spark, _map_dump(spark, d)).select("id", "num_changes", "open")


@query("s20_git_blame", """
select o_orderkey::varchar as commit_id, 'Ann ' || o_orderstatus as author, 'a' || o_custkey || '@x' as author_mail, (o_orderkey + 5)::int as author_time, -200 as author_timezone, 'Bob' as committer, 'b@x' as committer_mail, 6 as committer_time, 100 as committer_timezone,
       o_orderpriority as comment, 'f.py' as filename, (o_orderkey % 90)::int as line_num, '  x = ' || o_orderkey as line from orders""")  # fmt: skip
def s20_git_blame(spark, d):
    k = _text("o_orderkey")
    block = F.concat(k, F.lit(" 1 "), (F.col("o_orderkey") % 90).cast("string"), F.lit(" 1\nauthor Ann é"), "o_orderstatus", F.lit("\nauthor-mail <a"), _text("o_custkey"), F.lit("@x>\nauthor-time "), (F.col("o_orderkey") + 5).cast("string"), F.lit("\nauthor-tz -0200\ncommitter Bob\ncommitter-mail <b@x>\ncommitter-time 6\ncommitter-tz +0100\nsummary "), "o_orderpriority", F.lit("\nfilename f.py\n\t  x = "), k)
    return readers.git_blame(readers.numbered_lines(spark, _lines(X.table(spark, d, "orders"), block))).drop("path")


@query("s22_git_log", "select 'Ann ' || o_orderstatus as author, 'a@' || o_orderstatus as author_mail, f as filename, count(*) as edit_count from orders, lateral (select unnest(['p' || (o_custkey % 20) || '.py', 'all.py']) as f) group by all")
def s22_git_log(spark, d):
    commit = F.concat(F.lit("@@Ann "), "o_orderstatus", F.lit("\t<a@"), "o_orderstatus", F.lit(">\n\np"), (F.col("o_custkey") % 20).cast("string"), F.lit(".py\nall.py"))
    return readers.git_log(readers.numbered_lines(spark, _lines(X.table(spark, d, "orders"), commit)))


@query("s24_category_edges", "select 'Category:' || n_name as parent, 'Category:c' || c_custkey as child from customer join nation on c_nationkey = n_nationkey")
def s24_category_edges(spark, d):
    rows = X.table(spark, d, "customer").join(X.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    node = lambda *x: F.concat(F.lit("<http://x/resource/"), *x, F.lit(">"))
    child, parent = F.concat(F.lit("Category:c"), _text("c_custkey")), F.concat(F.lit("Category:"), "n_name")
    told = F.concat_ws(" ", node(child), F.lit("<http://y/core#broader>"), node(parent), F.lit(".\n"))
    other = F.concat_ws(" ", node(child), F.lit("<http://y/core#prefLabel>"), node(parent), F.lit(".\n"))
    apart = F.concat_ws(" ", node(F.lit("Thing")), F.lit("<http://y/core#broader>"), node(parent), F.lit("."))
    return readers.category_edges(spark, _lines(rows, F.concat(told, other, apart)))


@query("s25_word_vectors", "select 'w' || vec_id as word, embedding::double[] as vector from embeddings")
def s25_word_vectors(spark, d):
    rows = X.dense_content(spark, d)
    return readers.word_vectors(spark, _lines(rows, F.concat(F.lit("w"), _text("item"), F.lit(" "), F.array_join(F.transform("vector", lambda x: x.cast("string")), " "))))


@query("s26_word_vectors_json", "select 'w' || vec_id as word, embedding::double[] as vector from embeddings")
def s26_word_vectors_json(spark, d):
    words = X.dense_content(spark, d).select(F.concat(F.lit("w"), _text("item")).alias("word"), "vector", (F.col("item") % 16).alias("part"))
    objects, path = words.groupBy("part").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("word", "vector")))).alias("value")), scratch(spark, "files")
    objects.write.partitionBy("part").text(path)  # a file for each object
    return readers.word_vectors_json(spark, path)


@query("s27_libsvm", "select (vec_id % 2)::double as label, embedding::double[] as vector from embeddings")
def s27_libsvm(spark, d):
    rows = X.dense_content(spark, d)
    line = F.concat((F.col("item") % 2).cast("string"), F.lit(" "), F.array_join(F.transform("vector", lambda x, i: F.concat((i + 1).cast("string"), F.lit(":"), x.cast("string"))), " "))
    return readers.libsvm(spark, _lines(rows, line)).select("label", vector_to_array("features").alias("vector"))


@query("s28_results_csv", "select p_name as alg_type, p_partkey::double as \"N\", p_retailprice as rmse, case when p_size % 2 = 0 then p_size::double end as mae, p_size % 2 = 0 as axes from part")
def s28_results_csv(spark, d):
    rows = X.table(spark, d, "part")
    lines = F.concat_ws(",", "p_name", _text("p_partkey"), _text("p_retailprice"), F.when(F.col("p_size") % 2 == 0, _text("p_size")).otherwise("-"), F.when(F.col("p_size") % 2 == 0, "TRUE").otherwise("no"))
    path = scratch(spark, "files")
    one = rows.select(F.concat(F.lit("alg_type,N,rmse,mae,axes\r"), F.array_join(F.array_sort(F.collect_list(lines)), "\r")).alias("value"))
    one.write.options(lineSep="\r").text(path)  # one file with one header, as people save it
    return readers.results_csv(spark, path, text_columns=["alg_type"])


@query("s28_labels", "select 'm' || n_nationkey as raw, n_name as label, n_nationkey % 2 = 0 as axes, n_nationkey % 3 = 0 as \"groups\" from nation")
def s28_labels(spark, d):
    told = lambda n: F.when(F.col("n_nationkey") % n == 0, "true").otherwise("No")
    rows = X.table(spark, d, "nation").select(F.concat(F.lit("m"), _text("n_nationkey")).alias("raw"), F.col("n_name").alias("label"), told(2).alias("axes"), told(3).alias("groups"))
    return readers.labels(spark, _csv(rows, header=True))


@query("s21_x27_decode", "select doc_id, case when doc_id % 2 = 0 then text else lang || 'é' end as text, 'ascii ' || lang as other from documents")
def s21_x27_decode(spark, d):
    latin = F.encode(F.concat("lang", F.lit("é")), "ISO-8859-1")
    raw = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(latin)
    return X.table(spark, d, "documents").select("doc_id", text.decode(raw).alias("text"), text.decode(F.encode(F.concat(F.lit("ascii "), "lang"), "US-ASCII")).alias("other"))


@query("k8_word_vectors", "select 'w' || vec_id as word, embedding::double[] as vector from embeddings")
def k8_word_vectors(spark, d):
    path = scratch(spark, "files")
    store.save_word_vectors(X.dense_content(spark, d).select(F.concat(F.lit("w"), _text("item")).alias("word"), "vector"), path)
    return store.load_word_vectors(spark, path)
