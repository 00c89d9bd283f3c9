"""Interaction builders, content vectorizers, graphs, geometry and storage over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions.text import GENRES, genre_flags
from ..operators import content as C
from ..operators import content_based, geo, graph
from ..operators import interactions as I
from ..shared import scratch
from ..sources import readers, store
from ..streaming.interactions import running_counts
from . import query
from .recommend import rounded

RATINGS = X.ratings_sql()
OUT = '"user", item, rating'


def _movies(spark, d):
    return X.ratings(spark, d).select(F.col("user").alias("user_id"), F.col("item").alias("movie_id"), "rating")


@query("i1_movie_ratings", f"with {RATINGS} select {OUT} from ratings")
def i1_movie_ratings(spark, d):
    return I.movies(_movies(spark, d))


@query("i2_movie_pos_ratings", f"with {RATINGS} select {OUT} from ratings where rating > 3")
def i2_movie_pos_ratings(spark, d):
    return I.movies(_movies(spark, d), "pos_ratings")


@query("i3_movie_interactions", f'with {RATINGS} select "user", item, case when rating < 3 then -1.0 else 1.0 end::double as rating from ratings')
def i3_movie_interactions(spark, d):
    return I.movies(_movies(spark, d), "ratings_to_interact")


BOOKS = f"""{RATINGS},
book_ratings as (select "user" as user_id, 'b' || item as book_id, case when rating > 1 then rating * 2 end as rating, rating = 1 as implicit from ratings),
book_ids as (select book_id, row_number() over (order by book_id) - 1 as item from (select distinct book_id from book_ratings))"""


def _books(spark, d):
    r = F.col("rating")
    return X.ratings(spark, d).select(F.col("user").alias("user_id"), F.concat(F.lit("b"), F.col("item").cast("string")).alias("book_id"), F.when(r > 1, r * 2).alias("rating"), (r == 1).alias("implicit"))


def _books_sql(where: str, rating: str) -> str:
    return f'with {BOOKS} select user_id as "user", item, {rating}::double as rating from book_ratings join book_ids using (book_id) where {where}'


@query("i4_book_positive", _books_sql("implicit or rating > 5", "1"))
def i4_book_positive(spark, d):
    return I.books(_books(spark, d), "positive_interact")


@query("i5_book_interacts", _books_sql("implicit", "1"))
def i5_book_interacts(spark, d):
    return I.books(_books(spark, d), "interacts")


@query("i6_book_ratings", _books_sql("rating is not null", "rating"))
def i6_book_ratings(spark, d):
    return I.books(_books(spark, d), "ratings")


def _jokes(spark, d, kind):
    return I.jokes(X.ratings(spark, d).select(F.col("user").alias("user_id"), F.col("item").alias("joke_id"), (F.col("rating") - 3).alias("rating")), kind)


@query("i7_joke_ratings", f'with {RATINGS} select "user", item, rating - 3 as rating from ratings')
def i7_joke_ratings(spark, d):
    return _jokes(spark, d, "ratings")


@query("i7_joke_pos_ratings", f'with {RATINGS} select "user", item, rating - 3 as rating from ratings where rating > 3')
def i7_joke_pos_ratings(spark, d):
    return _jokes(spark, d, "pos_ratings")


@query("i7_joke_interactions", f'with {RATINGS} select "user", item, case when rating > 3 then 1.0 else -1.0 end::double as rating from ratings')
def i7_joke_interactions(spark, d):
    return _jokes(spark, d, "ratings_to_interact")


def _plays(spark, d, kind):
    return I.plays(X.counts(spark, d, item="supplier").select(F.col("user").alias("user_id"), F.col("item").alias("artist_id"), F.col("rating").alias("plays")), kind)


COUNTS = X.ratings_sql(item="supplier")


@query("i8_plays", f"with {COUNTS} select {OUT} from counts")
def i8_plays(spark, d):
    return _plays(spark, d, "num_plays")


@query("i9_any_plays", f'with {COUNTS} select "user", item, 1.0::double as rating from counts')
def i9_any_plays(spark, d):
    return _plays(spark, d, "any_interact")


@query("i10_log_plays", f'with {COUNTS} select "user", item, round(log10(rating), 6) as rating from counts')
def i10_log_plays(spark, d):
    return rounded(_plays(spark, d, "num_plays_log"), "rating")


REVISIONS = """
revisions as (
    select user_id, event_id % 97 as article_id, case when event_type = 'signup' then 1 else 0 end as ns, case when event_type = 'error' then 'x' end as redirect,
           strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as timestamp from events),
edits as (select * from revisions where redirect is null and ns = 0 and user_id is not null and timestamp like '2024%')"""


def _revisions(spark, d):
    return X.table(spark, d, "events").select(
        "user_id", (F.col("event_id") % 97).alias("article_id"), F.when(F.col("event_type") == "signup", 1).otherwise(0).alias("article_namespace"), F.when(F.col("event_type") == "error", "x").alias("redirect_target"),
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
    )


@query("i11_wiki_edits", f"with {REVISIONS} select user_id, article_id, timestamp from edits")
def i11_wiki_edits(spark, d):
    return I.wiki_edits(_revisions(spark, d), "2024").select("user_id", "article_id", "timestamp")


def _edits_sql(rating: str) -> str:
    return f'with {REVISIONS} select user_id as "user", article_id as item, {rating}::double as rating from edits group by 1, 2'


@query("i12_wiki_num_edits", _edits_sql("count(*)"))
def i12_wiki_num_edits(spark, d):
    return I.wiki(_revisions(spark, d), "num_edits", "2024")


@query("i12_wiki_any_interact", _edits_sql("1"))
def i12_wiki_any_interact(spark, d):
    return I.wiki(_revisions(spark, d), "any_interact", "2024")


@query("i12_wiki_num_edits_ceil", _edits_sql("least(count(*), 5)"))
def i12_wiki_num_edits_ceil(spark, d):
    return I.wiki(_revisions(spark, d), "num_edits_ceil", "2024")


@query("p2_temporal_split", f"with {REVISIONS} select timestamp like '%9Z' as late, count(*) as n from revisions group by 1")
def p2_temporal_split(spark, d):
    train, test = I.temporal_split(_revisions(spark, d))
    both = train.select(F.lit(False).alias("late")).unionByName(test.select(F.lit(True).alias("late")))
    return both.groupBy("late").agg(F.count(F.lit(1)).alias("n"))


@query("p1_hash_split", f'with {RATINGS} select "user", item, ("user" * 31 + item * 17) % 10 = 0 as held_out from ratings')
def p1_hash_split(spark, d):
    train, test = X.split(X.ratings(spark, d))
    return train.select("user", "item", F.lit(False).alias("held_out")).unionByName(test.select("user", "item", F.lit(True).alias("held_out")))


@query("p1_random_split")
def p1_random_split(spark, d):
    return X.ratings(spark, d).randomSplit([0.9, 0.1], 41)[1]


@query("p3_sample")
def p3_sample(spark, d):
    return X.table(spark, d, "events").sample(False, 0.5, 41)


@query("p8_ids", "select event_type, row_number() over (order by event_type) - 1 as id from (select distinct event_type from events)")
def p8_ids(spark, d):
    return I.ids(X.table(spark, d, "events"), "event_type")


CODE = r"""
lines as (select 'repo' as repo_name, 'f' || conv_id as filename, turn as line_num, role as author, role || '@x' as author_mail, lower(regexp_extract(text, '^\S+')) as function from conversations),
author_ids as (select author, author_mail, row_number() over (order by author, author_mail) - 1 as "user" from (select distinct author, author_mail from lines)),
function_ids as (select function, row_number() over (order by function) - 1 as item from (select distinct function from lines))"""


def _code(spark, d, kind):
    lines = X.table(spark, d, "conversations").select(
        F.lit("repo").alias("repo_name"), F.concat(F.lit("f"), F.col("conv_id").cast("string")).alias("filename"), F.col("turn").alias("line_num"), F.col("role").alias("author"), F.concat("role", F.lit("@x")).alias("author_mail"),
        F.lower(F.regexp_extract("text", r"^\S+", 0)).alias("function"),
    )
    return I.code(lines.drop("function"), lines.drop("author", "author_mail"), kind)


@query("i13_i15_code_any", f'with {CODE} select distinct "user", item, 1.0::double as rating from lines join author_ids using (author, author_mail) join function_ids using (function)')
def i13_i15_code_any(spark, d):
    return _code(spark, d, "any_interact")


@query("i15_code_num", f'with {CODE} select "user", item, count(*)::double as rating from lines join author_ids using (author, author_mail) join function_ids using (function) group by 1, 2')
def i15_code_num(spark, d):
    return _code(spark, d, "num_interact")


@query(
    "i17_script_num",
    r"""with s as (select o_orderkey as script, o_custkey as author, o_orderpriority as function from orders),
ids as (select function, row_number() over (order by function) - 1 as item from (select distinct function from s))
select author as "user", item, count(*)::double as rating from s join ids using (function) group by 1, 2""",
)
def i17_script_num(spark, d):
    s = X.table(spark, d, "orders").select(F.col("o_orderkey").alias("script"), F.col("o_custkey").alias("author"), F.col("o_orderpriority").alias("function"))
    return I.scripts(s.select("script", "author"), s.select("script", "function"), "num_interact")


@query(
    "i18_forks",
    """with s as (select o_orderkey as id, o_custkey as author, (o_orderkey * 7) % 1231 as parent from orders),
popular as (select parent from s group by 1 having count(*) > 10)
select distinct s.author as "user", s.parent as item, 1.0::double as rating from s join popular using (parent) join s k on k.id = s.parent""",
)
def i18_forks(spark, d):
    o = X.table(spark, d, "orders")
    return I.forks(o.select(F.col("o_orderkey").alias("Id"), F.col("o_custkey").alias("AuthorUserId"), F.format_string("%.1f", ((F.col("o_orderkey") * 7) % 1231).cast("double")).alias("ForkParentScriptVersionId"), F.col("o_orderkey").cast("string").alias("CurrentScriptVersionId")))


def _osm_sql(rating: str) -> str:
    return f"""select user_id as "user", event_id % 53 as item, {rating}::double as rating from events where user_id is not null group by 1, 2"""


def _osm(spark, d, kind):
    return I.osm(X.table(spark, d, "events").select(F.col("user_id").alias("uid"), (F.col("event_id") % 53).alias("id")), kind)


@query("i19_osm_num_edits", _osm_sql("count(*)"))
def i19_osm_num_edits(spark, d):
    return _osm(spark, d, "num_edits")


@query("i19_osm_any_interact", _osm_sql("1"))
def i19_osm_any_interact(spark, d):
    return _osm(spark, d, "any_interact")


@query("i19_osm_num_edits_ceil", _osm_sql("least(count(*), 5)"))
def i19_osm_num_edits_ceil(spark, d):
    return _osm(spark, d, "num_edits_ceil")


MOVIE_GENRES = "case p_type when 'ECONOMY' then 'Action|Comedy' when 'LARGE' then 'Film-Noir' when 'MEDIUM' then 'Children|War' when 'PROMO' then 'Sci-Fi|Drama|Western' when 'SMALL' then 'Horror' else '(no genres listed)' end"
GENRE_MARKS = [mark for mark, _ in GENRES]


def _movie_table(spark, d):
    part = X.table(spark, d, "part").select(F.col("p_partkey").alias("movie_id"), F.expr(MOVIE_GENRES).alias("genres"))
    return part.select("movie_id", *[c.alias(n) for n, c in genre_flags(F.col("genres")).items()])


C1_SQL = f"select p_partkey as item, list_transform({GENRE_MARKS!r}, lambda g: contains({MOVIE_GENRES}, g)::double) as vector from part"


@query("c1_genres", C1_SQL)
def c1_genres(spark, d):
    return C.genres(_movie_table(spark, d))


TAGS = """
tagged as (select l_partkey as item, l_returnflag || l_linestatus || o_orderpriority as tag from lineitem join orders on l_orderkey = o_orderkey),
vocabulary as (select list(tag order by n desc, tag) as v from (select tag, count(*) as n from tagged group by 1 order by n desc, tag limit 20)),
tag_sets as (select item, list(distinct tag) as tags from tagged group by 1)"""


def _tags(spark, d):
    rows = X.table(spark, d, "lineitem").join(X.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(F.col("l_partkey").alias("movie_id"), F.concat("l_returnflag", "l_linestatus", "o_orderpriority").alias("tag"))


@query("c2_genres_and_tags", f"with genre_vectors as ({C1_SQL}), {TAGS} select g.item, list_concat(vector, list_transform(v, lambda t: coalesce(list_contains(tags, t), false)::double)) as vector from genre_vectors g cross join vocabulary left join tag_sets s on s.item = g.item")
def c2_genres_and_tags(spark, d):
    return C.genres_and_tags(_movie_table(spark, d), _tags(spark, d), 20)


@query("c5_artist_tags", f"with {TAGS} select item, list_transform(v, lambda t: list_contains(tags, t)::double) as vector from tag_sets cross join vocabulary where len(list_intersect(tags, v)) > 0")
def c5_artist_tags(spark, d):
    return C.artist_tags(_tags(spark, d).select(F.col("movie_id").alias("artist_id"), F.col("tag").alias("tag_id")), 20)


def _vocabulary_sql(column: str) -> str:
    return f"(select list(x order by x) from (select {column} as x from part where {column} is not null group by 1 having count(*) > 5))"


@query(
    "c3_book_content",
    f"""with v as (select {_vocabulary_sql('p_brand')} as a, {_vocabulary_sql('p_type')} as b, {_vocabulary_sql('p_size')} as c),
vectors as (select p_partkey as item, list_concat(list_transform(coalesce(a, []), lambda x: (x = p_brand)::double), list_transform(coalesce(b, []), lambda x: (x = p_type)::double), list_transform(coalesce(c, []), lambda x: (x = p_size)::double)) as vector from part cross join v)
select * from vectors where list_sum(vector) > 0""",
)
def c3_book_content(spark, d):
    return C.attribute_vectors(X.table(spark, d, "part"), "p_partkey", ["p_brand", "p_type", "p_size"])


@query(
    "c3_sparse_content",
    f"""with v as (select {_vocabulary_sql('p_brand')} as a, {_vocabulary_sql('p_type')} as b, {_vocabulary_sql('p_size')} as c),
places as (select p_partkey as item, list_position(coalesce(a, []), p_brand) as i, list_position(coalesce(b, []), p_type) as j, list_position(coalesce(c, []), p_size) as k,
                  coalesce(len(a), 0) as na, coalesce(len(b), 0) as nb, coalesce(len(c), 0) as nc from part cross join v),
vectors as (select item, (na + nb + nc)::bigint as size, list_filter([case when i > 0 then i - 1 end, case when j > 0 then na + j - 1 end, case when k > 0 then na + nb + k - 1 end], lambda x: x is not null)::bigint[] as indices from places)
select item, size, indices, list_transform(indices, lambda x: 1.0::double) as values from vectors where len(indices) > 0""",
)
def c3_sparse_content(spark, d):
    """The vectors of c3_book_content by the places that aren't 0, without a row that holds a vocabulary."""
    return C.sparse_attribute_vectors(X.table(spark, d, "part"), "p_partkey", ["p_brand", "p_type", "p_size"]).select("item", "vector.*")


WORDS = r"""
words as (
    select word, embedding::double[] as vector from (
        select word, (row_number() over (order by word) - 1) % (select count(*) from embeddings) as k
        from (select distinct unnest(string_split(lower(regexp_replace(text, '[^a-zA-Z\s]', '', 'g')), ' ')) as word from benchmark) where word <> '') w
    join (select embedding, row_number() over (order by vec_id) - 1 as k from embeddings) e using (k))"""


def _words(spark, d):
    """The words of the benchmark texts with embeddings as their vectors."""
    words = X.table(spark, d, "benchmark").select(F.explode(F.split(F.lower(F.regexp_replace("text", r"[^a-zA-Z\s]", "")), " ")).alias("word")).filter("word != ''")
    words = I.ids(words, "word").withColumn("k", F.col("id") % X.table(spark, d, "embeddings").count())
    vectors = I.ids(X.table(spark, d, "embeddings"), "vec_id").join(X.table(spark, d, "embeddings"), "vec_id").select(F.col("id").alias("k"), F.col("embedding").cast("array<double>").alias("vector"))
    return words.join(vectors, "k").select("word", "vector")


def _rounded_vector(df):
    return df.withColumn("vector", F.transform("vector", lambda x: F.round(x, 6) + 0.0))


SUM_SQL = """
summed as (select item, pos, sum(v) as s from (select item, unnest(vector) as v, unnest(generate_series(1, len(vector))) as pos from tokens join words using (word)) group by 1, 2),
vectors as (select item, list(round(s, 6) + 0.0 order by pos) as vector from summed group by 1)
select i.item, coalesce(vector, list_transform(generate_series(1, 64), lambda x: 0.0::double)) as vector from items i left join vectors using (item)"""
PUNCT = r"[!-/:-@\[-`{-~]"


@query(
    "c4_joke_vectors",
    rf"""with {WORDS}, items as (select doc_id as item from documents),
tokens as (select doc_id as item, regexp_replace(lower(unnest(regexp_split_to_array(text, '\s+'))), '^{PUNCT}+|{PUNCT}+$', '', 'g') as word from documents), {SUM_SQL}""",
)
def c4_joke_vectors(spark, d):
    jokes = X.table(spark, d, "documents").select(F.col("doc_id").alias("joke_id"), F.col("text").alias("joke_text"))
    return _rounded_vector(C.joke_vectors(jokes, _words(spark, d), 64))


@query(
    "c6_article_vectors",
    rf"""with {WORDS}, items as (select doc_id as item from documents),
plain as (select doc_id as item, trim(regexp_replace(lang || ' ' || replace(text, chr(10), ' '), '{PUNCT}', '', 'g')) as text from documents),
tokens as (select item, lower(word) as word from (select item, unnest(regexp_split_to_array(text, '\s+')) as word from plain) where not starts_with(word, 'http')), {SUM_SQL}""",
)
def c6_article_vectors(spark, d):
    marked = F.concat(F.lit("{{box|{{x}}}}[[Category:"), "lang", F.lit("|"), "source", F.lit("]] "), F.replace("text", F.lit("|"), F.lit("")))
    return _rounded_vector(C.article_vectors(X.table(spark, d, "documents").select(F.col("doc_id").alias("article_id"), marked.alias("full_text")), _words(spark, d), 64))


@query("c8_function_vectors", f"with {WORDS}, ids as (select word, row_number() over (order by word) - 1 as item from words) select item, list_transform(vector, lambda x: round(x, 6) + 0.0) as vector from ids join words using (word) where len(list_filter(vector, lambda x: x <> 0)) > 0")
def c8_function_vectors(spark, d):
    words = _words(spark, d)
    return _rounded_vector(C.function_vectors(I.ids(words.withColumnRenamed("word", "function"), "function"), words))


@query(
    "c7_category_vectors",
    """with edges as (select distinct source, lang from documents),
reach as (select lang, source, 2.0 as n from edges where source in ('src0', 'src1', 'src2')),
dist as (select l.lang, list(coalesce(n, 1e9)::double order by r.source) as m from (select distinct lang from edges) l cross join (values ('src0'), ('src1'), ('src2')) r(source) left join reach using (lang, source) group by 1)
select doc_id as item, list_transform(m, lambda x: round(coalesce((list_max(m) - x) / nullif(list_max(m) - list_min(m), 0), 0), 6)) as vector
from documents join dist using (lang) where lang in (select lang from reach)""",
)
def c7_category_vectors(spark, d):
    docs = X.table(spark, d, "documents")
    edges = docs.select(F.concat(F.lit("Category:"), "source").alias("parent"), F.concat(F.lit("Category:"), "lang").alias("child")).distinct()
    articles = docs.select(F.col("doc_id").alias("article_id"), F.concat(F.lit("[[Category:"), "lang", F.lit("|"), "source", F.lit("]] "), "text").alias("full_text"))
    return _rounded_vector(C.category_vectors(articles, graph.distance_vectors(edges, ["Category:src0", "Category:src1", "Category:src2"])))


OSM_COLUMNS = list(dict.fromkeys(C.OSM_TAGS))


def _objects(spark, d):
    """Events as versions of map objects: an object for each user, a tag for each event type."""
    e = X.table(spark, d, "events")
    tags = {"name": "click", "highway": "view", "shop": "purchase", "railway": "error"}
    cols = [F.when(F.col("event_type") == tags[c], "x").alias(c) if c in tags else F.lit(None).cast("string").alias(c) for c in OSM_COLUMNS]
    kind = F.element_at(F.array(*map(F.lit, C.OSM_KINDS)), (F.col("user_id") % 3 + 1).cast("int")).alias("osm_type")
    return e.select(F.col("user_id").alias("id"), F.col("ts").alias("timestamp"), F.col("event_id").alias("version"), kind, *cols)


PRESENCE_SQL = f"""
latest as (select * from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1),
presence as (
    select user_id as item, list_concat(list_transform({C.OSM_TAGS!r}, lambda t: (case t when 'name' then event_type = 'click' when 'highway' then event_type = 'view' when 'shop' then event_type = 'purchase' when 'railway' then event_type = 'error' else false end)::double),
                                        list_transform([0, 1, 2], lambda k: (user_id % 3 = k)::double)) as vector from latest)"""


@query("c9_osm_presence", f"with {PRESENCE_SQL} select item, vector from presence")
def c9_osm_presence(spark, d):
    return C.osm_presence(_objects(spark, d)).select("item", "vector")


@query(
    "c11_inherit",
    f"""with {X.GENRE_SQL.strip()},
members as (select distinct l_suppkey as parent, l_partkey as child from lineitem),
rows_ as (select item, vector from content union all select m.parent, c.vector from members m join content c on c.item = m.child where m.parent in (select item from content)),
parts as (select item, pos, max(v) as v from (select item, unnest(vector) as v, unnest(generate_series(1, len(vector))) as pos from rows_) group by 1, 2)
select item, list(v order by pos) as vector from parts group by 1""",
)
def c11_inherit(spark, d):
    members = X.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("parent"), F.col("l_partkey").alias("child")).distinct()
    return C.inherit_osm(X.genre_content(spark, d), members)


@query(
    "c12_tf_idf",
    f"""with {X.GENRE_SQL.strip()},
flat as (select item, pos, v, sum(v) over (partition by item) as w from (select item, unnest(vector) as v, unnest(generate_series(1, len(vector))) as pos from content)),
idf as (select pos, case when sum(v) = 0 then 0 else ln((select count(*) from content) / sum(v)) end as i from flat group by 1)
select item, list(round(case when w = 0 then v else v / w end * i, 6) order by pos) as vector from flat join idf using (pos) group by 1""",
)
def c12_tf_idf(spark, d):
    return C.tf_idf(X.genre_content(spark, d)).withColumn("vector", F.transform("vector", lambda x: F.round(x, 6)))


@query(
    "c14_liked_sum",
    f"""with {RATINGS}, {X.GENRE_SQL.strip()},
s as (select "user", pos, sum(v) as v from (select "user", unnest(vector) as v, unnest(generate_series(1, len(vector))) as pos from ratings join content using (item) where rating >= 3.5) group by 1, 2)
select "user", list(v order by pos) as profile from s group by 1""",
)
def c14_liked_sum(spark, d):
    return content_based.liked_sum(X.ratings(spark, d), X.genre_content(spark, d))


HIERARCHY = """
edges as (
    select 'r' || r_regionkey as parent, 'n' || n_nationkey as child from region join nation on n_regionkey = r_regionkey
    union all select 'n' || c_nationkey, 'c' || c_custkey from customer)"""


def _edges(spark, d):
    text = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
    top = X.table(spark, d, "nation").select(text("r", "n_regionkey").alias("parent"), text("n", "n_nationkey").alias("child"))
    top = top.join(X.table(spark, d, "region").select(text("r", "r_regionkey").alias("parent")), "parent", "left_semi")
    return top.unionByName(X.table(spark, d, "customer").select(text("n", "c_nationkey").alias("parent"), text("c", "c_custkey").alias("child")))


@query("g1_distances", f"with recursive {HIERARCHY}, walk as (select 'r' || r_regionkey as root, 'r' || r_regionkey as node, 1 as nodes from region union all select root, child, nodes + 1 from walk join edges on parent = node) select root, node, min(nodes)::bigint as nodes from walk group by 1, 2")
def g1_distances(spark, d):
    return graph.distances(_edges(spark, d), X.table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("root")))


@query("g2_distance_vectors", f"with recursive {HIERARCHY}, walk as (select r as root, r as node, 1 as nodes from (values ('r0'), ('r1')) t(r) union all select root, child, nodes + 1 from walk join edges on parent = node), near as (select root, node, min(nodes) as n from walk group by 1, 2) select c.node as category, list(coalesce(n.n, 1e9)::double order by r.root) as vector from (select distinct node from near) c cross join (values ('r0'), ('r1')) r(root) left join near n on n.root = r.root and n.node = c.node group by 1")
def g2_distance_vectors(spark, d):
    return graph.distance_vectors(_edges(spark, d), ["r0", "r1"])


@query("g3_adjacency", f"with {HIERARCHY}, both_ways as (select parent as name, child as other from edges union select child, parent from edges), ids as (select name, row_number() over (order by name) as id from (select distinct name from both_ways)) select a.id, b.name, list(o.id order by o.id) as neighbours from both_ways b join ids a on a.name = b.name join ids o on o.name = b.other group by 1, 2")
def g3_adjacency(spark, d):
    return graph.adjacency(_edges(spark, d))


@query("g4_reachable", f"with recursive {HIERARCHY}, below as (select 'r1' as node union select child from below join edges on parent = node) select distinct parent, child from edges where parent in (select node from below)")
def g4_reachable(spark, d):
    return graph.reachable(_edges(spark, d), "r1")


@query("g5_shortest_path", f"with {HIERARCHY} select [a.parent, a.child, b.child] as path from edges a join edges b on b.parent = a.child where b.child = 'c7' and a.parent = (select x.parent from edges x join edges y on y.parent = x.child where y.child = 'c7')")
def g5_shortest_path(spark, d):
    edges = _edges(spark, d)
    nation = X.table(spark, d, "customer").filter("c_custkey = 7").join(X.table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).first()
    return graph.shortest_path(edges, f"r{nation['n_regionkey']}", "c7")


@query("f14_clean_edges", f"with {HIERARCHY} select parent, child from edges where parent not in ('r0', 'n1') and child not in ('r0', 'n1')")
def f14_clean_edges(spark, d):
    return graph.clean_edges(_edges(spark, d), ["r0", "n1"])


POLYGONS = [(0, (-500.0, 0.0, 2000.0, 10.0)), (1, (1000.0, 5.0, 5000.0, 20.0)), (2, (0.0, 0.0, 10000.0, 25.0))]


@query(
    "geo_divisions",
    "select c_custkey, " + "case " + " ".join(f"when c_acctbal >= {a} and c_acctbal < {c} and c_nationkey >= {b} and c_nationkey < {e} then {i}" for i, (a, b, c, e) in POLYGONS) + " end as division from customer",
)
def geo_divisions(spark, d):
    corners = [(i, [(a, b), (c, b), (c, e), (a, e)]) for i, (a, b, c, e) in POLYGONS]
    polygons = spark.createDataFrame(corners, "index int, polygon array<struct<x: double, y: double>>")
    points = X.table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("lon"), F.col("c_nationkey").cast("double").alias("lat"))
    return geo.divisions(points, polygons).select("c_custkey", "division")


@query(
    "geo_many_polygons",
    """with plots as (select p_partkey, (p_partkey * 7 % 600)::double as x, (p_partkey * 11 % 400)::double as y, (p_size * (1 + p_partkey % 3 * 4))::double as w, (1 + p_size % 7)::double as h from part),
    places as (select s_suppkey, (s_suppkey * 13 % 620 + 0.5)::double as lon, (s_suppkey * 17 % 410 + 0.5)::double as lat from supplier),
    found as (select s_suppkey, min(p_partkey) as division from places join plots on lon >= x and lon < x + w and lat >= y and lat < y + h and (lon - x) * h + (lat - y) * w < w * h group by 1)
    select s_suppkey, division from places left join found using (s_suppkey)""",
)
def geo_many_polygons(spark, d):
    """A triangle for each part, of many sizes; the first that each supplier's place lies in."""
    plots = X.table(spark, d, "part").selectExpr("p_partkey", "double(p_partkey * 7 % 600) as x", "double(p_partkey * 11 % 400) as y", "double(p_size * (1 + p_partkey % 3 * 4)) as w", "double(1 + p_size % 7) as h")
    polygons = plots.selectExpr("p_partkey as index", "array(struct(x, y), struct(x + w as x, y), struct(x, y + h as y)) as polygon")
    places = X.table(spark, d, "supplier").selectExpr("s_suppkey", "double(s_suppkey * 13 % 620) + 0.5 as lon", "double(s_suppkey * 17 % 410) + 0.5 as lat")
    return geo.divisions(places, polygons, one_hot=False).select("s_suppkey", "division")


@query("k1_ratings_text", f"with {RATINGS} select {OUT} from ratings")
def k1_ratings_text(spark, d):
    path = scratch(spark, "files")
    store.save_ratings_text(X.ratings(spark, d), path, compressed=True)
    return store.load_ratings_text(spark, path)


@query("k2_content_text", f"with {X.GENRE_SQL.strip()} select item, vector from content")
def k2_content_text(spark, d):
    path = scratch(spark, "files")
    store.save_content_text(X.genre_content(spark, d), path)
    return store.load_content_text(spark, path)


@query("k4_k5_save_once", f"with {RATINGS} select count(*) as n from ratings")
def k4_k5_save_once(spark, d):
    path = scratch(spark, "files")
    rows = store.save_once(X.ratings(spark, d), path)
    return store.save_once(rows.limit(0), path).agg(F.count(F.lit(1)).alias("n"))


@query("s1_s2_json_lines", "select event_id, user_id, event_type, value from events")
def s1_s2_json_lines(spark, d):
    rows, path = X.table(spark, d, "events").select("event_id", "user_id", "event_type", "value"), scratch(spark, "files")
    store.save_json(rows, path)
    return readers.json_lines(spark, path, rows.schema.json())


@query("s14_s15_book_cleanup", f"with {BOOKS}, kept as (select * from book_ratings where book_id in (select 'b' || p_partkey from part where p_size > 10) and user_id in (select c_custkey from customer where c_acctbal > 0)) select implicit, count(*) as n, count(distinct user_id) as users from kept group by 1")
def s14_s15_book_cleanup(spark, d):
    known = X.table(spark, d, "part").filter("p_size > 10").select(F.concat(F.lit("b"), F.col("p_partkey").cast("string")).alias("book_id"))
    users = X.table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    implicit, explicit, _ = readers.book_cleanup(_books(spark, d), known, users)
    return implicit.unionByName(explicit).groupBy("implicit").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


@query("s18_latest", "select user_id, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id) as rn from events) where rn = 1")
def s18_latest(spark, d):
    rows = X.table(spark, d, "events").select(F.col("user_id").alias("article_id"), F.col("ts").alias("timestamp"), F.col("event_id").alias("position"))
    return readers.latest_revisions(rows).select(F.col("article_id").alias("user_id"), F.col("position").alias("event_id"))


@query("s11_joke_unpivot", "select c_custkey::int as user_id, joke_id, rating from (select c_custkey, unnest([1, 2, 3]) as joke_id, unnest([c_acctbal, c_nationkey::double, case when c_custkey % 2 = 0 then 99.0 else 1.5 end]) as rating from customer) where rating <> 99 and rating <> 0")
def s11_joke_unpivot(spark, d):
    wide = X.table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("a"), F.col("c_nationkey").alias("b"), F.when(F.col("c_custkey") % 2 == 0, 99.0).otherwise(1.5).alias("c"))
    return readers.joke_ratings(wide, "c_custkey", ["a", "b", "c"])


@query("stream_running_counts", "select date_trunc('hour', ts) as start, user_id as \"user\", event_type as item, count(*)::double as rating from events group by 1, 2, 3")
def stream_running_counts(spark, d):
    return running_counts(X.table(spark, d, "events"), "user_id", "event_type", "ts").withColumn("start", F.col("start").cast("timestamp_ntz"))
