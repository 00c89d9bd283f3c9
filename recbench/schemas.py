"""Canonical relations, and the schemas of the data sets that can be read."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(), "array<double>": T.ArrayType(T.DoubleType())}


def _struct(spec: str) -> T.StructType:
    """A schema out of "name type, ..."; unlike the session's parser, it needs no session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (part.split() for part in spec.split(", "))])


INTERACTIONS = _struct("user long, item long, rating double")
CONTENT = _struct("item long, vector array<double>")
PREDICTIONS = _struct("user long, item long, prediction double")
WORD_VECTORS = _struct("word string, vector array<double>")

RATINGS_CSV = _struct("user_id int, movie_id int, rating float, timestamp int")
TAGS_CSV = _struct("user_id int, movie_id int, tag string, timestamp int")
MOVIES_CSV = _struct("movie_id int, title string, genres string")
LINKS_CSV = _struct("movie_id int, imdb_id string, tmdb_id string")
BOOK_RATINGS_CSV = _struct("user_id int, book_id string, rating int")
BOOKS_CSV = _struct("book_id string, title string, author string, year string, publisher string, image_s string, image_m string, image_l string")
BOOK_USERS_CSV = _struct("user_id int, location string, age string")
PLAYS_TSV = _struct("user_id int, artist_id int, plays int")
ARTISTS_TSV = _struct("artist_id int, name string, url string, picture_url string")
FRIENDS_TSV = _struct("user_id int, friend_user_id int")
ARTIST_TAGS_TSV = _struct("tag_id int, name string")
APPLIED_TAGS_TSV = _struct("user_id int, artist_id int, tag_id int, day int, month int, year int")
SCRIPTS_CSV = _struct("Id int, ScriptProjectId string, AuthorUserId int, CurrentScriptVersionId string, UrlSlug string, TotalVotes int, TotalViews string, ForkParentScriptVersionId string, FirstScriptVersionId string, IsProjectLanguageTemplate string, ForumTopicId string")
OSM_CHANGESETS = _struct("id string, created_at string, closed_at string, open string, user string, uid string, min_lat string, max_lat string, min_lon string, max_lon string, num_changes string, comments_count string")
EDGES = _struct("parent string, child string")
LABELS_CSV = _struct("raw string, label string, axes string, groups string")
