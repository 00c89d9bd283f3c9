"""Which user and content vectors a data set has, by its name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import not_zero
from ..operators import content as C
from ..operators import graph
from ..operators import interactions as I

Frames = dict[str, DataFrame]


@dataclass(frozen=True)
class Vectorizer:
    """Each maker takes the data set's frames by name; inputs: the frames that some maker needs."""

    inputs: tuple[str, ...]
    user_vectors: dict[str, Callable[[Frames], DataFrame]]
    content_vectors: dict[str, Callable[[Frames], DataFrame]]

    def user_vector(self, kind: str, frames: Frames) -> DataFrame:
        return _of(self.user_vectors, kind, "user")(frames)

    def content_vector(self, kind: str, frames: Frames) -> DataFrame:
        return _of(self.content_vectors, kind, "content")(frames)


def _of(makers: dict[str, Callable[[Frames], DataFrame]], kind: str, what: str) -> Callable[[Frames], DataFrame]:
    if kind not in makers:
        raise ValueError(f"unknown {what} vector: {kind!r}; known: {', '.join(sorted(makers))}")
    return makers[kind]


def _kinds(build: Callable[..., DataFrame], *inputs: str, kinds: tuple[str, ...]) -> dict[str, Callable[[Frames], DataFrame]]:
    return {kind: lambda f, kind=kind: build(*[f[i] for i in inputs], kind) for kind in kinds}


#: Dimensions of the word vectors.
WORDS = 300
#: By the name of a data set, or by how it begins: a star stands for the rest.
VECTORIZERS: dict[str, Vectorizer] = {
    "movielens*": Vectorizer(
        ("ratings", "movies", "tags"), _kinds(I.movies, "ratings", kinds=("ratings", "pos_ratings", "ratings_to_interact")),
        {"genre": lambda f: C.genres(f["movies"]), "tags": lambda f: C.genres_and_tags(f["movies"], f["tags"])},
    ),
    "book_crossing": Vectorizer(
        ("ratings", "books"), _kinds(I.books, "ratings", kinds=("positive_interact", "interacts", "ratings")), {"book_vector": lambda f: C.attribute_vectors(f["books"].join(I.ids(f["ratings"], "book_id"), "book_id"), "id", ["author", "publisher", "year"])},
    ),
    "jester": Vectorizer(
        ("ratings", "jokes", "words"), _kinds(I.jokes, "ratings", kinds=("ratings", "pos_ratings", "ratings_to_interact")),
        {"jester_glove": lambda f: C.joke_vectors(f["jokes"], f["words"], WORDS)},
    ),
    "last_fm": Vectorizer(
        ("plays", "applied_tags"), _kinds(I.plays, "plays", kinds=("num_plays", "any_interact", "num_plays_log")), {"last_fm_tags": lambda f: C.artist_tags(f["applied_tags"])},
    ),
    "wiki*": Vectorizer(
        ("revisions", "latest", "words", "category_edges", "top_categories"), _kinds(I.wiki, "revisions", kinds=("num_edits", "any_interact", "num_edits_ceil")),
        {
            "glove": lambda f: C.article_vectors(f["latest"], f["words"], WORDS),
            "category_map": lambda f: C.category_vectors(f["latest"], graph.distance_vectors(graph.clean_edges(f["category_edges"]), [r[0] for r in f["top_categories"].orderBy("category").collect()])),
        },
    ),
    "osm*": Vectorizer(
        ("objects", "polygons"), _kinds(I.osm, "objects", kinds=("num_edits", "any_interact", "num_edits_ceil")),
        {"osm": lambda f: C.osm_presence(f["objects"]).filter(not_zero(F.col("vector"))).select("item", "vector"), "osm_geo": lambda f: C.osm_presence_and_divisions(f["objects"], f["polygons"]).select("item", "vector")},
    ),
    "git": Vectorizer(
        ("line_authors", "line_functions", "functions", "words"), _kinds(I.code, "line_authors", "line_functions", kinds=("any_interact", "num_interact")), {"py2vec": lambda f: C.function_vectors(f["functions"], f["words"])},
    ),
    "kaggle": Vectorizer(
        ("script_authors", "script_functions", "scripts", "functions", "words"), _kinds(I.scripts, "script_authors", "script_functions", kinds=("any_interact", "num_interact")) | {"forked_interact": lambda f: I.forks(f["scripts"])}, {"py2vec": lambda f: C.function_vectors(f["functions"], f["words"])},
    ),
}


def vectorizer(dataset: str) -> Vectorizer:
    """By the whole name first, then by its beginning."""
    if dataset in VECTORIZERS:
        return VECTORIZERS[dataset]
    for name, found in VECTORIZERS.items():
        if name.endswith("*") and dataset.startswith(name[:-1]):
            return found
    raise ValueError(f"unknown data set: {dataset!r}; known: {', '.join(VECTORIZERS)}")


def vectors(dataset: str, frames: Frames, user_kinds: list[str], content_kinds: list[str]) -> tuple[Frames, Frames]:
    """(user vectors, content vectors) by kind, for an Experiment."""
    own = vectorizer(dataset)
    return {k: own.user_vector(k, frames) for k in user_kinds}, {k: own.content_vector(k, frames) for k in content_kinds}
