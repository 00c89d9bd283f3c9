"""Category graphs: distances, reachability, shortest paths, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import scratch
from .interactions import ids

#: Stands for a category that no path reaches.
UNREACHED = 1e9


#: Rounds of a search after which all that it has seen is written as one table.
ROUNDS = 8


def _cut(rows: DataFrame) -> DataFrame:
    path = scratch(rows.sparkSession, "rounds")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def distances(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, nodes): nodes on the shortest directed path from each root to each node it reaches, however deep.

    Breadth first: each round joins the frontier with the edges and keeps what is new, until nothing is. New rows are
    written each round, and all rows so far every ROUNDS rounds, so that no plan grows with the depth.
    """
    spark = edges.sparkSession
    steps = edges.select(F.col("parent").alias("node"), F.col("child").alias("next")).distinct()
    seen = roots.select(F.col("root"), F.col("root").alias("node"), F.lit(1).cast("long").alias("nodes")).distinct()
    front, depth = seen, 1
    while True:
        depth += 1
        new = front.join(steps, "node").select("root", F.col("next").alias("node")).distinct().join(seen.select("root", "node"), ["root", "node"], "left_anti")
        new = new.withColumn("nodes", F.lit(depth).cast("long"))
        new = _cut(new)
        if new.isEmpty():
            return seen
        seen, front = seen.unionByName(new), new
        seen = _cut(seen) if depth % ROUNDS == 0 else seen


#: Roots whose bits one number holds.
WORD = 64


def root_sets(edges: DataFrame, roots: list[str]) -> DataFrame:
    """(node, nodes, sets): the roots that reach a node first by a path of so many nodes, as bits in the order given.

    A node has one row for each distance at which roots reach it, whatever their number, so a round sends a row for each
    edge out of the frontier. Rounds are cut as in distances.
    """
    spark, words = edges.sparkSession, [f"b{k}" for k in range(-(-len(roots) // WORD))]
    steps = edges.select(F.col("parent").alias("node"), F.col("child").alias("next")).distinct()
    bit = lambda i: (1 << i % WORD) - (1 << WORD if i % WORD == WORD - 1 else 0)  # noqa: E731  as a signed number
    told = [(r, 1, *[bit(i) if i // WORD == k else 0 for k in range(len(words))]) for i, r in enumerate(roots)]
    seen = spark.createDataFrame(told, ", ".join(["node string, nodes bigint", *[f"{w} bigint" for w in words]]))
    seen = _cut(seen.groupBy("node", "nodes").agg(*[F.bit_or(w).alias(w) for w in words]))
    front, depth = seen, 1
    while True:
        depth += 1
        known = seen.groupBy("node").agg(*[F.bit_or(w).alias(f"_{w}") for w in words])
        new = front.join(steps, "node").groupBy(F.col("next").alias("node")).agg(*[F.bit_or(w).alias(w) for w in words]).join(known, "node", "left")
        new = new.select("node", F.lit(depth).cast("long").alias("nodes"), *[F.col(w).bitwiseAND(F.bitwise_not(F.coalesce(f"_{w}", F.lit(0).cast("long")))).alias(w) for w in words])
        new = _cut(new.filter(" or ".join(f"{w} != 0" for w in words)))
        if new.isEmpty():
            return seen.select("node", "nodes", F.array(*words).alias("sets"))
        seen, front = seen.unionByName(new), new
        seen = _cut(seen) if depth % ROUNDS == 0 else seen


def distance_vectors(edges: DataFrame, roots: list[str]) -> DataFrame:
    """(category, vector): node counts of the paths from each root, in the order given; unreached ones are far away."""
    if not roots:
        return edges.select(F.col("parent").alias("category"), F.array().cast("array<double>").alias("vector")).limit(0)
    found = root_sets(edges, roots).groupBy(F.col("node").alias("category")).agg(F.collect_list(F.struct("nodes", "sets")).alias("at"))

    def nodes(i: Column) -> Column:
        held = F.filter("at", lambda a: F.call_function("shiftright", F.element_at(a["sets"], (F.floor(i / WORD) + 1).cast("int")), (i % WORD).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)
        return F.coalesce(F.get(held, F.lit(0))["nodes"].cast("double"), F.lit(UNREACHED))

    return found.select("category", F.transform(F.sequence(F.lit(0), F.lit(len(roots) - 1)), nodes).alias("vector"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(id, name, neighbours): both directions, names numbered from 1 in their order."""
    both = edges.select(F.col("parent").alias("name"), F.col("child").alias("other")).unionByName(edges.select(F.col("child").alias("name"), F.col("parent").alias("other"))).distinct()
    numbers = ids(both, "name").withColumn("id", F.col("id") + 1)
    other = numbers.select(F.col("name").alias("other"), F.col("id").alias("other_id"))
    return both.join(other, "other").groupBy("name").agg(F.array_sort(F.collect_set("other_id")).alias("neighbours")).join(numbers, "name").select("id", "name", "neighbours")


def reachable(edges: DataFrame, root: str) -> DataFrame:
    """The edges below a root."""
    nodes = distances(edges, edges.sparkSession.createDataFrame([(root,)], "root string")).select(F.col("node").alias("parent"))
    return edges.join(nodes, "parent", "left_semi").distinct()


def shortest_path(edges: DataFrame, start: str, end: str) -> DataFrame:
    """One row (path) with the names on a shortest path, the least in their order among several; no row if there is none."""
    steps = edges.select(F.col("parent").alias("at"), F.col("child").alias("next")).distinct()
    front = edges.sparkSession.createDataFrame([(start, [start])], "at string, path array<string>")
    seen, depth = front.select("at"), 1
    while front.filter(F.col("at") == end).isEmpty():
        depth += 1
        front = front.join(steps, "at").groupBy("next").agg(F.min(F.concat("path", F.array("next"))).alias("path")).withColumnRenamed("next", "at")
        front = front.join(seen, "at", "left_anti")
        front = _cut(front)
        if front.isEmpty():
            break
        seen = seen.unionByName(front.select("at"))
        seen = _cut(seen) if depth % ROUNDS == 0 else seen
    return front.filter(F.col("at") == end).select("path")


#: Categories that don't belong in the graph.
HOUSEKEEPING = [
    "Category:Main_topic_classifications", "Category:Container_categories", "Category:Applied_sciences", "Category:Academic_disciplines",
    "Category:Wikipedia_1.0_assessments", "Category:Society", "Category:Wikipedia_administration",
]


def clean_edges(edges: DataFrame, dropped: list[str] | None = None) -> DataFrame:
    """Without edges that touch housekeeping categories or groupings by country and nationality."""
    names = HOUSEKEEPING if dropped is None else dropped
    fine = lambda c: ~F.col(c).isin(*names) & ~F.col(c).contains("_by_country") & ~F.col(c).contains("_by_nationality")
    return edges.filter(fine("parent") & fine("child"))
