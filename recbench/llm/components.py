"""Connected components of a link table, with labels in written tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables


def _renamed(edges: DataFrame, to: DataFrame) -> DataFrame:
    """Edges (u, v) between what their ends now stand for, each pair once, without loops."""
    edges = edges.join(to.toDF("u", "_u"), "u", "left").join(to.toDF("v", "_v"), "v", "left")
    edges = edges.select(F.coalesce("_u", "u").alias("u"), F.coalesce("_v", "v").alias("v")).filter("u != v")
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(links: DataFrame, tables: Tables, name: str, known: DataFrame | None = None) -> DataFrame:
    """(node, component) of every node of links (a, b), and of known; component is the smallest node reachable.

    Each round sends every node to its least neighbour, follows these steps down to their end, and contracts the links
    to the ends, so that links inside what has come together are gone for the next round. A table goes once what follows
    from it is written. known: (node, component) of other links found before. Only whether any links are left is asked on the driver.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    nodes = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    labels = nodes.withColumn("component", F.col("node"))
    if known is not None:
        labels = known.unionByName(labels.join(known.select("node"), "node", "left_anti"))
        edges = _renamed(edges, known)
    labels, edges, k = tables.write(labels, f"{name}-labels-0"), tables.write(edges, f"{name}-edges-0"), 0
    while not edges.isEmpty():
        k += 1
        ends = edges.select(F.col("u").alias("node"), F.col("v").alias("other")).unionByName(edges.select(F.col("v").alias("node"), F.col("u").alias("other")))
        to, j = tables.write(ends.groupBy("node").agg(F.min("other").alias("to")).select("node", F.least("node", "to").alias("to")), f"{name}-to-{k}-0"), 0
        moved = True
        while moved:
            j += 1
            further = to.join(to.toDF("to", "further"), "to").select("node", F.col("further").alias("to"), (F.col("further") != F.col("to")).alias("moved"))
            further = tables.write(further, f"{name}-to-{k}-{j}")
            tables.drop(f"{name}-to-{k}-{j - 1}")
            to, moved = further.select("node", "to"), not further.filter("moved").isEmpty()
        labels = labels.join(to.toDF("component", "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        labels, edges = tables.write(labels, f"{name}-labels-{k}"), tables.write(_renamed(edges, to), f"{name}-edges-{k}")
        tables.drop(f"{name}-labels-{k - 1}", f"{name}-edges-{k - 1}", f"{name}-to-{k}-{j}")
    return labels
