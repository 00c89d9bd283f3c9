"""Operator 5, approximate nearest neighbours: a robust-pruned directed graph in each shard, searched with a beam."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables

#: Vectors of a shard and queries of a block: as many as a task may hold, as every query is searched in every shard, and
#: a search's time hardly grows with its shard.
SHARD, QUERIES = 16_384, 32_768
#: Edges of a node, beam while building and while searching, slack of the pruning rule, nodes expanded at a time.
DEGREE, BUILD_BEAM, BEAM, ALPHA, WIDTH = 32, 64, 192, 1.2, 4
#: Points inserted or queries searched together.
TOGETHER = 128


def _beam(x: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Greedy beam search for many queries at once: (ids, distances), nearest first; -1 and inf where fewer were met.

    Distances are squared Euclidean without the query's own norm, which doesn't change any order. Every round expands
    each query's WIDTH nearest candidates not expanded yet, until the beam holds none.
    """
    m, n = len(queries), len(x)
    norms = np.einsum("ij,ij->i", x, x)
    ids = np.full((m, beam), -1, np.int64)
    dist = np.full((m, beam), np.inf, np.float32)
    done = np.ones((m, beam), bool)
    ids[:, 0], dist[:, 0], done[:, 0] = entry, norms[entry] - 2 * queries @ x[entry], False
    seen = np.zeros((m, n), bool)
    seen[:, entry] = True
    active = np.arange(m)
    while len(active):
        open_ = np.where(done[active], np.inf, dist[active])
        pick = np.argpartition(open_, WIDTH - 1, axis=1)[:, :WIDTH]
        fine = np.isfinite(np.take_along_axis(open_, pick, axis=1))
        done[active[:, None], pick] = True
        nodes = np.where(fine, ids[active[:, None], pick], 0)
        new = np.where(fine[:, :, None], edges[nodes], -1).reshape(len(active), -1)
        fresh = (new >= 0) & ~seen[active[:, None], new]
        # A node met twice in one round counts once.
        order = np.argsort(new, axis=1, kind="stable")
        ordered = np.take_along_axis(new, order, axis=1)
        twice = np.zeros_like(fresh)
        np.put_along_axis(twice, order[:, 1:], ordered[:, 1:] == ordered[:, :-1], axis=1)
        fresh &= ~twice
        at, col = np.nonzero(fresh)
        nodes = new[at, col]
        seen[active[at], nodes] = True
        d = np.full(new.shape, np.inf, np.float32)
        d[at, col] = norms[nodes] - 2 * np.einsum("ij,ij->i", x[nodes], queries[active[at]])
        all_d = np.concatenate([dist[active], d], axis=1)
        keep = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        dist[active] = np.take_along_axis(all_d, keep, axis=1)
        ids[active] = np.take_along_axis(np.concatenate([ids[active], new], axis=1), keep, axis=1)
        done[active] = np.take_along_axis(np.concatenate([done[active], ~fresh], axis=1), keep, axis=1)
        active = active[(~done[active] & np.isfinite(dist[active])).any(axis=1)]
    order = np.argsort(dist, axis=1, kind="stable")
    ids, dist = np.take_along_axis(ids, order, axis=1), np.take_along_axis(dist, order, axis=1)
    return np.where(np.isfinite(dist), ids, -1), dist


def _prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each point at most `degree` of its candidates (-1: none).

    The nearest candidate stays and drops every other one that is alpha times nearer to it than to the point, so the
    edges kept lead in different directions. Then the next nearest, and so on.
    """
    candidates = np.where(candidates == points[:, None], -1, candidates)
    order = np.argsort(candidates, axis=1, kind="stable")
    candidates = np.take_along_axis(candidates, order, axis=1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
    c = x[np.maximum(candidates, 0)]
    square = np.einsum("ijk,ijk->ij", c, c)
    own = square + np.einsum("ij,ij->i", x[points], x[points])[:, None] - 2 * np.einsum("ijk,ik->ij", c, x[points])
    among = square[:, :, None] + square[:, None, :] - 2 * c @ c.transpose(0, 2, 1)
    alive = np.where(candidates >= 0, own, np.inf)
    out = np.full((len(points), degree), -1, np.int64)
    rows = np.arange(len(points))
    for k in range(degree):
        best = alive.argmin(axis=1)
        found = np.isfinite(alive[rows, best])
        if not found.any():
            break
        out[found, k] = candidates[rows, best][found]
        alive[alpha * alpha * among[rows, best] <= own] = np.inf
        alive[rows, best] = np.inf
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 7) -> tuple[np.ndarray, int]:
    """(edges, entry): a directed graph over the rows of x, by batches of insertions of growing size."""
    n = len(x)
    entry = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    edges = np.full((n, degree), -1, np.int64)
    order = np.random.default_rng(seed).permutation(n)
    order = order[order != entry]
    at = 0
    while at < len(order):
        batch = order[at : at + max(1, min(TOGETHER, at))]
        at += len(batch)
        met, _ = _beam(x, edges, entry, x[batch], beam)
        edges[batch] = _prune(x, batch, np.concatenate([met, edges[batch]], axis=1), degree, alpha)
        source, target = np.repeat(batch, degree), edges[batch].reshape(-1)
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        ends, first, counts = np.unique(target, return_index=True, return_counts=True)
        back = np.full((len(ends), int(counts.max(initial=0))), -1, np.int64)
        back[np.repeat(np.arange(len(ends)), counts), np.arange(len(target)) - np.repeat(first, counts)] = source
        have = (edges[ends] >= 0).sum(axis=1)
        room = have + counts <= degree
        for i in np.flatnonzero(room):
            edges[ends[i], have[i] : have[i] + counts[i]] = back[i, : counts[i]]
        for i in range(0, int((~room).sum()), TOGETHER):
            full = np.flatnonzero(~room)[i : i + TOGETHER]
            edges[ends[full]] = _prune(x, ends[full], np.concatenate([edges[ends[full]], back[full]], axis=1), degree, alpha)
    return edges, entry


def _matrix(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    """A matrix from a column of lists of one length without nulls."""
    flat = pa.concat_arrays([x.flatten() for x in column.chunks]).to_numpy() if column.num_chunks else np.zeros(0)
    return flat.reshape(len(column), -1)


def _scaled(x: np.ndarray, largest: float) -> np.ndarray:
    """Vectors over the largest norm, as the graph has them."""
    return (x / np.sqrt(largest)).astype(np.float32)


def _build(key, table):
    table = table.sort_by("cid")
    x = _vectors(table.column("vector"))
    scaled = _scaled(x, table.column("largest")[0].as_py())
    lift = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", scaled, scaled, dtype=np.float64))).astype(np.float32)
    edges, entry = build_graph(np.concatenate([scaled, lift[:, None]], axis=1))
    n = len(x)
    out = {"dim": [key[0].as_py()] * n, "shard": [key[1].as_py()] * n, "at": np.arange(n), "entry": [entry] * n, "vector": table.column("vector"), "largest": table.column("largest"), "lift": lift, "edges": [e.astype(np.int32).tobytes() for e in edges], "ids": table.column("ids")}
    return pa.table(out)


def _search(k: int):
    def run(key, graph, queries):
        names = ["query", "vec_id", "score"]
        if not graph.num_rows or not queries.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names)
        graph = graph.sort_by("at")
        largest, x = graph.column("largest")[0].as_py(), _vectors(graph.column("vector"))
        lifted = np.concatenate([_scaled(x, largest), graph.column("lift").to_numpy()[:, None]], axis=1)
        edges, entry = _matrix(graph.column("edges"), np.int32), graph.column("entry")[0].as_py()
        ids, wide = graph.column("ids").to_pylist(), x.astype(np.float64)
        names_of, q = queries.column("query").to_numpy(), _vectors(queries.column("vector")).astype(np.float64)
        out: list[tuple[int, int, float]] = []
        for i in range(0, len(q), TOGETHER):
            part = q[i : i + TOGETHER]
            found, _ = _beam(lifted, edges, entry, np.concatenate([_scaled(part, largest), np.zeros((len(part), 1), np.float32)], axis=1), max(BEAM, k))
            for j, row in enumerate(found):
                row = row[row >= 0]
                scores = (wide[row] * part[j]).sum(axis=1)
                rows = [(-s, v) for s, r in zip(scores.tolist(), row.tolist(), strict=True) for v in ids[r]]
                out += [(int(names_of[i + j]), v, -s) for s, v in sorted(rows)[:k]]
        query, vec, score = zip(*out, strict=True)
        return pa.table([pa.array(query, pa.int64()), pa.array(vec, pa.int64()), pa.array(score, pa.float64())], names)

    return run


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector) of the vectors that take part: not null, not zero, all components there and finite."""
    kind = "array<float>" if dict(df.dtypes)[vector_col] == "array<float>" else "array<double>"
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("vector")).filter("vec_id is not null and vector is not null")
    return rows.filter(finite & F.exists("vector", lambda v: v != 0))


def nearest(vectors: DataFrame, tables: Tables, k: int = 20, every: int = 20, shard: int = SHARD, block: int = QUERIES, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each query (id divisible by `every`) its k nearest by inner product: query_id, rank, vec_id, score.

    Equal vectors are one node, which carries its k + 1 smallest ids, all that a list of k may need. The nodes of a
    dimension are dealt into shards of about `shard`; each shard's graph is built over vectors scaled and lifted by one
    coordinate to norms of 1, so that the nearest in distance is the largest in inner product. All queries are searched
    in all shards of their dimension, in blocks of about `block`, and the lists are merged by (score, id). Scores are
    inner products of the original vectors in double precision.

    Vectors null, zero, or with null or non-finite components take no part. Vectors of different dimensions are never
    near to each other. Rows that repeat id and vector count once; rows with the query's id are never its candidates.
    Fewer candidates than k: all. Empty table: no rows. Other columns are ignored.
    """
    rows = valid_vectors(vectors, id_col, vector_col).distinct()
    by = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= k + 1)
    classes = few.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    square = F.aggregate("vector", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    # A vector's id alone may stand for several vectors.
    classes = tables.write(classes.select(F.monotonically_increasing_id().alias("cid"), F.size("vector").cast("long").alias("dim"), "vector", "ids", square.alias("square")), "classes")
    dims = classes.groupBy("dim").agg(F.max("square").alias("largest"), F.ceil(F.count(F.lit(1)) / shard).alias("shards"))
    nodes = classes.select("cid", "dim", "vector", "ids").join(dims, "dim").withColumn("shard", F.pmod(F.xxhash64("cid"), F.col("shards")))
    kind = dict(rows.dtypes)["vector"]
    graph = nodes.groupBy("dim", "shard").applyInArrow(_build, f"dim long, shard long, at long, entry long, vector {kind}, largest double, lift float, edges binary, ids array<long>")
    graph = tables.write(graph, "graph")
    asked = rows.filter(F.col("vec_id") % every == 0)
    asked = tables.write(asked.join(classes.select("vector", "cid"), "vector").select("vec_id", "cid"), "asked")
    queries = classes.join(asked.select("cid").distinct(), "cid", "left_semi")
    blocks = max(1, -(-queries.count() // block))
    queries = queries.select(F.col("cid").alias("query"), "dim", "vector").join(dims.select("dim", "shards"), "dim")
    queries = queries.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))).drop("shards")
    graph = graph.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["dim", "shard", "block"]
    found = graph.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(_search(k + 1), "query long, vec_id long, score double")
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    merged = found.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k + 1).drop("_n")
    lists = asked.select(F.col("vec_id").alias("query_id"), F.col("cid").alias("query")).join(merged, "query").filter("vec_id != query_id")
    own = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return lists.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
