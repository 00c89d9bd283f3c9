"""Searches in graphs deeper than any set number of rounds, and from many roots at once."""

import random

from recbench.operators import graph

DEEP = 102


def test_search_has_no_bound(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # many small rounds
    edges = spark.range(0, DEEP, 1, 1).selectExpr("concat('n', id) as parent", "concat('n', id + 1) as child")
    roots = spark.range(0, 1, 1, 1).selectExpr("'n0' as root")
    nodes = {r["node"]: r["nodes"] for r in graph.distances(edges, roots).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert nodes == {f"n{i}": i + 1 for i in range(DEEP + 1)}


def test_many_roots_in_few_rows(spark):
    rng = random.Random(4)
    links = {(f"n{rng.randrange(90)}", f"n{rng.randrange(90)}") for _ in range(200)}
    edges = spark.createDataFrame([*links, *list(links)[:9]], "parent string, child string")
    roots = [f"n{i}" for i in rng.sample(range(95), 70)] + ["elsewhere", "n1"]
    below = {}
    for a, b in links:
        below.setdefault(a, []).append(b)
    want = {}
    for k, root in enumerate(roots):
        near, front = {root: 1}, [root]
        for node in front:
            for other in below.get(node, []):
                if other not in near:
                    near[other] = near[node] + 1
                    front.append(other)
        for node, n in near.items():
            want.setdefault(node, [graph.UNREACHED] * len(roots))[k] = float(n)
    assert {r["category"]: r["vector"] for r in graph.distance_vectors(edges, roots).collect()} == want
    sets = graph.root_sets(edges, roots)
    assert sets.count() < graph.distances(edges, spark.createDataFrame([(r,) for r in set(roots)], "root string")).count() / 4
    assert graph.distance_vectors(edges, []).count() == 0
