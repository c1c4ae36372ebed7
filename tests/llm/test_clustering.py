"""Dual-tree Lloyd against plain rounds over all vectors and centroids."""

import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import clustering, queries

COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def slow_clusters(rows, dimensions=64, k=16, rounds=3, scale=64):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [max(-clustering.BOUND, min(clustering.BOUND, x)) for x in v]) for i, v in kept]
    key = lambda p: (p[0] is None, hashlib.sha256(f"1:{p[0]}".encode()).hexdigest() if p[0] is not None else "", p[1])
    centroids = [list(v) for _, v in sorted(kept, key=key)[:k]]
    assign = lambda: [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        members = {}
        for (_, v), (_, j) in zip(kept, assign()):
            members.setdefault(j, []).append(v)
        for j, vs in members.items():
            centroids[j] = [sum(c) // len(vs) for c in zip(*vs)]
    last, by = assign(), {}
    for d, j in last:
        by[j] = by.get(j, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, by[j], sum(by.values()), digest[j]) for (i, _), (d, j) in zip(kept, last)), key=str)


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


@pytest.mark.parametrize("block", [2048, 7])
def test_odd_vectors_brute_force(spark, block):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(5, 64))
    rows = [(i, [float(x) for x in centres[i % 5] + rng.normal(size=64) * (0.02 if i % 3 else 0.5)]) for i in range(150)]
    rows += [(i, rows[0][1]) for i in range(200, 260)] + [(3, rows[7][1]), (3, rows[7][1]), (None, rows[9][1]), (None, rows[10][1])]
    bad = [None, [], [1.0] * 63, [1.0] * 65, [None] + [1.0] * 63, [float("nan")] * 64, [float("inf")] + [0.0] * 63]
    rows += [(300 + i, v) for i, v in enumerate(bad)]
    rows += [(400, [-0.001] * 64), (401, [0.0] * 64), (402, [5.0e7] + [0.0] * 63)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for c in ("cluster", "distance", "h", "v", "ids", "member", "points", "n"):
        table = table.withColumn(c, F.lit("clash"))
    assert rows_of(clustering.cluster_vectors(table, block=block)) == slow_clusters(rows)
    assert clustering.cluster_vectors(table.limit(0)).count() == 0
    few = rows[:5]
    assert rows_of(clustering.cluster_vectors(spark.createDataFrame(few, table.select("vec_id", "embedding").schema), block=block)) == slow_clusters(few)


def test_ties_go_to_the_smaller_number(spark):
    """A small grid: many equal distances, equal centroids and clusters that lose all their vectors."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) / 64 for x in rng.integers(0, 3, 4)]) for i in range(400)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = rows_of(clustering.cluster_vectors(table, dimensions=4, block=64))
    assert got == slow_clusters(rows, dimensions=4)


def test_a_table_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({queries.ORACLE_SQL['op11_clusters']})").fetchall()
    assert rows_of(queries.op11_clusters(spark, sf)) == sorted(want, key=str)


def test_cover_tree_invariants():
    rng = np.random.default_rng(2)
    points = np.unique(rng.integers(-50, 50, (300, 5)), axis=0)
    tree, places = clustering.CoverTree.build(points)
    assert (tree.points == points[places]).all() and sorted(places) == list(range(len(points)))
    distance = lambda a, b: float(np.sqrt(((a - b) ** 2).sum()))
    for node in range(len(tree.center)):
        own = tree.points[tree.low[node] : tree.high[node]]
        reach = max(distance(p, tree.points[tree.center[node]]) for p in own)
        assert reach == pytest.approx(tree.radius[node]) and tree.low[node] <= tree.center[node] < tree.high[node]
        kids = tree.child[tree.children[node] : tree.children[node] + tree.count[node]]
        if len(kids):
            ranges = sorted((tree.low[k], tree.high[k]) for k in kids)
            assert ranges[0][0] == tree.low[node] and ranges[-1][1] == tree.high[node] and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))
            assert tree.center[node] in tree.center[kids]
    order, scales = clustering._farthest_first(points)
    for level in range(0, 8):
        net = order[scales >= level]
        assert all(distance(points[a], points[b]) > 2**level for i, a in enumerate(net) for b in net[:i])
        assert all(min(distance(p, points[a]) for a in net) <= 2**level for p in points)


def test_pruning_leaves_most_pairs_out(monkeypatch):
    """Far groups: whole nodes are assigned, so that distances to few points are computed."""
    rng = np.random.default_rng(3)
    centres = rng.integers(-9000, 9000, (16, 64))
    points = np.unique(np.concatenate([c + rng.integers(-5, 5, (100, 64)) for c in centres]), axis=0)
    tree, _ = clustering.CoverTree.build(points)
    ctree, numbers = clustering._centroid_tree([list(map(int, c)) for c in centres])
    computed = []
    exact = clustering._squared
    monkeypatch.setattr(clustering, "_squared", lambda a, b: computed.append(len(a)) or exact(a, b))
    got = clustering.nearest(tree, ctree, numbers)
    assert sum(computed) < 0.1 * len(points) * 16
    assert (got == ((tree.points[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
