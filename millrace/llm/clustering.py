"""Lloyd's clustering of integer vectors by dual trees.

Every block of vectors has a cover tree, built once and kept in the shared folder.
Each round builds a cover tree over the centroids and walks pairs of nodes from
both: a centroid node goes when no vector of the other node can be nearer to it
than to a centroid already met, a vector node is assigned as a whole when one
centroid is left, and pairs of leaves are compared exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Workspace

DIMENSIONS, CENTROIDS, ROUNDS, SCALE = 64, 16, 3, 64
#: Vectors of one cover tree.
BLOCK = 2048
#: Largest absolute component, so that a squared distance of 64 components fits a long.
BOUND = (1 << 27) - 1
#: Pairs whose distances are computed at once.
PAIRS = 1 << 14
#: Share by which bounds are widened, well over the rounding of their arithmetic.
SLACK = 1e-9


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    out = np.empty(len(a), np.int64)
    for i in range(0, len(a), PAIRS):
        d = a[i : i + PAIRS] - b[i : i + PAIRS]
        out[i : i + PAIRS] = np.einsum("ij,ij->i", d, d)
    return out


@dataclass
class CoverTree:
    """Nodes in the order of a walk from the root; points so that each node's are a range.

    ``center`` is a node's point, ``low`` and ``high`` its range, ``radius`` the
    distance of its farthest point, ``children`` and ``count`` its child nodes' place in ``child``.
    """

    points: np.ndarray
    center: np.ndarray
    low: np.ndarray
    high: np.ndarray
    radius: np.ndarray
    children: np.ndarray
    count: np.ndarray
    child: np.ndarray

    @classmethod
    def build(cls, points: np.ndarray) -> tuple[CoverTree, np.ndarray]:
        """The tree of distinct points, and the place among them of each of the tree's points."""
        order, scales = _farthest_first(points)
        parent = _parents(points, order, scales)
        groups: list[dict[int, list[int]]] = [{} for _ in order]  # of each point: its children by level, falling
        for j in range(1, len(order)):
            groups[parent[j]].setdefault(int(scales[j]), []).append(j)
        levels = [list(g.values()) for g in groups]
        center, low, high, kids = [], [], [], []
        walked: list[int] = []

        # a node is (point, how many of its levels are used up); its children are the points of the next level and itself below
        stack: list[tuple[int, int, int]] = [(0, 0, -1)]
        while stack:
            j, used, above = stack.pop()
            if j < 0:  # the node is complete
                high[used] = len(walked)
                continue
            node = len(center)
            center.append(j)
            low.append(len(walked))
            high.append(0)
            kids.append([])
            if above >= 0:
                kids[above].append(node)
            if used == len(levels[j]):
                walked.append(j)
                high[node] = len(walked)
                continue
            stack.append((-1, node, -1))
            stack.extend((k, 0, node) for k in levels[j][used])
            stack.append((j, used + 1, node))
        place = np.empty(len(order), np.int64)
        place[walked] = np.arange(len(order))
        own = points[order[walked]]
        center_, low_, high_ = place[center], np.array(low), np.array(high)
        radius = np.array([np.sqrt(_squared(own[a:b], np.broadcast_to(own[c], (b - a, own.shape[1]))).max()) if b - a > 1 else 0.0 for c, a, b in zip(center_, low_, high_)])
        count = np.array([len(k) for k in kids])
        return cls(own, center_, low_, high_, radius, np.cumsum(count) - count, count, np.array([c for k in kids for c in k], np.int64)), order[walked]

    def pack(self) -> list[bytes]:
        return [getattr(self, f).astype(t).tobytes() for f, t in _PACKED.items()]

    @classmethod
    def unpack(cls, parts: list[bytes], dimensions: int) -> CoverTree:
        arrays = {f: np.frombuffer(b, t).astype(np.float64 if t == "<f8" else np.int64) for (f, t), b in zip(_PACKED.items(), parts)}
        return cls(**(arrays | {"points": arrays["points"].reshape(-1, dimensions)}))


_PACKED = {"points": "<i4", "center": "<i4", "low": "<i4", "high": "<i4", "radius": "<f8", "children": "<i4", "count": "<i4", "child": "<i4"}


def _farthest_first(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which each point is the farthest from those before it, and each one's level.

    The points of level i or more are more than 2^i apart and within 2^(i+1) of all others' nearest.
    """
    x = points.astype(np.float64)
    norms = np.einsum("ij,ij->i", x, x)
    n = len(x)
    order, reach = np.zeros(n, np.int64), np.zeros(n)
    nearest = np.maximum(norms + norms[0] - 2 * (x @ x[0]), 0)
    nearest[0] = -1
    cross = x @ x.T
    for j in range(1, n):
        at = int(nearest.argmax())
        order[j], reach[j] = at, nearest[at]
        np.minimum(nearest, norms + norms[at] - 2 * cross[at], out=nearest)
        nearest[order[: j + 1]] = -1
    with np.errstate(divide="ignore"):
        scales = np.ceil(np.log2(np.sqrt(np.maximum(reach, 0.25)))) - 1
    scales[0] = np.inf if n else 0
    return order, np.minimum.accumulate(scales) if n else scales


def _parents(points: np.ndarray, order: np.ndarray, scales: np.ndarray) -> np.ndarray:
    """For each place in the order the nearest place of a higher level."""
    x = points[order].astype(np.float64)
    norms = np.einsum("ij,ij->i", x, x)
    parent = np.zeros(len(order), np.int64)
    start = 1
    while start < len(order):
        end = int(np.searchsorted(-scales, -scales[start], side="right"))
        parent[start:end] = (norms[None, :start] - 2 * (x[start:end] @ x[:start].T)).argmin(axis=1)
        start = end
    return parent


def nearest(tree: CoverTree, centroids: CoverTree, numbers: np.ndarray) -> np.ndarray:
    """The number of the nearest centroid of each of the tree's points; of equal ones the smallest.

    ``numbers`` are those of the centroid tree's points.
    """
    out = np.full(len(tree.points), -1, np.int64)
    bound = np.full(len(tree.center), np.inf)  # no point of the node is farther from its nearest centroid
    q, c = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while q.size:
        squared = _squared(tree.points[tree.center[q]], centroids.points[centroids.center[c]])
        distance, wide, span = np.sqrt(squared), tree.radius[q], centroids.radius[c]
        np.minimum.at(bound, q, (distance + wide) * (1 + SLACK) + SLACK)
        near = distance - wide - span <= bound[q] + SLACK * distance
        q, c, squared, wide, span = q[near], c[near], squared[near], wide[near], span[near]
        leaf_q, leaf_c = tree.count[q] == 0, centroids.count[c] == 0
        # nodes that have one centroid left
        pairs = np.bincount(q, minlength=len(bound))
        alone = (pairs[q] == 1) & leaf_c
        for node, number in zip(q[alone], numbers[centroids.center[c[alone]]]):
            out[tree.low[node] : tree.high[node]] = number
        # all pairs of a node are refined alike: first its wide centroid nodes, then itself
        finer = ~leaf_c & ((span >= wide) | leaf_q)
        some = np.zeros(len(bound), bool)
        some[q[finer]] = True
        ends = leaf_q & ~some[q] & ~alone
        if ends.any():
            rank = np.lexsort((numbers[centroids.center[c[ends]]], squared[ends], q[ends]))
            first = np.append(True, np.diff(q[ends][rank]) > 0)
            best = rank[first]
            out[tree.low[q[ends][best]]] = numbers[centroids.center[c[ends][best]]]
        stay = some[q] & ~finer & ~alone
        down = ~some[q] & ~leaf_q & ~alone
        q1, c1 = _expanded(c[finer], q[finer], centroids)
        c2, q2 = _expanded(q[down], c[down], tree)
        bound[q2] = np.minimum(bound[q2], np.repeat(bound[q[down]], tree.count[q[down]]))
        q, c = np.concatenate([q[stay], q1, q2]), np.concatenate([c[stay], c1, c2])
    return out


def _expanded(nodes: np.ndarray, others: np.ndarray, tree: CoverTree) -> tuple[np.ndarray, np.ndarray]:
    """(other, child) for each child of each node."""
    counts = tree.count[nodes]
    if not counts.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    turn = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(others, counts), tree.child[np.repeat(tree.children[nodes], counts) + turn]


def _centroid_tree(centroids: list[list[int]]) -> tuple[CoverTree, np.ndarray]:
    """The tree over the distinct centroids and the smallest number of each."""
    distinct: dict[tuple[int, ...], int] = {}
    for number, point in enumerate(centroids):
        distinct.setdefault(tuple(point), number)
    tree, places = CoverTree.build(np.array(list(distinct), np.int64))
    return tree, np.array(list(distinct.values()))[places]


def forest(vectors: DataFrame, dimensions: int, block: int) -> DataFrame:
    """A row for each block of (id, v): the ids, the place of each one's vector among the tree's points, the packed tree."""
    id_type = vectors.schema[0].dataType
    schema = T.StructType([T.StructField("ids", T.ArrayType(id_type)), T.StructField("member", T.BinaryType()), *[T.StructField(f, T.BinaryType()) for f in _PACKED]])

    def row(ids: pa.Array, points: np.ndarray) -> pa.RecordBatch:
        distinct, member = np.unique(points, axis=0, return_inverse=True)
        tree, places = CoverTree.build(distinct)
        at = np.empty(len(places), np.int64)
        at[places] = np.arange(len(places))
        own = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.RecordBatch.from_arrays([own, *[pa.array([b], pa.binary()) for b in (at[member.ravel()].astype("<i4").tobytes(), *tree.pack())]], schema.names)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= block:
                table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                yield row(table.column(0).slice(0, block), _matrix(table.column(1).slice(0, block), dimensions))
                held = [table.slice(block)] if table.num_rows > block else []
        if sum(b.num_rows for b in held):
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            yield row(table.column(0), _matrix(table.column(1), dimensions))

    return vectors.mapInArrow(grow, schema)


def _matrix(lists: pa.ListArray, dimensions: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimensions)


def _trees(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[tuple[pa.Array, np.ndarray, CoverTree]]:
    for batch in batches:
        for i in range(batch.num_rows):
            member = np.frombuffer(batch.column(1)[i].as_py(), "<i4")
            yield batch.column(0)[i].values, member, CoverTree.unpack([batch.column(2 + k)[i].as_py() for k in range(len(_PACKED))], dimensions)


def _sums(trees: DataFrame, centroids: list[list[int]], dimensions: int) -> list:
    """(cluster, place, n, total) over all vectors under the centroids: at most centroids times dimensions rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctree, numbers = _centroid_tree(centroids)
        n, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dimensions), np.int64)
        for _, member, tree in _trees(batches, dimensions):
            own, weight = nearest(tree, ctree, numbers), np.bincount(member, minlength=len(tree.points))
            for k in np.unique(own):
                n[k] += weight[own == k].sum()
                total[k] += weight[own == k] @ tree.points[own == k]
        met = np.flatnonzero(n)
        rows = [np.repeat(met, dimensions), np.tile(np.arange(dimensions), len(met)), np.repeat(n[met], dimensions), total[met].ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], ["cluster", "place", "n", "total"])

    sums = trees.mapInArrow(add, "cluster long, place long, n long, total long")
    return sums.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()


def _assigned(trees: DataFrame, centroids: list[list[int]], dimensions: int, id_type: T.DataType) -> DataFrame:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not centroids:
            return
        ctree, numbers = _centroid_tree(centroids)
        points = np.array(centroids, np.int64)
        for ids, member, tree in _trees(batches, dimensions):
            own = nearest(tree, ctree, numbers)
            distance = _squared(tree.points, points[own])
            yield pa.RecordBatch.from_arrays([ids, pa.array(own[member], pa.int32()), pa.array(distance[member], pa.int64())], ["vec_id", "cluster", "distance"])

    return trees.mapInArrow(assign, T.StructType([T.StructField("vec_id", id_type), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]))


def cluster_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, dimensions: int = DIMENSIONS, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """Each vector's cluster after some rounds: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid.

    Vectors of exactly ``dimensions`` components, none null or non-finite, count;
    others have no row. Components become floor(scale * x), held to +-``BOUND`` so
    that squared distances fit a long. The first centroids are the vectors with the
    smallest hash of their id (null ids last, then by components); with fewer than
    ``k`` vectors there are fewer centroids. Repeated rows count each, equal
    distances go to the smaller number, an empty table gives no rows, other columns are not read.
    """
    spark = table.sparkSession
    work = Workspace(spark, "clustering")
    x = F.col(f"`{vector_col}`")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = F.transform(x, lambda c: F.least(F.greatest(F.floor(c.cast("double") * scale), F.lit(-BOUND)), F.lit(BOUND)).cast("int"))
    vectors = table.filter((F.size(x) == dimensions) & finite).select(F.col(f"`{id_col}`").alias("vec_id"), whole.alias("v"))
    trees = work.put(forest(vectors, dimensions, block), "trees")
    hashed = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    start = vectors.select(hashed.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()  # k rows
    centroids = [list(r["v"]) for r in start]
    for _ in range(rounds if centroids else 0):
        for r in _sums(trees, centroids, dimensions):
            centroids[r["cluster"]][r["place"]] = int(r["total"]) // r["n"]
    # without vectors there are no trees either
    assigned = work.put(_assigned(trees, centroids, dimensions, vectors.schema[0].dataType), "assigned")
    digest = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest(), c) for i, c in enumerate(centroids)]
    known = spark.createDataFrame(digest, "cluster int, centroid_sha256 string, centroid array<long>")
    by = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row a centroid
    inertia = spark.createDataFrame([(i, s, sum(by.values())) for i, s in by.items()], "cluster int, cluster_inertia long, inertia long")
    # k rows each
    return assigned.join(F.broadcast(inertia), "cluster").join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")
