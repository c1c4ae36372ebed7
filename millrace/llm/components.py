"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import FILE_ROWS, Workspace

MAX_ROUNDS = 60
#: Edges that a task holds at once to turn them into stars.
HELD_EDGES = 1 << 18


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the smallest one that these edges reach, less those from a node to itself."""
    nodes, at = np.unique(np.r_[u, v], return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while not (root[root] == root).all():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def out() -> pa.RecordBatch:
        u, v = stars(*(np.concatenate([x.column(k).to_numpy(zero_copy_only=False) for x in held]) for k in (0, 1)))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= HELD_EDGES:
            yield out()
            held = []
    if held:
        yield out()


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
    return tuple(row)


def connected_components(edges: DataFrame, work: Workspace, rows: int | None = None) -> DataFrame:
    """(node, root) for each node of ``edges`` (u, v): root is the smallest node reachable.

    Each round links every node's larger neighbours, then its smaller ones, to
    the smallest node near it, until only stars remain; the rounds grow with the
    logarithm of the longest path. Each round is written to the shared folder.
    Before that each task turns its own edges into stars.
    ``rows``: how many edges there are, if that is known. Up to ``FILE_ROWS`` are
    one task's, whose stars are the result: each round is a large plan, all of
    which the driver has to hold.
    """
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    if rows is not None:
        now = now.coalesce(max(1, -(-rows // FILE_ROWS)))
    now = work.put(now.mapInArrow(_stars, "u long, v long"), "edges0")
    if rows is None or rows > FILE_ROWS:
        now = _joined(now, work, rows)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _joined(now: DataFrame, work: Workspace, rows: int | None) -> DataFrame:
    """The stars of all edges (u, v), u > v, of the table ``edges0``."""
    before = _signature(now)
    for turn in range(1, MAX_ROUNDS + 1):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).select("w", F.least("w", "m").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("w")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # every edge of large is (larger, smaller)
        low = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        small = large.join(low, F.col("u") == F.col("w")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = work.put(small.unionByName(low.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct(), f"edges{turn}", rows=before[0])
        after = _signature(nxt)
        work.drop(f"edges{turn - 1}")
        now = nxt
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return now
