"""Exact deduplication by Grace hashing.

Records are first combined inside each scan task, then spilled to bucket files
by a hash of their content and each bucket is resolved in an open-addressing
table that compares complete normalised content. A bucket that outgrows its
table is spilled again under another hash, level after level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Workspace, shuffle_partitions

#: Bytes of records that one bucket's table may hold.
TABLE_BYTES = 48 << 20
MAX_LEVEL = 8

_HELPERS = ("_mr_text", "_mr_id", "_mr_uid", "_mr_n", "_mr_sha", "_mr_bytes", "_mr_kind")


class ContentTable:
    """Open addressing with linear probing; equality is that of the whole content."""

    def __init__(self, capacity: int = 1024):
        self._slots = [-1] * capacity
        self._mask = capacity - 1
        self.hashes: list[int] = []
        self.contents: list[bytes] = []

    def __len__(self) -> int:
        return len(self.contents)

    def find_or_add(self, h: int, content: bytes) -> tuple[int, bool]:
        """Index of the entry with this content, and whether it is new."""
        slots, mask = self._slots, self._mask
        at = h & mask
        while (entry := slots[at]) >= 0:
            if self.hashes[entry] == h and self.contents[entry] == content:
                return entry, False
            at = (at + 1) & mask
        entry = slots[at] = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        if 2 * len(self.contents) > mask:
            self._grow()
        return entry, True

    def _grow(self) -> None:
        size = 4 * (self._mask + 1)
        slots, mask = [-1] * size, size - 1
        for entry, h in enumerate(self.hashes):
            at = h & mask
            while slots[at] >= 0:
                at = (at + 1) & mask
            slots[at] = entry
        self._slots, self._mask = slots, mask


class _Combiner:
    """Groups of equal content among the batches so far, with the winning row of each."""

    def __init__(self):
        self.table = ContentTable()
        self.rows: list[tuple[int, int]] = []  # (batch, row) of each group's winner
        self.rank: list[tuple] = []
        self.count: list[int] = []
        self.batches: list[pa.RecordBatch] = []
        self.bytes = 0

    def add(self, batch: pa.RecordBatch) -> None:
        names = batch.schema.names
        texts, ids, uids, counts, shas = (batch.column(names.index(c)).to_pylist() for c in _HELPERS[:5])
        number = len(self.batches)
        self.batches.append(batch)
        self.bytes += batch.nbytes
        for row, (text, key, uid, n, sha) in enumerate(zip(texts, ids, uids, counts, shas)):
            entry, new = self.table.find_or_add(int(sha[:16], 16), (text or b"").lower())
            rank = (key is not None, key if key is not None else 0, -uid)
            if new:
                self.rows.append((number, row))
                self.rank.append(rank)
                self.count.append(n)
            else:
                self.count[entry] += n
                if rank > self.rank[entry]:
                    self.rank[entry] = rank
                    self.rows[entry] = (number, row)

    def result(self) -> list[pa.RecordBatch]:
        by_batch: list[tuple[list[int], list[int]]] = [([], []) for _ in self.batches]
        for (number, row), n in zip(self.rows, self.count):
            by_batch[number][0].append(row)
            by_batch[number][1].append(n)
        out = []
        for batch, (rows, counts) in zip(self.batches, by_batch):
            if rows:
                part = batch.take(pa.array(rows, pa.int64()))
                at = part.schema.names.index("_mr_n")
                out.append(part.set_column(at, part.schema.field(at), pa.array(counts, pa.int64())))
        return out


def _typed(batch: pa.RecordBatch, kind: str) -> pa.RecordBatch:
    at = batch.schema.names.index("_mr_kind")
    return batch.set_column(at, pa.field("_mr_kind", pa.string()), pa.array([kind] * batch.num_rows, pa.string()))


def _sliced(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def _scan(keep: list[str], table_bytes: int):
    """Hash each record; emit it without content ("row") and, combined, with content ("spill")."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = _Combiner()
        for whole in batches:
            for batch in _sliced(whole):
                names = batch.schema.names
                texts = batch.column(names.index("_mr_text")).to_pylist()
                low = [(x or b"").lower() for x in texts]
                cols = {c: batch.column(names.index(c)) for c in names}
                cols["_mr_sha"] = pa.array([hashlib.sha256(x).hexdigest() for x in low], pa.string())
                cols["_mr_n"] = pa.array([1] * batch.num_rows, pa.int64())
                cols["_mr_bytes"] = pa.array([len(x) for x in low], pa.int64())
                cols["_mr_kind"] = pa.array(["spill"] * batch.num_rows, pa.string())
                full = pa.RecordBatch.from_pydict({c: cols[c] for c in [*keep, *_HELPERS]})
                empty = {c: pa.nulls(batch.num_rows, full.schema.field(c).type) for c in [*keep, "_mr_text"]}
                yield pa.RecordBatch.from_pydict({c: empty.get(c, cols[c]) for c in [*keep, *_HELPERS[:-1]]} | {"_mr_kind": pa.array(["row"] * batch.num_rows, pa.string())})
                group.add(full)
                if group.bytes > table_bytes:
                    yield from group.result()
                    group = _Combiner()
        yield from group.result()

    return run


def _without_text(batch: pa.RecordBatch) -> pa.RecordBatch:
    at = batch.schema.names.index("_mr_text")
    return batch.set_column(at, batch.schema.field(at), pa.nulls(batch.num_rows, batch.schema.field(at).type))


def _resolve(table_bytes: int, keep_text: bool):
    """One bucket: resolved as a whole ("final"), or combined and spilled again ("spill").

    Content that nobody asked for isn't written again with the final rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, kind = _Combiner(), "final"
        for batch in batches:
            for part in _sliced(batch):
                group.add(part)
                if group.bytes > table_bytes:
                    small = _Combiner()
                    for x in group.result():
                        small.add(x)
                    group = small
                    if group.bytes > table_bytes // 2:  # the distinct content itself is too large
                        kind = "spill"
                        for x in group.result():
                            yield _typed(x, kind)
                        group = _Combiner()
        for x in group.result():
            yield _typed(x if keep_text or kind == "spill" else _without_text(x), kind)

    return run


def _helped(docs: DataFrame, keep: list[str], text_col: str, id_col: str) -> tuple[DataFrame, T.StructType]:
    base = docs.select(
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)],
        F.col(f"`{text_col}`").cast("binary").alias("_mr_text"),
        F.col(f"`{id_col}`").alias("_mr_id"),
        F.monotonically_increasing_id().alias("_mr_uid"),
    )
    schema = T.StructType([T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(keep)])
    for name, kind in zip(_HELPERS, (T.BinaryType(), docs.schema[id_col].dataType, T.LongType(), T.LongType(), T.StringType(), T.LongType(), T.StringType())):
        schema = schema.add(name, kind)
    return base, schema


def grace_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", *, carry: list[str] | None = None, table_bytes: int = TABLE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(rows, winners) of the groups of equal content.

    rows: one per input row (_mr_id, _mr_uid, _mr_sha, _mr_bytes). winners: one
    per group, the winning row's columns c0.. (those in ``carry``), its _mr_id,
    _mr_uid, _mr_sha, and _mr_n, the group's size. The largest non-null id wins;
    equal ids: the first row read.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "grace")
    base, schema = _helped(docs, [c for c in carry or [] if c != text_col], text_col, id_col)
    carry = carry or []
    names = [f"c{i}" for i in range(sum(c != text_col for c in carry))]  # the text is _mr_text
    level0 = work.put(base.mapInArrow(_scan(names, table_bytes), schema), "level0", "_mr_kind")
    rows = level0.filter("_mr_kind = 'row'").select("_mr_id", "_mr_uid", "_mr_sha", "_mr_bytes")
    spill = level0.filter("_mr_kind = 'spill'")
    done: list[DataFrame] = []
    level = 0
    while True:
        level += 1
        total = spill.agg(F.sum(F.col("_mr_bytes") + 64)).first()[0] or 0
        if not total:
            break
        buckets = max(shuffle_partitions(spark), -(-4 * total // table_bytes))
        limit = table_bytes if level < MAX_LEVEL else 1 << 62  # distinct hashes are apart by then
        dealt = spill.repartition(int(buckets), F.xxhash64(F.col("_mr_sha"), F.lit(level)))
        out = work.put(dealt.mapInArrow(_resolve(limit, text_col in carry), schema), f"level{level}", "_mr_kind")
        work.drop(f"level{level - 1}/_mr_kind=spill")
        done.append(out.filter("_mr_kind = 'final'"))
        spill = out.filter("_mr_kind = 'spill'")
    winners = done[0] if done else spill
    for more in done[1:]:
        winners = winners.unionByName(more)
    others = iter([F.col(c) for c in names])
    back = [F.col("_mr_text").cast(docs.schema[text_col].dataType) if c == text_col else next(others) for c in carry]
    return rows, winners.select(*[c.alias(f"c{i}") for i, c in enumerate(back)], "_mr_id", "_mr_uid", "_mr_sha", "_mr_n")


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", *, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, text_sha256, n_bytes``.

    Texts are equal when identical after lower-casing A-Z; the row with the
    largest id stays. Null text counts as empty; a null id never wins over
    another; of rows equal in text and id exactly one is kept. An empty table
    gives an empty result, and other columns of the input are ignored.
    """
    rows, winners = grace_groups(docs, text_col, id_col, table_bytes=table_bytes)
    groups = winners.filter("_mr_n > 1").select(F.col("_mr_sha").alias("_g_sha"), F.col("_mr_id").alias("_g_id"), F.col("_mr_uid").alias("_g_uid"), F.col("_mr_n").alias("_g_n"))
    joined = rows.join(groups, rows["_mr_sha"] == groups["_g_sha"], "left")
    return joined.select(
        F.col("_mr_id").alias(id_col),
        F.when(F.col("_g_n").isNull(), F.col("_mr_id")).otherwise(F.col("_g_id")).alias("keep_id"),
        F.coalesce("_g_n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("_g_uid").isNull() | (F.col("_g_uid") == F.col("_mr_uid"))).alias("kept"),
        F.col("_mr_sha").alias("text_sha256"),
        F.col("_mr_bytes").alias("n_bytes"),
    )


def keep_first_copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", *, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The input's rows, all columns, less those that ``exact_dedup`` doesn't keep."""
    carry = list(docs.columns)
    _, winners = grace_groups(docs, text_col, id_col, carry=carry, table_bytes=table_bytes)
    return winners.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)])
