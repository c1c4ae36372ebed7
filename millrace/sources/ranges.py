"""Byte ranges of files: cut by size, read at an offset, stitched where one ends.

Formats whose records have no fixed place are read in two steps. Each range first
guesses where its first record starts and walks from there over the records'
headers; then the ranges of a file are put end to end, and a range whose guess isn't
where the one before it ended is walked again from there. What the second step
hands on is exact, whatever the guesses were; right guesses only save time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .files import scratch

RANGE_BYTES = 64 << 20
#: Bytes read at once while walking.
CHUNK = 4 << 20
ROWS = 5000


def open_file(path: str):
    """A random-access file of the local or of a remote file system."""
    if path.startswith("file:"):
        return pa_fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    if not urlparse(path).scheme:
        return pa_fs.LocalFileSystem().open_input_file(path)
    fs, at = pa_fs.FileSystem.from_uri(path)
    return fs.open_input_file(at)


class Bytes:
    """Bytes of a file by offset, read in chunks: a walk over small records reads each chunk once, one over large ones skips."""

    def __init__(self, path: str, chunk: int = CHUNK):
        self.handle = open_file(path)
        self.length = self.handle.size()
        self.chunk, self.low, self.held, self.read = chunk, 0, b"", 0

    @classmethod
    def of(cls, content: bytes) -> Bytes:
        """Of bytes in memory."""
        out = cls.__new__(cls)
        out.handle, out.length, out.chunk, out.low, out.held, out.read = None, len(content), CHUNK, 0, content, 0
        return out

    def get(self, at: int, n: int) -> bytes:
        """Up to n bytes from an offset, fewer at the end of the file."""
        if self.handle and (at < self.low or at + n > self.low + len(self.held)):
            self.handle.seek(min(at, self.length))
            self.low, self.held = at, self.handle.read(max(n, min(self.chunk, self.length - at)) if at < self.length else 0)
            self.read += len(self.held)
        return self.held[at - self.low : at - self.low + n]

    def __enter__(self) -> Bytes:
        return self

    def __exit__(self, *_) -> None:
        self.handle.close()


def listed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, length); contents aren't read, so files may have any size."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length")


def cut(spark: SparkSession, path: str | list[str], size: int = RANGE_BYTES) -> DataFrame:
    """(file, length, part, low, high): each file's bytes in ranges of ``size``; Spark lists no empty files."""
    parts = F.sequence(F.lit(0).cast("long"), F.greatest(F.expr(f"(length - 1) DIV {size}"), F.lit(0).cast("long")))
    split = listed(spark, path).select("file", "length", F.explode(parts).alias("part"))
    return split.select("file", "length", "part", (F.col("part") * size).alias("low"), F.least(F.col("part") * size + size, F.greatest("length", F.lit(1))).alias("high"))


def tasks_for(spark: SparkSession, ranges: DataFrame) -> int:
    """How many tasks walk some ranges: one for ``RANGE_BYTES``, so that small ranges share one, but enough for all cores."""
    many, size = ranges.agg(F.count("*"), F.coalesce(F.sum(F.col("high") - F.col("low")), F.lit(0))).first()
    return max(1, min(many, 100_000, max(2 * spark.sparkContext.defaultParallelism, -(-size // RANGE_BYTES))))


def spread(df: DataFrame, tasks: int) -> DataFrame:
    """Rows of (file, part) dealt to some tasks."""
    return df.repartition(tasks, "file", "part")


def mapped(df: DataFrame, rows_of: Callable[[dict], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows that a function yields for each row (a dict) of a table of files or ranges."""
    own = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for given in batch.to_pylist():
                rows: list[tuple] = []
                size = 0
                for row in rows_of(given):
                    rows.append(row)
                    size += sum(len(v) for v in row if isinstance(v, bytes))
                    if len(rows) == ROWS or size > CHUNK:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), arrow)], schema=arrow)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), arrow)], schema=arrow)

    return df.mapInArrow(run, own)


def batched(df: DataFrame, columns_of: Callable[[dict], Iterator[list]], schema: str) -> DataFrame:
    """As ``mapped`` for columns: the function yields lists of arrays, a list for each column."""
    own = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for given in batch.to_pylist():
                for columns in columns_of(given):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, arrow)], schema=arrow)

    return df.mapInArrow(run, own)


def heads(spark: SparkSession, path: str | list[str], n: int) -> DataFrame:
    """(file, length, content): the first bytes of each file."""

    def head(row: dict) -> Iterator[tuple]:
        with Bytes(row["file"], n) as data:
            yield row["file"], row["length"], data.get(0, n)

    return mapped(listed(spark, path), head, "file string, length long, content binary")


#: One range after walking: where its first record starts, where the walk stopped, the state at both, what it met, and whether the file can't be read on.
WALK = "file string, length long, part long, low long, high long, start long, begin string, stop long, end string, met array<long>, dead boolean"
INDEX = WALK + ", before array<long>"


def walked(row: dict, guess: Callable, walk: Callable, kinds: int) -> tuple:
    """The range of a row, walked from where its first record seems to start."""
    given = tuple(row[c] for c in ("file", "length", "part", "low", "high"))
    with Bytes(row["file"]) as data:
        found = guess(data, row["low"], row["high"])
        if found is None:
            return (*given, None, None, None, None, [0] * kinds, False)
        start, begin = found
        stop, end, met, dead = walk(data, start, row["high"], begin)
        return (*given, start, begin, stop, end, met, dead)


def stitched(rows: list[tuple], walk: Callable, kinds: int) -> Iterator[tuple]:
    """The ranges of one file, in order, put end to end; those that started at a wrong place are walked again."""
    before, at, state, over = [0] * kinds, None, None, False
    for file, length, part, low, high, start, begin, stop, end, met, dead in rows:
        if over or at is not None and at >= high:  # nothing starts here
            start, begin, stop, end, met, dead = None, None, None, None, [0] * kinds, False
        elif at is not None and (start != at or begin != state):
            with Bytes(file) as data:
                start, begin = at, state
                stop, end, met, dead = walk(data, start, high, begin)
        yield file, length, part, low, high, start, begin, stop, end, met, dead, before
        before = [a + b for a, b in zip(before, met)]
        if start is not None:
            at, state, over = stop, end, dead


def indexed(spark: SparkSession, path: str | list[str], guess: Callable, walk: Callable, kinds: int, size: int = RANGE_BYTES) -> DataFrame:
    """The ranges of each file with exact starts, and the numbers of things met ``before`` each.

    ``guess(data, low, high)`` gives (start, state) or None; ``walk(data, start, high, state)``
    gives (stop, state, numbers met, dead) and reads headers only. A start of null
    means that no record starts in the range. The index is a row for each range; it
    is written to the shared folder, so that all tables of a report share it.
    """

    def first(row: dict) -> Iterator[tuple]:
        yield walked(row, guess, walk, kinds)

    arrow = to_arrow_schema(T._parse_datatype_string(INDEX))

    def stitch(table: pa.Table) -> pa.Table:
        rows = sorted((tuple(r.values()) for r in table.select([c.split()[0] for c in WALK.split(", ")]).to_pylist()), key=lambda r: r[2])
        done = list(zip(*stitched(rows, walk, kinds)))
        return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(done, arrow)], schema=arrow)

    ranges = cut(spark, path, size)
    tasks = tasks_for(spark, ranges)
    kept = scratch(spark, "ranges")
    # the ranges of one file are few rows: its size by the size of a range
    mapped(spread(ranges, tasks), first, WALK).groupBy("file").applyInArrow(stitch, INDEX).write.parquet(kept)
    return spread(spark.read.schema(INDEX).parquet(kept), tasks)
