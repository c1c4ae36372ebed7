"""Growing text files as a stream: each line once, when its end has been written.

Spark's file streams take a file once, as a whole, and never see it grow. Here the
offset is how far each file has been read, in bytes, always just behind a line
break, so that a line still being written waits for its end. A batch reads only
what has been added, in ranges that tasks share.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources.ranges import Bytes
from ..sources.shapes import found_files

SCHEMA = "file string, offset long, value string"
#: Files whose last line break is looked for at once.
LOOKS = 16
#: Bytes of one partition, and of a step back from a file's end to its last line break.
RANGE_BYTES, STEP = 32 << 20, 1 << 16


def complete(path: str, size: int, known: int = 0) -> int:
    """Bytes up to and with the last line break of a file's first ``size``; ``known`` is one of them already."""
    with Bytes(path, STEP) as data:
        high = min(size, data.length)
        while high > known:
            low = max(known, high - STEP)
            at = data.get(low, high - low).rfind(b"\n")
            if at >= 0:
                return low + at + 1
            high = low
    return known


@dataclass
class LineRange:
    """Lines that start in [low, high); ``first`` says that one starts at ``low``."""

    file: str
    low: int
    high: int
    end: int
    first: bool


@dataclass
class LineRanges(InputPartition):
    """Ranges that one task reads."""

    parts: list[LineRange]


def dealt(parts: list[LineRange], tasks: int) -> list[LineRanges]:
    """Ranges in order, put together up to an equal share of ``tasks`` tasks, at most ``RANGE_BYTES``: small files share a task."""
    share = min(RANGE_BYTES, -(-sum(p.high - p.low for p in parts) // tasks))
    out, size = [], 0
    for part in parts:
        if not out or size + part.high - part.low > share:
            out.append(LineRanges([]))
            size = 0
        out[-1].parts.append(part)
        size += part.high - part.low
    return out


def lines(part: LineRange) -> Iterator[tuple[str, int, str]]:
    with Bytes(part.file) as data:
        at = part.low
        if not part.first:  # behind the break of the line that the range before reads to its end
            at = _break(data, at - 1, part.end)
        while at < part.high:
            end = _break(data, at, part.end)
            yield part.file, at, data.get(at, end - at).rstrip(b"\n").removesuffix(b"\r").decode("utf-8", "replace")
            at = end


def _break(data: Bytes, at: int, end: int) -> int:
    """The place behind the next line break from ``at``, or the end."""
    step = 1 << 12
    while at < end:
        found = data.get(at, min(step, end - at)).find(b"\n")
        if found >= 0:
            return at + found + 1
        at, step = at + step, min(step * 2, 1 << 22)
    return end


class TailSource(DataSource):
    """``spark.readStream.format("tail").load(path)``: see ``tailed``."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


class TailReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.range, self.tasks = options["path"], int(options.get("range", RANGE_BYTES)), int(options.get("tasks", 1))
        self.seen: dict[str, tuple[int, int]] = {}  # of each file: (size when looked at, complete bytes then)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """How far each file is complete; only what was added since the last look is searched for a break."""

        def look(found: tuple[str, int]) -> tuple[str, tuple[int, int]]:
            path, size = found
            size_then, known = self.seen.get(path, (0, 0))
            if size < size_then:  # begun anew
                known = 0
            if size != size_then:
                known = complete(path, size, known)
            return path, (size, known)

        with ThreadPoolExecutor(LOOKS) as pool:
            self.seen.update(pool.map(look, found := found_files(self.path)))
        return {path: self.seen[path][1] for path, _ in found}

    def partitions(self, start: dict, end: dict) -> list[LineRanges]:
        out = []
        for path, high in sorted(end.items()):
            low = start.get(path, 0)
            if high < low:  # a file that has been begun anew
                low = 0
            out += [LineRange(path, at, min(at + self.range, high), high, at == low) for at in range(low, high, self.range)]
        return dealt(out, self.tasks) or [LineRanges([])]

    def read(self, partition: LineRanges) -> Iterator[tuple]:
        for part in partition.parts:
            yield from lines(part)

    def commit(self, end: dict) -> None:
        pass


def tailed(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A stream of (file, offset, value): the lines of a folder's files, as they grow.

    ``offset`` is the byte that a line starts at. A last line without a break comes
    when its break does; a file that got shorter is read from its start; new files
    are found. A restarted query goes on from its checkpoint.
    """
    spark.dataSource.register(TailSource)
    return spark.readStream.format("tail").option("range", range_bytes).option("tasks", 2 * spark.sparkContext.defaultParallelism).load(path)
