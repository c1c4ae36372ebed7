"""Lines that are edited by their number without being numbered anew: labels between labels.

A row's place is a label, a text that sorts where the row stands; between any two
labels there is room for more. The base table's labels are its row numbers of fixed
width, so that a number is turned into a label without looking at the table; edits
are a log of labels, small enough for the driver (it is folded into a new base when
it grows). An edit writes the rows it names and no others.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sinks.versions import VersionedTable
from ..sources.files import scratch
from .grid import Key, positions

DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: Digits of a base label: room for 62^9 rows, over 10^16.
WIDTH = 9
#: Edits after which the log is folded into a new base.
LOG_ROWS = 100_000


def base_label(rank: int) -> str:
    """A row number (and one, so that there are labels before the first) in digits."""
    out, rank = "", rank + 1
    for _ in range(WIDTH):
        rank, digit = divmod(rank, 62)
        out = DIGITS[digit] + out
    return out


def between(a: str, b: str | None) -> str:
    """A label after ``a`` and before ``b`` (none: no end), about in the middle and as short as that allows."""
    out, i = "", 0
    while True:
        x = DIGITS.index(a[i]) if i < len(a) else 0
        y = DIGITS.index(b[i]) if b is not None and i < len(b) else 62
        if y - x > 1:
            return out + DIGITS[(x + y) // 2]
        out += DIGITS[x]
        if x < y:
            b = None
        i += 1


def spread(a: str, b: str | None, n: int) -> list[str]:
    """n rising labels between two, halved again and again so that they stay short."""
    if n == 0:
        return []
    middle = between(a, b)
    return [*spread(a, middle, (n - 1) // 2), middle, *spread(middle, b, n - 1 - (n - 1) // 2)]


class OrderedTable:
    """A table of rows in order, edited by row numbers (from 0). Edits are seen at once and kept by ``commit``."""

    def __init__(self, spark: SparkSession, root: str, log_rows: int = LOG_ROWS):
        self.spark, self.root, self.log_rows = spark, root.rstrip("/"), log_rows
        self.base = VersionedTable(spark, f"{self.root}/base")
        self.written = 0  # rows that commits have written
        self._load()

    @classmethod
    def create(cls, df: DataFrame, order: list[Key], root: str, log_rows: int = LOG_ROWS) -> OrderedTable:
        """A new table of a frame's rows in an order that has to be total."""
        VersionedTable(df.sparkSession, f"{root.rstrip('/')}/base").save(cls._labelled(df, order))
        return cls(df.sparkSession, root, log_rows)

    @staticmethod
    def _labelled(df: DataFrame, order: list[Key]) -> DataFrame:
        numbered = positions(df, order, "_place", scratch(df.sparkSession, "ordered"))
        digit = lambda k: F.substring(F.lit(DIGITS), (F.pmod(F.expr(f"_place DIV {62**k}L"), F.lit(62)) + 1).cast("int"), F.lit(1))
        label = F.concat(*[digit(k) for k in reversed(range(WIDTH))])
        return numbered.select(label.alias("label"), *[F.col(f"`{c}`") for c in df.columns])

    def _load(self) -> None:
        """The state of the last commit; the log is read to the driver, which ``log_rows`` bounds."""
        self.version = self.base.versions()[-1]
        rows = self.base.read(self.version)
        self.schema = T.StructType(rows.schema.fields[1:])
        self.rows = rows.count()
        self.deleted: list[int] = []  # ranks of the base's rows that are gone
        self.inserted: list[str] = []  # labels of rows that the base hasn't
        self.pending: list[Row] = []
        self.commits = self.logged = 0
        for r in sorted(self._log().collect(), key=lambda r: (r["commit"], r["seq"])):
            self._note(r["label"], r["gone"])
            self.commits, self.logged = max(self.commits, r["commit"]), self.logged + 1

    def _log_path(self) -> str:
        return f"{self.root}/log-{self.version:020d}"

    def _log_schema(self) -> T.StructType:
        return T.StructType([T.StructField("label", T.StringType()), T.StructField("gone", T.BooleanType()), T.StructField("commit", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("row", self.schema)])

    def _log(self) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._log_path())
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], self._log_schema())
        return self.spark.read.schema(self._log_schema()).parquet(self._log_path())

    # numbers and labels

    def _rank(self, label: str) -> int | None:
        """The base's row number behind a label, if it is one of its labels."""
        if len(label) != WIDTH:
            return None
        rank = 0
        for c in label:
            rank = rank * 62 + DIGITS.index(c)
        return rank - 1 if 0 < rank <= self.rows else None

    def _note(self, label: str, gone: bool) -> None:
        rank = self._rank(label)
        known, value = (self.deleted, rank) if rank is not None else (self.inserted, label)
        at = bisect_left(known, value)
        there = at < len(known) and known[at] == value
        if (gone if rank is not None else not gone) and not there:
            insort(known, value)
        elif (not gone if rank is not None else gone) and there:
            del known[at]

    def count(self) -> int:
        return self.rows - len(self.deleted) + len(self.inserted)

    def _before(self, rank: int) -> int:
        """Rows before the base's row of a rank."""
        return rank - bisect_left(self.deleted, rank) + bisect_left(self.inserted, base_label(rank)) if rank >= 0 else 0

    def label_at(self, number: int) -> str:
        """The label of a row, by bisection over the base's ranks and the edits."""
        if not 0 <= number < self.count():
            raise IndexError(f"row {number} of {self.count()}")
        low, high = -1, self.rows  # the last rank with at most ``number`` rows before it
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if self._before(middle) <= number else (low, middle)
        offset = number - self._before(low)
        at = bisect_left(self.deleted, low)
        live = low >= 0 and not (at < len(self.deleted) and self.deleted[at] == low)
        if live and offset == 0:
            return base_label(low)
        return self.inserted[(bisect_left(self.inserted, base_label(low)) if low >= 0 else 0) + offset - live]

    # edits

    def _put(self, label: str, gone: bool, row: tuple | None) -> None:
        self.pending.append(Row(label=label, gone=gone, commit=self.commits + 1, seq=len(self.pending), row=row))
        self._note(label, gone)

    def insert(self, number: int, rows: list[tuple]) -> None:
        """Rows before the one with that number, or at the end."""
        if not 0 <= number <= self.count():
            raise IndexError(f"row {number} of {self.count()}")
        a = self.label_at(number - 1) if number else ""
        b = self.label_at(number) if number < self.count() else None
        for label, row in zip(spread(a, b, len(rows)), rows):
            self._put(label, False, tuple(row))

    def delete(self, numbers: list[int]) -> None:
        """Rows by their numbers before the edit (E02, E07); a table's only row stays."""
        labels = [self.label_at(n) for n in sorted(set(numbers))]
        if self.count() == 1 and labels:
            raise ValueError("the only row stays")
        for label in labels:
            self._put(label, True, None)

    def set(self, number: int, row: tuple) -> None:
        """Another row in place of one."""
        self._put(self.label_at(number), False, tuple(row))

    def move(self, number: int, to: int) -> None:
        """A row to where the one with number ``to`` is after it has been taken out."""
        label = self.label_at(number)
        row = self._row(label)
        self._put(label, True, None)
        self.insert(to, [row])

    def _row(self, label: str) -> tuple:
        """A row's cells: pending ones from the log, others by one filtered read."""
        for r in reversed(self.pending):
            if r["label"] == label:
                return r["row"]
        return tuple(self._merged(self._log()).filter(F.col("label") == label).drop("label").first())

    # reading and keeping

    def _merged(self, log: DataFrame) -> DataFrame:
        last = log.groupBy("label").agg(F.max_by(F.struct("gone", "row"), F.struct("commit", "seq")).alias("now"))
        put = last.filter("NOT now.gone").select("label", "now.row.*")
        return self.base.read(self.version).join(last.select("label"), "label", "left_anti").unionByName(put)

    def read(self) -> DataFrame:
        """(label, cells) of all rows, the log of the last commit merged; the order is that of the labels."""
        return self._merged(self._log())

    def commit(self) -> None:
        """Keep the edits since the last commit: the rows they name, in one small file."""
        if self.pending:
            self.spark.createDataFrame(self.pending, self._log_schema()).coalesce(1).write.mode("append").parquet(self._log_path())
            self.written += len(self.pending)
            self.commits, self.logged, self.pending = self.commits + 1, self.logged + len(self.pending), []
        if self.logged > self.log_rows:
            self.compact()

    def compact(self) -> None:
        """A new base with the log in it; the switch is the manifest's, so a stop in between leaves the old base and its log."""
        if self.pending:
            raise ValueError("edits that aren't committed")
        merged = self.read()
        self.base.save(self._labelled(merged.withColumnRenamed("label", "_label"), [Key(F.col("_label"))]).drop("_label"), based_on=self.version)
        self._load()
