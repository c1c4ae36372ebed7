"""Search, mixed-type sort, paging and row ranges over any DataFrame."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.jsnum import cell_text, text_number, trimmed

PAGE_ROWS = 100
#: Rows that a report's table shows; ``report_view`` alone applies it.
VIEW_ROWS = 1000


def matches(df: DataFrame, term: str, columns: list[str] | None = None) -> Column:
    """Whether any cell has the term in it, letters of any case; the empty term is everywhere."""
    if not term:
        return F.lit(True)
    tests = [F.contains(F.lower(cell_text(F.col(f"`{c}`"), df.schema[c].dataType)), F.lit(term.lower())) for c in columns or df.columns]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def search(df: DataFrame, term: str, columns: list[str] | None = None) -> DataFrame:
    """Rows with the term in any cell. Chained ORs of built-ins stay in one codegen stage."""
    return df.filter(matches(df, term, columns))


def search_report(df: DataFrame, term: str) -> DataFrame:
    """As ``search``, with the term trimmed."""
    return search(df, term.strip())


class Key(NamedTuple):
    """A part of an order: an expression, its direction, where nulls go."""

    value: Column
    descending: bool = False
    nulls_first: bool = False

    def of(self, column: Column) -> Column:
        """The order's part with its value in ``column``."""
        if self.descending:
            return column.desc_nulls_first() if self.nulls_first else column.desc_nulls_last()
        return column.asc_nulls_first() if self.nulls_first else column.asc_nulls_last()

    def before(self, column: Column, value: object) -> Column:
        """Whether a column comes before a value in this part of the order."""
        if value is None:
            return F.lit(False) if self.nulls_first else column.isNotNull()
        less = column > F.lit(value) if self.descending else column < F.lit(value)
        return F.coalesce(less, F.lit(self.nulls_first))


def sort_parts(column: Column, kind: T.DataType, direction: str, *, excel: bool = False) -> list[Key]:
    """The order of ``sort_keys`` as parts whose values can be made columns once."""
    down = direction != "asc"
    if isinstance(kind, T.BooleanType) and not excel:
        column, kind = column.cast("int"), T.IntegerType()
    if isinstance(kind, T.FractionalType) and excel:
        column = F.nanvl(column, F.lit(None).cast(kind))
    if isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return [Key(column, down, down)]
    text = trimmed(column if isinstance(kind, T.StringType) else cell_text(column, kind))
    number = text_number(text)
    kinds = F.when(text == "", 2).when(number.isNotNull(), 0).otherwise(1)
    return [Key(kinds, down), Key(number, down), Key(F.lower(text), down)]


def sort_keys(column: Column, kind: T.DataType, direction: str, *, excel: bool = False) -> list[Column]:
    """Keys for ``orderBy``: numbers, then texts, then empty cells; descending, all of it reversed.

    A typed column is ordered as such; a text column's cells count as numbers
    where the whole of them is one. ``excel``: booleans as text, NaN as empty.
    """
    return [k.of(k.value) for k in sort_parts(column, kind, direction, excel=excel)]


def mixed_sort(df: DataFrame, column: str, direction: str | None, index: str, *, excel: bool = False) -> DataFrame:
    """Stable sort by one column (asc, desc or None); ties keep the order of ``index``."""
    if direction is None:
        return df.orderBy(F.col(f"`{index}`"))
    return df.orderBy(*sort_keys(F.col(f"`{column}`"), df.schema[column].dataType, direction, excel=excel), F.col(f"`{index}`").asc())


def next_direction(direction: str | None) -> str | None:
    """The next of a header's three states."""
    return {None: "asc", "asc": "desc", "desc": None}[direction]


def page_count(rows: int, page_rows: int = PAGE_ROWS) -> int:
    return max(1, -(-rows // page_rows))


def page(df: DataFrame, number: int, order: list[Column], page_rows: int = PAGE_ROWS) -> DataFrame:
    """A page of rows in order, its number clamped to those there are.

    Only the rows up to the page's end are ordered: ``limit`` over ``orderBy``
    is a top-k in each partition, whatever the table's size.
    """
    ordered = df.orderBy(*order)
    number = max(1, number)
    got = ordered.offset((number - 1) * page_rows).limit(page_rows)
    if number > 1 and got.isEmpty():
        number = page_count(df.count(), page_rows)
        got = ordered.offset((number - 1) * page_rows).limit(page_rows)
    return got


def numbered_page(df: DataFrame, number: int, order: list[Column], page_rows: int = PAGE_ROWS) -> DataFrame:
    """A page near the start with each row's position ``pos`` (from 1) in the whole order; ``deep_page`` is for any other."""
    first = (number - 1) * page_rows
    top = df.orderBy(*order).limit(first + page_rows)
    return top.withColumn("pos", F.row_number().over(Window.orderBy(*order)).cast("long")).filter(F.col("pos") > first)


def _keyed(df: DataFrame, order: list[Key | Column], prefix: str) -> tuple[DataFrame, list[Column]]:
    """The table with the order's values as columns, so that they are worked out once a row, and the order by those."""
    keys = {f"{prefix}{i}": k for i, k in enumerate(order) if isinstance(k, Key)}
    table = df.select("*", *[k.value.alias(c) for c, k in keys.items()])
    return table, [k.of(F.col(f"{prefix}{i}")) if isinstance(k, Key) else k for i, k in enumerate(order)]


def positions(df: DataFrame, order: list[Key | Column], name: str, path: str) -> DataFrame:
    """Each row's position ``name`` (from 1) in the whole order, which has to be total.

    Rows are dealt by ranges and sorted in each; ``path`` (in the shared folder) keeps
    them, so that counting and numbering see the same ranges. Only a count for each
    range reaches the driver; no task has more than its range. Of an order's ``Key``
    parts the values are written first: ranges are sampled, dealt and sorted by those.
    """
    part, at = f"_{name}_part", f"_{name}_at"
    spark = df.sparkSession
    keyed, by = _keyed(df, order, f"_{name}_key")
    if any(isinstance(k, Key) for k in order):
        keyed.write.parquet(f"{path}-keys")
        keyed = spark.read.schema(keyed.schema).parquet(f"{path}-keys")
    dealt = keyed.repartitionByRange(*by).sortWithinPartitions(*by).select(*[F.col(f"`{c}`") for c in df.columns])
    dealt.withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)).write.parquet(path)
    kept = spark.read.parquet(path)
    before, starts = 0, []
    for row in kept.groupBy(part).count().orderBy(part).collect():
        starts.append((row[0], before))
        before += row[1]
    offsets = spark.createDataFrame(starts, f"{part} int, _before long")
    return kept.join(F.broadcast(offsets), part).withColumn(name, F.col(at) + F.col("_before") + 1).select(*[F.col(f"`{c}`") for c in df.columns], name)


#: Ranges that a step towards a deep page tells apart, the keys sampled for them, and the rows of a range that are sorted.
PAGE_RANGES, PAGE_SAMPLE, PAGE_SORTED = 32, 8_000, 50_000


def deep_page(df: DataFrame, number: int, order: list[Key], page_rows: int = PAGE_ROWS, *, name: str = "pos", sorted_rows: int = PAGE_SORTED) -> DataFrame:
    """A page, however deep, with each row's position ``name`` (from 1) in the whole order, which has to be total.

    Nothing before the page is sorted or moved. A pass over the table counts the
    rows between keys of a sample; the range that holds the page is told apart once
    more until it has at most ``sorted_rows`` rows, and only those are sorted. Each
    step leaves about one in ``PAGE_RANGES``, so a table of any size needs few. The
    sample decides how even the ranges are, never the result. A number below 1 is the
    first page, one after the last page is the last.
    """
    prefix = f"_{name}_key"
    keyed, by = _keyed(df, order, prefix)
    columns = [F.col(f"{prefix}{i}") for i in range(len(order))]
    total = keyed.count()
    number = min(max(1, number), page_count(total, page_rows))
    first, last = (number - 1) * page_rows, min(number * page_rows, total)
    inside, before, rows = keyed, 0, total
    while rows > max(sorted_rows, 2 * page_rows):
        some = inside.select(*columns).sample(min(1.0, PAGE_SAMPLE / rows), 17).orderBy(*by).collect()
        cuts = list(dict.fromkeys(tuple(some[i * len(some) // PAGE_RANGES]) for i in range(1, PAGE_RANGES))) if some else []
        ahead = [_before(order, columns, cut) for cut in cuts]
        place = reduce(lambda a, b: a + b, [(~x).cast("int") for x in ahead], F.lit(0))
        counts = dict(inside.groupBy(place.alias("range")).count().collect())
        ends = [before + sum(counts.get(j, 0) for j in range(i + 1)) for i in range(len(cuts) + 1)]
        low = next(i for i, end in enumerate(ends) if end > first)
        high = next(i for i, end in enumerate(ends) if end >= last)
        kept = sum(counts.get(j, 0) for j in range(low, high + 1))
        if kept == rows:
            break
        before, rows = ends[low] - counts.get(low, 0), kept
        inside = inside.filter(reduce(lambda a, b: a & b, [F.lit(True), *([~ahead[low - 1]] if low else []), *([ahead[high]] if high < len(ahead) else [])]))
    # one partition in order: at most a page, behind at most a range
    page = inside.orderBy(*by).offset(first - before).limit(last - first)
    return page.coalesce(1).select(*[F.col(f"`{c}`") for c in df.columns], (F.monotonically_increasing_id() + first + 1).alias(name))


def _before(order: list[Key], columns: list[Column], cut: tuple) -> Column:
    """Whether a row comes before a cut, the order's parts compared from the first."""
    out = F.lit(False)
    for key, column, value in reversed(list(zip(order, columns, cut))):
        out = key.before(column, value) | (column.eqNullSafe(F.lit(value)) & out)
    return out


def row_range(df: DataFrame, start: int, end: int, index: str) -> DataFrame:
    """Rows whose index is in [start, end)."""
    return df.filter((F.col(f"`{index}`") >= start) & (F.col(f"`{index}`") < end))


def report_view(df: DataFrame, order: list[Column], rows: int = VIEW_ROWS) -> DataFrame:
    """The first rows a report's table shows."""
    return df.orderBy(*order).limit(rows)


def slice_bounds(start: float, end: float, rate: int, frames: int) -> tuple[int, int]:
    """Frames [a, b) of [start, end) seconds: swapped if reversed, clamped, 0.1 s at least."""
    length = frames / rate
    a, b = sorted((min(max(start, 0.0), length), min(max(end, 0.0), length)))
    if b - a < 0.1:
        b = min(length, a + 0.1)
        a = max(0.0, b - 0.1)
    return int(a * rate), int(b * rate)


def time_slice(df: DataFrame, frame: str, start: float, end: float, rate: int, frames: int) -> DataFrame:
    """Frames of [start, end) seconds, as ``slice_bounds`` has them."""
    low, high = slice_bounds(start, end, rate, frames)
    return df.filter((F.col(frame) >= low) & (F.col(frame) < high))


def collated(column: str, collation: str = "UNICODE") -> Column:
    """A sort key in dictionary order: a, A, b, B."""
    return F.collate(F.col(f"`{column}`"), collation)


def natural_key(column: Column) -> list[Column]:
    """Sort keys of names with a number in them: section2 before section10."""
    return [F.regexp_extract(column, r"^(\D*)", 1), F.regexp_extract(column, r"(\d+)", 1).try_cast("long"), column]
