"""Row, column and line edits as functions from DataFrame to DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import scratch
from .grid import positions


def _empty_row(df: DataFrame, index: str, at: int) -> DataFrame:
    return df.sparkSession.range(1).select(*[F.lit(at).cast(df.schema[index].dataType).alias(c) if c == index else (F.lit("") if df.schema[c].dataType.simpleString() == "string" else F.lit(None)).cast(df.schema[c].dataType).alias(c) for c in df.columns])


def insert_row(df: DataFrame, index: str, at: int) -> DataFrame:
    """An empty row at an index; later rows move on by one. No shuffle: indexes are shifted in place."""
    return df.withColumn(index, F.when(F.col(index) >= at, F.col(index) + 1).otherwise(F.col(index)).cast(df.schema[index].dataType)).unionByName(_empty_row(df, index, at))


def delete_row(df: DataFrame, index: str, at: int | None = None) -> DataFrame:
    """Without a row (the last, unless ``at`` is given); the only row stays."""
    rows, last = df.agg(F.count("*"), F.max(index)).first()
    if rows <= 1:
        raise ValueError("the last row can't be deleted")
    at = last if at is None else at
    return df.filter(F.col(index) != at).withColumn(index, F.when(F.col(index) > at, F.col(index) - 1).otherwise(F.col(index)).cast(df.schema[index].dataType))


def insert_column(df: DataFrame, at: int | None = None, name: str | None = None) -> DataFrame:
    """A column of empty texts, named Column{n + 1} unless a name is given."""
    cols = df.columns
    at = len(cols) if at is None else at
    new = F.lit("").alias(name or f"Column{len(cols) + 1}")
    named = [F.col(f"`{c}`") for c in cols]
    return df.select(*named[:at], new, *named[at:])


def delete_column(df: DataFrame, name: str | None = None) -> DataFrame:
    if len(df.columns) <= 1:
        raise ValueError("the last column can't be deleted")
    return df.drop(name or df.columns[-1])


def update_cell(df: DataFrame, index: str, at: int, column: str, value: object) -> DataFrame:
    return df.withColumn(column, F.when(F.col(index) == at, F.lit(value).cast(df.schema[column].dataType)).otherwise(F.col(f"`{column}`")))


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.withColumnRenamed(old, new)


def fit_width(cells: Column, width: int) -> Column:
    """Cells padded with empty ones, or cut, to a header's width."""
    return F.slice(F.concat(cells, F.array_repeat(F.lit(""), width)), 1, width)


def update_line(df: DataFrame, number: str, text: str, at: int, value: str) -> DataFrame:
    _within(df, number, at)
    return update_cell(df, number, at, text, value)


def delete_lines(df: DataFrame, number: str, ats: list[int], strict: bool = False) -> DataFrame:
    """Lines that aren't there are passed over, unless ``strict``. The rest is numbered anew."""
    if strict:
        for at in ats:
            _within(df, number, at)
    gone = sorted(set(ats))
    before = F.size(F.filter(F.array(*[F.lit(g) for g in gone]), lambda g: g < F.col(number))) if gone else F.lit(0)
    return df.filter(~F.col(number).isin(gone)).withColumn(number, (F.col(number) - before).cast(df.schema[number].dataType))


def insert_line(df: DataFrame, number: str, text: str, at: int, value: str) -> DataFrame:
    new = insert_row(df, number, at)
    return update_cell(new, number, at, text, value)


def move_line(df: DataFrame, number: str, at: int, to: int) -> DataFrame:
    """The line at ``at`` goes to ``to``; those between move by one."""
    n = F.col(number)
    moved = F.when(n == at, F.lit(to)).when((n > at) & (n <= to), n - 1).when((n < at) & (n >= to), n + 1).otherwise(n)
    return df.withColumn(number, moved.cast(df.schema[number].dataType))


def append_valid(lines: DataFrame, pasted: DataFrame, number: str, valid: str) -> DataFrame:
    """Valid pasted lines, in order, after the others."""
    last = lines.agg(F.coalesce(F.max(number), F.lit(0))).first()[0]
    placed = positions(pasted.filter(F.col(valid)), [F.col(number).asc()], "_place", scratch(lines.sparkSession, "pasted"))
    return lines.unionByName(placed.withColumn(number, (F.col("_place") + last).cast(lines.schema[number].dataType)).drop("_place"), allowMissingColumns=True)


def _within(df: DataFrame, number: str, at: int) -> None:
    if not df.filter(F.col(number) == at).limit(1).count():
        raise IndexError(f"there is no line {at}")
