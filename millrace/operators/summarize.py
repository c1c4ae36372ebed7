"""Counts, tops, duplicates, boxes and peaks: aggregations with partial merges throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_and_column_counts(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total_rows")).withColumn("total_columns", F.lit(len(df.columns)).cast("long"))


def type_counts(df: DataFrame, column: str, first: str, top: int | None = None) -> DataFrame:
    """Values by count, descending, ties by their first appearance; ``rank`` from 1."""
    counted = df.groupBy(column).agg(F.count("*").alias("n"), F.min(first).alias("first_seen"))
    if top:
        counted = counted.orderBy(F.desc("n"), "first_seen").limit(top)
    return counted.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "first_seen")).cast("long"))


def distinct_count(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.countDistinct(column).alias("n_distinct"))


def conditional_counts(df: DataFrame, conditions: dict[str, Column], **others: Column) -> DataFrame:
    """Counts of rows that meet each condition, and other aggregates, in one pass."""
    return df.agg(*[F.count_if(c).alias(name) for name, c in conditions.items()], *[c.alias(name) for name, c in others.items()])


def duplicates(df: DataFrame, value: str, order: str) -> DataFrame:
    """The second and later occurrences of each value, with their number."""
    return df.withColumn("occurrence", F.row_number().over(Window.partitionBy(value).orderBy(order)).cast("long")).filter("occurrence > 1")


def repeated_values(df: DataFrame, value: str) -> DataFrame:
    """Values that occur more than once. Only counts are shuffled, so a hot value is one row a task."""
    return df.groupBy(value).agg(F.count("*").alias("n")).filter("n > 1")


def duplicate_summary(df: DataFrame, value: str) -> DataFrame:
    counted = df.groupBy(value).agg(F.count("*").alias("n"))
    return counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("distinct"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def shared_keys(df: DataFrame, by: list[str], name: str, order: str) -> DataFrame:
    """Rows whose key was taken before, with the name of the holder before."""
    return df.withColumn("previous", F.lag(name).over(Window.partitionBy(*by).orderBy(order))).filter("previous IS NOT NULL")


def bounding_boxes(df: DataFrame, by: list[str], **coordinates: Column) -> DataFrame:
    boxes = [f(c).alias(f"{side}_{name}") for name, c in coordinates.items() for side, f in (("min", F.min), ("max", F.max))]
    return df.groupBy(*by).agg(F.count("*").alias("n"), *boxes)


def merge_boxes(parts: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Boxes and counts of batches, merged."""
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), *[x for name in names for x in (F.min(f"min_{name}").alias(f"min_{name}"), F.max(f"max_{name}").alias(f"max_{name}"))])


def bucket_peaks(df: DataFrame, frame: str, value: Column, frames: int, width: int) -> DataFrame:
    """Bucket i has frames [i * frames / width, (i + 1) * frames / width): the largest magnitude, 0 if empty."""
    bucket = F.floor((F.col(frame).cast("long") * width + width - 1) / F.lit(frames)) if width > frames else F.expr(f"`{frame}` * {width} DIV {frames}")
    found = df.groupBy(bucket.cast("long").alias("bucket")).agg(F.max(F.abs(value)).alias("peak"))
    if width <= frames:
        return found
    every = df.sparkSession.range(width).select(F.col("id").alias("bucket"))
    return every.join(found, "bucket", "left").select("bucket", F.coalesce("peak", F.lit(0.0)).alias("peak"))


def pattern_count(text: Column, pattern: str) -> Column:
    """Occurrences of a fixed text that don't overlap."""
    return F.when(text.isNotNull(), F.size(F.split(text, F.lit("\\Q" + pattern.replace("\\E", "\\E\\\\E\\Q") + "\\E"), -1)) - 1).cast("long")


def dominant(df: DataFrame, by: list[str], value: str, threshold: float) -> DataFrame:
    """Each group's most frequent value where its share reaches the threshold (ties: the least)."""
    counted = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    best = counted.groupBy(*by).agg(F.min_by(value, F.struct(F.negative("n"), value)).alias(value), F.max("n").alias("n"), F.sum("n").alias("total"))
    return best.filter(F.col("n") >= F.col("total") * threshold)


def unpivot(df: DataFrame, ids: list[str], series: dict[str, Column]) -> DataFrame:
    """A row for each series: (ids, series, value)."""
    parts = F.array(*[F.struct(F.lit(k).alias("series"), v.cast("double").alias("value")) for k, v in series.items()])
    return df.select(*ids, F.inline(parts))


def running_bytes(df: DataFrame, text: str, order: str, by: list[str] | None = None) -> DataFrame:
    """Bytes of the lines up to each, line ends included."""
    return df.withColumn("bytes_so_far", F.sum(F.octet_length(text).cast("long") + 1).over(Window.partitionBy(*(by or [])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def carry_forward(df: DataFrame, value: Column, by: list[str], order: str, name: str) -> DataFrame:
    """The last value so far."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
