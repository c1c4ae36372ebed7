"""Unions and distincts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_sources(parts: dict[str, DataFrame], label: str = "source") -> DataFrame:
    """Rows of all parts, each with its part's name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(label, F.lit(name)) for name, df in parts.items()])


def append(first: DataFrame, *more: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), more, first)


def ordered_distinct(df: DataFrame, value: str, order: str) -> DataFrame:
    """Each value once, at its first place. A partial minimum: no window over hot values."""
    return df.groupBy(value).agg(F.min(order).alias(order))


def key_union(objects: DataFrame, keys: str, order: str) -> DataFrame:
    """The keys of all objects (arrays of names) by their first appearance."""
    seen = objects.select(F.col(order).alias("row"), F.posexplode(keys).alias("at", "key"))
    return seen.groupBy("key").agg(F.min(F.struct("row", "at")).alias("first"))
