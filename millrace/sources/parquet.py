"""Parquet: Spark's scan, its schema's leaves and ranges of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH_ROWS = 10_000
BATCH_FROM_BYTES = 50 << 20


def read_parquet(spark: SparkSession, path: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """The file's rows with ``_row_index``; [start, end) of them, if given.

    Row groups outside the range are left out by the reader where Spark can tell.
    """
    df = spark.read.parquet(path).select(F.col("_metadata.row_index").alias("_row_index"), "*")
    if start is not None:
        df = df.filter(F.col("_row_index") >= start)
    if end is not None:
        df = df.filter(F.col("_row_index") < end)
    return df


def next_batch(spark: SparkSession, path: str, start: int, rows: int = BATCH_ROWS) -> tuple[DataFrame, int, bool]:
    """A batch, the next one's start, and whether there is more. The total comes from footers."""
    total = spark.read.parquet(path).count()
    stop = min(total, start + rows)
    return read_parquet(spark, path, start, stop), stop, stop < total


def leaves(schema: T.StructType) -> list[tuple[str, str]]:
    """(dotted name, type) of each leaf."""

    def walk(kind: T.DataType, name: str):
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                yield from walk(f.dataType, f"{name}.{f.name}" if name else f.name)
        elif isinstance(kind, T.ArrayType):
            yield from walk(kind.elementType, f"{name}.list.element")
        elif isinstance(kind, T.MapType):
            yield from walk(kind.keyType, f"{name}.key_value.key")
            yield from walk(kind.valueType, f"{name}.key_value.value")
        else:
            yield name, kind.simpleString()

    return list(walk(schema, ""))
