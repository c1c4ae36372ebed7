"""JSON documents and JSON Lines, with strict validity."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import nonblank_lines, texts

PREVIEW_BYTES = 10 << 20


def _refuse(name: str):
    raise ValueError(name)


def is_json(text: str | None) -> bool:
    """Strictly one JSON value: no NaN, no trailing text, no leading zeros; keys may repeat."""
    try:
        json.loads(text or "", parse_constant=_refuse)
        return True
    except (ValueError, RecursionError):
        return False


@F.pandas_udf(T.BooleanType())
def _strict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(is_json)


def valid_json(column: Column) -> Column:
    return _strict(column)


def parse_lines(numbered: DataFrame) -> DataFrame:
    """(file, line_number, physical_line, content, is_valid, v) of (file, line, number, text).

    line_number counts non-blank lines, physical_line all; v is the value as a VARIANT.
    """
    content = F.trim("text")
    return numbered.select("file", F.col("number").alias("line_number"), F.col("line").alias("physical_line"), content.alias("content"), valid_json(content).alias("is_valid"), F.try_parse_json(content).alias("v"))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(nonblank_lines(spark, path))


def read_jsonl_preview(spark: SparkSession, path: str, limit: int = PREVIEW_BYTES) -> tuple[DataFrame, bool]:
    """Lines that end within the first ``limit`` bytes, and whether there are more.

    Of the bytes' sum only the lines of a file's first splits are ordered: a split
    that starts beyond the limit is left out before.
    """
    near = spark.read.option("lineSep", "\n").text(path).filter(F.col("_metadata.file_block_start") <= limit).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), F.col("value").alias("text"))
    so_far = F.sum(F.octet_length("text").cast("long") + 1).over(Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    physical = F.row_number().over(Window.partitionBy("file").orderBy("line")).cast("long")
    number = F.sum((F.trim("text") != "").cast("long")).over(Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    sized = near.select("file", physical.alias("line"), number.alias("number"), F.regexp_replace("text", "\r$", "").alias("text"), so_far.alias("_end"))
    total = spark.read.format("binaryFile").load(path).select(F.max("length")).first()[0] or 0
    return parse_lines(sized.filter((F.col("_end") <= limit) & (F.trim("text") != ""))), total > limit


def line_counts(parsed: DataFrame) -> DataFrame:
    return parsed.agg(F.count("*").alias("total"), F.count_if("is_valid").alias("valid"), F.count_if(~F.col("is_valid")).alias("invalid"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """(file, pretty, v): documents, indented by two; one that is no JSON is an error."""

    @F.pandas_udf("string")
    def pretty(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda x: json.dumps(json.loads(x, parse_constant=_refuse), indent=2, ensure_ascii=False))

    return texts(spark, path).select("file", pretty("text").alias("pretty"), F.try_parse_json("text").alias("v"))


def value_type(v: Column) -> Column:
    """null, array, object, string, number or boolean."""
    kind = F.schema_of_variant(v)
    return F.when(kind == "VOID", "null").when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").otherwise("number")
