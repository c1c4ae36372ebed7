"""Files as rows: whole texts, whole binaries, and lines that know their number."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the setting is absent on one machine (tests) a temporary folder is made.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import atexit
        import shutil
        import tempfile

        own = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, own, True)
        spark.sparkContext.setCheckpointDir(f"file://{own}")
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/formats/{name}-{uuid.uuid4().hex[:10]}"


def put_file(path: str, content: bytes) -> None:
    """Write one file of the shared folder from a task."""
    where = urlparse(path)
    fs, at = (pa_fs.LocalFileSystem(), where.path) if where.scheme in ("", "file") else pa_fs.FileSystem.from_uri(path)
    fs.create_dir(os.path.dirname(at), recursive=True)
    with fs.open_output_stream(at, compression=None) as out:
        out.write(content)


def texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, text): for documents that only make sense as a whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^﻿", "").alias("text"))


def binaries(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, length, content)."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length", "content")


#: Starts of splits (about 200 bytes each) that are broadcast; more are joined by key.
BROADCAST_SPLITS = 200_000


def _few(raw: DataFrame, starts: DataFrame) -> DataFrame:
    """``starts`` to be broadcast if there can't be more splits than ``BROADCAST_SPLITS``."""
    most = len(raw.inputFiles()) + raw.rdd.getNumPartitions()
    return F.broadcast(starts) if most <= BROADCAST_SPLITS else starts


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line, text): physical lines from 1, of files of any size.

    Files are read in splits. A task numbers its splits' lines without a shuffle;
    only a count for each split is gathered, to say where the split starts.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), F.col("value").alias("text"))
    splits = raw.groupBy("file", "block").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = splits.select("file", "block", "first", before.alias("before"))
    return raw.join(_few(raw, starts), ["file", "block"]).select("file", (F.col("seq") - F.col("first") + F.col("before") + 1).alias("line"), F.regexp_replace("text", "\r$", "").alias("text"))


def nonblank_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line, number, text): physical line and number among the lines that aren't blank.

    As ``lines``, with a second count for each split; blank lines are left out.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), F.col("value").alias("text"))
    kept = raw.filter(F.regexp_replace("text", r"\s", "") != "").withColumn("own", F.monotonically_increasing_id())
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = raw.groupBy("file", "block").agg(F.min("seq").alias("first"), F.count("*").alias("n")).select("file", "block", "first", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    own = kept.groupBy("file", "block").agg(F.min("own").alias("own_first"), F.count("*").alias("own_n")).select("file", "block", "own_first", F.coalesce(F.sum("own_n").over(order), F.lit(0)).alias("own_before"))
    joined = kept.join(_few(raw, starts.join(own, ["file", "block"])), ["file", "block"])
    return joined.select("file", (F.col("seq") - F.col("first") + F.col("before") + 1).alias("line"), (F.col("own") - F.col("own_first") + F.col("own_before") + 1).alias("number"), F.regexp_replace("text", "\r$", "").alias("text"))


def text_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """(file, line, text) of whole texts, split in place."""
    return docs.select("file", F.posexplode(F.split(text, "\r?\n", -1)).alias("at", "text")).select("file", (F.col("at") + 1).cast("long").alias("line"), "text")


def parsed(df: DataFrame, column: str, parse: Callable[..., Iterator[tuple]], schema: str | T.StructType) -> DataFrame:
    """(file, *schema): rows that a Python parser yields for each file's text or content.

    One file is one task's work; files are spread over tasks. A file that the parser
    refuses gives the rows up to there.
    """
    own = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    whole = T.StructType([T.StructField("file", T.StringType()), *own.fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows: list[tuple] = []
                for row in parse(content.as_py()):
                    rows.append((file, *row))
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), arrow)], schema=arrow)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), arrow)], schema=arrow)

    return df.select("file", column).mapInArrow(run, whole)


def capped(df: DataFrame, rows: int, by: str, order: str, preview: bool) -> DataFrame:
    """The first rows of each file in a preview, all otherwise."""
    if not preview:
        return df
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order))).filter(F.col("_n") <= rows).drop("_n")


def extension(file: Column) -> Column:
    return F.lower(F.regexp_extract(file, r"(\.[^./\\]+)$", 1))
