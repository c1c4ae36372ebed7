"""Streams: lines and tables as they arrive, and windows over event time (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parquet_stream(spark: SparkSession, path: str, schema: T.StructType, files: int = 1) -> DataFrame:
    """New Parquet files, a few in each batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def line_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """New lines of text files that aren't blank."""
    return spark.readStream.option("maxFilesPerTrigger", files).text(path).filter(F.trim("value") != "")


def windowed_counts(events: DataFrame, time: str, by: str, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts by tumbling window; state older than the watermark is dropped."""
    stamped = events.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", late)
    return stamped.groupBy(F.window("_time", width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Everything there is so far, into a table in memory (for tests and small results)."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def sink_parquet(stream: DataFrame, path: str, checkpoint: str):
    """Append batches to a folder, exactly once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
