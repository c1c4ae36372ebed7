"""Working tables, bounded broadcasts and small helpers for the corpus operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a file, where a table's number of rows is known before it is written.
FILE_ROWS = 20_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the setting is absent (tests, one machine) a temporary folder is made.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, urlparse(base).path, True)
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


class Workspace:
    """Parquet tables of one operator call under the shared folder.

    ``put`` writes a table and reads it back: lineage ends there, so a lost
    executor costs the current stage only. ``rows``, about how many there will be
    at most, keeps a small table from being a file of each shuffle partition: every
    file costs its task some processes that set permissions. ``drop`` removes what no later step
    reads; tables behind a returned DataFrame stay, since it is lazy.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/millrace/{name}-{uuid.uuid4().hex[:12]}"
        self.names: set[str] = set()

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str, partition_by: str | None = None, rows: int | None = None) -> DataFrame:
        if rows is not None:
            df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(self.path(name))
        self.names.add(name)
        schema = df.schema
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(path, True)
        self.names.discard(name)

    def drop_all_but(self, *kept: str) -> None:
        for name in self.names - set(kept):
            self.drop(name)


def clear(spark: SparkSession) -> None:
    """Remove the working tables of all operators; DataFrames they returned can't be read after."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/millrace")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def id_bucket(id_col: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus`` (null for a null id)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, with underlines put before those that columns have already."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
