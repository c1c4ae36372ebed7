"""Tables that are saved whole or not at all: versions with a manifest each.

A save writes its rows beside all others, then a manifest that names them; the
manifest appears under its number by one rename that refuses to overwrite. The
table is what the manifest of the largest number names, so a reader finds the old
rows or the new ones at any moment, and of two writers with the same number one is
told so. What a save left behind that stopped is rows without a manifest: nobody
reads them, and ``vacuum`` removes them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class SaveConflict(RuntimeError):
    """Another writer made the next version first."""


class VersionedTable:
    """``root`` holds ``rows-..`` folders and ``manifests``."""

    def __init__(self, spark: SparkSession, root: str, step: Callable[[str], None] = lambda name: None):
        """``step`` is called before each step of a save (tests stop there)."""
        self.spark, self.root, self.step = spark, root.rstrip("/"), step
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def versions(self) -> list[int]:
        """Numbers of the versions that can be read, rising."""
        return sorted(int(n[:-5]) for n in self._names("manifests") if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if not known or version is not None and version not in known:
            raise FileNotFoundError(f"no version {'' if version is None else version} of {self.root}")
        stream = self._fs.open(self._path(f"manifests/{known[-1] if version is None else version:020d}.json"))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the newest version or of one that is named."""
        found = self.manifest(version)
        return self.spark.read.schema(T.StructType.fromJson(found["schema"])).parquet(f"{self.root}/{found['rows']}")

    def save(self, df: DataFrame, based_on: int | None = None, note: str = "") -> int:
        """The next version's number. The frame may read from this table.

        ``based_on`` is the version that the rows were made from (by default the
        newest one now); if another has been saved since, ``SaveConflict`` says so and nothing changes.
        """
        known = self.versions()
        base = (known[-1] if known else 0) if based_on is None else based_on
        rows = f"rows-{base + 1:020d}-{uuid.uuid4().hex[:12]}"
        self.step("rows")
        df.write.parquet(f"{self.root}/{rows}")
        self.step("manifest")
        made = self._path(f"manifests/.{uuid.uuid4().hex}.tmp")
        self._fs.mkdirs(made.getParent())
        out = self._fs.create(made, False)
        out.write(bytearray(json.dumps({"version": base + 1, "rows": rows, "schema": df.schema.jsonValue(), "note": note}).encode()))
        out.close()
        self.step("switch")
        self._switch(made, self._path(f"manifests/{base + 1:020d}.json"))
        self.step("done")
        return base + 1

    def _switch(self, made, named) -> None:
        """Give the manifest its number, unless that is taken."""
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(made, named, none)
        except Exception as e:
            if self._fs.exists(named):
                self._fs.delete(made, False)
                raise SaveConflict(f"{named.getName()} is there already") from e
            raise

    def vacuum(self, keep: int = 1) -> int:
        """Remove all but the newest ``keep`` versions and the rows of saves that stopped; how many folders went.

        Readers of removed versions and saves under way lose their rows: run it when there are none.
        """
        known = self.versions()
        named = {self.manifest(v)["rows"] for v in known[-keep:]} if keep else set()
        for version in known[: len(known) - keep]:
            self._fs.delete(self._path(f"manifests/{version:020d}.json"), False)
        gone = [n for n in self._names("") if n.startswith("rows-") and n not in named]
        for name in gone:
            self._fs.delete(self._path(name), True)
        for name in self._names("manifests"):
            if name.endswith(".tmp"):
                self._fs.delete(self._path(f"manifests/{name}"), False)
        return len(gone)


def replace_table(df: DataFrame, path: str, step: Callable[[str], None] = lambda name: None) -> None:
    """Save over a path of plain Parquet that the frame may read from: written beside it, then swapped.

    Two renames can't be one step; ``recover_table`` finishes or undoes a swap that stopped between them.
    """
    recover_table(df.sparkSession, path)
    fs, new, at, old = _places(df.sparkSession, path)
    step("rows")
    df.write.mode("overwrite").parquet(path + ".new")
    step("away")
    if fs.exists(at) and not fs.rename(at, old):
        raise OSError(f"{path} can't be renamed")
    step("in")
    if not fs.rename(new, at):
        raise OSError(f"{path}.new can't be renamed")
    step("clear")
    fs.delete(old, True)


def recover_table(spark: SparkSession, path: str) -> None:
    """After a save that stopped: the new table if it was whole and the old one gone from its place, else the old one."""
    fs, new, at, old = _places(spark, path)
    if not fs.exists(at):
        for whole in (new, old):
            if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(whole, "_SUCCESS")) and fs.rename(whole, at):
                break
    if fs.exists(at):
        fs.delete(old, True)
        fs.delete(new, True)


def _places(spark: SparkSession, path: str):
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    at = make(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make(path + ".new"), at, make(path + ".old")
