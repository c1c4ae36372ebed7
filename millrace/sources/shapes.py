"""Shapefiles as a data source: partitions by the feature index, filters pushed to the reader.

The .shx file says where each feature starts, so that a range of features is read
without those before it. Filters on the feature number choose ranges when the scan
is planned; filters on a feature's box are tested on the box in its header, before
the geometry is decoded or its attributes are read.
"""

from __future__ import annotations

import glob
import json
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import pyarrow.fs as pa_fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .ranges import Bytes

SCHEMA = "stem string, feature_id long, geom_type string, coordinates string, n_vertices int, min_x double, min_y double, max_x double, max_y double, properties map<string,string>, has_dbf boolean, has_prj boolean"
#: Features of one partition, unless the option ``features`` says otherwise.
FEATURES = 10_000
BOX = ("min_x", "min_y", "max_x", "max_y")


def found_files(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, of a folder's files or of those that a pattern names; hidden ones left out."""
    where = urlparse(path)
    if where.scheme in ("", "file"):
        at = path if not where.scheme else "/" + path[5:].lstrip("/")
        names = [e.path for e in os.scandir(at)] if os.path.isdir(at) else glob.glob(at) or [at]
        return [("file:" + os.path.abspath(n), os.path.getsize(n)) for n in sorted(names) if os.path.isfile(n) and os.path.basename(n)[0] not in "._"]
    fs, at = pa_fs.FileSystem.from_uri(path)
    own = fs.get_file_info(at)
    infos = fs.get_file_info(pa_fs.FileSelector(at)) if own.type == pa_fs.FileType.Directory else [own]
    root = path[: len(path) - len(at)] if path.endswith(at) else f"{where.scheme}://"
    return [(root + i.path, i.size) for i in infos if i.is_file and i.base_name[0] not in "._"]


@dataclass
class FeatureRange(InputPartition):
    """Features [low, high) of one file; without an index all of them, high being unknown."""

    stem: str
    files: dict[str, str]
    low: int
    high: int | None


class ShapefileSource(DataSource):
    """``spark.read.format("shapefile").load(path)``: see ``geo.read_shapefile``."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ShapefileReader:
        return ShapefileReader(self.options)


class ShapefileReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.encoding = options.get("encoding")
        self.features = int(options.get("features", FEATURES))
        self.low, self.high = 0, None  # of feature numbers
        self.bounds: list[tuple[str, int, float]] = []  # (side of the box, 1 at least or -1 at most, value)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds are taken from the filters; Spark tests all of them again, as bounds are only as sharp as a range."""
        for f in filters:
            yield f
            column = f.attribute if hasattr(f, "attribute") else ()
            if column == ("feature_id",) and not isinstance(f, In):
                self._number(f)
            elif len(column) == 1 and column[0] in BOX and isinstance(getattr(f, "value", None), (int, float)):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.bounds.append((column[0], 1, float(f.value)))
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.bounds.append((column[0], -1, float(f.value)))

    def _number(self, f: Filter) -> None:
        value = getattr(f, "value", None)
        if not isinstance(value, int):
            return
        if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
            self.low = max(self.low, value + isinstance(f, GreaterThan))
        if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
            end = value + (not isinstance(f, LessThan))
            self.high = end if self.high is None else min(self.high, end)

    def partitions(self) -> list[FeatureRange]:
        stems: dict[str, dict[str, tuple[str, int]]] = {}
        pattern = self.path if not self.path.lower().endswith(".shp") else self.path[:-4] + ".*"
        for path, size in found_files(pattern):
            stem, _, ending = path.rpartition(".")
            stems.setdefault(stem, {})[ending.lower()] = (path, size)
        out = []
        for stem, files in stems.items():
            if "shp" not in files:
                continue
            paths = {k: p for k, (p, _) in files.items()}
            if "shx" not in files or files["shx"][1] < 108:
                out.append(FeatureRange(stem, paths, self.low, self.high))
                continue
            end = (files["shx"][1] - 100) // 8
            end = end if self.high is None else min(end, self.high)
            out += [FeatureRange(stem, paths, low, min(low + self.features, end)) for low in range(self.low, end, self.features)]
        return out or [FeatureRange("", {}, 0, 0)]

    def read(self, part: FeatureRange) -> Iterator[tuple]:
        if not part.files:
            return
        table = Attributes(part.files.get("dbf"), self.encoding or _encoding(part.files.get("cpg")))
        with Bytes(part.files["shp"]) as data:
            for number, raw in records(data, part):
                row = feature(number, raw, self.bounds)
                if row is not None:
                    yield (part.stem, *row, table.row(number), "dbf" in part.files, "prj" in part.files)


def _encoding(cpg: str | None) -> str:
    if cpg is None:
        return "utf-8"
    with Bytes(cpg, 64) as data:
        name = data.get(0, 64).decode("ascii", "ignore").strip()
    try:
        "".encode(name or "utf-8")
    except LookupError:
        return "utf-8"
    return name or "utf-8"


def records(data: Bytes, part: FeatureRange) -> Iterator[tuple[int, bytes]]:
    """(feature number, record) of a range: by the index, or from header to header without one."""
    if part.high is not None and "shx" in part.files:
        with Bytes(part.files["shx"], 8 * (part.high - part.low)) as index:
            places = index.get(100 + 8 * part.low, 8 * (part.high - part.low))
        for number, (at, n) in enumerate(struct.iter_unpack(">2i", places[: len(places) // 8 * 8]), part.low):
            if n < 2 or 2 * at + 8 + 2 * n > data.length:
                return
            yield number, data.get(2 * at + 8, 2 * n)
        return
    at, number = 100, 0
    while at + 8 <= data.length and (part.high is None or number < part.high):
        n = struct.unpack(">i", data.get(at + 4, 4))[0] * 2
        if n < 4 or at + 8 + n > data.length:
            return
        if number >= part.low:
            yield number, data.get(at + 8, n)
        at, number = at + 8 + n, number + 1


def box_of(raw: bytes) -> tuple[float, float, float, float] | None:
    """The box in a record's header; a point is its own."""
    base = struct.unpack_from("<i", raw)[0] % 10
    if base == 1 and len(raw) >= 20:
        x, y = struct.unpack_from("<2d", raw, 4)
        return x, y, x, y
    return struct.unpack_from("<4d", raw, 4) if base in (3, 5, 8) and len(raw) >= 36 else None


def feature(number: int, raw: bytes, bounds: list[tuple[str, int, float]]) -> tuple | None:
    """A feature's row, or none if its box is beyond the bounds."""
    from .geo import _geometry

    if bounds:
        box = box_of(raw)
        if box is None or any((box[BOX.index(side)] - value) * sign < -1e-6 * max(1.0, abs(value)) for side, sign, value in bounds):
            return None
    kind, coordinates, points = _geometry(raw)
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return number, kind, json.dumps(coordinates), len(points), min(xs, default=None), min(ys, default=None), max(xs, default=None), max(ys, default=None)


class Attributes:
    """Rows of a dBASE table by number, texts trimmed; deleted rows keep their place."""

    def __init__(self, path: str | None, encoding: str):
        self.data, self.encoding, self.fields = (Bytes(path) if path else None), encoding, []
        if self.data is None:
            return
        self.count, self.start, self.width = struct.unpack("<IHH", self.data.get(4, 8))
        at = 32
        while len(head := self.data.get(at, 32)) == 32 and head[0] != 0x0D:
            self.fields.append((head[:11].split(b"\0")[0].decode("ascii", "replace"), head[16]))
            at += 32

    def row(self, number: int) -> dict[str, str]:
        if self.data is None or number >= self.count:
            return {}
        raw, at, out = self.data.get(self.start + number * self.width, self.width), 1, {}
        for name, n in self.fields:
            out[name] = raw[at : at + n].decode(self.encoding, "replace").strip("\0 ")
            at += n
        return out
