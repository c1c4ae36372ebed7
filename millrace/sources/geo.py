"""Shapefiles as features: geometry, attributes and boxes."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import projection as P
from .shapes import ShapefileSource

#: Geometry of the shape types (with and without z and measures).
TYPES = {0: "Null", 1: "Point", 3: "LineString", 5: "Polygon", 8: "MultiPoint"}


def _ring_area(ring: list) -> float:
    return sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(ring, ring[1:])) / 2


def _geometry(raw: bytes) -> tuple[str, object, list[tuple[float, float]]]:
    (kind,) = struct.unpack_from("<i", raw)
    base = kind % 10
    if base == 1:
        point = struct.unpack_from("<2d", raw, 4)
        return "Point", list(point), [point]
    if base == 8:
        n = struct.unpack_from("<i", raw, 36)[0]
        points = [struct.unpack_from("<2d", raw, 40 + 16 * i) for i in range(n)]
        return "MultiPoint", [list(p) for p in points], points
    if base in (3, 5):
        parts, n = struct.unpack_from("<2i", raw, 36)
        starts = [*struct.unpack_from(f"<{parts}i", raw, 44), n]
        first = 44 + 4 * parts
        points = [struct.unpack_from("<2d", raw, first + 16 * i) for i in range(n)]
        lines = [[list(p) for p in points[a:b]] for a, b in zip(starts, starts[1:])]
        if base == 3:
            return ("LineString", lines[0], points) if parts == 1 else ("MultiLineString", lines, points)
        polygons: list[list] = []
        for ring in lines:  # clockwise rings are outer ones
            if _ring_area(ring) <= 0 or not polygons:
                polygons.append([ring])
            else:
                polygons[-1].append(ring)
        return ("Polygon", polygons[0], points) if len(polygons) == 1 else ("MultiPolygon", polygons, points)
    return "Null", None, []


def read_shapefile(spark: SparkSession, path: str, *, start: int = 0, limit: int | None = None, encoding: str | None = None, box: tuple[float, float, float, float] | None = None, features: int | None = None) -> DataFrame:
    """(stem, feature_id, geom_type, coordinates, n_vertices, min_x.., properties) of .shp files.

    ``path`` may name the folder or the .shp file; .shx, .dbf, .cpg and .prj of the same
    stem are found beside it. [start, start + limit) features of each file, those that
    meet the box (min_x, min_y, max_x, max_y) if one is given. A file is read in ranges
    of ``features``; its ranges, and filters on the result's columns, are as in ``shapes``.
    """
    spark.dataSource.register(ShapefileSource)
    # filters reach Python sources only with this setting
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options = {"encoding": encoding, "features": features}
    out = spark.read.format("shapefile").options(**{k: v for k, v in options.items() if v is not None}).load(path)
    if start or limit is not None:
        out = out.filter(F.col("feature_id") >= start)
    if limit is not None:
        out = out.filter(F.col("feature_id") < start + limit)
    if box is not None:
        out = out.filter((F.col("max_x") >= box[0]) & (F.col("max_y") >= box[1]) & (F.col("min_x") <= box[2]) & (F.col("min_y") <= box[3]))
    return out


def read_projections(spark: SparkSession, path: str) -> DataFrame:
    """(stem, projection) of a folder's .prj files, or of the one beside a .shp file."""
    folder, name = (path.rpartition("/")[0], path.rpartition("/")[2][:-4] + ".prj") if path.lower().endswith(".shp") else (path, "*.prj")
    texts = spark.read.format("binaryFile").option("pathGlobFilter", name).load(folder)
    return texts.select(F.regexp_replace("path", r"\.[^./]+$", "").alias("stem"), P.projection(F.decode("content", "UTF-8")).alias("projection"))


def reprojected(features: DataFrame, projections: DataFrame) -> DataFrame:
    """Features with longitudes and latitudes, their boxes made anew, ``projection_status`` and ``projection_message`` of their file.

    Files without a known projection keep their coordinates. All of it is column expressions.
    """
    joined = features.join(projections.withColumnRenamed("stem", "_stem"), F.col("stem") == F.col("_stem"), "left").drop("_stem")
    p = F.coalesce("projection", P.projection(F.lit(None).cast("string")))
    moved = joined.withColumn("projection", p).withColumn("coordinates", P.moved(F.col("coordinates"), F.col("geom_type"), F.col("projection")))
    boxed = moved.withColumn("_box", P.corners(F.col("coordinates"), F.col("geom_type")))
    for side in ("min_x", "min_y", "max_x", "max_y"):
        boxed = boxed.withColumn(side, F.col("_box")[side])
    return boxed.withColumn("projection_status", F.col("projection.status")).withColumn("projection_message", F.col("projection.message")).drop("_box", "projection")


def next_start(page: DataFrame) -> DataFrame:
    """(stem, next_start) to continue each file's features after a page of them."""
    return page.groupBy("stem").agg((F.max("feature_id") + 1).alias("next_start"))


def summarize_features(features: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(boxes, type counts, property names) by file; all of them merge partially."""
    boxes = features.groupBy("stem").agg(F.count("*").alias("features"), F.sum("n_vertices").alias("vertices"), F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"))
    kinds = features.groupBy("stem", "geom_type").agg(F.count("*").alias("n"))
    names = features.select("stem", F.explode(F.map_keys("properties")).alias("property")).distinct()
    return boxes, kinds, names


def is_wgs84(prj: Column) -> Column:
    return prj.rlike(r"(?i)WGS[ _]?(19)?84|EPSG[^0-9]*4326")
