"""Projections: control points, independent series, round trips, nested geometries, no Python in the plan."""

import json
import math

import pytest
from pyspark.sql import functions as F

from millrace.functions import projection as P
from millrace.sources import geo

UTM33 = 'PROJCS["WGS_1984_UTM_Zone_33N",GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]],PROJECTION["Transverse_Mercator"],PARAMETER["False_Easting",500000.0],PARAMETER["False_Northing",0.0],PARAMETER["Central_Meridian",15.0],PARAMETER["Scale_Factor",0.9996],PARAMETER["Latitude_Of_Origin",0.0],UNIT["Meter",1.0]]'
GRID = 'PROJCS["National",GEOGCS["G",DATUM["D",SPHEROID["Airy_1830",6377563.396,299.3249646]],UNIT["Degree",0.0174532925199433]],PROJECTION["Transverse_Mercator"],PARAMETER["False_Easting",400000],PARAMETER["False_Northing",-100000],PARAMETER["Central_Meridian",-2],PARAMETER["Scale_Factor",0.9996012717],PARAMETER["Latitude_Of_Origin",49],UNIT["Meter",1.0]]'
MERCATOR = 'PROJCS["World_Mercator",GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],UNIT["Degree",0.0174532925199433]],PROJECTION["Mercator"],PARAMETER["Central_Meridian",10.0],UNIT["Foot",0.3048]]'


def evaluated(spark, prj, rows, way):
    df = spark.createDataFrame(rows, "x double, y double").withColumn("prj", F.lit(prj)).withColumn("p", P.projection(F.col("prj")))
    return [tuple(r[0]) for r in df.select(way(F.col("p"), F.col("x"), F.col("y"))).collect()]


def series(lon, lat, a, rf, lon0, lat0, k0, fe, fn):
    """The classical series in the difference of longitude (good to under a millimetre within three degrees)."""
    f = 1 / rf
    e2 = f * (2 - f)
    ep2, phi = e2 / (1 - e2), math.radians(lat)

    def arc(p):
        return a * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * p - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * math.sin(2 * p) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * math.sin(4 * p) - 35 * e2**3 / 3072 * math.sin(6 * p))

    n, t, c = a / math.sqrt(1 - e2 * math.sin(phi) ** 2), math.tan(phi) ** 2, ep2 * math.cos(phi) ** 2
    w = math.radians(lon - lon0) * math.cos(phi)
    x = fe + k0 * n * (w + (1 - t + c) * w**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * w**5 / 120)
    y = fn + k0 * (arc(phi) - arc(math.radians(lat0)) + n * math.tan(phi) * (w * w / 2 + (5 - t + 9 * c + 4 * c * c) * w**4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * w**6 / 720))
    return x, y


def test_control_points(spark):
    places = [(15.0, 0.0), (15.0, 52.0), (16.2, 48.2), (13.4, 60.5), (14.0, -33.0), (15.5, 80.0)]
    got = evaluated(spark, UTM33, places, P.from_degrees)
    assert got[0] == pytest.approx((500000, 0), abs=1e-6)
    for (lon, lat), xy in zip(places, got):
        assert xy == pytest.approx(series(lon, lat, 6378137.0, 298.257223563, 15, 0, 0.9996, 500000, 0), abs=2e-3), (lon, lat)
    # a published example: 52 39 27.2531 N, 1 43 4.5177 E is 651409.903, 313177.270 in the national grid
    place = (1 + 43 / 60 + 4.5177 / 3600, 52 + 39 / 60 + 27.2531 / 3600)
    assert evaluated(spark, GRID, [place], P.from_degrees)[0] == pytest.approx((651409.903, 313177.270), abs=1e-3)
    assert evaluated(spark, GRID, [(651409.903, 313177.270)], P.to_degrees)[0] == pytest.approx(place, abs=1e-8)


@pytest.mark.parametrize("prj", [UTM33, GRID, MERCATOR])
def test_round_trips(spark, prj):
    places = [(lon, float(lat)) for lon in (-2.5, 0.0, 3.3, 12.0, 17.9) for lat in range(-80, 81, 20)]
    back = evaluated(spark, prj, evaluated(spark, prj, places, P.from_degrees), P.to_degrees)
    for want, got in zip(places, back):
        assert got == pytest.approx(want, abs=2e-8 if prj == MERCATOR or abs(want[0] - 15) < 5 else 1e-5)


def test_mercator_of_the_ellipsoid(spark):
    (x, y), = evaluated(spark, MERCATOR, [(12.0, 45.0)], P.from_degrees)
    e = math.sqrt(2 / 298.257223563 - 298.257223563**-2)
    psi = math.atanh(math.sin(math.radians(45))) - e * math.atanh(e * math.sin(math.radians(45)))
    assert (x * 0.3048, y * 0.3048) == pytest.approx((6378137 * math.radians(2), 6378137 * psi), abs=1e-6)


def test_status(spark):
    rows = [(1, UTM33), (2, None), (3, 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]]]'), (4, 'PROJCS["x",PROJECTION["Lambert_Conformal_Conic"]]'), (5, "nonsense"), (6, "EPSG:4326 WGS84")]
    df = spark.createDataFrame(rows, "i int, prj string").withColumn("p", P.projection(F.col("prj")))
    assert [r[0] for r in df.orderBy("i").select("p.status").collect()] == ["projected", "local", "assumed-wgs84", "failed", "failed", "assumed-wgs84"]


def test_nested_geometries(spark):
    """All depths, further numbers of a position, and boxes."""
    point = [500000.0, 5761038.0]
    shapes = [("Point", point), ("LineString", [point, [600000.0, 5761038.0, 7.5]]), ("Polygon", [[point, point], [point]]), ("MultiPolygon", [[[point]], [[[400000.0, 0.0]]]]), ("Null", None)]
    rows = [(k, json.dumps(c), p) for k, c in shapes for p in (UTM33, None)]
    df = spark.createDataFrame(rows, "kind string, c string, prj string").withColumn("p", P.projection(F.col("prj")))
    out = df.withColumn("moved", P.moved(F.col("c"), F.col("kind"), F.col("p")))
    got = {(r["kind"], r["prj"] is not None): json.loads(r["moved"]) for r in out.collect()}
    for kind, c in shapes:
        assert got[kind, False] == c
    assert got["Point", True] == pytest.approx([15.0, 52.0], abs=2e-3) and got["LineString", True][1][2] == 7.5 and got["Null", True] is None
    assert got["MultiPolygon", True][0][0][0] == got["Point", True] == got["Polygon", True][1][0] and got["MultiPolygon", True][1][0][0][0] < 15
    box = df.filter("prj IS NULL").select("kind", P.corners(F.col("c"), F.col("kind")).alias("b")).collect()
    assert {r["kind"]: r["b"]["max_x"] for r in box} == {"Point": 500000.0, "LineString": 600000.0, "Polygon": 500000.0, "MultiPolygon": 500000.0, "Null": None}
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_files_with_their_own_projection(spark, tmp_path):
    from test_shapes import point, write

    write(tmp_path, "a", [point(500000, 5761038)])
    write(tmp_path, "b", [point(1, 2)])
    (tmp_path / "a.prj").write_text(UTM33)
    for path in (str(tmp_path), str(tmp_path / "a.shp")):
        got = {r["stem"][-1]: r for r in geo.reprojected(geo.read_shapefile(spark, path), geo.read_projections(spark, path)).collect()}
        assert got["a"]["min_x"] == pytest.approx(15.0) and got["a"]["projection_status"] == "projected"
    got = {r["stem"][-1]: r for r in geo.reprojected(geo.read_shapefile(spark, str(tmp_path)), geo.read_projections(spark, str(tmp_path))).collect()}
    assert got["b"]["min_x"] == 1.0 and got["b"]["projection_status"] == "local"
