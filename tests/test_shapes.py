"""Shapefiles by their index: ranges, pushed filters, files without an index, odd records."""

import struct

import pytest
from pyspark.sql import functions as F

from millrace.sources import geo, shapes


def write(folder, stem, records, *, index=True, names=None):
    """A .shp file of (type, payload) records, with .shx and .dbf."""
    body, places, at = b"", b"", 50
    for i, raw in enumerate(records):
        body += struct.pack(">2i", i + 1, len(raw) // 2) + raw
        places += struct.pack(">2i", at, len(raw) // 2)
        at += 4 + len(raw) // 2
    head = struct.pack(">i", 9994) + bytes(24) + struct.pack("<2i", 1000, 1) + bytes(64)
    (folder / f"{stem}.shp").write_bytes(head + body)
    if index:
        (folder / f"{stem}.shx").write_bytes(head + places)
    if names:
        dbf = struct.pack("<BBBBIHH", 3, 0, 0, 0, len(names), 65, 21) + bytes(20) + b"name".ljust(11, b"\0") + b"C" + bytes(4) + bytes([20]) + bytes(15) + b"\r"
        (folder / f"{stem}.dbf").write_bytes(dbf + b"".join(b" " + n.encode().ljust(20) for n in names))


def point(x, y):
    return struct.pack("<i2d", 1, x, y)


def line(points):
    xs, ys = zip(*points)
    return struct.pack("<i4d3i", 3, min(xs), min(ys), max(xs), max(ys), 1, len(points), 0) + b"".join(struct.pack("<2d", *p) for p in points)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    folder = tmp_path_factory.mktemp("shapes")
    records = [point(i % 50, i // 50) if i % 3 else line([(i % 50, i // 50), (i % 50 + 2.5, i // 50 + 1)]) if i % 2 else struct.pack("<i", 0) for i in range(2000)]
    write(folder, "a", records, names=[f"n{i}" for i in range(1990)])
    write(folder, "plain", records[:70], index=False)
    (folder / "a.cpg").write_text("no such encoding")
    return folder


def rows(df):
    return sorted((tuple(sorted(r.items())) if isinstance(r, dict) else str(r) for r in df.drop("stem").collect()))


def test_ranges_give_what_one_task_gives(spark, folder):
    whole = geo.read_shapefile(spark, str(folder / "a.shp"), features=10**9)
    assert whole.rdd.getNumPartitions() == 1 and whole.count() == 2000
    for n in (1999, 300, 64):
        got = geo.read_shapefile(spark, str(folder / "a.shp"), features=n)
        assert got.rdd.getNumPartitions() == -(-2000 // n) and rows(got) == rows(whole)
    both = geo.read_shapefile(spark, str(folder))
    assert both.count() == 2070 and both.filter("NOT has_dbf").count() == 70
    assert whole.filter("feature_id = 1995").first()["properties"] == {} and whole.filter("feature_id = 7").first()["properties"] == {"name": "n7"}
    assert whole.filter("feature_id = 6").first()["min_x"] is None


def test_feature_numbers_choose_ranges(spark, folder):
    """Continuing at a feature number plans only the ranges from there."""
    page = geo.read_shapefile(spark, str(folder / "a.shp"), start=1200, limit=150, features=100)
    assert page.rdd.getNumPartitions() == 2 and sorted(r["feature_id"] for r in page.collect()) == list(range(1200, 1350))
    assert geo.next_start(page).first()["next_start"] == 1350
    assert "feature_id" in page._jdf.queryExecution().executedPlan().toString()
    assert geo.read_shapefile(spark, str(folder / "a.shp"), start=5000, limit=10).count() == 0
    assert [r["feature_id"] for r in geo.read_shapefile(spark, str(folder / "plain.shp"), start=60).orderBy("feature_id").collect()] == list(range(60, 70))


def test_boxes(spark, folder):
    whole = geo.read_shapefile(spark, str(folder / "a.shp"), features=10**9)
    for box in ((10, 5, 12, 9), (0, 0, 0, 0), (49.5, 39.5, 80, 80), (60, 60, 70, 70)):
        a, b, c, d = box
        want = [r["feature_id"] for r in whole.collect() if r["min_x"] is not None and r["max_x"] >= a and r["max_y"] >= b and r["min_x"] <= c and r["min_y"] <= d]
        got = geo.read_shapefile(spark, str(folder / "a.shp"), box=box, features=300)
        assert sorted(r["feature_id"] for r in got.collect()) == sorted(want), box
    assert whole.filter((F.col("min_x") > 47) & (F.col("geom_type") == "LineString")).count() == sum(1 for r in whole.collect() if r["geom_type"] == "LineString" and r["min_x"] > 47)


def test_features_beyond_the_box_are_not_decoded(monkeypatch, folder):
    decoded = []
    exact = geo._geometry
    monkeypatch.setattr(geo, "_geometry", lambda raw: decoded.append(1) or exact(raw))
    reader = shapes.ShapefileReader({"path": str(folder / "a.shp")})
    from pyspark.sql.datasource import GreaterThanOrEqual, LessThanOrEqual

    filters = [GreaterThanOrEqual(("min_x",), 3), LessThanOrEqual(("max_x",), 4), GreaterThanOrEqual(("feature_id",), 100)]
    assert list(reader.pushFilters(filters)) == filters
    found = [row for part in reader.partitions() for row in reader.read(part)]
    assert found and len(decoded) == len(found) < 150


def test_broken_index_and_empty_folder(spark, tmp_path):
    write(tmp_path, "b", [point(1, 2), point(3, 4)])
    (tmp_path / "b.shp").write_bytes((tmp_path / "b.shp").read_bytes()[:-3])
    assert [r["min_x"] for r in geo.read_shapefile(spark, str(tmp_path / "b.shp")).collect()] == [1.0]
    (tmp_path / "empty").mkdir()
    assert geo.read_shapefile(spark, str(tmp_path / "empty")).count() == 0
