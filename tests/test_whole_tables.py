"""Queries on tables that are larger than what they once read at most."""

import duckdb

import __spark_entry__ as entry


def agrees(spark, name, folder, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet{'' if str(folder).startswith('/root/testdata') else '/*.parquet'}'")
    df = entry.queries()[name](spark, str(folder))
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    return got


def test_shapefile_scan_has_all_suppliers(spark, tmp_path):
    spark.range(1, 12_002).selectExpr("id AS s_suppkey", "cast(id % 25 AS int) AS s_nationkey", "concat('Supplier#', id) AS s_name").write.parquet(str(tmp_path / "supplier.parquet"))
    assert len(agrees(spark, "shapefile_scan", tmp_path, "supplier")) == 12_001


def test_sound_peaks_has_every_event(spark, tmp_path):
    spark.range(7, 25_040).selectExpr("id AS event_id", "cast(id * 37 % 1000 / 300 AS double) AS value").write.parquet(str(tmp_path / "events.parquet"))
    assert len(agrees(spark, "sound_peaks", tmp_path, "events")) == 300
    assert len(agrees(spark, "sound_peaks", "/root/testdata/sf0.1", "events")) == 1000


def test_schema_diff_has_every_part(spark):
    got = agrees(spark, "schema_diff", "/root/testdata/sf0.1", "part")
    columns = sorted(("number", "name", "change", "severity", "detail"))
    assert max(r[columns.index("number")] for r in got) > 19_900


def test_size_labels_has_long_texts(spark, tmp_path):
    sizes = [0, 1, 1023, 1024, 1075, 999_999, 1_000_000, 1_048_575, 1_048_576, 1_100_000, 3_000_000]
    spark.createDataFrame([(n, "x" * n) for n in sizes] + [(-1, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = dict(agrees(spark, "size_labels", tmp_path, "documents"))
    assert len(got) == len(sizes) + 1 and got[3_000_000] == "2.9MB" and got[1_048_576] == "1MB" and got[1_000_000] == "976.6KB"
