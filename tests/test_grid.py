"""Grid operators on small fixtures."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.functions.jsnum import number_text, text_number
from millrace.operators import edit, grid, lookup, packetfilter, summarize
from millrace.sinks import delimited, documents

VALUES = ["10", "9", "abc", "Abd", "", " ", "2d", "1e2", "NaN", "Infinity", "-3", "0x10", "zeta", ".5", ".5", None]


@pytest.mark.parametrize("direction, want", [("asc", [10, 13, 14, 1, 0, 11, 7, 9, 6, 2, 3, 8, 12, 4, 5, 15]), ("desc", [4, 5, 15, 12, 8, 3, 2, 6, 9, 7, 11, 0, 1, 13, 14, 10])])
def test_mixed_sort(spark, direction, want):
    df = spark.createDataFrame(list(enumerate(VALUES)), "idx int, v string")
    assert [r["idx"] for r in grid.mixed_sort(df, "v", direction, "idx").collect()] == want
    assert [grid.next_direction(x) for x in (None, "asc", "desc")] == ["asc", "desc", None]


def test_page_is_clamped(spark):
    df = spark.range(250).select(F.col("id").alias("idx"))
    assert [r[0] for r in grid.page(df, 5, [F.col("idx")]).collect()] == list(range(200, 250))
    assert grid.page(df, -1, [F.col("idx")]).count() == 100 and grid.page_count(0) == 1


def test_search_covers_all_kinds(spark):
    df = spark.sql("SELECT 1 AS i, 20.0D AS d, timestamp'2021-01-07 12:34:56' AS t, array('xY') AS a, CAST(NULL AS STRING) AS s")
    for term, hit in (("", 1), ("20.", 0), ("20", 1), ("12:34:56.000z", 1), ('"xy"', 1), ("null", 0)):
        assert grid.search(df, term).count() == hit, term


def test_time_slice(spark):
    df = spark.range(1000).withColumnRenamed("id", "frame")
    assert grid.time_slice(df, "frame", 5.0, 2.0, 100, 1000).count() == 300
    assert grid.time_slice(df, "frame", 9.99, 30.0, 100, 1000).count() == 10


def test_numbers_as_text(spark):
    pairs = [(20.0, "20"), (1e7, "10000000"), (1e-4, "0.0001"), (1e21, "1e+21"), (1.5e-8, "1.5e-8"), (-0.0, "0"), (0.1, "0.1"), (123456789012345680.0, "123456789012345680"), (float("nan"), "NaN"), (-2.5e30, "-2.5e+30")]
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(pairs)], "i int, v double")
    assert [r[1] for r in df.select("i", number_text(F.col("v"))).orderBy("i").collect()] == [t for _, t in pairs]
    n = spark.createDataFrame([("1d",), ("1_000",), ("0b11",), ("0o17",), ("+.5e1",), ("",)], "t string").select(text_number(F.col("t"))).collect()
    assert [r[0] for r in n] == [None, None, 3.0, 15.0, 5.0, None]


def test_packet_filters(spark):
    row = ("DNS", "192.168.0.2:53000", "8.8.8.8:53", "Query example.com A")
    df = spark.createDataFrame([row], "Protocol string, Source string, Destination string, Info string")
    tests = {"protocol == dns": 1, "ip == 8.8.8": 1, "ip.src != 8.8.8.8": 1, "port = 53": 1, "dns.qry.name contains example": 1, "udp.srcport == 443": 0, "example": 1, "nothing.known != x": 0}
    for q, hit in tests.items():
        assert packetfilter.filter_packets(df, q).count() == hit, q
    assert packetfilter.filter_packets(df, "ip == 8.8.8", exact=True).count() == 0
    e = spark.createDataFrame([("fe80:0:0:0:0:0:0:22",), ("aa:bb:cc:00:11:22",), ("1.2.3.4:80",)], "s string")
    assert [r[0] for r in e.select(packetfilter.host_of(F.col("s"))).collect()] == ["fe80:0:0:0:0:0:0:22", "aa:bb:cc:00:11:22", "1.2.3.4"]
    assert e.select(packetfilter.host_of(F.col("s"), compat=True)).first()[0] == "fe80:0:0:0:0:0:0"


def test_writers(spark):
    df = spark.createDataFrame([(0, "Alice", "A\tB"), (1, "Bob", "Hello, world")], "i int, name string, note string")
    assert delimited.to_delimited_text(df, "i", "\t") == 'name\tnote\nAlice\t"A\tB"\nBob\tHello, world'
    assert documents.json_to_csv('[{"a":1},{"b":{"c":2},"a":null}]') == 'a,b\n1,\n,"{""c"":2}"'
    assert documents.json_to_xml('{"a b":[1,{"x":"<"}],"1":null}').splitlines()[2:7] == ["  <a_b>", "    <item>1</item>", "    <item>", "      <x>&lt;</x>", "    </item>"]
    assert documents.json_to_yaml('{"a":[1,{"b":"yes"}],"c":{}}') == 'a:\n  - 1\n  - b: "yes"\nc: {}'
    assert documents.unescape_text(r"a\n\u0041\x42\q\\") == "a\nAB" + "q\\"
    with pytest.raises(ValueError):
        documents.unescape_text("a\\")
    assert documents.sorted_keys('{"b":1,"a":{"d":1,"c":2}}') == '{"a":{"c":2,"d":1},"b":1}'
    assert '"totalRows": 9' in documents.export_json(df, "i", 9)


def test_edits(spark):
    one = spark.createDataFrame([(0, "x")], "i int, v string")
    with pytest.raises(ValueError):
        edit.delete_row(one, "i")
    with pytest.raises(ValueError):
        edit.delete_column(one.select("v"))
    with pytest.raises(IndexError):
        edit.update_line(one, "i", "v", 5, "y")
    two = edit.insert_line(one, "i", "v", 0, "first")
    assert {(r["i"], r["v"]) for r in two.collect()} == {(0, "first"), (1, "x")}


def test_scalars(spark):
    df = spark.sql("SELECT 1536L AS n, 'a<b&' AS t, X'00FF41' AS b, 'x.MP3' AS f")
    r = df.select(X.size_label(F.col("n")).alias("s"), X.html_safe_json(F.col("t")).alias("h"), X.hex_rows(F.col("b")).alias("x"), X.mime_type(F.col("f")).alias("m"), X.mac(F.col("b")).alias("mac")).first()
    assert (r["s"], r["h"], r["m"], r["mac"]) == ("1.5KB", "a\\u003cb\\u0026", "audio/mpeg", "00:ff:41")
    assert tuple(r["x"][0]) == ("0x0000", "00 ff 41", "..A")


def test_peaks_and_lookups(spark):
    f = spark.createDataFrame(list(enumerate([0.1, -0.5, 0.2, 0.3])), "frame long, x double")
    assert [r["peak"] for r in summarize.bucket_peaks(f, "frame", F.col("x"), 4, 2).orderBy("bucket").collect()] == [0.5, 0.3]
    assert summarize.bucket_peaks(f, "frame", F.col("x"), 4, 8).count() == 8
    files = spark.createDataFrame([("d/a.shp",), ("d/a.dbf",), ("d/b.dbf",)], "p string")
    assert [tuple(r) for r in lookup.sidecars(files, "p", "shp", ["dbf", "prj"]).collect()] == [("d/a", "d/a.shp", "d/a.dbf", None)]


def test_create_table_columns():
    from millrace.functions.sqltext import column_names

    sql = '''CREATE TABLE "t" (id INTEGER PRIMARY KEY, "a ""b""" TEXT DEFAULT 'x,(y', [c d] REAL CHECK (1 IN (1, 2)), `e` BLOB, CONSTRAINT k UNIQUE (id, `e`), PRIMARY KEY (id))'''
    assert column_names(sql) == ["id", 'a "b"', "c d", "e"] and column_names(None) == []


def test_positions_by_ranges(spark, tmp_path):
    df = spark.range(5000).selectExpr("id", "id * 7919 % 13 AS v").repartition(7)
    got = grid.positions(df, [F.col("v").desc(), F.col("id").asc()], "pos", f"file://{tmp_path}/p")
    want = sorted(((i * 7919 % 13, i) for i in range(5000)), key=lambda x: (-x[0], x[1]))
    assert [(r["v"], r["id"]) for r in sorted(got.collect(), key=lambda r: r["pos"])] == want
    assert {r["pos"] for r in got.collect()} == set(range(1, 5001)) and got.columns == ["id", "v", "pos"]
    assert grid.positions(df.limit(0), [F.col("id").asc()], "pos", f"file://{tmp_path}/e").count() == 0


@pytest.mark.parametrize("directions", [(False, False), (True, True), (True, False)])
def test_deep_pages(spark, directions):
    """Every page of an order with nulls, ties and both directions; only a part of the rows is sorted."""
    down, nulls_first = directions
    rows = [(i, None if i % 11 == 0 else "abcdefg"[i * 7919 % 7] * (i % 3), None if i % 5 == 0 else i * 31 % 17 / 4) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, s string, x double").repartition(5)
    order = [grid.Key(F.col("s"), down, nulls_first), grid.Key(F.col("x"), not down, nulls_first), grid.Key(F.col("id"), down)]
    want = [r["id"] for r in df.orderBy(*[k.of(k.value) for k in order]).collect()]
    for number in (-3, 1, 2, 9, 15, 29, 30, 31, 10**12):
        got = grid.deep_page(df, number, order, sorted_rows=250).collect()
        first = (min(max(number, 1), 30) - 1) * 100
        assert [r["id"] for r in got] == want[first : first + 100] and [r["pos"] for r in got] == list(range(first + 1, first + 101)), number
    assert grid.deep_page(df.limit(0), 5, order).count() == 0
    assert [r["pos"] for r in grid.deep_page(df.filter("id < 130"), 2, order).collect()] == list(range(101, 131))
    plan = grid.deep_page(df, 15, order, sorted_rows=250)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Filter" in plan


def test_deep_page_sorts_a_bounded_part(spark):
    """A first key with one value leads to cuts by the others."""
    df = spark.range(40_000).selectExpr("id", "1 AS same", "id * 7919 % 40000 AS v")
    page = grid.deep_page(df, 200, [grid.Key(F.col("same")), grid.Key(F.col("v")), grid.Key(F.col("id"))], sorted_rows=2500)
    assert [r["v"] for r in page.collect()] == list(range(19_900, 20_000))


def test_exports_are_whole_or_refused(spark):
    df = spark.range(12).selectExpr("id AS i", "cast(id AS string) AS v")
    assert documents.column_text(df, "v", "i", rows=12).count("\n") == 11
    for export in (lambda: documents.column_text(df, "v", "i", rows=11), lambda: documents.export_json(df, "i", 12, rows=11), lambda: delimited.to_delimited_text(df, "i", rows=11)):
        with pytest.raises(ValueError):
            export()


def test_mode_ties_go_to_the_least_value(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (1, "a"), (1, "c"), (2, "z")], "k int, v string")
    assert {(r["k"], r["v"], r["n"], r["total"]) for r in summarize.dominant(df, ["k"], "v", 0.4).collect()} == {(1, "a", 2, 5), (2, "z", 1, 1)}
