"""Queries that write a table in a format, read it back and must agree with SQL over the table."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import grid
from ..sinks import documents
from ..sources import catalogs, detect, geo, media, parquet
from ..sources.files import put_file, scratch
from ..streaming import streams
from .tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: Keys a shapefile covers at most.
SHAPE_FEATURES = 5000
#: Keys a sound file covers at most, and its peaks.
SOUND_FRAMES, SOUND_PEAKS = 10_000, 100


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


@query("SELECT l_orderkey, l_linenumber, row_no AS _row_index FROM (SELECT l_orderkey, l_linenumber, file_row_number AS row_no FROM (SELECT *, row_number() OVER () - 1 AS file_row_number FROM lineitem)) WHERE row_no BETWEEN 1000 AND 1999")
def parquet_range(spark, sf_dir):
    """Rows [1000, 2000) of a file."""
    return parquet.read_parquet(spark, f"{sf_dir}/lineitem.parquet", 1000, 2000).select("l_orderkey", "l_linenumber", "_row_index")


@query("SELECT * FROM (VALUES ('event_id', 'bigint'), ('ts', 'timestamp_ntz'), ('user_id', 'bigint'), ('event_type', 'string'), ('value', 'double'), ('props', 'string')) t(name, type)")
def parquet_leaves(spark, sf_dir):
    """S08."""
    return spark.createDataFrame(parquet.leaves(table(spark, sf_dir, "events").schema), "name string, type string")





@query("SELECT 'MEASUREMENT' AS type, count(*) AS count FROM nation UNION ALL SELECT 'CHARACTERISTIC', count(*) FROM region")
def a2l_counts(spark, sf_dir):
    """S12, A03."""
    path = scratch(spark, "a2l")
    blocks = table(spark, sf_dir, "nation").select(F.concat(F.lit("/begin MEASUREMENT "), F.replace("n_name", F.lit(" "), F.lit("_"))).alias("value")).unionAll(table(spark, sf_dir, "region").select(F.concat(F.lit("  /begin CHARACTERISTIC "), "r_name")))
    blocks.write.text(path)
    return catalogs.read_a2l(spark, path).tables["counts"].select("type", "count")


@query("SELECT event_id / 1000.0 AS time, 'CAN' AS type, upper(to_hex(user_id)) AS id, CASE WHEN event_id % 2 = 0 THEN 'Rx' ELSE 'Tx' END AS direction FROM events")
def asc_events(spark, sf_dir):
    """A log that is read in splits."""
    path = scratch(spark, "asc")
    e = table(spark, sf_dir, "events")
    line = F.concat_ws(" ", (F.col("event_id") / 1000).cast("decimal(20,3)").cast("string"), F.lit("1"), F.hex("user_id"), F.when(F.col("event_id") % 2 == 0, "Rx").otherwise("Tx"), F.lit("d 2 01 02"))
    e.select(line.alias("value")).write.text(path)
    events = catalogs.read_asc(spark, path).tables["events"]
    return events.select(F.col("time").cast("double").alias("time"), "type", "id", "direction")


@query("SELECT p_brand AS type, count(*) AS count FROM (SELECT upper(replace(p_brand, '#', '_')) AS p_brand FROM part) GROUP BY p_brand")
def step_types(spark, sf_dir):
    """Entities by type."""
    path = scratch(spark, "step")
    p = table(spark, sf_dir, "part")
    p.select(F.concat(F.lit("#"), F.col("p_partkey").cast("string"), F.lit(" = "), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit("('',#1);")).alias("value")).write.text(path)
    return catalogs.read_step(spark, path).tables["entities"].groupBy("type").agg(F.count("*").alias("count"))


def _shapes(spark: SparkSession, sf_dir: str) -> str:
    """Suppliers as points, in shapefiles of ``SHAPE_FEATURES`` keys with index and attributes."""
    path = scratch(spark, "shapes")

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("s_suppkey")
        stem = f"{path}/{rows['no'].iloc[0]}"
        head = struct.pack(">i", 9994) + bytes(24) + struct.pack("<2i", 1000, 1) + bytes(64)
        put_file(f"{stem}.shp", head + b"".join(struct.pack(">2i", i + 1, 10) + struct.pack("<i2d", 1, k % 100, n - 10) for i, (k, n) in enumerate(zip(rows["s_suppkey"], rows["s_nationkey"]))))
        put_file(f"{stem}.shx", head + b"".join(struct.pack(">2i", 50 + 14 * i, 10) for i in range(len(rows))))
        dbf = struct.pack("<BBBBIHH", 3, 0, 0, 0, len(rows), 97, 51) + bytes(20)
        for name, n in ((b"name", 30), (b"key", 20)):
            dbf += name.ljust(11, b"\0") + b"C" + bytes(4) + bytes([n]) + bytes(15)
        put_file(f"{stem}.dbf", dbf + b"\r" + b"".join(b" " + n.encode().ljust(30) + str(k).encode().ljust(20) for k, n in zip(rows["s_suppkey"], rows["s_name"])))
        return pd.DataFrame({"n": [len(rows)]})

    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_name", F.expr(f"s_suppkey DIV {SHAPE_FEATURES}").alias("no"))
    supplier.groupBy("no").applyInPandas(write, "n long").agg(F.sum("n")).collect()
    return path


@query("SELECT s_suppkey AS feature_id, 'Point' AS geom_type, (s_suppkey % 100)::DOUBLE AS min_x, (s_nationkey - 10)::DOUBLE AS min_y, s_name AS name FROM supplier")
def shapefile_scan(spark, sf_dir):
    """Points with attributes."""
    return geo.read_shapefile(spark, _shapes(spark, sf_dir)).select(F.col("properties")["key"].cast("long").alias("feature_id"), "geom_type", "min_x", "min_y", F.col("properties")["name"].alias("name"))


@query(f"SELECT place AS feature_id, s_suppkey AS key, s_name AS name FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey // {SHAPE_FEATURES} ORDER BY s_suppkey) - 1 AS place FROM supplier) WHERE place >= 40 AND s_suppkey % 100 BETWEEN 10 AND 70 AND s_nationkey - 10 BETWEEN -5 AND 8")
def shapefile_continued(spark, sf_dir):
    """Features from a number on that meet a box; the index leads to both."""
    got = geo.read_shapefile(spark, _shapes(spark, sf_dir), start=40, box=(10, -5, 70, 8), features=25)
    return got.select("feature_id", F.col("properties")["key"].cast("long").alias("key"), F.col("properties")["name"].alias("name"))


@query("SELECT s_suppkey AS key, round(degrees((s_suppkey % 100) * 1000 / 6378137.0), 6) AS lon, round(degrees(2 * atan(exp((s_nationkey - 10) * 1000 / 6378137.0)) - pi() / 2), 6) AS lat, 'projected' AS status FROM supplier")
def reprojected_points(spark, sf_dir):
    """Web Mercator, in kilometres, to degrees by column functions."""
    path = _shapes(spark, sf_dir)
    for file in spark.read.format("binaryFile").option("pathGlobFilter", "*.shp").load(path).select("path").toLocalIterator():  # a row a file
        put_file(file[0][:-4] + ".prj", b'PROJCS["WGS_1984_Web_Mercator_Auxiliary_Sphere",GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]],PROJECTION["Mercator_Auxiliary_Sphere"],PARAMETER["Central_Meridian",0.0],UNIT["Kilometer",1000.0]]')
    got = geo.reprojected(geo.read_shapefile(spark, path), geo.read_projections(spark, path))
    return got.select(F.col("properties")["key"].cast("long").alias("key"), F.round("min_x", 6).alias("lon"), F.round("max_y", 6).alias("lat"), F.col("projection_status").alias("status"))


@query(f"""WITH e AS (SELECT (event_id - (SELECT min(event_id) FROM events)) // {SOUND_FRAMES} AS file_no, event_id, greatest(-32768, least(32767, floor((value % 2 - 1) * 32768 + 0.5))) / 32768 AS v FROM events),
          f AS (SELECT file_no, row_number() OVER (PARTITION BY file_no ORDER BY event_id) - 1 AS frame, count(*) OVER (PARTITION BY file_no) AS n, v FROM e),
          p AS (SELECT file_no, CASE WHEN n < {SOUND_PEAKS} THEN (frame * {SOUND_PEAKS} + {SOUND_PEAKS - 1}) // n ELSE ((frame + 1) * {SOUND_PEAKS} - 1) // n END AS bucket, max(abs(v)) AS peak FROM f GROUP BY ALL),
          b AS (SELECT file_no, bucket FROM (SELECT DISTINCT file_no FROM f), range({SOUND_PEAKS}) r(bucket))
          SELECT file_no::BIGINT AS file_no, bucket::BIGINT AS bucket, round(coalesce(peak, 0), 4) AS peak FROM b LEFT JOIN p USING (file_no, bucket)""")
def sound_peaks(spark, sf_dir):
    """All events as raw PCM files, written in tasks and read by path."""
    path = scratch(spark, "sound")
    events = table(spark, sf_dir, "events").select("event_id", "value")
    first = events.agg(F.min("event_id").alias("first"))

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values("event_id")["value"].to_numpy()
        pcm = np.clip(np.floor((np.fmod(x, 2) - 1) * 32768 + 0.5), -32768, 32767).astype("<i2")
        put_file(f"{path}/{rows['no'].iloc[0]}.pcm", pcm.tobytes())
        return pd.DataFrame({"n": [len(rows)]})

    numbered = events.crossJoin(F.broadcast(first)).select("event_id", "value", F.expr(f"(event_id - first) DIV {SOUND_FRAMES}").alias("no"))
    numbered.groupBy("no").applyInPandas(write, "n long").agg(F.sum("n")).collect()
    found = media.peaks(media.read_audio(spark, path), SOUND_PEAKS)
    return found.select(F.regexp_extract("file", r"(\d+)\.pcm$", 1).cast("long").alias("file_no"), "bucket", F.round("peak", 4).alias("peak"))


@query("SELECT page_id, 'unknown' AS format FROM pages".replace("'unknown'", "CASE WHEN strpos(html, ',') > 0 OR strpos(html, ';') > 0 OR strpos(html, '|') > 0 OR strpos(html, chr(9)) > 0 THEN 'csv' END"))
def detect_pages(spark, sf_dir):
    """Pages have no signature and pass for delimited text where a delimiter is in them."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("file"), F.encode("html", "utf-8").alias("content"))
    found = detect.detect_contents(p.select("file", F.octet_length("content").cast("long").alias("length"), "content"))
    return found.select(F.col("file").cast("long").alias("page_id"), "format")


@query("SELECT n_nationkey, '<?xml version=\"1.0\" encoding=\"UTF-8\"?>' || chr(10) || '<root>' || chr(10) || '  <name>' || n_name || '</name>' || chr(10) || '  <tags>' || chr(10) || '    <item>' || n_regionkey || '</item>' || chr(10) || '  </tags>' || chr(10) || '</root>' AS xml, 'name: ' || n_name || chr(10) || 'tags:' || chr(10) || '  - ' || n_regionkey AS yaml FROM nation")
def json_conversions(spark, sf_dir):
    """JSON as XML and YAML."""
    j = F.to_json(F.struct(F.col("n_name").alias("name"), F.array("n_regionkey").alias("tags")))
    return table(spark, sf_dir, "nation").select("n_nationkey", documents.to_xml(j).alias("xml"), documents.to_yaml(j).alias("yaml"))


@query("""SELECT event_id, props AS minified FROM (SELECT event_id, replace(replace(props, ': ', ':'), ', ', ',') AS props FROM events)""")
def json_minified(spark, sf_dir):
    """X06."""
    return table(spark, sf_dir, "events").select("event_id", documents.minified("props").alias("minified"))


@query("SELECT doc_id, md5(text) AS h FROM documents")
def escape_round_trip(spark, sf_dir):
    """Escaped and unescaped."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(documents.unescaped(documents.escaped("text")).cast("binary")).alias("h"))


@query("SELECT n_nationkey, '0x' || lpad(lower(to_hex(16 * i)), 4, '0') AS offset, substr(n_name, 16 * i + 1, 16) AS ascii FROM nation, range(2) r(i) WHERE length(n_name) > 16 * i")
def hex_dump(spark, sf_dir):
    """S41."""
    return table(spark, sf_dir, "nation").select("n_nationkey", F.inline(X.hex_rows(F.encode("n_name", "utf-8")))).select("n_nationkey", "offset", "ascii")


@query("SELECT event_type, count(*) AS n, time_bucket(INTERVAL 1 DAY, ts) AS day FROM events GROUP BY ALL")
def stream_windows(spark, sf_dir):
    """An extension: counts by day over a stream of files."""
    events = table(spark, sf_dir, "events")
    source = scratch(spark, "events")
    events.repartition(2).write.parquet(source)
    stream = streams.windowed_counts(streams.parquet_stream(spark, source, events.schema), "ts", "event_type", "1 day")
    got = streams.run_once(stream, f"w{uuid.uuid4().hex[:8]}", scratch(spark, "state"), "complete")
    return got.select("event_type", "n", F.col("start").cast("timestamp_ntz").alias("day"))


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS pos FROM orders QUALIFY pos <= 100")
def top_page(spark, sf_dir):
    """L01 over O02: a first page is a top-k in each partition."""
    return grid.numbered_page(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 1, [F.col("o_totalprice").desc(), F.col("o_orderkey")])
