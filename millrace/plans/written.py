"""Queries over files of many kinds: tasks write a table as files of bounded size, the public readers read them by path."""

from __future__ import annotations

import gzip
import io
import json
import sqlite3
import struct
import tarfile
import zipfile
from collections.abc import Callable
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grid, ordered
from ..sinks import delimited as writer
from ..sinks import documents, versions
from ..sources import arrays, catalogs, containers, delimited, files, jsonlines, media, office, packets, trees
from ..streaming import streams, tail
from .tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: Keys that a file covers at most.
FILE_KEYS = 500


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _write(rows: pd.DataFrame, key: str, path: str, make: Callable[[int, pd.DataFrame], dict[str, bytes]]) -> pd.DataFrame:
    for name, content in make(int(rows["no"].iloc[0]), rows.sort_values(key)).items():
        files.put_file(f"{path}/{name}", content)
    return pd.DataFrame({"n": [len(rows)]})


def written(df: DataFrame, key: str, make: Callable[[int, pd.DataFrame], dict[str, bytes]], name: str, path: str | None = None) -> str:
    """A folder, new unless given, with the files that ``make`` gives for each ``FILE_KEYS`` keys; each is one task's work."""
    path = path or files.scratch(df.sparkSession, name)
    numbered = df.withColumn("no", F.expr(f"{key} DIV {FILE_KEYS}"))

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        return _write(rows, key, path, make)

    numbered.groupBy("no").applyInPandas(write, "n long").agg(F.sum("n")).collect()
    return path


def _customer(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")


def _part(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")


def _lines(column: str, head: str | None, suffix: str, no: int, rows: pd.DataFrame) -> dict[str, bytes]:
    return {f"{no}.{suffix}": "".join(f"{x}\n" for x in ([head] if head else []) + rows[column].tolist()).encode()}


# --- text


@query("SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_brand, p_size::VARCHAR AS p_size, row_number() OVER (PARTITION BY p_partkey // 500 ORDER BY p_partkey) - 1 AS row_in_file FROM part")
def csv_scan(spark, sf_dir):
    """Written and read as delimited text, rows numbered in each file."""
    part = _part(spark, sf_dir)
    path = written(part.select("p_partkey", writer.delimited_line(part).alias("value")), "p_partkey", partial(_lines, "value", "p_partkey,p_name,p_brand,p_size", "csv"), "part")
    return delimited.read_delimited(spark, path, ",").withColumnRenamed("_row_index", "row_in_file")


@query("""SELECT p_partkey::VARCHAR AS p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'say "hi", ' WHEN 1 THEN 'a;b' ELSE '' END || p_brand AS note FROM part""")
def quoted_scan(spark, sf_dir):
    """Quoted cells, the delimiter inferred from the file."""
    k = F.col("p_partkey")
    note = F.concat(F.when(k % 3 == 0, 'say "hi", ').when(k % 3 == 1, "a;b").otherwise(""), F.col("p_brand"))
    part = _part(spark, sf_dir).select("p_partkey", note.alias("note"))
    path = written(part.select("p_partkey", writer.delimited_line(part).alias("value")), "p_partkey", partial(_lines, "value", "p_partkey,note", "csv"), "quoted")
    return delimited.read_delimited(spark, path).drop("_row_index")


_IN_FILES = "SELECT *, row_number() OVER (PARTITION BY event_id // 500 ORDER BY event_id) AS n FROM events"


@query(f"SELECT n AS line_number, n * 2 - 1 AS physical_line, CASE WHEN event_id % 9 = 0 THEN 'oops' ELSE props END AS content, event_id % 9 <> 0 AS is_valid, CASE WHEN event_id % 9 <> 0 THEN (props::JSON->>'$.k')::BIGINT END AS k FROM ({_IN_FILES})")
def jsonl_scan(spark, sf_dir):
    """JSON lines between blank ones, with their numbers and validity."""
    events = table(spark, sf_dir, "events").select("event_id", F.concat(F.when(F.col("event_id") % 9 == 0, "oops").otherwise(F.col("props")), F.lit("\n")).alias("value"))
    path = written(events, "event_id", partial(_lines, "value", None, "jsonl"), "props")
    got = jsonlines.read_jsonl(spark, path)
    return got.select("line_number", "physical_line", "content", "is_valid", F.try_variant_get("v", "$.k", "bigint").alias("k"))


@query(f"SELECT n AS line_number, props AS content, true AS is_valid FROM (SELECT *, sum(strlen(props) + 1) OVER (PARTITION BY event_id // 500 ORDER BY event_id) AS upto FROM ({_IN_FILES})) WHERE upto <= 1000")
def jsonl_preview(spark, sf_dir):
    """The lines that end within a file's first bytes."""
    path = written(table(spark, sf_dir, "events").select("event_id", "props"), "event_id", partial(_lines, "props", None, "jsonl"), "head")
    got, _ = jsonlines.read_jsonl_preview(spark, path, 1000)
    return got.select("line_number", "content", "is_valid")


def _pretty_files(no: int, rows: pd.DataFrame) -> dict[str, bytes]:
    return {f"{no}.json": json.dumps([{"k": int(k), "n": n} for k, n in zip(rows["c_custkey"], rows["c_name"])]).encode()}


@query("SELECT c_custkey AS k, c_name AS n FROM customer")
def json_scan(spark, sf_dir):
    """Whole JSON documents, exploded from their VARIANT."""
    path = written(_customer(spark, sf_dir), "c_custkey", _pretty_files, "json")
    v = jsonlines.read_json(spark, path).select(F.explode(F.from_json(F.to_json("v"), "array<struct<k:long,n:string>>")).alias("x"))
    return v.select("x.k", "x.n")


def _document_lines(no: int, rows: pd.DataFrame) -> dict[str, bytes]:
    return {f"{no}.txt": "".join(f"{t}\n" for t in rows["text"]).encode("utf-8", "surrogatepass")}


@query("""SELECT row_number() OVER (PARTITION BY doc_id // 500 ORDER BY doc_id, i) AS line, md5(trim(line, chr(13))) AS h FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)""")
def physical_lines(spark, sf_dir):
    """Physical lines of files that are read in splits."""
    path = written(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", _document_lines, "lines")
    return files.lines(spark, path).select("line", F.md5(F.col("text").cast("binary")).alias("h"))


# --- catalogs


@query("SELECT 256 + p_partkey AS message_id, 'M' || p_partkey AS name, 8 AS dlc, 'N' || p_size AS transmitter, p_name AS comment, (p_size % 5 + 1)::BIGINT AS n_signals FROM part")
def dbc_scan(spark, sf_dir):
    """Messages with comments and signals."""
    k, r = F.col("p_partkey").cast("string"), F.col("p_size") % 5
    signals = F.array_join(F.transform(F.sequence(F.lit(0), r), lambda i: F.concat(F.lit(" SG_ S"), i.cast("string"), F.lit(' : 0|8@1+ (1,0) [0|255] "" X'))), "\n")
    number = (F.col("p_partkey") + 256).cast("string")
    text = F.concat(F.lit("BO_ "), number, F.lit(" M"), k, F.lit(": 8 N"), F.col("p_size").cast("string"), F.lit("\n"), signals, F.lit("\nCM_ BO_ "), number, F.lit(' "'), F.col("p_name"), F.lit('";'))
    path = written(_part(spark, sf_dir).select("p_partkey", text.alias("value")), "p_partkey", partial(_lines, "value", None, "dbc"), "dbc")
    m = catalogs.read_dbc(spark, path)["messages"]
    return m.select("message_id", "name", "dlc", "transmitter", "comment", F.size("signals").cast("long").alias("n_signals"))


def _arxml(no: int, rows: pd.DataFrame) -> dict[str, bytes]:
    inner = "".join(f'<CAN-FRAME><SHORT-NAME>F{k}</SHORT-NAME></CAN-FRAME><X><FRAME-REF DEST="FRAME">/P{no}/F{k}</FRAME-REF></X>' for k in rows["p_partkey"])
    return {f"{no}.arxml": f'<AUTOSAR xmlns="http://autosar.org/schema/r4.0"><AR-PACKAGE><SHORT-NAME>P{no}</SHORT-NAME>{inner}</AR-PACKAGE></AUTOSAR>'.encode()}


@query("SELECT 'FRAME-REF' AS tag, 'FRAME' AS dest, '/P' || p_partkey // 500 || '/F' || p_partkey AS target FROM part")
def arxml_references(spark, sf_dir):
    """References of AUTOSAR XML files."""
    return catalogs.read_arxml(spark, written(_part(spark, sf_dir), "p_partkey", _arxml, "arxml")).tables["references"].select("tag", "dest", "target")


def _reqif(no: int, rows: pd.DataFrame) -> dict[str, bytes]:
    objects = "".join(f'<SPEC-OBJECT IDENTIFIER="o{k}" LONG-NAME="{n} &amp; more"/>' for k, n in zip(rows["p_partkey"], rows["p_brand"]))
    return {f"{no}.reqif": f'<REQ-IF><REQ-IF-HEADER IDENTIFIER="h{no}"><TITLE>T{no}</TITLE></REQ-IF-HEADER><SPEC-OBJECTS>{objects}</SPEC-OBJECTS></REQ-IF>'.encode()}


@query("SELECT 'o' || p_partkey AS identifier, p_brand || ' & more' AS long_name FROM part")
def reqif_objects(spark, sf_dir):
    """Requirement objects."""
    return catalogs.read_reqif(spark, written(_part(spark, sf_dir), "p_partkey", _reqif, "reqif")).tables["objects"].select("identifier", "long_name")


# --- trees


def _toml(no: int, rows: pd.DataFrame) -> dict[str, bytes]:
    return {f"{no}.toml": "\n".join(f'# c{k}\n[customer.k{k}]\nname = "{n}"\ntags = [{k}, "x"]\n' for k, n in zip(rows["c_custkey"], rows["c_name"])).encode()}


@query("""SELECT 'customer.k' || c_custkey || s AS path, t AS value_type, CASE s WHEN '.name' THEN c_name WHEN '.tags[0]' THEN c_custkey::VARCHAR ELSE 'x' END AS value FROM customer, (VALUES ('.name', 'string'), ('.tags[0]', 'integer'), ('.tags[1]', 'string')) v(s, t)""")
def toml_leaves(spark, sf_dir):
    """S29, N01."""
    return trees.read_toml(spark, written(_customer(spark, sf_dir), "c_custkey", _toml, "toml"))["flattened"].select("path", "value_type", "value")


@query("SELECT c_custkey AS k, c_name AS name FROM customer")
def toml_json(spark, sf_dir):
    """TOML as JSON."""
    v = trees.read_toml(spark, written(_customer(spark, sf_dir), "c_custkey", _toml, "tomlj"))["json"].select(F.from_json(F.to_json("v"), "customer map<string,struct<name:string,tags:array<string>>>").alias("x"))
    return v.select(F.explode("x.customer").alias("key", "c")).select(F.substring("key", 2, 20).cast("long").alias("k"), "c.name")


def _yaml(no: int, rows: pd.DataFrame) -> dict[str, bytes]:
    return {f"{no}.yaml": "".join(f'k{k}: {{name: "{n}", nation: {r}, "odd key": yes}}\n' for k, n, r in zip(rows["c_custkey"], rows["c_name"], rows["c_nationkey"])).encode()}


@query("""SELECT '$.k' || c_custkey || s AS json_path, t AS scalar_type, CASE s WHEN '.name' THEN c_name WHEN '.nation' THEN c_nationkey::VARCHAR ELSE 'yes' END AS value, s LIKE '[%' AS ambiguous FROM customer, (VALUES ('.name', 'string'), ('.nation', 'number'), ('["odd key"]', 'string')) v(s, t)""")
def yaml_nodes(spark, sf_dir):
    """S30, N03, N04."""
    nodes = trees.read_yaml(spark, written(_customer(spark, sf_dir), "c_custkey", _yaml, "yaml"))["nodes"]
    return nodes.filter("kind = 'scalar'").select("json_path", "scalar_type", "value", "ambiguous")


@query("""SELECT 'k' || c_custkey || '.name' AS path FROM customer WHERE contains(lower(c_name), '#00000001')""")
def yaml_search(spark, sf_dir):
    """Nodes by their value."""
    nodes = trees.read_yaml(spark, written(_customer(spark, sf_dir), "c_custkey", _yaml, "yamls"))["nodes"]
    return trees.search_nodes(nodes, " #00000001 ", "value").select("path")


def _proto(no: int, rows: pd.DataFrame) -> dict[str, bytes]:
    fields = "\n".join(f'  /* of {k} */ {"repeated " if k % 3 == 0 else ""}{"M%d" % no if k % 4 == 0 else "string"} f{k} = {k + 1}; // "x"' for k in rows["p_partkey"])
    return {f"{no}.proto": f'syntax = "proto3";\npackage pkg;\nmessage M{no} {{\n{fields}\n}}\n'.encode()}


@query("SELECT 'pkg.M' || p_partkey // 500 AS message, 'f' || p_partkey AS name, CASE WHEN p_partkey % 4 = 0 THEN 'M' || p_partkey // 500 ELSE 'string' END AS type, CASE WHEN p_partkey % 3 = 0 THEN 'repeated' END AS label, p_partkey + 1 AS number, 'of ' || p_partkey AS doc FROM part")
def proto_fields(spark, sf_dir):
    """Fields with their comments."""
    return trees.read_proto(spark, written(_part(spark, sf_dir), "p_partkey", _proto, "proto"))["fields"].select("message", "name", "type", "label", "number", "doc")


@query("SELECT 'pkg.M' || p_partkey // 500 AS full_name, 'pkg.M' || p_partkey // 500 || '.f' || p_partkey AS \"from\" FROM part WHERE p_partkey % 4 = 0")
def proto_references(spark, sf_dir):
    """Where a message is used."""
    p = trees.read_proto(spark, written(_part(spark, sf_dir), "p_partkey", _proto, "protor"))
    return trees.references_to(p["edges"].filter("from_kind = 'field'"), p["messages"]).select("full_name", "from")


# --- databases, archives, arrays, workbooks


def _database(no: int, rows: pd.DataFrame) -> dict[str, bytes]:
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE t (key INTEGER PRIMARY KEY, name TEXT, half REAL)")
    db.executemany("INSERT INTO t VALUES (?, ?, ?)", [(int(k), n, None if k % 5 == 0 else float(r)) for k, n, r in zip(rows["c_custkey"], rows["c_name"], rows["c_acctbal"])])
    db.commit()
    return {f"{no}.db3": bytes(db.serialize())}


def _nested_proto(no: int, rows: pd.DataFrame) -> dict[str, bytes]:
    body = "".join(
        f"message M{k} {{ int64 id = 1; E{k} e = 2; map<string, int32> m = 3; N{k} n = 4; message N{k} {{ bool b = 1; pkg.M{k} back = 2; repeated string t = 3; Lost x = 4; }} }}\nenum E{k} {{ A{k} = 0; B{k} = 1; }}\n"
        for k in rows["p_partkey"]
    )
    return {f"{no}.proto": f'syntax = "proto3";\npackage pkg;\n{body}'.encode()}


@query("""WITH p AS (SELECT p_partkey AS k FROM part), m AS (SELECT k, '"id":"0","e":"A' || k || '","m":{"key":"value"},' AS head FROM p)
          SELECT 'pkg.M' || k AS message, '{' || head || '"n":{"b":false,"back":{},"t":["string"],"x":null}}' AS example FROM m
          UNION ALL SELECT 'pkg.M' || k || '.N' || k, '{"b":false,"back":{' || head || '"n":{}},"t":["string"],"x":null}' FROM m""")
def proto_examples(spark, sf_dir):
    """Examples of all messages, names resolved and cycles ended by joins, folded from the innermost out."""
    return trees.proto_examples(spark, written(_part(spark, sf_dir), "p_partkey", _nested_proto, "examples")).select("message", "example")


@query("SELECT c_custkey AS rowid, c_custkey AS key, c_name AS name, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS half FROM customer")
def sqlite_scan(spark, sf_dir):
    """A table of databases, its nulls kept."""
    return containers.read_sqlite_table(spark, written(_customer(spark, sf_dir), "c_custkey", _database, "db"), "t").select("rowid", "key", "name", "half")


@query("SELECT c_custkey // 500 AS file_no, 't' AS name, 'table' AS type FROM customer GROUP BY ALL")
def sqlite_schema(spark, sf_dir):
    """User tables of databases."""
    found = containers.user_tables(containers.read_sqlite_schema(spark, written(_customer(spark, sf_dir), "c_custkey", _database, "dbs")))
    return found.select(F.regexp_extract("file", r"(\d+)\.db3$", 1).cast("long").alias("file_no"), "name", "type")


def _archive(no: int, rows: pd.DataFrame) -> dict[str, bytes]:
    out = io.BytesIO()
    items = [(f"d/{k}.txt", n.encode() * 10) for k, n in zip(rows["c_custkey"], rows["c_name"])]
    if no % 2 == 0:
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, content in items:
                z.writestr(name, content)
        return {f"{no}.zip": out.getvalue()}
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name, content in items:
            info = tarfile.TarInfo(name)
            info.size = len(content)
            t.addfile(info, io.BytesIO(content))
    return {f"{no}.tar.gz": out.getvalue()}


@query("SELECT 'd/' || c_custkey || '.txt' AS path, 'file' AS kind, (length(c_name) * 10)::BIGINT AS size FROM customer")
def archive_listing(spark, sf_dir):
    """Entries of ZIP and TAR archives."""
    return containers.read_archive(spark, written(_customer(spark, sf_dir), "c_custkey", _archive, "archives")).select("path", "kind", "size")


@query("SELECT c_custkey // 500 AS file_no, count(*) AS total, count(*) AS files, 0::BIGINT AS directories FROM customer GROUP BY 1")
def archive_totals(spark, sf_dir):
    """Counts by archive, of entries with a term in their path."""
    entries = containers.path_filter(containers.read_archive(spark, written(_customer(spark, sf_dir), "c_custkey", _archive, "archivet"), sort=False), " .TXT")
    return containers.archive_counts(entries).select(F.regexp_extract("file", r"(\d+)\.[a-z.]+$", 1).cast("long").alias("file_no"), "total", "files", "directories")


def _entry(no: int, rows: pd.DataFrame) -> dict[str, bytes]:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("all.txt", "\n".join(rows["c_name"]))
    return {f"{no}.zip": out.getvalue(), f"{no}.gz": gzip.compress("\n".join(rows["c_name"]).encode(), mtime=0)}


@query("SELECT c_custkey // 500 AS file_no, md5(string_agg(c_name, chr(10) ORDER BY c_custkey)) AS h FROM customer GROUP BY 1")
def archive_entry(spark, sf_dir):
    """The text of an entry of each archive."""
    path = written(_customer(spark, sf_dir), "c_custkey", _entry, "entries")
    got = containers.read_entry(spark, f"{path}/*.zip", "all.txt")
    return got.select(F.regexp_extract("file", r"(\d+)\.zip$", 1).cast("long").alias("file_no"), F.md5(F.col("text").cast("binary")).alias("h"))


@query("SELECT (c_custkey // 500) || '' AS path, 'file' AS kind, (sum(length(c_name) + 1) - 1)::BIGINT AS size FROM customer GROUP BY c_custkey // 500")
def gzip_listing(spark, sf_dir):
    """Single compressed files."""
    path = written(_customer(spark, sf_dir), "c_custkey", _entry, "gzip")
    return containers.read_archive(spark, f"{path}/*.gz", sort=False).select("path", "kind", "size")


def _tensors(no: int, rows: pd.DataFrame) -> dict[str, bytes]:
    at, head = 0, {}
    for k, n in zip(rows["c_custkey"], rows["c_name"]):
        size = 8 * (int(k) % 7)
        head[n] = {"dtype": "F32", "shape": [int(k) % 7, 2], "data_offsets": [at, at + size]}
        at += size
    raw = json.dumps(head).encode()
    return {f"{no}.safetensors": struct.pack("<Q", len(raw)) + raw + bytes(at)}


@query("SELECT c_name AS name, 'F32' AS dtype, [c_custkey % 7, 2]::VARCHAR AS shape, c_custkey % 7 * 8 AS n_bytes FROM customer")
def tensor_catalog(spark, sf_dir):
    """S26."""
    rows = containers.read_safetensors(spark, written(_customer(spark, sf_dir), "c_custkey", _tensors, "tensors"))
    return rows.select("name", "dtype", F.concat(F.lit("["), F.array_join("shape", ", "), F.lit("]")).alias("shape"), "n_bytes")


def _workbook(no: int, rows: pd.DataFrame) -> dict[str, bytes]:
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    body = "".join(f'<row r="{i + 2}"><c r="A{i + 2}"><v>{k}</v></c><c r="B{i + 2}" t="inlineStr"><is><t>{n}</t></is></c><c r="C{i + 2}"><v>{r / 2}</v></c></row>' for i, (k, n, r) in enumerate(zip(rows["c_custkey"], rows["c_name"], rows["c_nationkey"])))
    head = "".join(f'<c r="{c}1" t="inlineStr"><is><t>{n}</t></is></c>' for c, n in zip("ABC", ("key", "name", "half")))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S{no}" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1">{head}</row>{body}</sheetData></worksheet>')
    return {f"{no}.xlsx": out.getvalue()}


@query("SELECT 'S' || c_custkey // 500 AS sheet, c_custkey::VARCHAR AS key, c_name AS name, CASE WHEN c_nationkey % 2 = 0 THEN (c_nationkey // 2)::VARCHAR ELSE (c_nationkey / 2.0)::VARCHAR END AS half FROM customer")
def workbook_scan(spark, sf_dir):
    """S09."""
    cells = office.read_workbook(spark, written(_customer(spark, sf_dir), "c_custkey", _workbook, "books")).filter("row > 0")
    return cells.select("sheet", *[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(("key", "name", "half"))])


def _mat_file(no: int, rows: pd.DataFrame) -> dict[str, bytes]:
    element = lambda kind, raw: struct.pack("<2I", kind, len(raw)) + raw + bytes(-len(raw) % 8)
    out = [b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H", 0x0100) + b"IM"]
    for k in rows["c_custkey"]:
        n = int(k) % 5 + 1
        out.append(element(14, element(6, struct.pack("<2I", 6, 0)) + element(5, struct.pack("<2i", 1, n)) + element(1, f"m{k}".encode()) + element(9, struct.pack(f"<{n}d", *range(n)))))
    return {f"{no}.mat": b"".join(out)}


@query("SELECT 'm' || c_custkey AS name, 'double' AS class, '1 x ' || (c_custkey % 5 + 1) AS size FROM customer")
def mat_catalog(spark, sf_dir):
    """S25."""
    return arrays.read_mat(spark, written(_customer(spark, sf_dir), "c_custkey", _mat_file, "mat")).select("name", "class", "size")


def _binary_logs(no: int, rows: pd.DataFrame) -> dict[str, bytes]:
    n = len(rows)
    zigzag = lambda x: bytes([x << 1]) if x < 64 else bytes([x << 1 & 127 | 128, x << 1 >> 7])
    text = lambda x: zigzag(len(x)) + x
    avro = b"Obj\x01" + zigzag(2) + text(b"avro.codec") + text(b"null") + text(b"rows") + text(str(n).encode()) + zigzag(0)
    return {
        f"{no}.blf": b"LOGG" + struct.pack("<I", 144) + bytes(24) + struct.pack("<I", 2) + bytes(92) + struct.pack("<Q", n) + bytes(20),
        f"{no}.mf4": b"MDF     4.10    TEST    " + b"##HD" + b"##CN" * n,
        f"{no}.avro": avro,
        f"{no}.bag": b"#ROSBAG V2.0\n" + b"op=\x07" + b"op=\x05" * n,
    }


_FILES = "(SELECT c_custkey // 500 AS file_no, count(*) AS n FROM customer GROUP BY 1)"


def _file_no(extension: str):
    return F.regexp_extract("file", rf"(\d+)\.{extension}$", 1).cast("long").alias("file_no")


@query(f"SELECT file_no, '##HD' AS block, 1::BIGINT AS count FROM {_FILES} UNION ALL SELECT file_no, '##CN', n FROM {_FILES}")
def mf4_blocks(spark, sf_dir):
    """Block markers of measurement files."""
    path = written(_customer(spark, sf_dir), "c_custkey", _binary_logs, "mf4")
    return containers.read_mf4(spark, f"{path}/*.mf4")[1].select(_file_no("mf4"), "block", "count")


@query(f"SELECT file_no, 'Connection' AS record, 1::BIGINT AS count FROM {_FILES} UNION ALL SELECT file_no, 'Chunk', n FROM {_FILES}")
def bag_records(spark, sf_dir):
    """Record kinds of robot logs."""
    path = written(_customer(spark, sf_dir), "c_custkey", _binary_logs, "bag")
    return containers.read_bag(spark, f"{path}/*.bag")[1].select(_file_no("bag"), "record", "count")


@query(f"SELECT file_no, 'avro.codec' AS key, 'null' AS value FROM {_FILES} UNION ALL SELECT file_no, 'rows', n::VARCHAR FROM {_FILES}")
def avro_header(spark, sf_dir):
    """The header's map."""
    path = written(_customer(spark, sf_dir), "c_custkey", _binary_logs, "avro")
    return containers.read_avro_header(spark, f"{path}/*.avro").select(_file_no("avro"), "key", "value")


@query(f"SELECT file_no, 'LOGG' AS signature, n AS objects FROM {_FILES}")
def blf_headers(spark, sf_dir):
    """Headers of binary CAN logs."""
    path = written(_customer(spark, sf_dir), "c_custkey", _binary_logs, "blf")
    got = containers.read_blf(spark, f"{path}/*.blf")
    return got.select(_file_no("blf"), F.col(got.columns[1]).alias("signature"), F.col(got.columns[4]).cast("long").alias("objects"))


# --- packets


def _ip4(proto: int, body: bytes, k: int) -> bytes:
    return bytes(12) + b"\x08\x00" + struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 0, 0, 64, proto, 0, bytes([10, k >> 16 & 255, k >> 8 & 255, k & 255]), bytes([8, 8, 8, 8])) + body


def _udp(source: int, target: int, body: bytes) -> bytes:
    return struct.pack(">4H", source, target, 8 + len(body), 0) + body


def _tcp(source: int, target: int, flags: int, body: bytes, k: int = 1) -> bytes:
    return struct.pack(">HHIIBBHHH", source, target, k, 0, 0x50, flags, 100, 0, 0) + body


def _frame(k: int) -> bytes:
    """A frame of one of twelve protocols."""
    kind, port = k % 12, 5000 + k % 300
    if kind == 0:
        name = f"c{k}".encode()
        return _ip4(17, _udp(port, 53, struct.pack(">6H", k & 0xFFFF, 0x0100, 1, 0, 0, 0) + bytes([len(name)]) + name + b"\0" + struct.pack(">2H", 1, 1)), k)
    if kind == 1:
        return _ip4(6, _tcp(port, 2000, 2, b"", k), k)
    if kind == 2:
        return _ip4(1, b"\x08\0" + bytes(6), k)
    if kind == 3:
        return bytes(12) + b"\x08\x06" + struct.pack(">HHBBH", 1, 0x0800, 6, 4, 1) + bytes.fromhex("aabbcc001122") + bytes([10, k >> 16 & 255, k >> 8 & 255, k & 255]) + bytes(6) + bytes([10, 0, 0, 2])
    if kind == 4:
        return _ip4(6, _tcp(port, 80, 24, f"GET /{k} HTTP/1.1\r\nHost: h{k}.example\r\n\r\n".encode()), k)
    if kind == 5:
        return _ip4(17, _udp(port, 123, bytes([0x23, 2]) + bytes(38) + struct.pack(">II", k, 0)), k)
    if kind == 6:
        return _ip4(17, _udp(port, 5683, bytes([0x40, 1]) + struct.pack(">H", k & 0xFFFF)), k)
    if kind == 7:
        topic = f"t{k}".encode()
        return _ip4(6, _tcp(port, 1883, 24, bytes([0x30, len(topic) + 2]) + struct.pack(">H", len(topic)) + topic), k)
    if kind == 8:
        return _ip4(6, _tcp(port, 443, 24, bytes([23, 3, 3, 0, 5]) + b"12345"), k)
    if kind == 9:
        body = _udp(port, 2000, b"")
        return bytes(12) + b"\x86\xdd" + struct.pack(">IHBB", 6 << 28, len(body), 17, 64) + bytes.fromhex("20010db8") + bytes(8) + struct.pack(">I", k) + bytes(15) + b"\1" + body
    if kind == 10:
        return _ip4(17, _udp(68, 67, bytes([1, 1, 6, 0]) + struct.pack(">I", k) + bytes(20) + bytes.fromhex("aabbcc001122") + bytes(206) + bytes([53, 1, 1, 255])), k)
    return bytes(12) + b"\x81\x00\x00\x07\x08\x00" + _ip4(17, _udp(port, 1900, b"M-SEARCH * HTTP/1.1\r\nX: y\r\n\r\n"), k)[14:]


def _captures(no: int, rows: pd.DataFrame) -> dict[str, bytes]:
    frames = [(int(k), _frame(int(k))) for k in rows["c_custkey"]]
    old = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + b"".join(struct.pack("<4I", k, k % 1_000_000, len(f), len(f)) + f for k, f in frames)
    block = lambda kind, body: struct.pack("<2I", kind, 12 + len(body)) + body + struct.pack("<I", 12 + len(body))
    new = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 65535)) + b"".join(block(6, struct.pack("<5I", 0, 0, k, len(f), len(f)) + f + bytes(-len(f) % 4)) for k, f in frames)
    return {f"{no}.pcap": old, f"{no}.pcapng": new}


_PACKET_SQL = """
    WITH c AS (SELECT c_custkey AS k, c_custkey % 12 AS kind, 5000 + c_custkey % 300 AS port, '10.' || (c_custkey >> 16) % 256 || '.' || (c_custkey >> 8) % 256 || '.' || c_custkey % 256 AS ip FROM customer),
    h AS (SELECT *, [lower(to_hex(k >> 16)), lower(to_hex(k % 65536))] AS x FROM c)
    SELECT k || '.' || lpad(k::VARCHAR, 6, '0') AS timestamp,
      CASE kind WHEN 0 THEN 'DNS' WHEN 1 THEN 'IPv4/TCP' WHEN 2 THEN 'ICMP' WHEN 3 THEN 'ARP' WHEN 4 THEN 'HTTP' WHEN 5 THEN 'NTP' WHEN 6 THEN 'CoAP' WHEN 7 THEN 'MQTT' WHEN 8 THEN 'TLS' WHEN 9 THEN 'IPv6/UDP' WHEN 10 THEN 'DHCP' ELSE 'SSDP' END AS protocol,
      CASE kind WHEN 2 THEN ip WHEN 3 THEN ip || ' (aa:bb:cc:00:11:22)' WHEN 9 THEN '2001:db8:0:0:0:0:' || x[1] || ':' || x[2] || ':' || port WHEN 10 THEN ip || ':68' ELSE ip || ':' || port END AS source,
      CASE kind WHEN 2 THEN '8.8.8.8' WHEN 3 THEN '10.0.0.2 (00:00:00:00:00:00)' WHEN 9 THEN '0:0:0:0:0:0:0:1:2000' ELSE '8.8.8.8:' || CASE kind WHEN 0 THEN 53 WHEN 1 THEN 2000 WHEN 4 THEN 80 WHEN 5 THEN 123 WHEN 6 THEN 5683 WHEN 7 THEN 1883 WHEN 8 THEN 443 WHEN 10 THEN 67 ELSE 1900 END END AS destination,
      CASE kind WHEN 0 THEN 'Query id=0x' || lpad(lower(to_hex(k % 65536)), 4, '0') || ', rcode=NOERROR, questions=1, answers=0, c' || k || ' A'
        WHEN 1 THEN 'TCP SYN, seq=' || k || ', ack=0, win=100, 0 byte payload' WHEN 2 THEN 'Type 8, code 0' WHEN 3 THEN 'Who has 10.0.0.2? Tell ' || ip
        WHEN 4 THEN 'GET /' || k || ' HTTP/1.1, Host=h' || k || '.example' WHEN 5 THEN 'LI=0, version=4, mode=client, stratum=2, tx=' || k WHEN 6 THEN 'v1, Confirmable, code=0.01, mid=' || k % 65536 || ', tokenLen=0'
        WHEN 7 THEN 'PUBLISH, remaining=' || (3 + length(k::VARCHAR)) || ', topic=t' || k WHEN 8 THEN 'ApplicationData, version 0x303, 5 byte record' WHEN 9 THEN 'UDP 0 byte payload'
        WHEN 10 THEN 'DHCP Discover, xid=0x' || lpad(lower(to_hex(k)), 8, '0') || ', client=aa:bb:cc:00:11:22, ciaddr=0.0.0.0, yiaddr=0.0.0.0' ELSE 'M-SEARCH * HTTP/1.1 VLAN 7' END AS info
    FROM h"""


@query(_PACKET_SQL)
def pcap_scan(spark, sf_dir):
    """Captures of twelve protocols."""
    path = written(_customer(spark, sf_dir), "c_custkey", _captures, "pcap")
    return packets.read_pcap(spark, f"{path}/*.pcap").tables["packets"].select("timestamp", "protocol", "source", "destination", "info")


@query(_PACKET_SQL.replace("k || '.' || lpad(k::VARCHAR, 6, '0') AS timestamp", "k::VARCHAR AS timestamp"))
def pcapng_scan(spark, sf_dir):
    """The same in blocks, link types by interface."""
    path = written(_customer(spark, sf_dir), "c_custkey", _captures, "pcapng")
    return packets.read_pcapng(spark, f"{path}/*.pcapng").tables["packets"].select("timestamp", "protocol", "source", "destination", "info")


@query("SELECT 'Enhanced Packet' AS type, count(*) AS count FROM customer UNION ALL SELECT unnest(['Section Header', 'Interface Description']), count(DISTINCT c_custkey // 500) FROM customer")
def pcapng_blocks(spark, sf_dir):
    """Blocks by type."""
    path = written(_customer(spark, sf_dir), "c_custkey", _captures, "blocks")
    return packets.read_pcapng(spark, f"{path}/*.pcapng").tables["block_counts"]


# --- conversions of rows


@query("""SELECT event_id, 'b,a.x' || chr(10) || event_id || ',' || chr(10) || ',"' || '{""c"":' || event_id % 7 || '}"' AS csv FROM events""".replace("'b,a.x'", "'b,a'"))
def json_to_csv(spark, sf_dir):
    """JSON arrays as delimited text, keys by first appearance."""
    j = F.concat(F.lit('[{"b":'), F.col("event_id").cast("string"), F.lit('},{"a":{"c":'), (F.col("event_id") % 7).cast("string"), F.lit("}}]"))
    return table(spark, sf_dir, "events").select("event_id", documents.to_csv(j).alias("csv"))


@query("""SELECT event_id, '{"a":{"c":2,"d":' || event_id || '},"b":[{"x":1,"y":2}]}' AS sorted FROM events""")
def sorted_keys(spark, sf_dir):
    """Keys sorted at all depths."""
    j = F.concat(F.lit('{"b": [{"y": 2, "x": 1}], "a": {"d": '), F.col("event_id").cast("string"), F.lit(', "c": 2}}'))
    return table(spark, sf_dir, "events").select("event_id", documents.key_sorted(j).alias("sorted"))


# --- more readers


def _slides(no: int, rows: pd.DataFrame) -> dict[str, bytes]:
    a = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    cell = lambda x: f"<a:tc><a:txBody><a:p><a:r><a:t>{x}</a:t></a:r></a:p></a:txBody></a:tc>"
    body = "".join(f"<a:tr>{cell(k)}{cell(n)}</a:tr>" for k, n in zip(rows["c_custkey"], rows["c_name"]))
    points = lambda values: "".join(f'<c:pt idx="{i}"><c:v>{v}</c:v></c:pt>' for i, v in enumerate(values))
    chart = f'<c:chartSpace xmlns:c="http://schemas.openxmlformats.org/drawingml/2006/chart"><c:barChart><c:ser><c:tx><c:strCache><c:pt idx="0"><c:v>S{no}</c:v></c:pt></c:strCache></c:tx><c:cat><c:strCache>{points(rows["c_name"])}</c:strCache></c:cat><c:val><c:numCache>{points(rows["c_nationkey"])}</c:numCache></c:val></c:ser></c:barChart></c:chartSpace>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("ppt/slides/slide1.xml", f"<p:sld xmlns:p='p' {a}><a:tbl>{body}</a:tbl></p:sld>")
        z.writestr("ppt/charts/chart1.xml", chart)
    return {f"{no}.pptx": out.getvalue()}


@query("SELECT 1 AS slide, row_number() OVER (PARTITION BY c_custkey // 500 ORDER BY c_custkey) - 1 AS row, c_custkey::VARCHAR AS key, c_name AS name FROM customer")
def slide_tables(spark, sf_dir):
    """Tables of presentations."""
    t = office.read_slide_tables(spark, written(_customer(spark, sf_dir), "c_custkey", _slides, "slides"))
    return t.select("slide", "row", F.get("cells", F.lit(0)).alias("key"), F.get("cells", F.lit(1)).alias("name"))


@query("SELECT 'S' || c_custkey // 500 AS name, c_name AS category, c_nationkey::DOUBLE AS value FROM customer")
def chart_series(spark, sf_dir):
    """Points of charts."""
    return office.read_charts(spark, written(_customer(spark, sf_dir), "c_custkey", _slides, "charts")).select("name", "category", "value")


def _listing(no: int, rows: pd.DataFrame) -> dict[str, bytes]:
    return {f"{no}.txt": "".join(f"Path = d/{k}.txt\nSize = {len(n)}\nPacked Size = {k % 9}\nModified = 2020-01-02 03:04:05\nFolder = {'+' if k % 4 == 0 else '-'}\n\n" for k, n in zip(rows["c_custkey"], rows["c_name"])).encode()}


@query("SELECT 'd/' || c_custkey || '.txt' AS path, length(c_name)::BIGINT AS size, c_custkey % 9 AS compressed_size, c_custkey % 4 = 0 AS is_folder FROM customer")
def listing_entries(spark, sf_dir):
    """Entries of printed archive listings."""
    return containers.read_listing(files.lines(spark, written(_customer(spark, sf_dir), "c_custkey", _listing, "listing"))).select("path", "size", "compressed_size", "is_folder")


@query("SELECT c_custkey // 500 AS file_no, 'MODULE' AS type, 'M' || c_custkey // 500 AS name, 1::BIGINT AS line FROM customer GROUP BY ALL UNION ALL SELECT c_custkey // 500, 'MEASUREMENT', 'm' || c_custkey, 2 * row_number() OVER (PARTITION BY c_custkey // 500 ORDER BY c_custkey) FROM customer")
def a2l_important(spark, sf_dir):
    """The blocks of interest of measurement descriptions."""
    found = catalogs.read_a2l(spark, written(_customer(spark, sf_dir), "c_custkey", _a2l, "a2l")).tables["important"]
    return found.select(F.regexp_extract("file", r"(\d+)\.a2l$", 1).cast("long").alias("file_no"), "type", "name", "line")


def _a2l(no: int, rows: pd.DataFrame) -> dict[str, bytes]:
    return {f"{no}.a2l": (f"/begin MODULE M{no}\n" + "".join(f"  /begin MEASUREMENT m{k}\n  /begin OTHER x\n" for k in rows["c_custkey"])).encode()}


def _dbc(no: int, rows: pd.DataFrame) -> dict[str, bytes]:
    body = "".join(f'BO_ {k + 1} M{k}: 8 N{k % 7}\n SG_ S : 0|8@1+ (1,0) [0|255] "" R{k % 5}\nCM_ SG_ {k + 1} S "of {k}";\n' for k in rows["p_partkey"])
    return {f"{no}.dbc": f'BU_: N0 N1\n{body}CM_ BU_ N1 "node of {no}";\nCM_ "file {no}";\n'.encode()}


@query("SELECT 'M' || p_partkey AS name FROM part WHERE p_partkey % 7 = 3 AND contains('of ' || p_partkey, '1')")
def dbc_filtered(spark, sf_dir):
    """Messages of a node, with a text in a signal's comment."""
    messages = catalogs.read_dbc(spark, written(_part(spark, sf_dir), "p_partkey", _dbc, "dbcf"))["messages"]
    return catalogs.dbc_filter(messages, "N3").filter(F.exists("signals", lambda s: F.contains(s["comment"], F.lit("1")))).select("name")


@query("SELECT target, count(*) AS n FROM (SELECT 'signal' AS target FROM part UNION ALL SELECT unnest(['node', 'network']) FROM (SELECT DISTINCT p_partkey // 500 FROM part)) GROUP BY target")
def dbc_comments(spark, sf_dir):
    """Comments of signals, nodes and files."""
    return catalogs.read_dbc(spark, written(_part(spark, sf_dir), "p_partkey", _dbc, "dbcc"))["comments"].groupBy("target").agg(F.count("*").alias("n"))


def _anchors(no: int, rows: pd.DataFrame) -> dict[str, bytes]:
    return {f"{no}.yaml": "".join(f"b{k}: &a{k} {{x: {k}}}\nu{k}: {{<<: *a{k}, x: 2, y: *a{k}}}\n" for k in rows["c_custkey"]).encode()}


@query("SELECT 'u' || c_custkey || '.y' AS path, 'b' || c_custkey AS alias_path FROM customer UNION ALL SELECT 'u' || c_custkey || '[\"<<\"]', 'b' || c_custkey FROM customer")
def yaml_aliases(spark, sf_dir):
    """Aliases with the path of their anchor."""
    nodes = trees.read_yaml(spark, written(_customer(spark, sf_dir), "c_custkey", _anchors, "anchors"))["nodes"]
    return nodes.filter("kind = 'alias'").select("path", "alias_path")


@query("SELECT 'u' || c_custkey || '.x' AS path FROM customer")
def yaml_overrides(spark, sf_dir):
    """Keys that stand before what a merge brings in."""
    nodes = trees.read_yaml(spark, written(_customer(spark, sf_dir), "c_custkey", _anchors, "overrides"))["nodes"]
    return nodes.filter("overrides").select("path")


def _step(no: int, rows: pd.DataFrame) -> dict[str, bytes]:
    body = "".join(f"#{k + 1} = PART('{n}',#1);\n" for k, n in zip(rows["p_partkey"], rows["p_brand"]))
    return {f"{no}.stp": f"ISO-10303-21;\nHEADER;\nFILE_NAME('n{no}, a','2020-01-01',('me'),('org'),'pre','sys','ok');\nFILE_SCHEMA(('AP214'));\nENDSEC;\n{body}".encode()}


@query("SELECT field, CASE field WHEN 'name' THEN 'n' || f || ', a' WHEN 'schema' THEN 'AP214' ELSE '2020-01-01' END AS value FROM (SELECT DISTINCT p_partkey // 500 AS f FROM part), (SELECT unnest(['name', 'schema', 'timestamp']) AS field)")
def step_header(spark, sf_dir):
    """Header fields of exchange files."""
    return catalogs.read_step(spark, written(_part(spark, sf_dir), "p_partkey", _step, "step")).tables["header"].filter("field in ('name', 'schema', 'timestamp')").select("field", "value")


# --- exports and sounds


def _one(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(text,)], "text string")


@query("SELECT string_agg(r_name, chr(10) ORDER BY r_regionkey) AS text FROM region")
def column_export(spark, sf_dir):
    """One column's cells, a line each."""
    return _one(spark, documents.column_text(table(spark, sf_dir, "region"), "r_name", "r_regionkey"))


@query("""SELECT '{' || chr(10) || '  "headers": [' || chr(10) || '    "r_name"' || chr(10) || '  ],' || chr(10) || '  "rows": [' || chr(10) || string_agg('    [' || chr(10) || '      "' || r_name || '"' || chr(10) || '    ]', ',' || chr(10) ORDER BY r_regionkey) || chr(10) || '  ],' || chr(10)
          || '  "metadata": {' || chr(10) || '    "totalRows": 7,' || chr(10) || '    "filteredRows": ' || count(*) || ',' || chr(10) || '    "columns": 1' || chr(10) || '  }' || chr(10) || '}' AS text FROM region""")
def grid_export(spark, sf_dir):
    """A grid with its headers and counts."""
    return _one(spark, documents.export_json(table(spark, sf_dir, "region"), "r_regionkey", 7))


@query("SELECT r_regionkey - 1 AS _row_index, r_regionkey::VARCHAR AS r_regionkey, r_name, '' AS \"empty\" FROM region WHERE r_regionkey > 0")
def edited_text(spark, sf_dir):
    """An edited raw text, its rows padded to the header's width."""
    region = table(spark, sf_dir, "region").filter("r_regionkey > 0").orderBy("r_regionkey").select("r_regionkey", "r_name")
    text = "r_regionkey,r_name,empty\n" + "\n".join(f"{k},{n}" for k, n in region.collect())
    return delimited.read_fixed_width(spark, text, ",")


@query("SELECT c_custkey, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 2 = 0")
def replaced_table(spark, sf_dir):
    """A table saved over the path it was read from."""
    path = files.scratch(spark, "replaced")
    table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").write.parquet(path)
    edited = spark.read.parquet(path).filter("c_custkey % 2 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1)
    versions.replace_table(edited, path)
    spark.catalog.refreshByPath(path)
    return spark.read.parquet(path)


@query("""WITH o AS (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer),
          e AS (SELECT -1::BIGINT AS c_custkey, 'new' AS c_name, -1::BIGINT AS k UNION ALL SELECT c_custkey, CASE WHEN i = 6 THEN 'set' ELSE c_name END, CASE WHEN i = 0 THEN 1000000000000 ELSE i END FROM o WHERE i NOT IN (1, 2))
          SELECT c_custkey, c_name, row_number() OVER (ORDER BY k) AS number FROM e""")
def edited_lines(spark, sf_dir):
    """A table edited by row numbers; five log rows, no other row written or numbered anew."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    lines = ordered.OrderedTable.create(customer, [grid.Key(F.col("c_custkey"))], files.scratch(spark, "lines"))
    lines.insert(0, [(-1, "new")])
    lines.delete([2, 3])
    lines.set(5, (customer.orderBy("c_custkey").offset(6).limit(1).first()[0], "set"))
    lines.move(1, lines.count() - 1)
    lines.commit()
    return grid.positions(lines.read(), [grid.Key(F.col("label"))], "number", files.scratch(spark, "numbers")).drop("label")


def _growing(share: float, no: int, rows: pd.DataFrame) -> dict[str, bytes]:
    content = "".join(f"{x}\n" for x in rows["props"]).encode()
    return {f"{no}.log": content[: int(len(content) * share)]}


@query("SELECT event_id // 500 AS file_no, props AS value, count(*) AS times FROM events GROUP BY ALL")
def tailed_lines(spark, sf_dir):
    """Files that grow between the batches of a stream, cut anywhere; each line comes once."""
    events, folder, out = table(spark, sf_dir, "events").select("event_id", "props"), None, files.scratch(spark, "tailed")
    for share in (0.3, 0.3, 0.75, 1.0):
        folder = written(events, "event_id", partial(_growing, share), "growing", folder)
        streams.sink_parquet(tail.tailed(spark, folder, 4096), f"{out}/rows", f"{out}/state").awaitTermination()
    got = spark.read.schema(tail.SCHEMA).parquet(f"{out}/rows")
    return got.groupBy(_file_no("log"), "value").agg(F.count("*").alias("times"))


@query("SELECT c_custkey, c_acctbal + 2 AS c_acctbal, 3 AS versions FROM customer WHERE c_custkey % 3 <> 0")
def saved_versions(spark, sf_dir):
    """A table saved twice over itself, by versions that appear whole."""
    saved = versions.VersionedTable(spark, files.scratch(spark, "versions"))
    saved.save(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"))
    saved.save(saved.read().withColumn("c_acctbal", F.col("c_acctbal") + 2))
    number = saved.save(saved.read().filter("c_custkey % 3 <> 0"))
    return saved.read().withColumn("versions", F.lit(number))


@query(_PACKET_SQL.replace("SELECT k || '.'", "SELECT row_number() OVER (PARTITION BY k // 500 ORDER BY k) AS no, k || '.'"))
def pcap_ranges(spark, sf_dir):
    """Captures in ranges of a few packets, numbered over the file."""
    path = written(_customer(spark, sf_dir), "c_custkey", _captures, "ranges")
    return packets.read_pcap(spark, f"{path}/*.pcap", range_bytes=8192).tables["packets"].select("no", "timestamp", "protocol", "source", "destination", "info")


@query(_PACKET_SQL.replace("SELECT k || '.' || lpad(k::VARCHAR, 6, '0') AS timestamp", "SELECT row_number() OVER (PARTITION BY k // 500 ORDER BY k) AS no, k::VARCHAR AS timestamp"))
def pcapng_ranges(spark, sf_dir):
    """Blocks in ranges; interfaces of a section hold for later ranges."""
    path = written(_customer(spark, sf_dir), "c_custkey", _captures, "blockranges")
    return packets.read_pcapng(spark, f"{path}/*.pcapng", range_bytes=8192).tables["packets"].select("no", "timestamp", "protocol", "source", "destination", "info")


@query("SELECT 'd/' || c_custkey || '.txt' AS path, repeat(c_name, 10) AS text FROM customer WHERE contains('d/' || c_custkey || '.txt', '7.t')")
def archive_entries(spark, sf_dir):
    """Contents of the entries with a term in their path, each read from its place."""
    return containers.read_entry(spark, written(_customer(spark, sf_dir), "c_custkey", _archive, "entries"), term=" 7.T ").select("path", "text")


@query("SELECT event_id // 500 AS file_no, min(frame) AS start, count(*) AS frames FROM (SELECT *, frame - row_number() OVER (PARTITION BY event_id // 500 ORDER BY frame) AS run FROM (SELECT event_id, row_number() OVER (PARTITION BY event_id // 500 ORDER BY event_id) - 1 AS frame FROM events) WHERE event_id % 100 < 7) GROUP BY 1, run")
def quiet_stretches(spark, sf_dir):
    """Silence in files that are read in ranges, stitched over their ends."""
    path = written(table(spark, sf_dir, "events").select("event_id"), "event_id", _wave, "quiet")
    return media.read_silence(spark, path, 0.065, range_frames=101).select(_file_no("wav"), "start", "frames")


@query("SELECT event_id // 500 AS file_no, ((frame + 1) * 10 - 1) // n AS bucket, max(x) AS peak FROM (SELECT event_id, trunc((event_id % 100) / 100.0 * 32767) / 32768 AS x, row_number() OVER (PARTITION BY event_id // 500 ORDER BY event_id) - 1 AS frame, count(*) OVER (PARTITION BY event_id // 500) AS n FROM events) GROUP BY 1, 2")
def range_peaks(spark, sf_dir):
    """Peaks of buckets that ranges share."""
    path = written(table(spark, sf_dir, "events").select("event_id"), "event_id", _wave, "rangepeaks")
    return media.read_peaks(spark, path, 10, range_frames=33).select(_file_no("wav"), "bucket", "peak")


@query("SELECT event_id // 10 AS \"column\", round(avg(event_id % 256))::INT AS low, round(avg(event_id * 7 % 256))::INT AS high FROM events GROUP BY 1")
def band_means(spark, sf_dir):
    """Blocks of a spectrogram's columns."""
    k = F.col("event_id")
    columns = table(spark, sf_dir, "events").select(F.lit("f").alias("file"), k.alias("column"), F.array((k % 256).cast("int"), (k * 7 % 256).cast("int")).alias("bands"))
    return media.downsample_columns(columns, 10).select("column", F.col("bands")[0].alias("low"), F.col("bands")[1].alias("high"))


@query("""SELECT user_id, min(event_id) AS start, count(*) AS frames FROM (SELECT user_id, event_id, event_id - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM events WHERE abs(value) < 20) GROUP BY user_id, run""")
def silent_runs(spark, sf_dir):
    """Runs of frames under a level."""
    samples = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("file"), F.col("event_id").alias("frame"), F.col("value").alias("sample"))
    return media.silence_runs(samples, F.lit(20.0)).select(F.col("file").cast("long").alias("user_id"), "start", "frames")


def _wave(no: int, rows: pd.DataFrame) -> dict[str, bytes]:
    return {f"{no}.wav": media.wav_bytes((rows["event_id"].to_numpy() % 100) / 100, 8000)}


@query("SELECT event_id // 500 AS file_no, 'wav' AS format, 8000 AS rate, 1 AS channels, count(*) AS frames FROM events GROUP BY 1")
def sound_info(spark, sf_dir):
    """Rate, channels and length of sounds."""
    got = media.read_audio_info(spark, written(table(spark, sf_dir, "events").select("event_id"), "event_id", _wave, "waves"))
    names = got.columns
    return got.select(_file_no("wav"), F.col(names[1]).alias("format"), F.col(names[2]).cast("int").alias("rate"), F.col(names[3]).cast("int").alias("channels"), F.col(names[5]).cast("long").alias("frames"))


@query("SELECT event_id // 500 AS file_no, row_number() OVER (PARTITION BY event_id // 500 ORDER BY event_id) - 1 AS frame, trunc((event_id % 100) / 100.0 * 32767) / 32768 AS sample FROM events")
def wave_samples(spark, sf_dir):
    """Samples written as 16-bit sound and read back."""
    got = media.read_audio(spark, written(table(spark, sf_dir, "events").select("event_id"), "event_id", _wave, "samples"))
    return got.select(_file_no("wav"), "frame", F.col("sample").cast("double").alias("sample"))
