"""Headers and listings of binary files: logs, object containers, archives, tensors, databases."""

from __future__ import annotations

import json
import sqlite3
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import hex_rows
from .archives import archive_counts, looks_binary, path_filter, read_archive, read_entry, read_entry_parts  # noqa: F401
from .files import binaries, parsed

#: Block markers of measurement files, and record kinds of robot logs.
MDF_BLOCKS = ("##HD", "##DG", "##CG", "##CN", "##TX", "##MD", "##CC", "##SI", "##DT", "##DZ")
BAG_RECORDS = (("Bag header", 3), ("Connection", 7), ("Chunk", 5), ("Index data", 4), ("Chunk info", 6), ("Message data", 2))


def little_endian(content: Column, offset: int, width: int) -> Column:
    """An unsigned little-endian number (of 8 bytes: as a long)."""
    flipped = F.reverse(F.hex(F.substring(content, offset + 1, width)))
    # reversed text has each byte's digits swapped
    return F.conv(F.regexp_replace(flipped, "(.)(.)", "$2$1"), 16, -10).cast("long")


def byte_count(content: Column, pattern: bytes) -> Column:
    """Occurrences of some bytes that don't overlap."""
    text = F.decode(content, "ISO-8859-1")
    quoted = "".join(f"\\x{b:02x}" for b in pattern)
    return (F.size(F.split(text, quoted, -1)) - 1).cast("long")


def header_dump(df: DataFrame, length: int = 256) -> DataFrame:
    """(file, offset, hex, ascii) of the first bytes."""
    return df.select("file", F.inline(hex_rows(F.substring("content", 1, length))))


def read_blf(spark: SparkSession, path: str) -> DataFrame:
    c = F.col("content")
    n = F.col("length")
    return binaries(spark, path).select("file", F.decode(F.substring(c, 1, 4), "ISO-8859-1").alias("signature"), F.when(n >= 8, little_endian(c, 4, 4)).alias("header_size"), F.when(n >= 40, little_endian(c, 32, 4)).alias("application_id"), F.when(n >= 136, little_endian(c, 128, 8)).alias("object_count"), (F.hex(F.substring(c, 1, 4)) == "4C4F4747").alias("valid"))


def read_mf4(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(headers, blocks): version and program; counts of block markers."""
    df = binaries(spark, path)
    part = lambda a, b: F.trim(F.replace(F.decode(F.substring("content", a + 1, b - a), "ISO-8859-1"), F.lit("\0"), F.lit("")))
    headers = df.select("file", part(0, 8).alias("magic"), part(8, 16).alias("version"), part(16, 24).alias("program"))
    blocks = df.select("file", F.inline(F.array(*[F.struct(F.lit(m).alias("block"), byte_count(F.col("content"), m.encode()).alias("count")) for m in MDF_BLOCKS])))
    return headers, blocks.filter("count > 0")


def read_bag(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(headers, records): first line; counts of record kinds."""
    df = binaries(spark, path)
    headers = df.select("file", F.trim(F.regexp_extract(F.decode(F.substring("content", 1, 256), "ISO-8859-1"), r"^([^\n]*)", 1)).alias("header"))
    records = df.select("file", F.inline(F.array(*[F.struct(F.lit(k).alias("record"), byte_count(F.col("content"), b"op=" + bytes([op])).alias("count")) for k, op in BAG_RECORDS])))
    return headers, records.filter("count > 0")


def _avro_metadata(data: bytes, preview: bool = False) -> Iterator[tuple]:
    if data[:4] != b"Obj\x01":
        return
    at, limit = 4, min(len(data), 64 << 10) if preview else len(data)

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value >> 1 ^ -(value & 1)
            shift += 7
            if shift > 63:
                raise ValueError("a number of over 64 bits")

    def block() -> bytes:
        nonlocal at
        n = number()
        if n < 0 or at + n > len(data):
            raise ValueError("bytes beyond the file's end")
        at += n
        return data[at - n : at]

    try:
        while at < limit and (count := number()):
            if count < 0:
                number()
                count = -count
            if preview and count > 64:
                return
            for _ in range(count):
                key, value = block().decode("utf-8", "replace"), block()
                shown = value.decode("utf-8", "replace") if all(32 <= b < 127 or b in (9, 10, 13) for b in value) else value.hex()
                if key == "avro.schema":
                    try:
                        shown = json.dumps(json.loads(value), separators=(",", ":"), ensure_ascii=False)
                    except ValueError:
                        shown = value.decode("utf-8", "replace")
                yield key, shown
    except (ValueError, IndexError):
        return


def read_avro_header(spark: SparkSession, path: str, preview: bool = False) -> DataFrame:
    """(file, key, value) of the header's map."""
    return parsed(binaries(spark, path), "content", lambda d: _avro_metadata(d, preview), "key string, value string")


def _safetensors(data: bytes) -> Iterator[tuple]:
    (n,) = struct.unpack_from("<Q", data)
    for name, t in json.loads(data[8 : 8 + n]).items():
        if name != "__metadata__":
            a, b = t["data_offsets"]
            yield name, t["dtype"], list(t["shape"]), b - a, a


def read_safetensors(spark: SparkSession, path: str) -> DataFrame:
    return parsed(binaries(spark, path), "content", _safetensors, "name string, dtype string, shape array<long>, n_bytes long, offset long")


# --- databases


def _sqlite(data: bytes) -> sqlite3.Connection:
    db = sqlite3.connect(":memory:")
    db.deserialize(data)
    db.text_factory = lambda b: b.decode("utf-8", "replace")
    return db


def _schema_rows(data: bytes) -> Iterator[tuple]:
    with _sqlite(data) as db:
        yield from db.execute("SELECT type, name, tbl_name, rootpage, sql FROM sqlite_master")


def read_sqlite_schema(spark: SparkSession, path: str) -> DataFrame:
    """(file, type, name, table, root_page, sql) of all entries."""
    return parsed(binaries(spark, path), "content", _schema_rows, "type string, name string, `table` string, root_page long, sql string")


def user_tables(schema: DataFrame) -> DataFrame:
    return schema.filter((F.col("type") == "table") & ~F.startswith("name", F.lit("sqlite_")))


def _cells(data: bytes, limit: int | None) -> Iterator[tuple]:
    shown = 24 if limit else None  # bytes of a blob
    with _sqlite(data) as db:
        for (table,) in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite\\_%' ESCAPE '\\'").fetchall():
            quoted = table.replace('"', '""')
            try:
                found = db.execute(f'SELECT rowid, * FROM "{quoted}"' + (f" LIMIT {limit}" if limit else ""))
            except sqlite3.OperationalError:  # a table without row ids
                found = db.execute(f'SELECT NULL, * FROM "{quoted}"' + (f" LIMIT {limit}" if limit else ""))
            names = [d[0] for d in found.description[1:]]
            for rowid, *values in found:
                yield table, rowid, [(n, None if v is None else f"BLOB({len(v)} bytes) {v[:shown].hex()}" + "..." * (len(v) > len(v[:shown])) if isinstance(v, bytes) else str(v), {int: "integer", float: "real", bytes: "blob", str: "text"}.get(type(v), "null")) for n, v in zip(names, values)]


def read_sqlite_rows(spark: SparkSession, path: str, preview: bool = False) -> DataFrame:
    """(file, table, rowid, cells) of all user tables; a cell is (column, value, storage)."""
    return parsed(binaries(spark, path), "content", lambda d: _cells(d, 100 if preview else None), "`table` string, rowid long, cells array<struct<column:string,value:string,storage:string>>")


def read_sqlite_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One table with its columns, typed by their storage; null stays null."""
    rows = read_sqlite_rows(spark, path).filter(F.col("table") == table)
    first = rows.select(F.inline("cells")).groupBy("column").agg(F.collect_set("storage").alias("kinds")).collect()
    kinds = {r["column"]: {k for k in r["kinds"] if k != "null"} for r in first}
    order = rows.select("cells.column").first()
    names = order[0] if order else []
    kind = lambda n: "long" if kinds[n] == {"integer"} else "double" if kinds[n] and kinds[n] <= {"integer", "real"} else "string"
    value = lambda i, n: F.get("cells", F.lit(i))["value"].cast(kind(n)).alias(n)
    return rows.select("rowid", *[value(i, n) for i, n in enumerate(names)])


def schema_hints(content: Column) -> Column:
    """CREATE statements found in the first bytes of a damaged database."""
    text = F.decode(F.substring(content, 1, 1 << 20), "ISO-8859-1")
    found = F.regexp_extract_all(text, F.lit(r"(?is)(CREATE\s+(?:TABLE|INDEX|VIEW|TRIGGER).{0,400}?)(?=\x00|$)"), F.lit(1))
    return F.slice(F.filter(F.transform(found, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"[^\x20-\x7E]+", " "), r"\s+", " "))), lambda x: x != ""), 1, 100)


# --- archives: contents are in archives.py


def read_listing(lines: DataFrame) -> DataFrame:
    """Entries of a key = value listing (file, line, text): blocks start at their Path line."""
    from pyspark.sql import Window

    pair = lines.filter(F.col("text").rlike(r"^\s*[A-Za-z ]+ = ")).select("file", "line", F.trim(F.regexp_extract("text", r"^([^=]+) = ", 1)).alias("k"), F.trim(F.regexp_extract("text", r" = (.*)$", 1)).alias("v"))
    numbered = pair.withColumn("block", F.sum((F.col("k") == "Path").cast("long")).over(Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)))
    value = lambda k: F.max(F.when(F.col("k") == k, F.col("v")))
    return numbered.groupBy("file", "block").agg(value("Path").alias("path"), value("Size").try_cast("long").alias("size"), value("Packed Size").try_cast("long").alias("compressed_size"), F.try_to_timestamp(value("Modified"), F.lit("yyyy-MM-dd HH:mm:ss")).alias("modified_at"), F.coalesce(value("Folder") == "+", F.lit(False)).alias("is_folder"))
