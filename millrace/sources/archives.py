"""Archives by ranges: a directory from a file's tail, an entry from its offset.

Listing a ZIP file reads its end and its central directory, nothing else. What is
wanted is chosen in the listing; then each entry is read on its own from where it
starts, so that the entries of one archive are spread over tasks. TAR files are
walked from header to header. Compressed TAR files and single compressed files
have no such places: they are streamed, one file a task.
"""

from __future__ import annotations

import bz2
import lzma
import os
import struct
import tarfile
import zlib
from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranges import Bytes, listed, mapped, open_file

#: How long a ZIP file's comment may be; the signatures of its records.
COMMENT = 0xFFFF
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
ENTRY_BYTES, ENTRY_TEXT = 512 << 10, 64 << 10
BINARY_SAMPLE = 8 << 10
#: Bytes of an entry in one row of ``read_entry_parts``, and of a file read at once.
PART, BUFFER = 16 << 20, 1 << 20
STORED, DEFLATED, BZIPPED = 0, 8, 12

_ENTRY = "file string, path string, kind string, compressed_size long, size long, modified_at timestamp, method int, flags int, crc long, offset long"


def _stamp(day: int, time: int) -> datetime | None:
    try:
        return datetime((day >> 9) + 1980, day >> 5 & 15, day & 31, time >> 11, time >> 5 & 63, (time & 31) * 2)
    except ValueError:
        return None


def _wide(extra: bytes, values: list[int]) -> list[int]:
    """Sizes and offset with those that say all ones taken from the extra field of large files."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<2H", extra, at)
        if kind == 1:
            wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
            return [next(wide, v) if v == 0xFFFFFFFF else v for v in values]
        at += 4 + n
    return values


def zip_entries(data: Bytes) -> Iterator[tuple]:
    """(path, kind, compressed_size, size, modified_at, method, flags, crc, offset) of a ZIP file's entries."""
    low = max(0, data.length - 22 - COMMENT - 20)
    tail = data.get(low, data.length - low)
    end = len(tail) - 22
    while end >= 0 and not (tail[end : end + 4] == END and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] == len(tail)):
        end -= 1  # a comment may have the signature in it
    if end < 0:
        return
    many, size, start = struct.unpack_from("<H2I", tail, end + 10)
    place = low + end
    if end >= 20 and tail[end - 20 : end - 16] == LOCATOR64:
        (at,) = struct.unpack_from("<Q", tail, end - 12)
        record = data.get(at, 56)
        if record[:4] == END64:
            many, size, start = struct.unpack_from("<3Q", record, 32)
            place = at
    shift = place - size - start  # bytes before the archive's own first one
    at = start + shift
    for _ in range(many):
        head = data.get(at, 46)
        if len(head) < 46 or head[:4] != CENTRAL:
            return
        flags, method, time, day, crc, packed, whole, n_name, n_extra, n_comment = struct.unpack_from("<4H3I3H", head, 8)
        (offset,) = struct.unpack_from("<I", head, 42)
        rest = data.get(at + 46, n_name + n_extra)
        name = rest[:n_name].decode("utf-8" if flags & 0x800 else "cp437", "replace")
        whole, packed, offset = _wide(rest[n_name:], [whole, packed, offset])
        yield name, "directory" if name.endswith("/") else "file", packed, whole, _stamp(day, time), method, flags, crc, offset + shift
        at += 46 + n_name + n_extra + n_comment


def _unpacker(head: bytes):
    """A decompressor for a single compressed file."""
    return zlib.decompressobj(31) if head[:2] == b"\x1f\x8b" else bz2.BZ2Decompressor() if head[:3] == b"BZh" else lzma.LZMADecompressor() if head[:6] == b"\xfd7zXZ\0" else None


def _unpacked(path: str) -> Iterator[bytes]:
    """A compressed file's content, members that follow each other included."""
    with open_file(path) as handle:
        held = handle.read(BUFFER)
        while held:
            unpacker = _unpacker(held)
            if unpacker is None:
                return
            while True:
                yield unpacker.decompress(held)
                if unpacker.eof:
                    held = unpacker.unused_data or handle.read(BUFFER)
                    break
                held = handle.read(BUFFER)
                if not held:
                    return


def _single_name(data: Bytes, base: str) -> str:
    """The name in a GZIP header, else the file's without its ending."""
    head = data.get(0, 4096)
    if head[:2] == b"\x1f\x8b" and head[3] & 8:
        start = 10 + (2 + struct.unpack_from("<H", head, 10)[0] if head[3] & 4 else 0)
        return head[start : head.index(b"\0", start)].decode("latin-1")
    return base.rsplit(".", 1)[0]


def entries(path: str) -> Iterator[tuple]:
    """``_ENTRY`` without the file; the offset is that of the content and null where there is none to seek to."""
    with Bytes(path, BUFFER) as data:
        if data.get(0, 4) == LOCAL or data.get(0, 4) == END:
            yield from zip_entries(data)
            return
        try:
            with open_file(path) as handle, tarfile.open(fileobj=handle, mode="r:*") as tar:
                plain = data.get(257, 5) == b"ustar"
                for m in tar:
                    yield m.name, "directory" if m.isdir() else "file", None, m.size, datetime.fromtimestamp(m.mtime), STORED if plain else None, 0, None, m.offset_data if plain else None
                return
        except tarfile.TarError:
            pass
        if _unpacker(data.get(0, 6)):
            yield _single_name(data, os.path.basename(path)), "file", data.length, sum(map(len, _unpacked(path))), None, None, 0, None, None


def listing(spark: SparkSession, path: str, term: str | None = None, entry: str | None = None) -> DataFrame:
    """Entries with the places of their contents; those with a term in their path, or of one path, if given."""

    def of_file(row: dict) -> Iterator[tuple]:
        for e in entries(row["file"]):
            if (entry is None or e[0] == entry) and (not term or term.strip().lower() in e[0].lower()):
                yield row["file"], *e

    return mapped(listed(spark, path), of_file, _ENTRY)


def read_archive(spark: SparkSession, path: str, sort: bool = True) -> DataFrame:
    """(file, path, kind, compressed_size, size, modified_at) of all entries, in dictionary order."""
    out = listing(spark, path).select("file", "path", "kind", "compressed_size", "size", "modified_at")
    return out.orderBy("file", F.collate("path", "UNICODE"), "path") if sort else out


def _zip_content(data: Bytes, row: dict) -> Iterator[bytes]:
    if row["flags"] & 1:
        raise ValueError("encrypted")
    head = data.get(row["offset"], 30)
    if head[:4] != LOCAL:
        raise ValueError("no entry at its offset")
    n_name, n_extra = struct.unpack_from("<2H", head, 26)
    at, left = row["offset"] + 30 + n_name + n_extra, row["compressed_size"]
    makers = {STORED: lambda: None, DEFLATED: lambda: zlib.decompressobj(-15), BZIPPED: bz2.BZ2Decompressor}
    if row["method"] not in makers:
        raise ValueError(f"compression method {row['method']}")
    unpacker, crc = makers[row["method"]](), 0
    while left:
        part = data.get(at, min(BUFFER, left))
        if not part:
            raise ValueError("truncated")
        at, left = at + len(part), left - len(part)
        content = part if unpacker is None else unpacker.decompress(part)
        crc = zlib.crc32(content, crc)
        yield content
    if row["method"] == DEFLATED and (rest := unpacker.flush()):
        crc = zlib.crc32(rest, crc)
        yield rest
    if crc != row["crc"]:
        raise ValueError("the checksum differs")


def _content(row: dict) -> Iterator[bytes]:
    """The content of an entry in pieces."""
    if row["offset"] is None:
        with Bytes(row["file"], BUFFER) as data:
            if row["compressed_size"] is not None and _unpacker(data.get(0, 6)):
                yield from _unpacked(row["file"])
                return
        with open_file(row["file"]) as handle, tarfile.open(fileobj=handle, mode="r:*") as tar:
            for m in tar:
                if m.name == row["path"] and m.isfile() and m.size == row["size"]:
                    stream = tar.extractfile(m)
                    while part := stream.read(BUFFER):
                        yield part
                    return
        return
    with Bytes(row["file"], BUFFER) as data:
        if row["crc"] is not None:
            yield from _zip_content(data, row)
            return
        at, left = row["offset"], row["size"]
        while left:
            part = data.get(at, min(BUFFER, left))
            if not part:
                raise ValueError("truncated")
            at, left = at + len(part), left - len(part)
            yield part


def _spread(wanted: DataFrame) -> DataFrame:
    """Entries dealt over tasks, by number: rows of a few bytes stand for contents of any size, so that coalescing by size would put them together."""
    many = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return wanted.filter("kind = 'file'").repartition(many, "file", "path", "offset")


def read_entry_parts(spark: SparkSession, path: str, term: str | None = None, entry: str | None = None) -> DataFrame:
    """(file, path, part, content, problem): contents of any size in parts of 16 MiB, numbered from 0.

    An entry that can't be read has a last part with the problem. An empty one has
    one empty part. Of equal paths in one archive each is read.
    """

    def parts(row: dict) -> Iterator[tuple]:
        held, size, part = [], 0, 0
        try:
            for piece in _content(row):
                held.append(piece)
                size += len(piece)
                if size >= PART:
                    yield row["file"], row["path"], part, b"".join(held), None
                    held, size, part = [], 0, part + 1
        except (ValueError, zlib.error, OSError, lzma.LZMAError, EOFError) as e:
            yield row["file"], row["path"], part, b"".join(held), str(e)
            return
        if held or part == 0:
            yield row["file"], row["path"], part, b"".join(held), None

    return mapped(_spread(listing(spark, path, term, entry)), parts, "file string, path string, part long, content binary, problem string")


def looks_binary(data: bytes) -> bool:
    """A zero byte, or over 2 in 100 control characters, in the first 8 KiB."""
    sample = data[:BINARY_SAMPLE]
    if not sample:
        return False
    control = sum(b < 7 or 13 < b < 32 for b in sample)
    return 0 in sample or control / len(sample) > 0.02


def entry_text(content: bytes, preview: bool = False) -> str | None:
    """Text of an entry; Android's binary XML is decoded, other binary content has none."""
    from .android import decode_binary_xml

    if preview and len(content) > ENTRY_BYTES:
        return None
    if content[:4] == b"\x03\x00\x08\x00":
        return decode_binary_xml(content)
    return None if looks_binary(content) else content[: ENTRY_TEXT if preview else None].decode("utf-8", "replace")


def read_entry(spark: SparkSession, path: str, entry: str | None = None, preview: bool = False, term: str | None = None) -> DataFrame:
    """(file, path, text) of entries of one path, or with a term in theirs; null for binary content and what can't be read."""

    def text(row: dict) -> Iterator[tuple]:
        if preview and (row["size"] or 0) > ENTRY_BYTES:
            yield row["file"], row["path"], None
            return
        try:
            content = b"".join(_content(row))
        except (ValueError, zlib.error, OSError, lzma.LZMAError, EOFError):
            yield row["file"], row["path"], None
            return
        yield row["file"], row["path"], entry_text(content, preview)

    return mapped(_spread(listing(spark, path, term, entry)), text, "file string, path string, text string")


def archive_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("file").agg(F.count("*").alias("total"), F.count_if(F.col("kind") == "file").alias("files"), F.count_if(F.col("kind") == "directory").alias("directories"))


def path_filter(entries: DataFrame, term: str) -> DataFrame:
    return entries.filter(_has(F.col("path"), term))


def _has(path: Column, term: str) -> Column:
    return F.contains(F.lower(path), F.lit(term.strip().lower()))
