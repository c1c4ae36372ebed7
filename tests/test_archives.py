"""Archives by ranges: what is read, how it is spread, large and odd archives."""

import bz2
import gzip
import io
import lzma
import random
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.sources import archives
from millrace.sources.ranges import Bytes


def noise(n, seed):
    return random.Random(seed).randbytes(n)


def test_listing_reads_the_tail_only(tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        for i in range(40):
            z.writestr(f"d/{i}.bin", noise(100_000, i))
    with Bytes(str(path), 1000) as data:
        got = list(archives.zip_entries(data))
        assert len(got) == 40 and data.read < 80_000 < data.length
        row = dict(zip([c.split()[0] for c in archives._ENTRY.split(", ")], (str(path), *got[17])))
    with Bytes(str(path), 1000) as data:
        assert b"".join(archives._zip_content(data, row)) == noise(100_000, 17) and data.read < 110_000


def test_entries_of_one_archive_are_spread(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(60):
            z.writestr(f"d/{i}.txt", f"text {i}\n" * 1000)
        z.writestr("other.md", "x")
        z.mkdir("d/sub")
    got = archives.read_entry(spark, str(tmp_path / "a.zip"), term=" .TXT ").withColumn("task", F.spark_partition_id()).collect()
    assert {r["path"]: r["text"] for r in got} == {f"d/{i}.txt": f"text {i}\n" * 1000 for i in range(60)}
    assert len({r["task"] for r in got}) > 1
    assert archives.archive_counts(archives.read_archive(spark, str(tmp_path / "a.zip"))).first()[1:] == (62, 61, 1)


def test_large_file_records(spark, tmp_path, monkeypatch):
    """More entries than 16 bits count, and sizes in extra fields."""
    with zipfile.ZipFile(tmp_path / "many.zip", "w") as z:
        for i in range(66_000):
            z.writestr(f"{i}", str(i))
    assert archives.read_archive(spark, str(tmp_path / "many.zip"), sort=False).count() == 66_000
    assert archives.read_entry(spark, str(tmp_path / "many.zip"), "65999").first()["text"] == "65999"
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 50)
    with zipfile.ZipFile(tmp_path / "wide.zip", "w") as z:
        for i in range(5):
            z.writestr(f"{i}.txt", f"{i}" * 200)
    got = archives.read_archive(spark, str(tmp_path / "wide.zip")).collect()
    assert [r["size"] for r in got] == [200] * 5
    assert archives.read_entry(spark, str(tmp_path / "wide.zip"), "3.txt").first()["text"] == "3" * 200


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA])
def test_methods_prefixes_and_damage(spark, tmp_path, method):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        z.writestr("é.txt", "héllo " * 500)
        z.writestr("empty", b"")
        z.writestr("bin", bytes(100))
        z.comment = b"PK\5\6 in a comment, too short to be one"[:15]
    (tmp_path / "a.zip").write_bytes(out.getvalue())
    (tmp_path / "b.zip").write_bytes(b"#!/bin/sh\n" + out.getvalue())
    read = lambda name, entry: archives.read_entry(spark, str(tmp_path / name), entry).first()["text"]
    assert read("a.zip", "é.txt") == (None if method == zipfile.ZIP_LZMA else "héllo " * 500)
    assert read("a.zip", "empty") == "" or method == zipfile.ZIP_LZMA
    assert read("a.zip", "bin") is None
    assert archives.read_entry(spark, str(tmp_path / "a.zip"), "missing").count() == 0
    with Bytes(str(tmp_path / "b.zip")) as data:
        assert [e[0] for e in archives.zip_entries(data)] == ["é.txt", "empty", "bin"]
    damaged = bytearray(out.getvalue())
    damaged[60] ^= 255
    (tmp_path / "c.zip").write_bytes(bytes(damaged))
    last = archives.read_entry_parts(spark, str(tmp_path / "c.zip"), entry="é.txt").first()
    assert last["problem"] and read("c.zip", "é.txt") is None
    (tmp_path / "d.zip").write_bytes(b"PK\3\4 but no directory")
    assert archives.read_archive(spark, str(tmp_path / "d.zip")).count() == 0


def test_parts_of_long_entries(spark, tmp_path, monkeypatch):
    content = noise(40 << 20, 5)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("long", content)
        z.writestr("empty", b"")
    parts = archives.read_entry_parts(spark, str(tmp_path / "a.zip")).collect()
    long = sorted((r["part"], bytes(r["content"])) for r in parts if r["path"] == "long")
    assert len(long) == 3 and b"".join(c for _, c in long) == content
    assert [(r["part"], bytes(r["content"])) for r in parts if r["path"] == "empty"] == [(0, b"")]


@pytest.mark.parametrize("ending, mode", [("tar", "w"), ("tgz", "w:gz"), ("tbz2", "w:bz2"), ("txz", "w:xz")])
def test_tar(spark, tmp_path, ending, mode):
    with tarfile.open(tmp_path / f"a.{ending}", mode) as t:
        for i in range(5):
            info = tarfile.TarInfo(f"d/{i}.txt")
            info.size = 1000 + i
            t.addfile(info, io.BytesIO(f"{i}".encode() * info.size))
        folder = tarfile.TarInfo("d")
        folder.type = tarfile.DIRTYPE
        t.addfile(folder)
    path = str(tmp_path / f"a.{ending}")
    assert [(r["path"], r["kind"], r["size"]) for r in archives.read_archive(spark, path).collect()] == [("d", "directory", 0)] + [(f"d/{i}.txt", "file", 1000 + i) for i in range(5)]
    assert archives.read_entry(spark, path, "d/3.txt").first()["text"] == "3" * 1003


@pytest.mark.parametrize("ending, pack", [("gz", gzip.compress), ("bz2", bz2.compress), ("xz", lzma.compress)])
def test_single_files(spark, tmp_path, ending, pack):
    """Of several members in a row, too."""
    (tmp_path / f"n.txt.{ending}").write_bytes(pack(b"abc" * 1000) + pack(b"def"))
    row = archives.read_archive(spark, str(tmp_path / f"n.txt.{ending}")).first()
    assert (row["path"], row["size"]) == ("n.txt", 3003)
    assert archives.read_entry(spark, str(tmp_path / f"n.txt.{ending}"), "n.txt").first()["text"] == "abc" * 1000 + "def"
