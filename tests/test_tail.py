"""Growing files: each line once, over appends, restarts, ranges and new files."""

import pytest

from millrace.streaming import streams, tail


def run(spark, path, out, range_bytes=tail.RANGE_BYTES):
    query = streams.sink_parquet(tail.tailed(spark, str(path), range_bytes), f"file://{out}/rows", f"file://{out}/state")
    query.awaitTermination()
    return sorted((r["file"].rsplit("/", 1)[1], r["offset"], r["value"]) for r in spark.read.schema(tail.SCHEMA).parquet(f"file://{out}/rows").collect())


def append(path, content):
    with open(path, "ab") as f:
        f.write(content)


def test_lines_come_once_when_they_are_complete(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    append(folder / "a.log", b"one\ntwo\nthr")
    assert run(spark, folder, out) == [("a.log", 0, "one"), ("a.log", 4, "two")]
    append(folder / "a.log", "ee\r\n\nfünf".encode())
    append(folder / "b.log", b"x" * 200_000 + b"\nlast")
    got = run(spark, folder, out, 1000)
    assert got[:4] == [("a.log", 0, "one"), ("a.log", 4, "two"), ("a.log", 8, "three"), ("a.log", 15, "")] and got[4:] == [("b.log", 0, "x" * 200_000)]
    assert run(spark, folder, out) == got  # nothing new
    append(folder / "a.log", b"\n")
    assert run(spark, folder, out)[4] == ("a.log", 16, "fünf")


def test_a_file_begun_anew(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    append(folder / "a.log", b"old one\nold two\n")
    run(spark, folder, out)
    (folder / "a.log").write_bytes(b"new\n")
    assert ("a.log", 0, "new") in run(spark, folder, out)


@pytest.mark.parametrize("size", [1, 2, 3, 5, 8, 13, 50, 1000])
def test_ranges_share_lines_without_loss(tmp_path, size):
    content = b"a\n\nbb\nccc\n" + b"d" * 30 + b"\n\n\ne\n"
    (tmp_path / "f").write_bytes(content + b"open")
    reader = tail.TailReader({"path": str(tmp_path), "range": str(size)})
    end = reader.latestOffset()
    assert list(end.values()) == [len(content)]
    parts = reader.partitions({}, end)
    got = [(o, v) for p in parts for _, o, v in reader.read(p)]
    assert [v for _, v in got] == content.decode().split("\n")[:-1] and all(content[o : o + len(v)] == v.encode() for o, v in got)
    assert reader.latestOffset() == end and [r for p in reader.partitions(end, end) for r in reader.read(p)] == []
