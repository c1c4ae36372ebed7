"""Small ranges and small files share tasks: their number goes by bytes and cores, not by files."""

from millrace.sources import ranges, trees
from millrace.streaming import tail


def test_small_ranges_share_tasks(spark, tmp_path):
    for i in range(90):
        (tmp_path / f"{i}.bin").write_bytes(b"x" * 1000)
    cut = ranges.cut(spark, str(tmp_path), 100)
    assert cut.count() == 900
    tasks = ranges.tasks_for(spark, cut)
    assert tasks == 2 * spark.sparkContext.defaultParallelism
    index = ranges.indexed(spark, str(tmp_path), lambda data, low, high: (low, ""), lambda data, start, high, state: (high, state, [1], False), 1, 100)
    assert index.rdd.getNumPartitions() == tasks and index.count() == 900
    large = spark.createDataFrame([("a", i, i * ranges.RANGE_BYTES, (i + 1) * ranges.RANGE_BYTES) for i in range(500)], "file string, part long, low long, high long")
    assert ranges.tasks_for(spark, large) == 500


def test_files_that_grow_share_tasks(tmp_path):
    for i in range(50):
        (tmp_path / f"{i}.log").write_text("".join(f"{i} {j}\n" for j in range(100)))
    reader = tail.TailReader({"path": str(tmp_path), "range": "256", "tasks": "4"})
    end = reader.latestOffset()
    parts = reader.partitions({}, end)
    assert 4 <= len(parts) <= 5
    got = sorted(line for p in parts for _, _, line in reader.read(p))
    assert got == sorted(f"{i} {j}" for i in range(50) for j in range(100))
    assert all(sum(r.high - r.low for r in p.parts) <= tail.RANGE_BYTES for p in parts)


def test_proto_files_are_parsed_once(spark, tmp_path, monkeypatch):
    (tmp_path / "a.proto").write_text("message A { B b = 1; }\nmessage B { int32 n = 1; }\n")
    seen = []
    put = trees._proto_table

    def counted(*a):
        df = put(*a)
        total = spark.sparkContext.accumulator(0)
        seen.append(total)

        def run(batches):
            total.add(1)
            yield from batches

        return df.mapInArrow(run, df.schema)

    monkeypatch.setattr(trees, "_proto_table", counted)
    got = {r["message"]: r["example"] for r in trees.proto_examples(spark, str(tmp_path)).collect()}
    assert got == {"A": '{"b":{"n":0}}', "B": '{"n":0}'}
    assert [x.value for x in seen] == [1]
