"""A save that stops at any step leaves the old table or the new one, whole."""

import pytest

from millrace.sinks import versions


class Stopped(Exception):
    pass


def stop_at(name):
    def step(now):
        if now == name:
            raise Stopped(name)

    return step


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize("name, kept", [("rows", 10), ("manifest", 10), ("switch", 10), ("done", 5)])
def test_a_stopped_save(spark, tmp_path, name, kept):
    root = f"file://{tmp_path}/t"
    table = versions.VersionedTable(spark, root)
    table.save(spark.range(10).toDF("id"))
    with pytest.raises(Stopped):
        versions.VersionedTable(spark, root, stop_at(name)).save(table.read().filter("id < 5"))
    again = versions.VersionedTable(spark, root)
    assert ids(again.read()) == list(range(kept))
    assert again.save(again.read().filter("id % 2 = 0")) == len(again.versions())
    assert ids(again.read()) == list(range(0, kept, 2))
    again.vacuum()
    assert len(again.versions()) == 1 and ids(again.read()) == list(range(0, kept, 2)) and len(list((tmp_path / "t").glob("rows-*"))) == 1


def test_versions_and_conflicts(spark, tmp_path):
    table = versions.VersionedTable(spark, f"file://{tmp_path}/t")
    with pytest.raises(FileNotFoundError):
        table.read()
    first = table.save(spark.range(3).toDF("id"))
    table.save(table.read().selectExpr("id + 1 AS id", "'x' AS note"))
    with pytest.raises(versions.SaveConflict):
        table.save(spark.range(9).toDF("id"), based_on=first)
    assert table.versions() == [1, 2] and ids(table.read()) == [1, 2, 3] and ids(table.read(1)) == [0, 1, 2]
    assert table.read().columns == ["id", "note"] and table.vacuum(keep=2) == 1
    assert table.save(spark.range(0).toDF("id")) == 3 and table.read().count() == 0


@pytest.mark.parametrize("name, kept", [("rows", 10), ("away", 10), ("in", 5), ("clear", 5)])
def test_a_stopped_swap_is_recovered(spark, tmp_path, name, kept):
    path = f"file://{tmp_path}/plain"
    versions.replace_table(spark.range(10).toDF("id"), path)
    with pytest.raises(Stopped):
        versions.replace_table(spark.read.parquet(path).filter("id < 5"), path, stop_at(name))
    versions.recover_table(spark, path)
    spark.catalog.refreshByPath(path)
    assert ids(spark.read.parquet(path)) == list(range(kept))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["plain"]
