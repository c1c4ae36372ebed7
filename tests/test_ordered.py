"""Edits by row number: against a list, with few rows written, over commits, reopenings and new bases."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import ordered
from millrace.operators.grid import Key


def test_labels_between_labels():
    rng = random.Random(1)
    labels = [ordered.base_label(i) for i in range(5)]
    assert labels == sorted(labels) and {len(x) for x in labels} == {ordered.WIDTH}
    for _ in range(3000):
        at = rng.choice([0, len(labels), len(labels) // 2, rng.randrange(len(labels) + 1)])
        new = ordered.between(labels[at - 1] if at else "", labels[at] if at < len(labels) else None)
        labels.insert(at, new)
    assert labels == sorted(labels) and len(set(labels)) == len(labels)
    many = ordered.spread("A", "B", 1000)
    assert many == sorted(set(many)) and len(many) == 1000 and max(map(len, many)) < 8 and "A" < many[0] and many[-1] < "B"


def rows(table):
    return [(r["n"], r["s"]) for r in table.read().orderBy("label").collect()]


def test_a_thousand_random_edits(spark, tmp_path):
    df = spark.range(500).selectExpr("id AS n", "concat('line ', id) AS s").repartition(4)
    table = ordered.OrderedTable.create(df, [Key(F.col("n"))], f"file://{tmp_path}/t", log_rows=700)
    want = [(i, f"line {i}") for i in range(500)]
    rng, named = random.Random(9), 0
    for k in range(1000):
        n = table.count()
        assert n == len(want)
        kind = rng.choice(["insert", "insert", "delete", "set", "paste"])
        if kind == "insert":
            at = rng.choice([0, n, rng.randrange(n + 1)])
            table.insert(at, [(k, "new")])
            want.insert(at, (k, "new"))
            named += 1
        elif kind == "paste":
            at, some = rng.randrange(n + 1), [(k, f"p{i}") for i in range(rng.randrange(4))]
            table.insert(at, some)
            want[at:at] = some
            named += len(some)
        elif kind == "delete" and n > 10:
            gone = {rng.randrange(n) for _ in range(3)}
            table.delete(list(gone))
            want = [r for i, r in enumerate(want) if i not in gone]
            named += len(gone)
        else:
            at = rng.randrange(n)
            table.set(at, (k, "set"))
            want[at] = (k, "set")
            named += 1
        if k % 250 == 249:
            table.commit()
            assert rows(table) == want
            table = ordered.OrderedTable(spark, f"file://{tmp_path}/t", log_rows=700) if k == 499 else table
            assert table.count() == len(want)
    assert len(table.base.versions()) > 1  # the log was folded in on the way
    assert [table.label_at(i) for i in range(len(want))] == [r["label"] for r in table.read().orderBy("label").collect()]


def test_an_edit_writes_the_rows_it_names(spark, tmp_path):
    df = spark.range(20_000).selectExpr("id AS n", "'x' AS s")
    table = ordered.OrderedTable.create(df, [Key(F.col("n"), True)], f"file://{tmp_path}/t")
    table.insert(3, [(-1, "new")])
    table.move(0, 10_000)
    table.delete([5])
    table.commit()
    assert table.written == 4 and len(table.base.versions()) == 1
    want = [19_999 - i for i in range(20_000)]
    want.insert(3, -1)
    want.insert(10_000, want.pop(0))
    del want[5]
    assert [r["n"] for r in table.read().orderBy("label").collect()] == want
    with pytest.raises(IndexError):
        table.set(50_000, (1, "x"))


def test_the_only_row_stays(spark, tmp_path):
    table = ordered.OrderedTable.create(spark.range(1).selectExpr("id AS n", "'x' AS s"), [Key(F.col("n"))], f"file://{tmp_path}/t")
    with pytest.raises(ValueError):
        table.delete([0])
    table.insert(1, [(7, None)])
    table.delete([0])
    table.commit()
    assert rows(table) == [(7, None)]
