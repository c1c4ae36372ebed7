"""Working tables whose number of rows is known are few files, whatever the shuffle partitions."""

import os
import random
from urllib.parse import urlparse

from millrace.llm import shared, simhash
from millrace.llm.components import connected_components


def _files(work, name):
    return [f for f in os.listdir(urlparse(work.path(name)).path) if f.endswith(".parquet")]


def test_known_rows_are_few_files(spark):
    work = shared.Workspace(spark, "small")
    wide = spark.range(5000).selectExpr("id % 700 AS u").repartition(40)
    assert work.put(wide, "few", rows=700).count() == 5000
    assert len(_files(work, "few")) == 1
    assert work.put(wide, "more", rows=3 * shared.FILE_ROWS - 1).count() == 5000
    assert len(_files(work, "more")) == 3
    assert work.put(spark.range(0), "none", rows=0).count() == 0


def test_rounds_of_a_small_graph_are_few_files(spark, monkeypatch):
    written = []
    put = shared.Workspace.put

    def noted(self, df, name, *a, **b):
        out = put(self, df, name, *a, **b)
        written.append((name, len(_files(self, name))))
        return out

    monkeypatch.setattr(shared.Workspace, "put", noted)
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "u long, v long").repartition(20)
    got = connected_components(edges, shared.Workspace(spark, "graph"), 60)
    assert {tuple(r) for r in got.collect()} == {(i, 0) for i in range(61)}
    assert max(n for name, n in written if name.startswith("edges")) == 1

    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        text = random.Random(i // 3).choices(words, k=90)
        text[i % 3 * 30] = f"own{i}"
        rows.append((i, " ".join(text)))
    written.clear()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(20)
    assert sorted(r[0] for r in simhash.keep_similar_representatives(docs).select("doc_id").collect()) == list(range(0, 60, 3))
    assert max(n for name, n in written if name.startswith("star-") or name == "owners") == 1
