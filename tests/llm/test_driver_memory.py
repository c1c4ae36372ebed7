"""What the driver holds for the pipeline: plans of the rounds, and training rows."""

import random

import numpy as np

from millrace.llm import components, quality, shared


def _least(edges):
    root = {x: x for e in edges for x in e}
    while any(root[u] != root[v] for u, v in edges):
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    return root


def _random_edges(seed, nodes, n):
    r = random.Random(seed)
    names = [r.randrange(-(1 << 63), 1 << 63) for _ in range(nodes)]
    return [tuple(r.sample(names, 2)) for _ in range(n)]


def test_stars():
    for seed in range(30):
        edges = _random_edges(seed, 80, 10 + 5 * seed)
        u, v = components.stars(*np.array(edges, np.int64).T)
        assert {(a, b) for a, b in _least(edges).items() if a != b} == set(zip(u.tolist(), v.tolist())) and len(u) == len(set(u.tolist()))
    assert not len(components.stars(np.empty(0, np.int64), np.empty(0, np.int64))[0])


def test_few_edges_need_no_rounds(spark, monkeypatch):
    written = []
    put = shared.Workspace.put
    monkeypatch.setattr(shared.Workspace, "put", lambda self, df, name, *a, **b: written.append(name) or put(self, df, name, *a, **b))
    edges = _random_edges(1, 500, 450) + [(7, 7)]
    table = spark.createDataFrame(edges, "u long, v long").repartition(20)
    got = components.connected_components(table, shared.Workspace(spark, "few"), len(edges))
    assert sorted(tuple(r) for r in got.collect()) == sorted(_least(edges[:-1]).items())
    assert written == ["edges0"]
    # more than a task's, or of unknown number: the same by rounds
    monkeypatch.setattr(components, "FILE_ROWS", 60)
    for rows in (len(edges), None):
        got = components.connected_components(table, shared.Workspace(spark, "more"), rows)
        assert sorted(tuple(r) for r in got.collect()) == sorted(_least(edges[:-1]).items())
    assert len(written) > 3


def test_training_rows_are_few_arrays(spark, monkeypatch):
    texts = ["", *[" ".join(random.Random(i).choices("red green blue, one two. Three four five six".split(), k=i % 40 + 1)) for i in range(300)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(texts))], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality.FactorisationMachine, "fit", lambda self, rows, y: seen.append((rows, y)) or self)
    quality.fit_quality(docs, labels)
    (rows, y), make = seen[0], quality.Featurizer()
    want = sorted((np.asarray(a, np.int32).tobytes(), np.asarray(b, np.float32).tobytes(), i % 2) for i, (a, b) in enumerate(map(make, texts)))
    assert [(a.astype(np.int32).tobytes(), b.astype(np.float32).tobytes(), int(c)) for (a, b), c in zip(rows, y)] == want
    assert {(a.dtype, b.dtype) for a, b in rows} == {(np.dtype(np.int64), np.dtype(np.float64))} and y.dtype == float
    assert len({id(x[k].base) for x in rows for k in (0, 1)}) == 2
