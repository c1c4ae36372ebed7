"""Repeated strings in periodic texts: as by brute force, and in bounded time and rows."""

import hashlib
import random
import time
from collections import Counter

import numpy as np
import pytest

from millrace.llm import substring_dedup


def slow(rows, window):
    data = [(k, (t or "").encode()) for k, t in rows]
    seen = Counter(d[i : i + window] for _, d in data for i in range(len(d) - window + 1))
    out = []
    for k, d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - window + 1):
            if seen[d[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        spans = sum(1 for i in range(len(d)) if gone[i] and not (i and gone[i - 1]))
        out.append((k, len(d), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def texts(rng):
    noise = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    out = []
    for p in (1, 2, 3, 7, 16, 23, 24, 25, 39, 40, 41, 60):
        unit = noise(p)
        long = (unit * 400)[: 300 + rng.randrange(50)]
        out += [noise(30) + long + noise(30), long[rng.randrange(p + 1) :][:200] + noise(50), noise(20) + (unit * 60)[: 40 + p // 2] + noise(9), noise(5) + (unit * 9)[: 40 + 2 * p] + noise(9)]
        out.append(noise(10) + long[:150] + "!" + long[:90] + noise(10))
    return out


@pytest.mark.parametrize("group_bytes", [1 << 18, 600])
def test_periodic_texts_brute_force(spark, group_bytes):
    rows = list(enumerate(texts(random.Random(8)))) + [(900, "a" * 500), (901, "a" * 39), (902, "a" * 40), (903, "a" * 41), (904, "ab" * 21)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup.substring_dedup(df, window=40, gram=16, group_bytes=group_bytes, shard_bytes=4000)
    assert sorted((tuple(r) for r in got.collect()), key=str) == slow(rows, 40)


def test_one_periodic_text_alone(spark):
    """Its strings occur again in itself only."""
    for text in ("a" * 2000, "ab" * 1000, "x" + "ruler---+" * 300):
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        assert [tuple(r) for r in substring_dedup.substring_dedup(df, window=40, gram=16).collect()] == slow([(1, text)], 40)


def test_long_periodic_texts_are_few_segments():
    began = time.perf_counter()
    h, lo, hi, at = substring_dedup.segments(b"a" * 20_000_000)
    assert time.perf_counter() - began < 60 and len(h) < 50
    known = at < 0
    covered = np.zeros(20_000_000 - 399, bool)
    for a, b in zip(lo[known], hi[known]):
        covered[a : b + 1] = True
    assert covered.all()
