"""Spelling variants against a version that compares all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm import spelling

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def slow_variants(rows, min_length=6, min_count=5, ratio=5):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            if h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    known = {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        less = lambda t: [t[:i] + "?" * (len(a) == len(b)) + t[i + 1 :] for i in range(len(t))]
        return a != b and (a in less(b) if len(a) < len(b) else any(x == y for x, y in zip(less(a), less(b))))

    neighbours = {w: [x for x in known if abs(len(x) - len(w)) < 2 and near(w, x)] for w in known}
    form = {}
    for w in known:
        best = min(neighbours[w], key=lambda x: (-known[x], x), default=None)
        form[w] = best if best is not None and known[best] >= ratio * known[w] else None
    out = set()
    for w in known:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, known[w], len(neighbours[w]), known[form[w]] if form[w] else None))
    return out


def mangled(rng):
    base = ["abcabcab", "abcabc", "abcabcabc", "aaaaaa", "aaaaaaa", "aaaaaaaa", "banana", "bananas", "Üngeheuer", "abcdefgh", "abcdefgi"]
    for key in range(300):
        words = []
        for _ in range(60):
            word = rng.choice(base)
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                at, kind, c = rng.randrange(len(word) + 1), rng.randrange(3), rng.choice("abcé")
                word = word[:at] + (c if kind != 1 else "") + word[at + (kind > 0) :]
            words.append(word if rng.random() < 0.9 else word.upper())
        yield key, " ".join(words)


@pytest.mark.parametrize("half_owners, shard_rows", [(5_000, 40_000), (2, 50)])
def test_variants_brute_force(spark, half_owners, shard_rows):
    rows = list(mangled(random.Random(3)))
    rows += [(None, rows[0][1]), (5, None), (6, ""), (7, rows[1][1]), (7, rows[1][1]), (8, "12 ×÷ 34 ."), (9, "bananna " * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("word", "n", "id", "shard", "half", "root", "form"):
        docs = docs.withColumn(c, F.lit("clash"))
    got = [tuple(r[c] for c in COLUMNS) for r in spelling.spelling_variants(docs, half_owners=half_owners, shard_rows=shard_rows).collect()]
    want = slow_variants(rows)
    assert len(got) == len(set(got)) and set(got) == want
    assert any(r[1] for r in want) and any(r[1] != r[2] for r in want if r[1])


def test_variants_of_a_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = {tuple(r[c] for c in COLUMNS) for r in spelling.spelling_variants(docs, min_count=20).collect()}
    assert got == slow_variants(docs.collect(), min_count=20)


def test_no_words(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a bc"), (None, None)], "doc_id long, text string")
    assert spelling.spelling_variants(docs).count() == 0 and spelling.spelling_variants(docs.limit(0)).count() == 0


def test_chain_of_forms(spark):
    """Roots are found over chains of more than one step."""
    n = [("abcdef", 3125), ("abcdeg", 625), ("abcdhg", 125), ("abcihg", 25), ("abjihg", 5)]
    docs = spark.createDataFrame([(i, " ".join([w] * k)) for i, (w, k) in enumerate(n)], "doc_id long, text string")
    got = {r["word"]: r for r in spelling.spelling_variants(docs).collect()}
    assert {r["root"] for r in got.values()} == {"abcdef"} and got["abjihg"]["form"] == "abcihg" and got["abcdef"]["form"] is None


def test_one_long_run(spark):
    word = "ab" * 50_000
    docs = spark.createDataFrame([(i, word + ("x" if i > 5 else "")) for i in range(30)], "doc_id long, text string")
    got = {len(r["word"]): r for r in spelling.spelling_variants(docs).collect()}
    assert got[100_000]["n"] == 6 and got[100_001]["n_near"] == 1
