"""Packing: every id in one piece, sequences without gaps and padding, the program against its bounds."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import packing, queries

PATH = queries.vocabulary_path(queries.BYTE_VOCABULARY)


def check(rows, texts, capacity=1024):
    """Rows of (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) against the library's ids."""
    library = Tokenizer.from_file(PATH)
    want = Counter()
    for key, text in texts:
        want[key, tuple(library.encode(text or "", add_special_tokens=False).ids + [0])] += 1
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"], r["doc_tokens"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    left = {k: Counter((r["start"], r["length"], r["ids_crc32"]) for r in v) for k, v in by_doc.items()}
    for (key, ids), times in want.items():
        pieces = left[key, len(ids)]
        for _ in range(times):
            at = 0
            while at < len(ids):
                fits = [p for p in pieces if pieces[p] and p[0] == at and p[2] == zlib.crc32(np.array(ids[at : at + p[1]], "<u4").tobytes())]
                assert fits, (key, at)
                pieces[fits[0]] -= 1
                at += fits[0][1]
            assert at == len(ids)
    assert not any(n for c in left.values() for n in c.values())
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity and not at & (at - 1)


def test_packing_of_a_table(spark, sf):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.op12_packing(spark, sf)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    check(got.collect(), texts)


def test_odd_texts_and_a_hot_length(spark):
    hot = "one two three " * 200
    texts = [(i, hot) for i in range(60)] + [(1, None), (2, ""), (2, ""), (None, "a b"), (None, "a b"), (5, "é\u0000ß 日本語 🙂 <|endoftext|> x"), (6, " ".join(f"word{i % 977}" for i in range(120_000))), (7, "x" * 50_000), (8, "   \n\n  ")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    for c in ("start", "length", "task", "rank", "ids", "n", "offset"):
        docs = docs.withColumn(c, F.lit("clash"))
    got = packing.pack(docs, PATH)
    rows = got.collect()
    check(rows, texts)
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in rows)
    check(packing.pack(docs, PATH, capacity=64).collect(), texts, 64)
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_ids_are_those_of_the_library():
    """Each vocabulary entry, each block of code points, long runs."""
    library = Tokenizer.from_file(PATH)
    with open(PATH, encoding="utf-8") as f:
        encoder = packing.Encoder(f.read())
    texts = [library.decode([i], skip_special_tokens=False) for i in range(0, 50257, 3)]
    texts += [f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}.{chr(c)} " for c in [*range(0x3000), *range(0x3000, 0x110000, 97)] if not 0xD800 <= c < 0xE000]
    texts += [" " * 400_000 + "x", "a" * 100_000, "<|endoftext|>" * 3 + "<|endof", "it's 'S don't\r\n\n x"]
    for i in range(0, len(texts), 5000):
        for text, made in zip(texts[i : i + 5000], library.encode_batch(texts[i : i + 5000], add_special_tokens=False)):
            assert encoder.ids(text).tolist() == made.ids, text[:50]


def test_parts_of_a_text_have_the_ids_of_the_whole():
    rng, library = random.Random(2), Tokenizer.from_file(PATH)
    words = ["plain", "it's", " 's", "12", "x,", "...", "\n", "  ", " ", "日本", "<|endoftext|>", "A"]
    for _ in range(30):
        text = " ".join(rng.choice(words) for _ in range(400))
        parts = packing.spans(text, 50)
        assert len(parts) > 5 and "".join(parts) == text
        assert [i for p in parts for i in library.encode(p, add_special_tokens=False).ids] == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(4))
def test_program_is_within_its_bounds(seed):
    """The fractional solution covers the demand, between the material and first fit by falling length."""
    rng = random.Random(seed)
    demand = np.zeros(32)
    for _ in range(6):
        demand[rng.randrange(1, 32)] += rng.randrange(1, 40) * 25
    used = packing.solve(demand, gap=0.0)
    cover = sum(c * u for c, u in used)
    assert np.allclose(cover, demand) and all(u >= 0 and (np.arange(32) * c).sum() <= 32 for c, u in used)
    total = sum(u for _, u in used)
    assert total >= (np.arange(32) * demand).sum() / 32 - 1e-6
    open_ = []
    for w in range(31, 0, -1):
        for _ in range(int(demand[w])):
            i = next((i for i, room in enumerate(open_) if room >= w), None)
            if i is None:
                open_.append(32 - w)
            else:
                open_[i] -= w
    assert total <= len(open_) + 1


def test_columns_are_generated_where_greedy_filling_is_poor():
    """Halves and thirds that greedy filling from the longest mixes badly: the program finds a better mix, close to the best."""
    demand = np.zeros(1024)
    rng = random.Random(1)
    for w in range(300, 500):
        demand[w] = rng.randrange(1, 100_000)
    greedy = sum(p[1] for p in packing._first_patterns(demand))
    assert sum(u for _, u in packing.solve(demand)) < 0.97 * greedy


@pytest.mark.parametrize("histogram", [{}, {5: 1}, {1: 1000}, {700: 10, 600: 5, 500: 3, 13: 2}, {600: 100_000}, {w: 7 * w % 101 + 1 for w in range(1, 1024)}])
def test_plan_uses_each_piece_once_and_pads_nothing(histogram):
    steps = packing.plan(histogram)
    for step in steps:
        if len(step) == 2:
            total = sum(w * a for w, a in step[0].items())
            assert total <= 1024 and not total & (total - 1)
    covered, places = Counter(), Counter()
    for w, low, high, cut, piece, first, many, at, turn in packing.slots(steps, histogram):
        covered[w] += (high - low) * piece
        assert 0 <= cut and cut + piece <= w
        for rank in range(low, min(high, low + 50)):
            t = rank - low + turn
            places[first + t // many, at + t % many * piece] += 1
    assert covered == Counter({w: w * n for w, n in histogram.items()}) and all(n == 1 for n in places.values())
