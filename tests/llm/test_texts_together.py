"""Texts hashed together give what each gives alone; suffixes of long repeats are ordered."""

import random

import numpy as np

from millrace.llm.substring_dedup import segments, segments_of
from millrace.llm.suffix_array import suffix_array


def test_segments_of_many_texts():
    rng = random.Random(3)
    texts = [bytes(rng.choices(b"abcd ", k=rng.choice((0, 1, 99, 100, 101, 700)))) for _ in range(60)]
    texts += [b"x" * 900, b"", b"xy" * 400, texts[5], texts[5] + texts[9], b"x" * 100, b"x" * 100]
    of, *rest = segments_of(texts, 100, 40)
    for i, text in enumerate(texts):
        got = sorted(zip(*[x[of == i].tolist() for x in rest]))
        assert got == sorted(zip(*[x.tolist() for x in segments(text, 100, 40)])), i
    assert all(len(x) == 0 for x in segments_of([b"", b"ab"], 100, 40))


def test_suffixes_of_long_repeats():
    rng = np.random.default_rng(4)
    part = rng.integers(1, 5, 700)
    for text in (np.tile(part, 5), np.ones(3000), np.r_[part, 1, part, 2, part], np.tile([2, 1], 999), part[:1], part[:0]):
        t = np.r_[text, 0].astype(np.uint8)
        raw = t.tobytes()
        assert suffix_array(t).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
