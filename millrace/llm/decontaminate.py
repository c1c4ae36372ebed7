"""Benchmark decontamination with spaced seeds, in DataFrame functions only.

Fixed masks pick five words out of a few consecutive ones and ignore the rest.
The hashes of the benchmark's masked words are broadcast and the documents'
are looked up in them; around a hit the words of document and item are compared
one by one, so that substituted words don't hide a passage.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, unused

#: Positions that each mask keeps. With the three of them, two substitutions anywhere in
#: 13 words leave a hit.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 3, 4, 5), (0, 1, 2, 4, 7))
#: Further masks for items below ``WINDOW`` words: the substitutions that such an item may have leave a hit.
SHORT_MASKS = ((0, 1, 2, 3), (0, 2, 3, 4), (0, 1, 2, 4), (0, 1, 3, 4))
#: Items of fewer words are looked for as a whole, and only if ``short_items`` is set.
LEAST_WORDS = 5
WINDOW = 13
SIMILARITY = 0.8
#: Seeds (about 40 bytes each) and bytes of items that are broadcast at once; a larger benchmark is
#: searched in blocks, each of which reads the documents once more.
BLOCK_SEEDS = 1_000_000
BLOCK_BYTES = 32 << 20


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits; null has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _seed(words: Column, at: Column, number: int, mask: tuple[int, ...]) -> Column:
    return F.xxhash64(F.lit(number), *[F.get(words, at + o) for o in mask])


def _positions(words: Column, least: int) -> Column:
    n = F.size(words)
    return F.when(n >= least, F.sequence(F.lit(0), n - least)).otherwise(F.array().cast("array<int>"))


def _sized(masks: tuple[tuple[int, ...], ...], short_masks: tuple[tuple[int, ...], ...], window: int, lengths: list[int]) -> list[tuple[tuple[int, ...], int, int | None]]:
    """(mask, least and most words of the items it is for), for items of these lengths up to ``window``."""
    few = [((*range(n),), n, n) for n in lengths if n < LEAST_WORDS]
    short = [(m, LEAST_WORDS, window - 1) for m in short_masks] if any(LEAST_WORDS <= n < window for n in lengths) else []
    return [*[(m, LEAST_WORDS, None) for m in masks], *short, *few]


def _seeds(items: DataFrame, sized: list[tuple[tuple[int, ...], int, int | None]]) -> DataFrame:
    """(key, item_no, j, previous): the masked words of each item from word j on."""
    parts = []
    for number, (mask, low, high) in enumerate(sized):
        fit = (F.size("item_words") >= low) & (F.lit(True) if high is None else F.size("item_words") <= high)
        at = items.filter(fit).select("item_no", "item_words", F.explode(_positions(F.col("item_words"), mask[-1] + 1)).alias("j"))
        parts.append(at.select(_seed(F.col("item_words"), F.col("j"), number, mask).alias("key"), "item_no", "j", F.lit(number).alias("mask"), F.when(F.col("j") > 0, _seed(F.col("item_words"), F.col("j") - 1, number, mask)).alias("previous")))
    return reduce(DataFrame.unionByName, parts)


def _hits(docs: DataFrame, items: DataFrame, seeds: DataFrame, masks: tuple[tuple[int, ...], ...], window: int, similarity: float) -> DataFrame:
    words, i = F.col("words"), F.col("i")
    keys = F.explode(F.array(*[F.struct(_seed(words, i, n, m).alias("key"), F.lit(n).alias("m")) for n, m in enumerate(masks)]))
    looked = docs.select("id", "mark", "words", F.explode(_positions(words, min(m[-1] for m in masks) + 1)).alias("i")).select("id", "mark", "words", "i", keys.alias("k"))
    found = looked.join(F.broadcast(seeds), looked["k.key"] == seeds["key"])
    # of hits one after the other on a diagonal the first is enough
    before = reduce(lambda rest, nm: F.when(F.col("mask") == nm[0], _seed(words, i - 1, *nm)).otherwise(rest), enumerate(masks), F.lit(None).cast("long"))
    found = found.filter((i == 0) | F.col("previous").isNull() | (before != F.col("previous")))
    found = found.select("id", "mark", "item_no", (i - F.col("j")).alias("shift"), "words").join(F.broadcast(items), "item_no")
    first = F.greatest(F.lit(0), -F.col("shift"))
    last = F.least(F.size("item_words"), F.size("words") - F.col("shift"))
    same = F.zip_with(F.slice("words", F.col("shift") + first + 1, last - first), F.slice("item_words", first + 1, last - first), lambda x, y: (x == y).cast("int"))
    found = found.select("id", "mark", "item_no", "item_id", "shift", F.size("item_words").alias("n_item_words"), same.alias("same"))
    span = F.least(F.lit(window), F.col("n_item_words"))
    equal = lambda p: F.aggregate(F.slice("same", p + 1, span), F.lit(0), lambda a, x: a + x)
    best = F.when(F.size("same") >= span, F.array_max(F.transform(F.sequence(F.lit(0), F.size("same") - span), equal)))
    found = found.select("*", span.alias("span"), best.alias("best"))
    total = F.aggregate("same", F.lit(0), lambda a, x: a + x)
    return found.filter(F.col("best") >= F.ceil(F.col("span") * similarity)).select("id", "mark", "item_no", "item_id", "n_item_words", F.col("best").alias("window_equal"), F.col("span").alias("window_words"), total.alias("equal_words"), F.greatest(F.lit(0), F.col("shift")).alias("first_word"))


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", masks: tuple[tuple[int, ...], ...] = MASKS, window: int = WINDOW, similarity: float = SIMILARITY, block_seeds: int = BLOCK_SEEDS, mark: Column | None = None, short_masks: tuple[tuple[int, ...], ...] = SHORT_MASKS, short_items: bool = False) -> DataFrame:
    """One row per document and benchmark item found in it: ``id_col, item_col,
    equal_words, n_item_words, window_equal, window_words, first_word``.

    An item is found where ``window`` words side by side (all, of a shorter
    item) agree in ``similarity`` of their places; case and punctuation don't
    count. Items of fewer than five words are looked for, all words alike, with
    ``short_items`` only. Null texts have no words, null ids are returned as such, rows of one id are
    reported together, and other columns are ignored. ``mark`` is a further
    column of ``docs`` that tells rows of one id apart.
    """
    items = benchmark.select(F.col(f"`{item_col}`").alias("item_id"), words_of(F.col(f"`{item_text_col}`")).alias("item_words"))
    items = items.filter(F.size("item_words") >= (1 if short_items else LEAST_WORDS)).distinct()
    items = items.select(F.xxhash64("item_id", "item_words").alias("item_no"), "item_id", "item_words")
    n = F.size("item_words")
    count, size, lengths = items.agg(F.sum(n), F.sum(F.octet_length(F.array_join("item_words", " ")).cast("long")), F.collect_set(F.when(n < window, n))).first()
    sized = _sized(masks, short_masks, window, sorted(lengths))
    masks = tuple(m for m, _, _ in sized)
    blocks = max(1, math.ceil((count or 0) * len(masks) / block_seeds), math.ceil((size or 0) / BLOCK_BYTES))
    base = docs.select(F.col(f"`{id_col}`").alias("id"), (mark if mark is not None else F.lit(0)).alias("mark"), words_of(F.col(f"`{text_col}`")).alias("words"))
    parts = []
    for block in range(blocks):
        some = items.filter(F.pmod("item_no", F.lit(blocks)) == block) if blocks > 1 else items
        parts.append(_hits(base, some, _seeds(some, sized), masks, window, similarity))
    found = reduce(DataFrame.unionByName, parts)
    best = F.max(F.struct("equal_words", "window_equal", "window_words", "n_item_words", (-F.col("first_word")).alias("before")))
    found = found.groupBy("id", "mark", "item_id").agg(best.alias("b"))
    return found.select(F.col("id").alias(id_col), F.col("item_id").alias(item_col), F.col("b.equal_words").cast("long").alias("equal_words"), F.col("b.n_item_words").cast("long").alias("n_item_words"), F.col("b.window_equal").cast("long").alias("window_equal"), F.col("b.window_words").cast("long").alias("window_words"), (-F.col("b.before")).cast("long").alias("first_word"), *(["mark"] if mark is not None else []))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, in whose text no benchmark item is found.

    Null and empty texts stay, as do null ids without a hit; rows equal in id and
    text stay or go together; texts of any length are searched whole; columns of
    any name are kept; an empty benchmark takes nothing out, an empty table gives
    no rows.
    """
    work = Workspace(docs.sparkSession, "decontaminate")
    mark = F.xxhash64(F.col(f"`{text_col}`"))
    found = contamination(docs, benchmark, id_col=id_col, text_col=text_col, mark=mark, **options)
    hit_id, hit_mark = unused(docs.columns, "_hit_id", "_hit_mark")
    found = work.put(found.select(F.col(f"`{id_col}`").alias(hit_id), F.col("mark").alias(hit_mark)).distinct(), "hits")
    return docs.join(found, docs[f"`{id_col}`"].eqNullSafe(found[hit_id]) & (mark == found[hit_mark]), "left_anti")
