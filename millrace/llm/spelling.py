"""Spelling variants of words: near words found by Aho-Corasick automata over word halves.

A word within one edit of another has at least one of the other's two halves in
it untouched: the first half at its start or the second half at its end. Automata
over the halves are sharded by a hash of the half, every word is scanned by the
shards that its possible halves fall in, and what an automaton reports is checked
for offset and length before the distance is verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, shuffle_partitions

#: Least length and least number of occurrences of a word, and how much more often its form occurs.
MIN_LENGTH, MIN_COUNT, FORM_RATIO = 6, 5, 5
#: One of so many (document, word) pairs has a letter left out.
SLIP = 199
#: Counts that a task holds before it hands them on, and code points of a text that are counted by a list.
HELD, LISTED = 400_000, 1 << 20
#: Scans a shard has on average, and owners of one half up to which they stay in one shard.
SHARD_ROWS, HALF_OWNERS = 40_000, 5_000
#: Owners of a half that are compared one by one; more are looked up by what is left of them without a letter.
COMPARED = 8
#: A form occurs five times as often as its word, so a long counts at most 27 steps: five doublings are enough.
DOUBLINGS = 5

_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _text_words(doc_id: str, text: str, runs: re.Pattern, least: int) -> Iterator[tuple[str, int]]:
    """The words of a text with their counts; the same word may come more than once."""
    found = Counter(runs.findall(text)) if len(text) <= LISTED else Counter(m.group() for m in runs.finditer(text))
    start = zlib.crc32(f"{doc_id}:".encode())
    lowered: dict[str, int] = {}
    for run, n in found.items():
        word = run.lower() if run.isascii() else run.translate(_UPPER)
        lowered[word] = lowered.get(word, 0) + n
    for word, n in lowered.items():
        h = zlib.crc32(word.encode(), start)
        if h % SLIP == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
            if len(word) < least:
                continue
        yield word, n


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """(word, n) of all words of at least ``min_length`` code points; a null id counts as an empty one."""
    base = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).filter("text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = re.compile(f"[A-Za-zÀ-ÿ]{{{max(1, min_length)},}}")
        held: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for word, n in _text_words(doc_id, text, runs, min_length):
                        held[word] = held.get(word, 0) + n
                if len(held) > HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return base.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def is_near(a: str, b: str) -> bool:
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i + 1 :]


def one_less(text: str) -> set[str]:
    """The text, and the text without each one of its code points."""
    return {text, *(text[:i] + text[i + 1 :] for i in range(len(text)))}


class HalfShard:
    """An automaton over halves and the words that own them.

    Halves have a side: 0 for a word's first part, 1 for the rest of it.
    """

    def __init__(self, owners: Iterator[tuple[int, str, str | None, str, int]]):
        """Owners are (side, half, variant, word, n); variant is null unless the half is a hot one."""
        self.owners: dict[tuple[int, str, str | None], list[tuple[str, int]]] = defaultdict(list)
        self.by_rest: dict[tuple[int, str], dict[str, list[tuple[str, int]]]] = {}
        self.automaton = ahocorasick.Automaton()
        for side, half, variant, word, n in owners:
            self.owners[side, half, variant].append((word, n))
            self.automaton.add_word(half, half)
        self.any = len(self.automaton) > 0
        if self.any:
            self.automaton.make_automaton()

    def _candidates(self, side: int, half: str, variant: str | None, rest: str) -> list[tuple[str, int]]:
        own = self.owners.get((side, half, variant), [])
        if variant is not None or len(own) <= COMPARED:
            return own
        index = self.by_rest.get((side, half))
        if index is None:
            index = self.by_rest[side, half] = defaultdict(list)
            for word, n in own:
                for v in one_less(word[len(half) :] if side == 0 else word[: len(word) - len(half)]):
                    index[v].append((word, n))
        return list({pair for v in one_less(rest) for pair in index.get(v, ())})

    def near(self, word: str, only: tuple[int, int, str] | None = None) -> Iterator[tuple[str, int]]:
        """The owners near a word, each once over all shards; ``only``: the side, length and variant of a hot half."""
        if not self.any:
            return
        variant = only and only[2]
        for end, half in self.automaton.iter(word):
            for side in (0, 1):
                if end + 1 != (len(half) if side == 0 else len(word)) or (only and only[:2] != (side, len(half))):
                    continue
                rest = word[len(half) :] if side == 0 else word[: len(word) - len(half)]
                for other, n in self._candidates(side, half, variant, rest):
                    if abs(len(other) - len(word)) > 1 or not is_near(other, word):
                        continue
                    if side == 1 and word.startswith(other[: len(other) // 2]):
                        continue  # by its first half too
                    if variant is not None:
                        own = other[len(half) :] if side == 0 else other[: len(other) - len(half)]
                        if variant != min(one_less(rest) & one_less(own)):
                            continue  # by a smaller variant too
                    yield other, n


def _scan(rows: pd.DataFrame) -> pd.DataFrame:
    """(word, n_near, form_n, form) of the words scanned by one shard."""
    words, counts, owns = rows["word"].tolist(), rows["n"].tolist(), rows["owns"].tolist()
    sides, lengths, variants = rows["side"].tolist(), rows["length"].tolist(), [v if isinstance(v, str) else None for v in rows["variant"].tolist()]

    def owners() -> Iterator[tuple[int, str, str | None, str, int]]:
        for word, n, own, variant in zip(words, counts, owns, variants):
            half = len(word) // 2
            if own & 1:
                yield 0, word[:half], variant, word, n
            if own & 2:
                yield 1, word[half:], variant, word, n

    shard, out = HalfShard(owners()), []
    for word, side, length, variant in zip(words, sides, lengths, variants):
        found = list(shard.near(word, None if variant is None else (int(side), int(length), variant)))
        if found:
            form, n = min(found, key=lambda f: (-f[1], f[0]))
            out.append((word, len(found), n, form))
    return pd.DataFrame(out, columns=["word", "n_near", "form_n", "form"]).astype({"n_near": "int64", "form_n": "int64"})


def _halves(word: Column) -> Column:
    """Each half that a near word may own and this word then has, as (side, half, own)."""
    n = F.length(word)
    first = lambda k: F.struct(F.lit(0).alias("side"), F.substring(word, F.lit(1), k).alias("half"), (k == F.floor(n / 2)).alias("own"))
    last = lambda k: F.struct(F.lit(1).alias("side"), F.substring(word, n - k + 1, k).alias("half"), (k == n - F.floor(n / 2)).alias("own"))
    cut = lambda m: F.floor(m / 2).cast("int")
    lengths = [n - 1, n, n + 1]
    return F.array_distinct(F.array(*[first(cut(m)) for m in lengths], *[last((m - cut(m)).cast("int")) for m in lengths]))


def _links(vocabulary: DataFrame, work: Workspace, shards: int, half_owners: int) -> DataFrame:
    """(word, n_near, form_n, form), each near pair found once from both sides."""
    halves = vocabulary.select("word", "n", F.inline(_halves(F.col("word"))))
    hot = halves.filter("own").groupBy("side", "half").agg(F.count("*").alias("owners")).filter(F.col("owners") > half_owners).select("side", "half", F.lit(True).alias("hot"))
    routed = work.put(halves.join(hot, ["side", "half"], "left"), "routed")
    shard = lambda *key: F.pmod(F.xxhash64(*key), F.lit(shards)).cast("int")
    own = F.when(F.col("own"), F.when(F.col("side") == 0, 1).otherwise(2)).otherwise(0)
    cold = routed.filter("hot is null").select("word", "n", own.alias("own"), shard("side", "half").alias("shard"))
    cold = cold.groupBy("word", "n", "shard").agg(F.bit_or("own").alias("owns")).select("shard", "word", "n", "owns", F.lit(None).cast("int").alias("side"), F.lit(None).cast("int").alias("length"), F.lit(None).cast("string").alias("variant"))
    rest = F.when(F.col("side") == 0, F.expr("substring(word, length(half) + 1)")).otherwise(F.expr("substring(word, 1, length(word) - length(half))"))
    less = F.expr("array_distinct(concat(array(rest), transform(sequence(1, greatest(length(rest), 1)), i -> concat(substring(rest, 1, i - 1), substring(rest, i + 1)))))")
    warm = routed.filter("hot").withColumn("rest", rest).select("word", "n", own.alias("owns"), "side", F.length("half").alias("length"), "half", F.explode(less).alias("variant"))
    warm = warm.select(shard("side", "half", "variant").alias("shard"), "word", "n", "owns", "side", "length", "variant")
    found = cold.unionByName(warm).groupBy("shard").applyInPandas(_scan, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("k"), F.col("form")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.k")).alias("form_n"), F.col("best.form").alias("form"))


def _roots(forms: DataFrame, work: Workspace) -> DataFrame:
    """(word, root): the last of each word's chain of forms, by doubling."""
    now = work.put(forms.select("word", F.col("form").alias("root")), "roots0")
    for turn in range(1, DOUBLINGS + 1):
        step = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        nxt = work.put(now.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), f"roots{turn}")
        done = nxt.filter("moved").isEmpty()
        now = nxt.select("word", "root")
        if done:
            break
    return now


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = FORM_RATIO, shard_rows: int = SHARD_ROWS, half_owners: int = HALF_OWNERS) -> DataFrame:
    """Words with their near words, the more frequent form each is a variant of, and the root of that form.

    Rows: word, form, root, n, n_near, form_n. Words are runs of letters, A-Z
    lower-cased, with a letter left out of one (document, word) in ``SLIP``; those
    of ``min_length`` code points (4 at least) and ``min_count`` occurrences count.
    Repeated rows count each; null and empty texts have no words; a null id is an
    empty one; a tie of forms goes to the smallest; an empty table has no words;
    other columns are not read. Very long texts are counted piece by piece, and
    halves that over ``half_owners`` words own are split by the rest of the word.
    """
    if min_length < 4 or ratio < 2:
        raise ValueError("words need 4 code points and forms twice the occurrences")
    work = Workspace(docs.sparkSession, "spelling")
    vocabulary = work.put(word_counts(docs, id_col, text_col, min_length).filter(F.col("n") >= min_count), "vocabulary")
    shards = max(shuffle_partitions(docs.sparkSession), -(-4 * vocabulary.count() // shard_rows))
    near = work.put(_links(vocabulary, work, shards, half_owners), "near")
    words = work.put(vocabulary.join(near, "word", "left").withColumn("is_form", F.col("form_n") >= ratio * F.col("n")), "words")
    roots = _roots(words.filter("is_form"), work)
    work.drop_all_but("words", *[n for n in work.names if n.startswith("roots")])
    return words.join(roots, "word", "left").select(
        "word", F.when(F.col("is_form"), F.col("form")).alias("form"), F.coalesce("root", "word").alias("root"),
        "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("is_form"), F.col("form_n")).alias("form_n"),
    )
