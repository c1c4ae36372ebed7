"""Packing of documents into sequences by cutting-stock column generation.

Documents are encoded once and cut into whole sequences and a rest. The rests are
packed by the linear program over patterns of the histogram of their lengths:
columns are priced by a knapsack's dynamic program under the program's duals. The
program has one row a length, hence at most ``capacity - 1``, whatever the data.
Its rounded patterns are given to the rests by their rank within a length.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import byte_symbols, read_spec
from .shared import Workspace

CAPACITY = 1024
#: Code points after which a long text is cut for the encoder.
TEXT_SPAN = 1 << 18
#: The program stops within this share, or one sequence, of the fewest sequences that could do, or after so many columns.
GAP, MAX_COLUMNS = 1e-4, 1500
REFACTOR = 150
#: A place where the vocabulary's pre-tokenizer always cuts: a space between letters or digits.
_SAFE = re.compile("(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")

#: Fixed value: the pattern of byte-level pre-tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_LOADED: dict[str, Encoder] = {}


class Encoder:
    """Ids of a byte-level vocabulary, from a ``tokenizers`` JSON file's text.

    Texts go through tiktoken, whose ranks are the file's ids if those follow its
    merges; a text that its pattern matcher refuses (a million spaces in a row) goes
    through the tokenizers library. The results are the same.
    """

    def __init__(self, spec: str):
        import tiktoken

        data = json.loads(spec)
        model, before = data["model"], data["pre_tokenizer"] or {}
        merged = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = [model["vocab"][a + b] for a, b in merged]
        if model["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or data.get("normalizer") or ids != sorted(set(ids)):
            raise ValueError("expected byte-level BPE whose ids follow its merges")
        byte = {c: bytes([i]) for i, c in enumerate(byte_symbols())}
        ranks = {b"".join(byte[c] for c in token): i for token, i in model["vocab"].items() if all(c in byte for c in token)}
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks={k: i for k, i in ranks.items() if i not in special.values()}, special_tokens=special)
        self.spec, self.library = spec, None

    def _slow(self, text: str) -> list[int]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.spec)
            self.library.no_truncation()
            self.library.no_padding()
        return self.library.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> np.ndarray:
        """Little-endian numbers of 32 bits."""
        out = []
        for part in spans(text):
            try:
                out.append(np.array(self.fast.encode(part, allowed_special="all"), "<u4"))
            except ValueError:
                out.append(np.array(self._slow(part), "<u4"))
        return out[0] if len(out) == 1 else np.concatenate(out)

    @classmethod
    def of(cls, spec: str) -> Encoder:
        key = hashlib.sha256(spec.encode()).hexdigest()
        if key not in _LOADED:
            _LOADED.clear()
            _LOADED[key] = cls(spec)
        return _LOADED[key]


def spans(text: str, size: int = TEXT_SPAN) -> list[str]:
    """A text in parts whose ids are the text's ids; a part ends at the first safe place from ``size`` on."""
    out, at = [], 0
    while len(text) - at > size and (cut := _SAFE.search(text, at + size)):
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]] if at else [text]


# the linear program


def _first_patterns(demand: np.ndarray) -> list[tuple[np.ndarray, float, int]]:
    """(pattern, uses, the length used up) by taking the longest left and filling up; a triangular basis.

    A length that runs out along with another has a pattern of its own that isn't used.
    """
    left, out = demand.astype(float).copy(), []
    capacity = len(demand)
    while (open_ := np.flatnonzero(left > 1e-9)).size:
        longest = int(open_[-1])
        pattern, room = Counter({longest: 1}), capacity - longest
        while room and (fits := open_[open_ <= room]).size:
            pairs = fits[left[room - fits] > 1e-9]
            part = room if left[room] > 1e-9 else int(pairs[-1]) if pairs.size else int(fits[-1])
            pattern[part] += 1
            room -= part
        uses, used_up = min((left[w] / a, w) for w, a in pattern.items())
        column = np.zeros(capacity)
        for w, a in pattern.items():
            column[w] = a
            left[w] -= uses * a
        left[used_up] = 0
        out.append((column, uses, used_up))
    for w in set(np.flatnonzero(demand).tolist()) - {p[2] for p in out}:
        out.append((np.eye(1, capacity, w)[0], 0.0, w))
    return out


def _priced(duals: np.ndarray) -> tuple[float, np.ndarray]:
    """The pattern of the largest value under the duals (unbounded knapsack), and its value."""
    capacity = len(duals)
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, int)
    for c in range(1, capacity + 1):
        k = min(c, capacity - 1)
        values = duals[1 : k + 1] + best[c - k : c][::-1]
        w = int(values.argmax())
        if values[w] > best[c - 1] + 1e-12:
            best[c], took[c] = values[w], w + 1
        else:
            best[c] = best[c - 1]
    column, c = np.zeros(capacity), capacity
    while c > 0:
        if took[c]:
            column[took[c]] += 1
            c -= took[c]
        else:
            c -= 1
    return float(best[capacity]), column


def solve(demand: np.ndarray, gap: float = GAP, max_columns: int = MAX_COLUMNS) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often each is used, in fractions, to cut the demanded lengths from fewest sequences.

    ``demand[w]`` pieces of length w; its size is the capacity. The revised simplex
    method starts from patterns that fill greedily; a column enters by the knapsack.
    """
    rows = np.flatnonzero(demand)
    if not rows.size:
        return []
    start = _first_patterns(demand)
    basis, x = np.array([p[0][rows] for p in start]).T, np.array([p[1] for p in start])
    inverse, least = np.linalg.inv(basis), float((np.arange(len(demand)) * demand).sum() / len(demand))
    for turn in range(max_columns):
        if x.sum() <= max(least * (1 + gap), least + 1):
            break
        duals = np.zeros(len(demand))
        duals[rows] = inverse.sum(axis=0)
        value, column = _priced(duals)
        if value <= 1 + gap:
            break
        entering = column[rows]
        step = inverse @ entering
        ratio = np.full(len(x), np.inf)
        np.divide(x, step, out=ratio, where=step > 1e-7)
        # of the rows that leave alike the one with the largest pivot
        out = int(np.where(ratio <= ratio.min() * (1 + 1e-9) + 1e-9, step, -np.inf).argmax())
        uses = float(ratio[out])
        x = np.maximum(x - uses * step, 0)
        x[out], basis[:, out] = uses, entering
        if turn % REFACTOR == REFACTOR - 1:
            inverse = np.linalg.inv(basis)
            x = np.maximum(inverse @ demand[rows], 0)
        else:
            row = inverse[out] / step[out]
            inverse -= np.outer(step, row)
            inverse[out] = row
    out = []
    for j, uses in enumerate(x):
        column = np.zeros(len(demand))
        column[rows] = basis[:, j]
        out.append((column, float(uses)))
    return out


def _filled(left: dict[int, int], goal: int) -> tuple[Counter, int]:
    """Pieces of what is left that come to ``goal``, long ones preferred, and the room that stays if no choice does."""
    reach, after = 1, []
    for w in sorted(left, reverse=True):  # bits are the sums that can be reached, a step for each doubling of a piece's count
        many, k = min(left[w], goal // w), 1
        while many:
            k = min(k, many)
            after.append((w, k, reach))
            reach |= reach << (w * k) & ((1 << (goal + 1)) - 1)
            many -= k
            k *= 2
    best = at = reach.bit_length() - 1
    pattern: Counter = Counter()
    for w, k, before in reversed(after):
        if not before >> at & 1:
            pattern[w] += k
            at -= w * k
    return pattern, goal - best


#: (length, first part, times) of pieces that are cut in two, or (pattern, times) of sequences.
Step = tuple[int, int, int] | tuple[Counter, int]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, gap: float = GAP, max_columns: int = MAX_COLUMNS) -> list[Step]:
    """Cuts and sequences, in order, for pieces shorter than the capacity; no sequence needs padding.

    The program's full patterns are used as often as their uses say, rounded down.
    What is left is filled pattern by pattern, each as often as it can be; where
    no choice of pieces fills a sequence one of them is cut, and the last tokens
    go to sequences of powers of two.
    """
    demand = np.zeros(capacity)
    for w, n in histogram.items():
        demand[w] = n
    left, out = Counter({w: n for w, n in histogram.items() if n}), []

    def use(pattern: Counter, times: int) -> None:
        for w, a in pattern.items():
            left[w] -= times * a
            if not left[w]:
                del left[w]
        out.append((pattern, times))

    for column, uses in sorted(solve(demand, gap, max_columns), key=lambda p: -p[1]):
        pattern = Counter({int(w): int(round(column[w])) for w in np.flatnonzero(column > 0.5)})
        times = min(int(uses + 1e-6), *(left[w] // a for w, a in pattern.items()))
        if times > 0 and sum(w * a for w, a in pattern.items()) == capacity:
            use(pattern, times)
    while left:
        material = sum(w * n for w, n in left.items())
        goal = capacity if material >= capacity else 1 << material.bit_length() - 1
        pattern, room = _filled(left, goal)
        needed = Counter(pattern)
        longest = max(w for w in left if left[w] > pattern[w]) if room else 0
        if room:
            needed[longest] += 1
        times = min(left[w] // a for w, a in needed.items()) if goal == capacity else 1
        if room:
            out.append((longest, room, times))
            left[longest] -= times
            left[room] += times
            left[longest - room] += times
            pattern[room] += 1
            left = +left
        use(pattern, times)
    return out


def slots(steps: list[Step], histogram: dict[int, int]) -> list[tuple[int, ...]]:
    """Where ranks of a length go: (length, low, high, cut at, piece, first sequence, pieces a sequence, offset, turn of the lowest)."""
    lots = {w: [(w, 0, n, 0)] for w, n in histogram.items() if n}  # of each length: (uncut length, low, high, cut at)
    out, sequence = [], 0

    def taken(w: int, many: int) -> Iterator[tuple[int, int, int, int]]:
        while many:
            own, low, high, at = lots[w].pop(0)
            end = min(high, low + many)
            if end < high:
                lots[w].insert(0, (own, end, high, at))
            many -= end - low
            yield own, low, end, at

    for step in steps:
        if len(step) == 3:
            w, part, times = step
            for own, low, high, at in list(taken(w, times)):
                lots.setdefault(part, []).append((own, low, high, at))
                lots.setdefault(w - part, []).append((own, low, high, at + part))
            continue
        pattern, times = step
        offset = 0
        for w, a in sorted(pattern.items(), reverse=True):
            turn = 0
            for own, low, high, at in taken(w, a * times):
                out.append((own, low, high, at, w, sequence, a, offset, turn))
                turn += high - low
            offset += a * w
        sequence += times
    return out


# the table


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """Documents cut at multiples of the capacity: doc_id, start, length, ids_crc32, doc_tokens, the task, the rank among its pieces of that length, the ids.

    Ids are little-endian numbers of 32 bits; those of whole pieces only if ``ids``.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(docs.sparkSession, vocabulary))
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kinds = {"start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "task": pa.int64(), "rank": pa.int64(), "ids": pa.binary()}
    fields = [base.schema.fields[0], *[T.StructField(c, T.BinaryType() if c == "ids" else T.LongType()) for c in kinds]]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = Encoder.of(spec.value), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                out: dict[str, list] = {c: [] for c in kinds}
                owner = []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    own = np.append(encoder.ids(text or ""), np.zeros(1, "<u4"))
                    for at in range(0, len(own), capacity):
                        n = min(capacity, len(own) - at)
                        part = own[at : at + n].tobytes()
                        owner.append(i)
                        for c, v in zip(kinds, (at, n, zlib.crc32(part), len(own), task, seen[n], part if ids or n < capacity else None)):
                            out[c].append(v)
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *[pa.array(out[c], kinds[c]) for c in kinds]], ["doc_id", *kinds])

    return base.mapInArrow(cut, T.StructType(fields))


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = CAPACITY, ids: bool = True, gap: float = GAP, max_columns: int = MAX_COLUMNS) -> DataFrame:
    """Pieces of documents with the sequence and the offset each has there.

    Rows: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if
    ``ids``, the piece's ids (little-endian numbers of 32 bits). A document is its
    text's ids by the vocabulary (byte BPE) and the id 0; a null text is empty, a null id stays one; repeated rows are
    each packed; texts of any length are encoded in parts; an empty table has no
    pieces; other columns are not read. Sequences are numbered from 0, those of
    rests first, then the whole ones.
    """
    if capacity & (capacity - 1) or capacity < 16:
        raise ValueError("the capacity is a power of two")
    spark = docs.sparkSession
    work = Workspace(spark, "packing")
    cut = work.put(pieces(docs, vocabulary, id_col, text_col, capacity, ids), "pieces")
    counts = work.put(cut.groupBy("task", "length").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row a length
    full = histogram.pop(capacity, 0)
    steps = plan(histogram, capacity, gap, max_columns)
    first_whole = sum(step[1] for step in steps if len(step) == 2)
    rows = [*slots(steps, histogram), (capacity, 0, full, 0, capacity, first_whole, 1, 0, 0)]
    table = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in ("length", "low", "high", "cut", "piece", "first", "many", "at", "turn"))).coalesce(1)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    ranked = cut.join(counts.select("task", "length", F.coalesce(before, F.lit(0)).alias("before")), ["task", "length"]).withColumn("place", F.col("rank") + F.col("before"))
    # the table's rows follow the lengths, at most capacity - 1, not the documents
    placed = ranked.join(F.broadcast(table), "length").filter("place >= low AND place < high").withColumn("t", F.expr("place - low + turn"))
    own = F.expr("substring(ids, cast(4 * cut + 1 AS int), cast(4 * piece AS int))")
    return placed.select(
        "doc_id", (F.col("start") + F.col("cut")).alias("start"), F.col("piece").alias("length"),
        F.when(F.col("piece") == F.col("length"), F.col("ids_crc32")).otherwise(F.crc32(own)).alias("ids_crc32"), "doc_tokens",
        F.expr("first + t DIV many").alias("sequence_id"), F.expr("at + t % many * piece").alias("offset"), *([own.alias("ids")] if ids else []),
    )
