"""Quality classifier: a factorisation machine over hashed words and text structure.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)),
so pairwise interactions cost as much as the single features do.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import id_bucket, unused

BUCKETS = 1 << 15
RANK = 6
#: Labelled rows that a classifier is fitted on, at most: those with the least hash of the id.
SAMPLE_ROWS = 12_000
#: Batches that a machine is fitted with, whatever the sample's size.
STEPS = 2250
THRESHOLD = 0.3

#: Structure statistics and metadata of a text, in this order.
STATISTICS = ("length", "words", "word_length", "distinct_words", "upper", "digits", "symbols", "line_repeats", "sentence_repeats", "top_word", "symbol_tails", "exclamations", "lines", "bytes_per_char")

_WORD = re.compile(r"[^\W\d_]+")
_SYMBOL_TAIL = re.compile(r"[^\w\s]{2,}(?=\s|$)")
_SENTENCE = re.compile(r"[.!?\n]+")


def statistics(text: str, words: list[str], counts: Counter) -> list[float]:
    n, m = max(1, len(text)), max(1, len(words))
    raw = text.encode("utf-8", "surrogatepass")
    upper = sum(map(len, re.findall("[A-Z]+", text)))
    digits = sum(map(len, re.findall("[0-9]+", text)))
    letters = sum(map(len, words))
    spaces = sum(map(len, re.findall(r"\s+", text)))
    lines = [x for x in text.split("\n") if x.strip()]
    sentences = [x.strip() for x in _SENTENCE.split(text) if x.strip()]
    tails = len(_SYMBOL_TAIL.findall(text))
    return [
        min(1.5, np.log1p(len(text)) / 10),
        min(1.5, np.log1p(len(words)) / 8),
        min(2.0, letters / m / 8),
        len(counts) / m,
        upper / n,
        digits / n,
        max(0, n - letters - digits - spaces) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        1 - len(set(sentences)) / max(1, len(sentences)),
        max(counts.values(), default=0) / m,
        min(1.0, tails / m),
        min(1.0, text.count("!") / m),
        min(1.5, np.log1p(len(lines)) / 6),
        len(raw) / n - 1,
    ]


class Featurizer:
    """A text's features as (index, value): first the statistics, then hashed words."""

    def __init__(self, buckets: int = BUCKETS, memory: int = 500_000):
        self.buckets, self.memory = buckets, memory
        self._index: dict[str, int] = {}

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        text = text or ""
        words = _WORD.findall(text)
        counts = Counter(words)
        index = self._index
        if len(index) > self.memory:
            index.clear()
        at = []
        for word in counts:
            i = index.get(word)
            if i is None:
                i = index[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % self.buckets
            at.append(i)
        k = len(STATISTICS)
        values = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
        values /= max(1e-9, np.sqrt((values**2).sum()))
        return np.r_[np.arange(k), np.array(at, np.int64) + k], np.r_[statistics(text, words, counts), values]


class FactorisationMachine:
    def __init__(self, size: int, rank: int = RANK, seed: int = 7):
        self.bias = 0.0
        self.w = np.zeros(size)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (size, rank))

    def score(self, index: np.ndarray, value: np.ndarray) -> float:
        vx = self.v[index] * value[:, None]
        z = self.bias + self.w[index] @ value + 0.5 * ((vx.sum(0) ** 2).sum() - (vx**2).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, *, steps: int = STEPS, rate: float = 0.15, decay: float = 1e-5, batch: int = 32, seed: int = 7) -> FactorisationMachine:
        """Adagrad on the log loss, in small batches; the same rows give the same model."""
        rng = np.random.default_rng(seed)
        gw, gv, gb = np.full_like(self.w, 1e-6), np.full_like(self.v, 1e-6), 1e-6
        order, done = np.empty(0, np.int64), 0
        for _ in range(steps):
            if done >= len(order):
                order, done = rng.permutation(len(rows)), 0
            part = order[done : done + batch]
            done += batch
            sizes = np.array([len(rows[i][0]) for i in part])
            index, value = np.concatenate([rows[i][0] for i in part]), np.concatenate([rows[i][1] for i in part])
            bounds = np.r_[0, np.cumsum(sizes)[:-1]]
            vx = self.v[index] * value[:, None]
            s = np.add.reduceat(vx, bounds)
            z = self.bias + np.add.reduceat(self.w[index] * value, bounds) + 0.5 * ((s**2).sum(1) - np.add.reduceat((vx**2).sum(1), bounds))
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]) / len(part)
            each = np.repeat(error, sizes)
            used, back = np.unique(index, return_inverse=True)
            dw = np.bincount(back, each * value, len(used)) + decay * self.w[used]
            grad = (each * value)[:, None] * (np.repeat(s, sizes, axis=0) - vx)
            dv = np.stack([np.bincount(back, grad[:, f], len(used)) for f in range(grad.shape[1])], 1) + decay * self.v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            gb += error.sum() ** 2
            self.w[used] -= rate * dw / np.sqrt(gw[used])
            self.v[used] -= 0.3 * rate * dv / np.sqrt(gv[used])
            self.bias -= rate * error.sum() / np.sqrt(gb)
        return self


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    make = Featurizer()
    for batch in batches:
        made = [make(x.as_py()) for x in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array([i.astype(np.int32).tobytes() for i, _ in made], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in made], pa.binary()), batch.column(1)], ["index", "value", "label"])


def training_rows(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, train: Column | None = None) -> DataFrame:
    """(text, label) of at most ``sample_rows`` labelled ids: those with the least hash.

    Of several labels of an id the largest counts, of several texts the first in order.
    """
    chosen = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if train is not None:
        chosen = chosen.filter(train)
    chosen = chosen.groupBy(F.col(id_col).alias("_label_id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    chosen = chosen.orderBy(F.xxhash64("_label_id"), "_label_id").limit(sample_rows)
    found = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(chosen), F.col("_id") == F.col("_label_id"))
    # one text of a repeated id, so that the bound holds however often it is repeated
    return found.groupBy("_id").agg(F.min("text").alias("text"), F.first("label").alias("label")).select("text", "label")


def fit_quality(docs: DataFrame, labels: DataFrame, **options) -> FactorisationMachine:
    """A machine fitted on the driver; what reaches it is bounded by ``sample_rows``.

    Of a repeated id one text is used. Without labelled rows every score is one half.
    """
    got = training_rows(docs, labels, **options).mapInArrow(_features, "index binary, value binary, label int").toArrow()
    got = got.sort_by([(c, "ascending") for c in ("index", "value", "label")])
    machine = FactorisationMachine(BUCKETS + len(STATISTICS))
    if not len(got):
        machine.v[:] = 0
        return machine
    # views of one array each: thousands of small arrays would leave the process their memory for good
    pairs = list(zip(_numbers(got["index"], np.int32, np.int64), _numbers(got["value"], np.float32, np.float64)))
    return machine.fit(pairs, got["label"].to_numpy().astype(float))


def _numbers(column: pa.ChunkedArray, kind: type, wide: type) -> list[np.ndarray]:
    """Each row's packed numbers of ``kind``, as ``wide`` ones."""
    packed = [x.cast(pa.large_binary()) for x in column.chunks if len(x)]
    bounds = [np.frombuffer(x.buffers()[1], np.int64)[x.offset : x.offset + len(x) + 1] for x in packed]
    every = np.concatenate([np.frombuffer(x.buffers()[2] or b"", np.uint8)[at[0] : at[-1]] for x, at in zip(packed, bounds)]).view(kind).astype(wide)
    sizes = np.concatenate([np.diff(at) for at in bounds]) // np.dtype(kind).itemsize
    return np.split(every, np.cumsum(sizes)[:-1])


def score_quality(docs: DataFrame, machine: FactorisationMachine, text_col: str = "text", *, keep: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """Columns ``keep`` and, last, the score (0 to 1) and the prediction (1 if the score >= threshold),
    named _mr_score and _mr_predicted, with more underlines where ``keep`` has these names.

    Null counts as empty; empty texts are scored on their statistics alone.
    """
    model = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.w, machine.v))
    at = keep.index(text_col) if text_col in keep else len(keep)
    base = docs.select(*[F.col(f"`{c}`") for c in keep], *([F.col(f"`{text_col}`")] if at == len(keep) else []))
    kept = base.schema.fields[: len(keep)]
    names = unused(keep, "_mr_score", "_mr_predicted")
    schema = T.StructType([*kept, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, fm = Featurizer(), FactorisationMachine(1, 1)
        fm.bias, fm.w, fm.v = model.value
        for batch in batches:
            scores = [fm.score(*make(x.as_py())) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], schema.names)

    return base.mapInArrow(run, schema)


def quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, held_out_of: int = 5, held_out: int = 0, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per input row: ``id_col, held_out, score, predicted``.

    Labels are learned from rows whose id's crc32 modulo ``held_out_of`` isn't
    ``held_out``; a null id is not held out and has no label. Null texts are
    empty, and empty texts have a score too; whole texts count, however long;
    repeated rows are each scored, a score equal to ``threshold`` is predicted 1,
    other columns are ignored, and an empty table gives no rows. Without any
    label every score is one half.
    """
    machine = fit_quality(docs, labels, id_col=id_col, text_col=text_col, sample_rows=sample_rows, train=id_bucket(id_col, held_out_of) != held_out)
    scored = score_quality(docs, machine, text_col, keep=[id_col], threshold=threshold)
    return scored.select(F.col(f"`{id_col}`"), F.coalesce(id_bucket(id_col, held_out_of) == held_out, F.lit(False)).alias("held_out"), F.col("_mr_score").alias("score"), F.col("_mr_predicted").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, held_out_of: int = 5, held_out: int = 0, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches ``threshold``.

    Null ids and texts, repeated rows and empty tables are treated as in ``quality``;
    columns of any name are kept as they are.
    """
    machine = fit_quality(docs, labels, id_col=id_col, text_col=text_col, sample_rows=sample_rows, train=id_bucket(id_col, held_out_of) != held_out)
    scored = score_quality(docs, machine, text_col, keep=list(docs.columns), threshold=threshold)
    return scored.filter(F.col(scored.columns[-1]) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
