"""Language identification by compression: the language whose raw-content
dictionary lets zstandard encode a text in the fewest bytes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import id_bucket

#: Documents of each language that its dictionary is chosen from, at most: those with the least hash of the id.
SAMPLE_DOCS = 400
#: Bytes of whole texts that a language's dictionary is made of, at most (a single text may be longer).
DICTIONARY_BYTES = 112 << 10
#: A text is compressed in pieces of so many bytes, so that all of it is held against the dictionary rather than its own start.
PIECE_BYTES = 8 << 10
LEVEL = 3
#: Blocks of each language that a piece is appended to, and their bytes.
FILLERS = 2
FILLER_BYTES = 2 << 10
#: Bits a byte by which the best must lead the second; below it the answer is rejected.
MARGIN = 0.02
UNKNOWN = "und"
HASHES = 1 << 31

_LETTER = regex.compile(r"\p{L}")


def _words(text: str) -> list[str]:
    return regex.findall(r"[\p{L}\p{M}]+", text.lower())


def _clean(words: list[str]) -> bytes:
    """Lower-case words with single spaces: what tells languages apart."""
    return (" " + " ".join(words) + " ").encode("utf-8", "surrogatepass")


class LanguageModel:
    """Compressors with the dictionaries of some languages.

    The last ``FILLERS`` blocks of a language's sample are kept out of its
    dictionary. Each piece of a text is measured behind each of them, as the
    bytes it adds: a short piece by itself leaves the coder nothing to gain.
    """

    def __init__(self, samples: dict[str, bytes]):
        self.languages = sorted(samples)
        options = dict(write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        self._coders = []
        for language in self.languages:
            sample = samples[language]
            cut = max(8, len(sample) - FILLERS * FILLER_BYTES)
            content = zstandard.ZstdCompressionDict(sample[:cut], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            parameters = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=PIECE_BYTES + FILLER_BYTES, dict_size=cut, **options)
            coder = zstandard.ZstdCompressor(dict_data=content, compression_params=parameters)
            blocks = [sample[i : i + FILLER_BYTES] for i in range(cut, len(sample), FILLER_BYTES)] or [b""]
            self._coders.append((coder, [(block, len(coder.compress(block))) for block in blocks]))

    def sizes(self, text: str) -> list[float]:
        """Bytes that the whole text takes in each language."""
        data = _clean(_words(text))
        pieces = [data[i : i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)]
        return [sum(len(coder.compress(block + piece)) - alone for piece in pieces for block, alone in fillers) / len(fillers) for coder, fillers in self._coders]

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, bits a byte by which it leads); ties go to the first in order."""
        if not text or not self.languages or not _LETTER.search(text):
            return UNKNOWN, 0.0, 0.0
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
        share = 1 / sum(math.exp(max(-60.0, (sizes[best] - s) * math.log(2))) for s in sizes)
        rest = [s for i, s in enumerate(sizes) if i != best]
        lead = 8 * (min(rest) - sizes[best]) / max(1, len(text)) if rest else 8.0
        return self.languages[best], share, lead


def dictionaries(docs: DataFrame, *, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", train: Column | None = None, sample_docs: int = SAMPLE_DOCS, dictionary_bytes: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Each learned language's dictionary: some of its documents, whole, joined.

    Of the ``sample_docs`` ids of least hash those are taken, in order of the hash,
    whose whole texts still fit ``dictionary_bytes``; if none does, the shortest.
    Only lengths and the chosen texts reach the driver. Of a repeated id the
    shortest text is used.
    """
    labelled = docs.filter(train) if train is not None else docs
    labelled = labelled.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{id_col}`").alias("id"), F.octet_length(F.col(f"`{text_col}`")).alias("bytes")).filter("lang is not null and id is not null and bytes > 0")
    # ids in order of a hash; those that can't be among the first are left out by its value,
    # so that no language's rows meet in one task
    place = F.pmod(F.xxhash64("id"), F.lit(HASHES))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.approx_count_distinct("id").alias("n")).collect()}
    if not counts:
        return {}
    limits = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, HASHES if n <= 8 * sample_docs else HASHES * 8 * sample_docs // n)])
    near = labelled.filter(place <= F.element_at(limits, F.col("lang"))).groupBy("lang", "id").agg(F.min("bytes").alias("bytes"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(place, "id"))
    first: dict[str, list] = {}
    for row in near.withColumn("n", rank).filter(F.col("n") <= sample_docs).orderBy("lang", "n").collect():
        first.setdefault(row["lang"], []).append(row)
    chosen = {}
    for lang, rows in first.items():
        room, taken = dictionary_bytes, []
        for row in rows:
            if row["bytes"] <= room:
                room -= row["bytes"]
                taken.append(row)
        for row in taken or [min(rows, key=lambda r: r["bytes"])]:
            chosen[lang, row["id"]] = (lang, row["id"], row["bytes"])
    schema = T.StructType([T.StructField("l", T.StringType()), T.StructField("i", docs.schema[id_col].dataType), T.StructField("b", T.IntegerType())])
    wanted = docs.sparkSession.createDataFrame(list(chosen.values()), schema)
    texts = docs.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    found = texts.join(F.broadcast(wanted), (F.col("lang") == F.col("l")) & (F.col("id") == F.col("i")) & (F.octet_length("text") == F.col("b")))
    got = {(r["lang"], r["id"]): r["text"] for r in found.groupBy("lang", "id").agg(F.min("text").alias("text")).collect()}
    parts: dict[str, list[bytes]] = {}
    for lang, i in chosen:
        parts.setdefault(lang, []).append(_clean(_words(got[lang, i])))
    return {lang: b"".join(x) for lang, x in parts.items() if len(b"".join(x)) >= 8}


def identify_language(docs: DataFrame, model: dict[str, bytes], text_col: str = "text", *, keep: list[str], margin: float = MARGIN) -> DataFrame:
    """Columns ``keep`` with lang_pred, score, rejected and lang_accepted.

    lang_pred is the language of the smallest encoding, ``und`` for a null text
    or one without letters; score is its share of the weights 2^-bits. A lead
    under ``margin`` bits a byte is rejected: lang_accepted is then ``und``.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("_mr_text"))
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType()), T.StructField("lang_accepted", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = LanguageModel(sent.value)
        for batch in batches:
            made = [languages.predict(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            refused = [lead < margin or lang == UNKNOWN for lang, _, lead in made]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64()), pa.array(refused, pa.bool_()), pa.array([UNKNOWN if r else m[0] for r, m in zip(refused, made)], pa.string())],
                [*batch.schema.names[:-1], "lang_pred", "score", "rejected", "lang_accepted"],
            )

    return base.mapInArrow(run, T.StructType([*base.schema.fields[:-1], *new]))


def language_id(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out_of: int = 4, held_out: int = 2, sample_docs: int = SAMPLE_DOCS, margin: float = MARGIN) -> DataFrame:
    """One row per input row: ``id_col, held_out, lang_pred, score, rejected, lang_accepted``.

    Learned from rows with a language whose id's crc32 modulo ``held_out_of``
    isn't ``held_out``. A null id is neither learned from nor held out. Without
    any labelled row each answer is ``und``, as it is for null, empty and
    letterless texts; whole texts count, however long. Repeated rows are each
    answered, ties between languages go to the first in order, other columns
    are ignored, and an empty table gives no rows.
    """
    bucket = id_bucket(id_col, held_out_of)
    model = dictionaries(docs, lang_col=lang_col, id_col=id_col, text_col=text_col, train=bucket != held_out, sample_docs=sample_docs)
    out = identify_language(docs, model, text_col, keep=[id_col], margin=margin)
    return out.select(F.col(f"`{id_col}`"), F.coalesce(bucket == held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected", "lang_accepted")
