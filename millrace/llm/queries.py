"""The corpus operators as queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_encode
from .clustering import cluster_vectors
from .decontaminate import contamination
from .exact_dedup import exact_dedup
from .html_text import extract_text
from .langid import language_id
from .packing import pack
from .pseudonyms import DEMO_KEY, pseudonymise
from .quality import quality
from .shared import Workspace
from .simhash import simhash_dedup
from .spelling import spelling_variants
from .substring_dedup import substring_dedup
from .warc import archive

VOCABULARY, BYTE_VOCABULARY = "word_bpe_49k.json", "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A language for each document; ``und`` for null, empty and letterless texts; repeated rows are each answered."""
    return language_id(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each document; null, empty and wordless texts have fingerprint zero."""
    return simhash_dedup(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's ids and decoded text; a null text is empty and has no ids."""
    out = bpe_encode(table(spark, sf_dir, "documents"), vocabulary_path(), keep=[F.col("doc_id")], ids=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the benchmark items found in them, items of any length; a null text has none."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short_items=True)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the one of equal text that stays; null and empty texts are equal."""
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text with its values permuted, and their number; null stays null."""
    return pseudonymise(table(spark, sf_dir, "documents"), DEMO_KEY).select("doc_id", "text", "n_values")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The capture of each page, read back from its archive; a null page is an empty payload."""
    index = archive(table(spark, sf_dir, "pages"), Workspace(spark, "archives").path("warc"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction of each document; null texts are empty, and empty texts have a score."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of each document without its repeated strings; a null text is empty."""
    return substring_dedup(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page; empty for a null page and for one without main text."""
    return extract_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of each vector of 64 finite components after three rounds; others have no row."""
    return cluster_vectors(table(spark, sf_dir, "embeddings")).drop("centroid")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 ids; a null text is the id 0 alone."""
    return pack(table(spark, sf_dir, "documents"), vocabulary_path(BYTE_VOCABULARY), ids=False)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of at least six letters and five occurrences, with the forms they are variants of; null texts have none."""
    return spelling_variants(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of the documents that all stages of the pipeline keep."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_simhash": op2_simhash,
    "op3_bpe": op3_bpe,
    "op4_decontaminate": op4_decontaminate,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_pseudonyms": op6_pseudonyms,
    "op7_warc": op7_warc,
    "op8_quality": op8_quality,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_html_text": op10_html_text,
    "op11_clusters": op11_clusters,
    "op12_packing": op12_packing,
    "op13_spelling": op13_spelling,
    "pipeline": pipeline,
}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: What SQL can't express has none: 1 and 8 (trained models), 2 (XXH64), 3 (BPE),
#: 6 (held against plain Python in the tests),
#: 10 (a tree over parsed pages), 12 (BPE), 13 (CRC-32), pipeline (8, 2 and 3).
_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


def _lloyd_sql(rounds: int = 3) -> str:
    """Lloyd's rounds as common tables: assignment to the least (distance, number), then exact floors of means."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
        a{r} AS (SELECT r, vec_id, e, b.d, b.c FROM (SELECT r, vec_id, e, min(struct_pack(d := list_sum(list_transform(range(1, 65), lambda i: (v.e[i] - o.ce[i]) * (v.e[i] - o.ce[i])))::BIGINT, c := o.c)) AS b
                 FROM v CROSS JOIN (SELECT c, e AS ce FROM c{r}) o GROUP BY ALL))""")
        if r < rounds:
            steps.append(f"""
        s{r} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM a{r}) GROUP BY ALL),
        c{r + 1} AS (SELECT c, coalesce(m.e, old.e) AS e FROM c{r} old LEFT JOIN
                     (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS e FROM s{r} GROUP BY c) m USING (c))""")
    return f"""
        WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
                   WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
        c0 AS (SELECT row_number() OVER (ORDER BY h, e) - 1 AS c, e FROM (SELECT sha256('1:' || vec_id) AS h, e FROM v ORDER BY h, e LIMIT 16)),{",".join(steps)}
        SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
        FROM a{rounds} JOIN (SELECT c, sha256(array_to_string(e, ',')) AS centroid_sha256 FROM c{rounds}) USING (c)"""


ORACLE_SQL: dict[str, str] = {
    "op11_clusters": _lloyd_sql(),
    "op4_decontaminate": f"""
        WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        iw AS (SELECT item_id, w, len(w) AS n, least(13, len(w)) AS span FROM (SELECT DISTINCT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) >= 1),
        d AS (SELECT doc_id, len(w) AS nd, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS p FROM dw),
        i AS (SELECT item_id, n, span, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS j FROM iw),
        c AS (SELECT doc_id, item_id, n, span, p - j AS shift, nd, list(j) AS js, count(*) AS equal_words
              FROM d JOIN i USING (word) GROUP BY ALL HAVING count(*) >= ceil(span * 0.8)),
        b AS (SELECT *, list_max(list_transform(range(greatest(0, -shift), least(n, nd - shift) - span + 1),
                  lambda s: len(list_filter(js, lambda j: j >= s AND j < s + span)))) AS best FROM c),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY equal_words DESC, best DESC, greatest(0, shift)) AS k
              FROM b WHERE best >= ceil(span * 0.8))
        SELECT doc_id, item_id, equal_words, n::BIGINT AS n_item_words, best::BIGINT AS window_equal, span::BIGINT AS window_words,
               greatest(0, shift)::BIGINT AS first_word FROM r WHERE k = 1""",
    "op5_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256({_LOWERED}) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY {_LOWERED})""",
    "op9_substring_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
        s AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 800)) AS h FROM (SELECT doc_id, x, unnest(range(greatest(0, n - 399))) AS i FROM d)),
        r AS (SELECT doc_id, i FROM s WHERE h IN (SELECT h FROM s GROUP BY h HAVING count(*) > 1)),
        g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run
              FROM (SELECT doc_id, i, (i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -401) + 400)::INT AS fresh FROM r)),
        m AS (SELECT doc_id, run, min(i) AS a, max(i) + 400 AS b FROM g GROUP BY ALL),
        k AS (SELECT m.doc_id, a, b, substr(x, 2 * before + 1, 2 * (a - before)) AS part, x
              FROM (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM m) m JOIN d USING (doc_id)),
        c AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans,
                     sha256(unhex(string_agg(part, '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1))) AS kept_sha256 FROM k GROUP BY doc_id)
        SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(kept_sha256, sha256(unhex(x))) AS kept_sha256
        FROM d LEFT JOIN c USING (doc_id)""",
    "op7_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h,
                          max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31) + 1, 1)), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM p""",
}
