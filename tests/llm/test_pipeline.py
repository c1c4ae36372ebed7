"""The pipeline against a plain version of what each stage decides."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import queries
from millrace.llm.quality import quality
from test_operators import slow_similar


def test_stages_and_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "decontamination", "encoding"]
    bench = [set_of(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    scores = {r["doc_id"]: r["predicted"] for r in quality(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    rows = [r for r in docs.collect() if scores[r["doc_id"]]]
    last = {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        last[r["text"].encode().lower()] = r
    rows = sorted(last.values(), key=lambda r: r["doc_id"])
    kept = slow_similar([r["doc_id"] for r in rows], [r["text"] for r in rows])
    rows = [r for r in rows if r["doc_id"] in kept]
    rows = [r for r in rows if not any(b in set_of(r["text"]) for b in bench)]
    got = {r["doc_id"] for r in queries.pipeline(spark, sf).collect()}
    assert got == {r["doc_id"] for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == columns, name


def set_of(text):
    return " " + " ".join(re.findall(r"[^\W_]+", text.lower())) + " "


def test_empty_input(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0, name


def test_odd_rows_in_each_stage(spark, sf):
    """Nulls, empties, repeats, long texts and columns with the operators' own names."""
    words = "a plain sentence of some words that says what it has to say and then it ends here"
    rows = [(1, None), (2, ""), (3, "  "), (4, words), (4, words), (5, words.upper()), (6, words + " now"), (None, words), (7, "word " * 60_000), (8, "é\u0000ß 日本語"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("lang", "source", "n_chars", "score", "_mr_score", "_gone_id", "_hit_id", "node", "mark", "kept", "fp", "words", "n_tokens"):
        docs = docs.withColumn(c, F.lit("clash"))
    ids = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "encoding":
            assert out.columns == docs.columns, name
        ids[name] = sorted((str(r["doc_id"]) for r in out.collect()))
    assert ids["exact_dedup"] == ["2", "3", "5", "6", "7", "8"]
    assert ids["near_dedup"] == ["1", "4", "4", "7", "8"]
    assert ids["decontamination"] == sorted(str(k) for k, _ in rows) and len(ids["encoding"]) == len(rows)
    assert set(ids["quality"]) <= {str(k) for k, _ in rows}
