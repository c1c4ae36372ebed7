"""The similarity stage where many texts share a passage, a template or nearly all of their words."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import simhash
from millrace.llm.shared import Workspace
from test_operators import slow_similar


@pytest.mark.parametrize("hot_key, block", [(64, 4096), (5, 30)])
def test_common_passages_and_copies(spark, hot_key, block):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=5))
    passage, base = [word() for _ in range(60)], [word() for _ in range(120)]
    texts = [[word() for _ in range(rng.randint(5, 60))] + passage for _ in range(150)]
    texts += [passage + [word() for _ in range(k)] for k in (3, 5, 8, 12, 13, 14, 15, 20) for _ in range(6)]
    for _ in range(150):
        copy = list(base)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(120)] = word()
        texts.append(copy)
    texts += [passage, passage[:50], base[:100], base + passage, passage * 3]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"] for r in simhash.keep_similar_representatives(docs, hot_key=hot_key, block=block).collect()}
    assert got == slow_similar([k for k, _ in rows], [t for _, t in rows])


def test_groups_without_hot_hashes_are_small(spark):
    """A passage in all texts: no group of texts has it for a key, unless the text is little else."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    passage = [word() for _ in range(40)]
    rows = [(i, " ".join([word() for _ in range(40)] + passage)) for i in range(400)]
    base = spark.createDataFrame(rows, "id long, text string").withColumn("mark", F.xxhash64("text"))
    schema = T._parse_datatype_string("id long, mark long, node long, n int, fp long, fp2 long, prefix array<long>")
    plain = base.mapInArrow(simhash._sketches(5, 0.8), schema).select(F.explode("prefix").alias("key")).groupBy("key").count().agg(F.max("count")).first()[0]
    sketches, members = simhash._members(base, schema, Workspace(spark, "hot-test"), 5, 0.8, 64)
    assert plain > 300 and (members.groupBy("key").count().agg(F.max("count")).first()[0] or 0) <= 64
    assert all(len(r["prefix"]) == r["n"] - simhash.least_overlap(r["n"], 0.8) + 1 for r in sketches.collect())


def test_large_groups_that_no_task_noticed_call_for_another_order(spark, monkeypatch):
    """Where texts are counted one by one no hash is met twice: the groups say so."""
    monkeypatch.setattr(simhash, "HOT_GROUP", 1)
    rng = random.Random(14)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    passage = [word() for _ in range(40)]
    rows = [(i, " ".join([word() for _ in range(40)] + passage)) for i in range(300)]
    base = spark.createDataFrame(rows, "id long, text string").withColumn("mark", F.xxhash64("text"))
    schema = T._parse_datatype_string("id long, mark long, node long, n int, fp long, fp2 long, prefix array<long>")
    monkeypatch.setattr(simhash, "_repeated", lambda words: lambda batches: iter(()))
    work = Workspace(spark, "turns-test")
    simhash._members(base, schema, work, 5, 0.8, 64)
    assert "sketches0" not in work.names and work.spark.read.parquet(work.path("members")).groupBy("key").count().agg(F.max("count")).first()[0] < 300


def test_odd_classes_are_a_bound():
    """Sets differ in as many hashes as their bits do, or more; few differences show one by one."""
    rng = np.random.default_rng(15)
    for n in (0, 1, 20, 300, 5000):
        a = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        for d in (0, 1, n // 5, n):
            b = np.r_[a[d:], rng.integers(0, 1 << 64, d, dtype=np.uint64)]
            apart = int(np.bitwise_count((simhash.odd_classes(a) ^ simhash.odd_classes(b)).view(np.uint64)).sum())
            assert apart <= 2 * d and (n != 300 or d != 60 or apart > 80)


def test_unlinked_copies_make_no_square_of_pairs(spark, monkeypatch):
    """Copies of one text with too many changes to link to most others: their pairs grow with the rows, not with their square."""
    rng = random.Random(16)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    base, texts = [word() for _ in range(120)], []
    for _ in range(250):
        copy = list(base)
        for _ in range(rng.choice((1, 2, 2, 2, 2))):
            copy[rng.randrange(5, 115)] = word()
        texts.append(copy)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    read, made, plain = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0), simhash._pairs_in_groups

    def counted(*args):
        def run(batches):
            def through():
                for batch in batches:
                    read.add(batch.num_rows)
                    yield batch

            for batch in inner(through()):
                made.add(batch.num_rows)
                yield batch

        inner = plain(*args)
        return run

    monkeypatch.setattr(simhash, "_pairs_in_groups", counted)
    got = {r["doc_id"] for r in simhash.keep_similar_representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == slow_similar([k for k, _ in rows], [t for _, t in rows])
    assert read.value > 500 and made.value < read.value, (read.value, made.value)
