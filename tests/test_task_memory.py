"""Tasks hold the words and vectors of a few texts, however many rows one of Spark's batches has."""

import tracemalloc
import weakref

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import lectern as L

LIMIT = 32 << 20  # bytes that numpy holds; the words of all 16 MB at once take over 60 MB


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    return [" ".join(f"w{x}" for x in rng.integers(0, 3000, 340)) for _ in range(8192)]


def peak_of(work):
    tracemalloc.start()
    try:
        done = work()
        return done, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def task_of(monkeypatch, docs, made):
    """The function that the tasks of a query run."""
    kept = []
    plain = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, *a, **b: kept.append(f) or plain(self, f, *a, **b))
    made()
    return kept[-1]


def test_term_statistics_of_a_large_batch(spark, texts, monkeypatch):
    docs = spark.createDataFrame([(1, "x")], "doc_id bigint, title string")
    task = task_of(monkeypatch, docs, lambda: L.term_statistics(docs, ["title"]))
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["title"])
    found, peak = peak_of(lambda: pa.Table.from_batches(list(task([batch]))))
    assert peak < LIMIT
    sums = found.group_by("term").aggregate([("docs", "sum"), ("words", "sum")]).to_pylist()
    sums = {r["term"]: (r["docs_sum"], r["words_sum"]) for r in sums}
    assert sums[""] == (8192, 8192 * 340) and len(sums) == 3001
    assert sums["w7"][0] == sum(" w7 " in f" {t} " for t in texts)


def test_word_search_of_a_large_batch(spark, texts, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:20])], "doc_id bigint, title string")
    asked = spark.createDataFrame([(1, "w1 w2 w3")], "qid bigint, query string")
    saved = L.term_statistics(docs, ["title"])
    task = task_of(monkeypatch, docs, lambda: L.lexical_search(docs, asked, ["title"], statistics=saved))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "title"])
    found, peak = peak_of(lambda: pa.Table.from_batches(list(task([batch]))))
    assert peak < LIMIT and found.num_rows == 200


def test_hashed_words_of_many_texts(texts):
    whole, peak = peak_of(lambda: L.HashedWords(16)(texts))
    assert peak < LIMIT
    assert np.array_equal(whole[100:200], L.HashedWords(16)(texts[100:200]))


MADE = []


def count_alive(texts):
    """A vector for each text: how many vectors the worker holds by now."""
    alive = sum(r() is not None for r in MADE)
    out = [np.full(1, alive + 1, np.float32) for _ in texts]
    MADE.extend(weakref.ref(v) for v in out)
    return out


def test_vectors_of_a_call_are_handed_on(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).coalesce(1)
    out = L.embed_table(docs, count_alive, 1, batch_size=100)
    alive, rows = out.agg(F.max(F.col("embedding")[0]), F.count("*")).first()
    assert alive <= 201 and rows == 2000
