import random

import numpy as np
import pytest

from lectern.llm import quality as Q
from lectern.llm.queries import QUERIES

DOCS = "doc_id bigint, text string, score double"


def test_measures_and_votes():
    found = Q.measures("One two three!! One two\nlast line.\nlast line.")
    assert found["doubled_marks"] == 1 / 9 and found["repeated_lines"] == pytest.approx(1 / 3)
    assert found["plain_words"] == 8 / 9 and found["odd_words"] == 0
    assert Q.measures("") is None and Q.measures(" \n") is None and Q.votes(None) == [Q.ABSTAIN] * len(Q.LABELLERS)
    junk = Q.votes(Q.measures("THE*** AND### OF%%% " * 20))
    assert junk.count(Q.BAD) >= 5 and Q.GOOD not in junk[:8]
    assert Q.BAD not in Q.votes(Q.measures("This is a plain line of prose, as it should be."))


def test_chunks_do_not_matter(monkeypatch):
    text = "Ab 1!\n é🙂 word " * 40
    whole = Q.features(text, None), Q.measures(text)
    monkeypatch.setattr(Q, "CHUNK", 5)
    assert (Q.features(text, None) == whole[0]).all() and Q.measures(text) == whole[1]


def test_estimation_finds_the_rates():
    rng = random.Random(1)
    rates = [(0.7, 0.05, 0.0, 0.6), (0.5, 0.02, 0.0, 0.4), (0.6, 0.1, 0.1, 0.5), *[(0.4, 0.03, 0.0, 0.3)] * (len(Q.LABELLERS) - 3)]
    counts, truth = {}, {}
    for _ in range(20000):
        good = rng.random() < 0.8
        cast = []
        for bad_if_bad, bad_if_good, good_if_bad, good_if_good in rates:
            u, b, g = rng.random(), *((bad_if_good, good_if_good) if good else (bad_if_bad, good_if_bad))
            cast.append(Q.BAD if u < b else Q.GOOD if u < b + g else Q.ABSTAIN)
        p = Q.pattern(cast)
        counts[p] = counts.get(p, 0) + 1
        truth[p] = truth.get(p, 0) + good
    patterns = np.array(sorted(counts))
    model = Q.estimated(patterns, np.array([counts[p] for p in patterns]))
    assert abs(model.good - 0.8) < 0.02
    assert all(abs(model.rates[i, 0, Q.BAD] - r[0]) < 0.05 and abs(model.rates[i, 1, Q.BAD] - r[1]) < 0.02 for i, r in enumerate(rates))


def test_query_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in QUERIES["op4_weak_labels"](spark, sf).collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert np.mean([rows[r.doc_id].keep == bool(r.quality) for r in labels]) > 0.98
    assert np.mean([rows[r.doc_id].keep for r in labels if r.quality]) > 0.99


def test_odd_rows(spark):
    rows = [(i, f"Some plain prose of the number {i}, as it is.", None) for i in range(40)]
    rows += [(100 + i, f"JUNK*** {i}### %%% " * 30, 1.0) for i in range(10)]
    rows += [(None, None, None), (200, "", None), (201, " \n ", None), (1, rows[1][1], None), (202, "plain words here and there, " * 40_000, None)]
    docs = spark.createDataFrame(rows, DOCS)
    model = Q.learn(docs)
    got = Q.score(docs.drop("score"), model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in got)
    keep = {r.doc_id: r.keep for r in got}
    assert all(keep[i] for i in range(40)) and not any(keep[100 + i] for i in range(10)) and not keep[None] and not keep[200]
    assert len({r.score for r in got if r.doc_id == 1}) == 1
    none = docs.limit(0)
    assert Q.learn(none) is None and Q.score(none.drop("score"), None).count() == 0
    with pytest.raises(ValueError):
        Q.score(docs, model, keep=("doc_id", "score"))


def test_copies_do_not_empty_the_sample(spark):
    from pyspark.sql import functions as F

    order = F.pmod(F.xxhash64("text", F.lit(11)), F.lit(1 << 30))
    ids = F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")
    good = spark.range(40).select(F.concat(F.lit("Some plain prose about the word "), ids, F.lit(", as it is.")).alias("text"))
    junk = spark.range(40).select(F.repeat(F.concat(F.lit("JUNK*** "), ids, F.lit("### %%% ")), 30).alias("text"))
    # 12,800 rows of eight texts late in the order of the hash
    texts = [r.text for some in (good, junk) for r in some.orderBy(order.desc()).limit(4).collect()]
    rows = [(i, t, 3000 if i < 4 else 200) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n int").select(
        "doc_id", "text", F.explode(F.expr("array_repeat(0, n)"))).drop("col")
    model = Q.learn(docs)
    got = Q.score(docs.distinct(), model).collect()
    assert {r.doc_id: r.keep for r in got} == {i: i < 4 for i in range(8)}


def test_fit_counts_copies():
    rng = np.random.default_rng(3)
    x, target, copies = rng.random((6, 5), np.float32), np.array([0.9, 0.1, 0.8, 0.3, 0.6, 0.2]), np.array([1, 4, 2, 1, 3, 5])
    assert np.allclose(Q.fitted(x, target, copies), Q.fitted(x.repeat(copies, 0), target.repeat(copies), np.ones(copies.sum())), atol=1e-5)
