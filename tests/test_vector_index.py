import numpy as np
import pytest
from pyspark.sql import functions as F

import lectern as L
from lectern.functions.batches import vectors
from lectern.operators import knn, pivots as P, vector_index as V
from lectern.plans.sizing import top_per_group

SCHEMA = "doc_id bigint, embedding array<float>, side string"


def clustered(n, centres, dim=32, spread=0.35, seed=2):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((centres, dim))
    return middle[rng.integers(0, centres, n)] + spread * rng.standard_normal((n, dim))


def frame(spark, x, parts=6):
    return spark.createDataFrame([(i, v.tolist(), "ab"[i % 2]) for i, v in enumerate(x)], SCHEMA).repartition(parts).cache()


def asked_of(table, every):
    return table.where(F.col("doc_id") % every == 0).select(F.col("doc_id").alias("qid"), F.col("embedding").alias("vector"))


def pairs(found):
    return {(r.qid, r.doc_id): r.score for r in found.collect()}


@pytest.fixture(scope="module")
def big(spark, tmp_path_factory):
    table = frame(spark, clustered(20_000, 200))
    root = str(tmp_path_factory.mktemp("index") / "big")
    return table, L.build_vector_index(table, root)


def test_recall_at_few_pairs(spark, big):
    table, index = big
    assert not index.exact and index.share < 0.05 and index.recall >= 0.9, index.reason
    asked = asked_of(table, 20).where("qid < 4000")
    exact = pairs(L.knn_search(table, asked))
    near = pairs(L.knn_search(table, asked, mode="approx", index=index))
    assert len(exact.keys() & near.keys()) / len(exact) >= 0.9
    assert all(abs(exact[p] - s) < 1e-9 for p, s in near.items() if p in exact)
    assert len(near) == len(exact)
    # what is measured is what is scored
    x = np.array([r.vector for r in asked.collect()], float)
    probed = index.probed(x / np.linalg.norm(x, axis=1, keepdims=True), index.probes)
    assert (probed @ index.sizes).mean() / index.rows < 0.05


def test_every_row_is_indexed_and_lists_are_apart(spark, big):
    table, index = big
    rows = index.table(spark)
    assert rows.count() == 20_000 == index.rows == index.sizes.sum() and rows.select("doc_id").distinct().count() == 20_000
    plan = V._lists(rows, index.probed(index.centroids[:1], 1))._jdf.queryExecution().toString()
    assert "PushedFilters: [In(lst" in plan or "EqualTo(lst" in plan
    files = rows.groupBy(F.input_file_name().alias("f")).agg(F.min("lst").alias("a"), F.max("lst").alias("b")).orderBy("a").collect()
    assert all(x.b <= y.a for x, y in zip(files, files[1:]))


def test_loaded_index_searches_alike(spark, big):
    table, index = big
    again = L.load_vector_index(spark, index.root)
    assert (again.probes, again.candidates, again.share) == (index.probes, index.candidates, index.share)
    asked = asked_of(table, 2000)
    assert pairs(L.knn_search(table, asked, mode="approx", index=again)) == pairs(L.knn_search(table, asked, mode="approx", index=index))


def test_filtered_questions_are_exact(spark, big):
    table, index = big
    asked = asked_of(table, 1000).withColumn("filters", F.when(F.col("qid") % 2000 == 0, F.create_map(F.lit("side"), F.lit("b"))))
    found = L.knn_search(table, asked, mode="approx", index=index)
    exact, near = pairs(L.knn_search(table, asked)), pairs(found)
    assert {p for p in exact if p[0] % 2000 == 0} == {p for p in near if p[0] % 2000 == 0}
    assert len(near) == len(exact)


def test_vectors_without_neighbourhoods_go_exact(spark, tmp_path):
    table = frame(spark, np.random.default_rng(1).standard_normal((3000, 64)))
    index = L.build_vector_index(table, str(tmp_path / "flat"))
    assert index.exact and "of all pairs" in index.reason
    asked = asked_of(table, 300)
    assert pairs(L.knn_search(table, asked, mode="approx", index=index)) == pairs(L.knn_search(table, asked))


def test_a_large_group_of_copies_is_spread(spark, tmp_path):
    x = clustered(9000, 60)
    x[::3] = x[0]
    index = L.build_vector_index(frame(spark, x), str(tmp_path / "hot"))
    sizes = [r["count"] for r in index.table(spark).groupBy(F.input_file_name()).count().collect()]
    assert max(sizes) < 2.5 * 9000 / len(sizes) and index.rows == 9000


def test_odd_rows(spark, tmp_path):
    rows = [(1, [1.0, 0.0], "a"), (1, [1.0, 0.0], "a"), (2, None, "a"), (3, [0.0, 0.0], "b"), (4, [float("nan"), 1.0], "b")]
    index = L.build_vector_index(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "odd"))
    assert index.rows == 2 and index.exact
    for i, none in enumerate(([], rows[2:4])):
        index = L.build_vector_index(spark.createDataFrame(none, SCHEMA), str(tmp_path / f"none{i}"))
        assert index.rows == 0 and index.exact
    with pytest.raises(ValueError, match="length"):
        L.build_vector_index(spark.createDataFrame([(1, [1.0], "a"), (2, [1.0, 2.0], "a")], SCHEMA), str(tmp_path / "mixed"))


def test_repeated_ids_and_no_questions(spark, tmp_path):
    x = clustered(4000, 80)
    table = frame(spark, np.concatenate([x, x[:10]])).withColumn("doc_id", F.when(F.col("doc_id") >= 4000, F.col("doc_id") - 4000).otherwise(F.col("doc_id")))
    index = L.build_vector_index(table, str(tmp_path / "twice"))
    assert not index.exact, index.reason
    asked = asked_of(table, 1).where("qid < 3").distinct()
    found = L.knn_search(table, asked, mode="approx", index=index)
    assert all(r["count"] == 2 for r in found.where("qid = doc_id").groupBy("qid").count().collect())
    assert L.knn_search(table, asked.where("qid < 0"), mode="approx", index=index).count() == 0


def test_code_scores_are_near_the_true_ones():
    x = clustered(2000, 40)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centroids = V.k_means(x, 40, 1)
    rest = x - centroids[V.nearest(x, centroids)]
    books = [V.k_means(rest[:, s], V.CODES, 2) for s in V._segments(32)]
    lst, codes = V.encoded(x, centroids, books)
    again = centroids[lst] + np.concatenate([b[codes[:, m]] for m, b in enumerate(books)], axis=1)
    assert np.abs(x @ x[:50].T - again @ x[:50].T).mean() < 0.05
    assert knn.RANK_DECIMALS and vectors is not None


def test_exact_search_in_one_scan_skips_rows(spark, big, monkeypatch):
    table, index = big
    monkeypatch.setattr(P, "QUESTIONS_PER_PASS", 150)
    asked = asked_of(table, 40)
    counted = spark.sparkContext.accumulator(0)
    found = P.pivot_search(index, asked, 10, counted)
    best = top_per_group(found, ["qid"], [F.desc("score"), F.asc("doc_id")], 10)
    want = L.knn_search(table, asked)
    key = lambda rows: sorted((r.qid, r.rk, r.doc_id, round(r.score, 11)) for r in rows.collect())
    assert key(best) == key(want)
    assert counted.value < 0.4 * 500 * 20_000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    whole = L.knn_search(table, asked, index=index)
    assert key(whole) == key(want)


@pytest.mark.parametrize("k", [1, 7])
def test_exact_search_by_index_on_odd_vectors(spark, tmp_path, k):
    """Copies, opposite vectors, ties, and vectors without neighbourhoods."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((1500, 6))
    x[::3] = x[0]
    x[1::9] = -x[0]
    table = frame(spark, x.round(1))
    index = L.build_vector_index(table, str(tmp_path / "odd"), lists=20)
    asked = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate([*rng.standard_normal((20, 6)), x[0], -x[0], np.zeros(6)])], "qid int, vector array<double>")
    key = lambda rows: sorted((r.qid, r.rk, r.doc_id, round(r.score, 11)) for r in rows.collect())
    assert key(L.knn_search(table, asked, k, index=index)) == key(L.knn_search(table, asked, k))
    assert L.knn_search(table, asked.where("qid < 0"), k, index=index).count() == 0


def test_bounds_hold_for_every_row():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((900, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    asked = rng.standard_normal((40, 5))
    asked /= np.linalg.norm(asked, axis=1, keepdims=True)
    order, start, pivots, reach = P.rings(x, rng.integers(0, 7, 900), 50)
    limit = P.bounds(asked, pivots, reach)
    assert sorted(order) == list(range(900))
    for ring in range(len(pivots)):
        scores = (1 + asked @ x[order[start[ring] : start[ring + 1]]].T) / 2
        assert (scores.max(axis=1) <= limit[:, ring]).all()
