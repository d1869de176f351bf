import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import lectern as L
from lectern.functions.batches import BestRows
from lectern.operators import questions as asking


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).round(2).tolist(), "ab"[i % 2], i % 5) for i in range(300)]
    # a third of the table is copies of one vector
    rows += [(1000 + i, rows[7][1], "a", 1) for i in range(150)]
    rows += [(2000, [0.0] * 8, "a", 0), (2002, None, "b", 0), (2003, [float("nan")] * 8, "b", 0)]
    return spark.createDataFrame(rows, "doc_id bigint, embedding array<float>, side string, n int").repartition(6)


def nearest(rows, asked, k, keep=lambda r: True):
    scored = []
    q = np.array(asked, float)
    for r in rows:
        v = np.array(r.embedding if r.embedding is not None else [], float)
        if v.shape != q.shape or not np.isfinite(v).all() or not v.any() or not keep(r):
            continue
        score = (1 + q @ v / np.linalg.norm(q) / np.linalg.norm(v)) / 2
        scored.append((-round(score, 12), r.doc_id))
    return [(d, -s) for s, d in sorted(scored)[:k]]


def check(found, want):
    got = {}
    for r in found.orderBy("qid", "rk").collect():
        got.setdefault(r.qid, []).append((r.doc_id, r.score))
    for q, hits in want.items():
        assert [d for d, _ in got.get(q, [])] == [d for d, _ in hits], q
        assert [s for _, s in got.get(q, [])] == pytest.approx([s for _, s in hits], abs=1e-9)
    assert set(got) == {q for q, hits in want.items() if hits}


def questions(spark, asked):
    return spark.createDataFrame(asked, "qid int, vector array<double>, filters map<string,string>")


def random_asks(n, filters=({},)):
    rng = np.random.default_rng(4)
    return [(i, rng.normal(size=8).tolist(), filters[i % len(filters)]) for i in range(n)]


def test_exact_search(spark, vectors):
    rows = vectors.collect()
    hot = next(r for r in rows if r.doc_id == 7)
    asked = random_asks(12) + [(99, [float(x) for x in hot.embedding], {})]
    want = {q: nearest(rows, v, 10) for q, v, _ in asked}
    assert want[99][0][0] == 7 and want[99][9][0] == 1008
    check(L.knn_search(vectors, questions(spark, asked)), want)


def test_another_length_is_an_error(spark, vectors):
    odd = vectors.limit(5).union(spark.createDataFrame([(2001, [1.0] * 3, "a", 0)], vectors.schema))
    with pytest.raises(Exception, match="3 numbers where 8"):
        L.knn_search(odd, questions(spark, random_asks(2))).collect()


def test_search_with_filters(spark, vectors):
    rows = vectors.collect()
    asked = random_asks(9, ({"side": " a "}, {"side": "b", "n": "03"}, {"side": " ", "n": "nothing"}))
    keeps = [lambda r: r.side == "a", lambda r: r.side == "b" and r.n == 3, lambda r: False]
    want = {q: nearest(rows, v, 10, keeps[q % 3]) for q, v, _ in asked}
    check(L.knn_search(vectors, questions(spark, asked)), want)
    open_too = asked + [(50, asked[0][1], {})]
    want[50] = nearest(rows, asked[0][1], 10)
    check(L.knn_search(vectors, questions(spark, open_too)), want)


def test_common_filter_reaches_the_scan(spark, vectors, tmp_path):
    vectors.write.parquet(str(tmp_path / "v"))
    stored = spark.read.parquet(str(tmp_path / "v"))
    plan = L.knn_search(stored, questions(spark, random_asks(3, ({"n": "2"},))))._jdf.queryExecution().toString()
    assert "EqualTo(n,2)" in plan


def test_more_questions_than_one_pass(spark, vectors, monkeypatch):
    asked = random_asks(30)
    want = L.knn_search(vectors, questions(spark, asked), 5).orderBy("qid", "rk").collect()
    real = asking.passes
    monkeypatch.setattr("lectern.operators.knn.passes", lambda q: real(q, rows=8, size=500))
    assert L.knn_search(vectors, questions(spark, asked), 5).orderBy("qid", "rk").collect() == want


def test_min_score_and_odd_inputs(spark, vectors):
    asked = questions(spark, random_asks(3) + [(7, [0.0] * 8, {})])
    found = L.knn_search(vectors, asked, 10, min_score=0.8).collect()
    assert found and all(r.score >= 0.8 for r in found) and 7 not in {r.qid for r in found}
    assert L.knn_search(vectors, asked.limit(0)).count() == 0
    with pytest.raises(ValueError):
        L.knn_search(vectors, questions(spark, [(1, [1.0], {}), (2, [1.0, 2.0], {})]))


def test_reordered_hits(spark, vectors):
    asked = questions(spark, random_asks(4))
    plain = L.knn_search(vectors, asked, 5).collect()
    newest = L.knn_search(vectors, asked, 5, order_by=F.col("doc_id")).orderBy("qid", "rk").collect()
    for q in range(4):
        ids = [r.doc_id for r in newest if r.qid == q]
        assert ids == sorted((r.doc_id for r in plain if r.qid == q), reverse=True)


def test_approximate_search_finds_most(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    asked = table.where("vec_id % 25 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    exact = {(r.qid, r.doc_id) for r in L.knn_search(table, asked, id_col="vec_id").collect()}
    near = {(r.qid, r.doc_id) for r in L.knn_search(table, asked, id_col="vec_id", mode="approx").collect()}
    assert len(exact & near) / len(exact) > 0.9
    narrow = L.knn_search(table, asked, id_col="vec_id", mode="approx", bucket_length=0.05, tables=1).collect()
    assert len(narrow) < len(exact)
    scores = L.knn_search(table, asked, id_col="vec_id", mode="approx").groupBy("qid", "doc_id").count()
    assert scores.where("count > 1").count() == 0


def test_approximate_search_keeps_filters(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    asked = table.where("vec_id < 10").select(
        F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"),
        F.create_map(F.lit("label"), F.col("label").cast("string")).alias("filters"),
    )
    found = L.knn_search(table, asked, id_col="vec_id", mode="approx")
    labels = found.join(table.select(F.col("vec_id").alias("doc_id"), "label"), "doc_id")
    mine = labels.join(table.select(F.col("vec_id").alias("qid"), F.col("label").alias("mine")), "qid")
    assert found.count() > 10 and mine.where("label <> mine").count() == 0


def test_best_rows_against_sorting():
    rng = random.Random(5)
    import pyarrow as pa

    best = BestRows(3, 4, 12)
    best.PENDING_ROWS = 7
    seen = {0: [], 1: [], 2: []}
    for _ in range(20):
        ids = [rng.randrange(10**6) for _ in range(6)]
        scores = np.array([[rng.choice([0.1, 0.2, 0.3]) for _ in ids] for _ in range(3)])
        usable = np.array([[rng.random() < 0.8 for _ in ids] for _ in range(3)])
        best.offer(scores, pa.array(ids), usable)
        for q in seen:
            seen[q] += [(-s, i) for s, i, u in zip(scores[q], ids, usable[q]) if u]
    rows = pa.Table.from_batches(best.result(pa.array(["a", "b", "c"]), "id")).to_pylist()
    for q, name in enumerate("abc"):
        assert [(-r["score"], r["id"]) for r in rows if r["qid"] == name] == sorted(seen[q])[:4]


WORDS = "red blue green café the the the of Of straße naïve x_y 42 λόγος".split()


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(6)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(n)))
    rows = [(i, say(30), say(6) if i % 3 else None) for i in range(200)]
    rows += [(500 + i, "the red copy", "copy") for i in range(100)]
    return spark.createDataFrame(rows, "doc_id bigint, description string, title string").repartition(5)


def split(text):
    return [w for w in re.split(r"[^\w]+", (text or "").lower()) if w]


def bm25(rows, query, k):
    best = {}
    for field in ("description", "title"):
        words = {r.doc_id: split(r[field]) for r in rows}
        words = {d: w for d, w in words.items() if w}
        mean = sum(map(len, words.values())) / len(words)
        df = Counter(w for ws in words.values() for w in set(ws))
        for d, ws in words.items():
            tf = Counter(ws)
            s = sum(
                math.log(1 + (len(words) - df[t] + 0.5) / (df[t] + 0.5))
                * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(ws) / mean))
                for t in split(query) if tf[t]
            )
            if s:
                best[d] = max(best.get(d, 0), s)
    return sorted(((-round(s, 9), d) for d, s in best.items()))[:k]


QUERIES = ["the red", "Café", "λόγος x_y of", "the the the", "nothing here", "", "42 STRASSE straße"]


def test_lexical_search(spark, docs):
    rows = docs.collect()
    asked = spark.createDataFrame(list(enumerate(QUERIES)), "qid int, query string")
    found = L.lexical_search(docs, asked, max_docs=60, page=50).orderBy("qid", "rk").collect()
    for q, query in enumerate(QUERIES):
        want = bm25(rows, query, 100)
        mine = [r for r in found if r.qid == q]
        assert [r.doc_id for r in mine] == [d for _, d in want], query
        assert [r.score for r in mine] == pytest.approx([-s for s, _ in want], abs=1e-8)


def test_lexical_search_in_small_steps(spark, docs, monkeypatch):
    import lectern.operators.lexical as lexical

    asked = spark.createDataFrame(list(enumerate(QUERIES * 3)), "qid int, query string")
    want = L.lexical_search(docs, asked, max_docs=10, page=5).orderBy("qid", "rk").collect()
    real = asking.passes
    monkeypatch.setattr(lexical, "passes", lambda q: real(q, rows=6))
    assert L.lexical_search(docs, asked, max_docs=10, page=5).orderBy("qid", "rk").collect() == want


def test_field_scores_do_not_depend_on_the_step(monkeypatch):
    import pyarrow as pa

    import lectern.operators.lexical as lexical

    rng = random.Random(1)
    texts = pa.array([" ".join(rng.choice(WORDS) for _ in range(20)) for _ in range(50)])
    terms = pa.array(sorted({w.lower() for w in WORDS}))
    n_q = 9
    cells = sorted({(t, rng.randrange(n_q)) for t in range(len(terms)) for _ in range(4)})
    start = np.searchsorted([t for t, _ in cells], np.arange(len(terms) + 1))
    holders = (start, np.array([q for _, q in cells]), np.ones(len(cells)))
    args = (texts, terms, holders, np.linspace(1, 2, len(terms)), 20.0, n_q)
    whole = lexical._field_scores(*args)
    for step in (10, 33, 1000):
        monkeypatch.setattr(lexical, "PAIRS_PER_STEP", step)
        assert np.allclose(lexical._field_scores(*args), whole)


def test_saved_statistics_give_the_same_scores(spark, docs, tmp_path):
    L.term_statistics(docs).write.parquet(str(tmp_path / "s"))
    saved = spark.read.parquet(str(tmp_path / "s"))
    asked = spark.createDataFrame(list(enumerate(QUERIES)), "qid int, query string")
    want = L.lexical_search(docs, asked).orderBy("qid", "rk").collect()
    assert L.lexical_search(docs, asked, statistics=saved).orderBy("qid", "rk").collect() == want


def test_filtered_pages(spark, docs):
    asked = spark.createDataFrame(
        [(1, {"title": "copy"}), (2, {"title": " "}), (3, {"title": "none"})], "qid int, filters map<string,string>"
    )
    rows = L.filtered_page(docs, asked, max_docs=60, page=50).orderBy("qid", "rk").collect()
    first = [r for r in rows if r.qid == 1]
    assert [r.doc_id for r in first] == list(range(500, 600)) and {r.score for r in first} == {0.0}
    second = [r for r in rows if r.qid == 2]
    assert [r.doc_id for r in second] == list(range(100)) and {r.score for r in second} == {1.0}
    assert len(rows) == 200


def test_merge_dedup_rank(spark):
    near = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 2)], "qid int, doc_id bigint, score double, rk int")
    words = spark.createDataFrame(
        [(1, 11, 7.0, 1), (1, 12, 6.0, 2), (1, 13, 0.8, 3), (1, 14, 0.1, 4)], near.schema
    )
    merged = L.merge_hits(near, words)
    rows = merged.orderBy("merge_rk").collect()
    assert [(r.doc_id, r.score, r.branch) for r in rows] == [
        (10, 0.9, 1), (11, 0.8, 1), (12, 6.0, 2), (13, 0.8, 2), (14, 0.1, 2)
    ]
    docs = spark.createDataFrame(
        [(10, "A ", None, "x" * 120), (11, None, "b", " "), (12, "a", "z", "X" * 100 + "other"), (13, None, None, None),
         (14, " ", "q", "")],
        "doc_id bigint, title string, name string, description string",
    )
    unique = L.dedup_hits(L.fetch_docs(merged, docs))
    # 12 repeats 10; 13 and 14 have neither title nor description
    assert [r.doc_id for r in unique.orderBy("merge_rk").collect()] == [10, 11, 13]
    ranked = L.rank_hits(unique, 2).orderBy("rk").collect()
    assert [(r.doc_id, r.rk) for r in ranked] == [(10, 1), (11, 2)]


def test_dedup_of_a_hot_group_is_cut_before_the_shuffle(spark):
    docs = spark.range(1000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', string(id)) as title", "id as merge_rk")
    plan = L.dedup_hits(docs, group=(), order="merge_rk")
    assert plan.count() == 667
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text and "Partial" in text


def test_uncovered_values(spark):
    values = spark.createDataFrame([("Red",), ("blue",), ("Green",)], "value string")
    docs = spark.createDataFrame([(" red ",), (None,), ("GREEN",)], "colour string")
    assert [r.value for r in L.uncovered_values(values, docs, "colour").collect()] == ["blue"]


def test_citations(spark):
    hits = spark.createDataFrame(
        [(1, 5, 1, 0.123456, None, "form", "d" * 300, None, "s", "loc"), (1, 6, 2, 0.1, None, None, None, "f", "s", None)],
        "qid int, doc_id bigint, rk int, score double, title string, form_title string, description string, "
        "form_type string, source_type string, location_name string",
    )
    first, second = L.citations(hits).first().sources
    assert (first.idx, first.score, first.id, first.title, len(first.description)) == (1, 0.1235, "5", "form", 200)
    assert (first.type, first.location, first.activity) == ("s", "loc", "")
    assert (second.title, second.description, second.type, second.location) == ("Untitled", "", "f", "")
    assert len(L.citations(hits, 1).first().sources) == 1


def test_all_filters_in_one_scan(spark, vectors, tmp_path):
    from lectern.operators.filters import filter_key, match_filters

    vectors.write.parquet(str(tmp_path / "v"))
    stored = spark.read.parquet(str(tmp_path / "v"))
    maps = [{"side": "a"}, {"n": "03"}, {"side": "b", "n": "2"}, {"side": "nowhere"}, {"n": "no number"}]
    for some in (maps, maps + [{}]):
        specs = spark.createDataFrame([(m,) for m in some], "filters map<string,string>")
        found = match_filters(stored, specs.select(filter_key(F.col("filters")).alias("spec"), "filters"))
        rows = vectors.collect()
        want = {(i, r.doc_id) for i, m in enumerate(some) for r in rows
                if all(str(r[f]) == v.lstrip("0") if f == "n" else r[f] == v for f, v in m.items())}
        keys = [r[0] for r in specs.select(filter_key(F.col("filters"))).collect()]
        got = [(keys.index(r.spec), r.doc_id) for r in found.collect()]
        assert set(got) == want and len(got) == len(want)
        assert found._jdf.queryExecution().sparkPlan().toString().count("FileScan") == 1


def test_many_filters_give_the_same_rows(spark, vectors, monkeypatch):
    from lectern.operators import filters as module

    specs = spark.createDataFrame([({"side": "a"},), ({"n": "3"},), ({"n": "4", "side": "b"},)], "filters map<string,string>")
    specs = specs.select(module.filter_key(F.col("filters")).alias("spec"), "filters")
    few = sorted((r.spec, r.doc_id) for r in module.match_filters(vectors, specs).collect())
    monkeypatch.setattr(module, "IN_LIST_VALUES", 1)
    assert sorted((r.spec, r.doc_id) for r in module.match_filters(vectors, specs).collect()) == few


def test_found_documents_do_not_shuffle_the_corpus(spark, vectors, tmp_path):
    vectors.write.parquet(str(tmp_path / "v"))
    stored = spark.read.parquet(str(tmp_path / "v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = L.knn_search(stored, questions(spark, random_asks(3)))
        plan = L.fetch_docs(hits, stored)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
