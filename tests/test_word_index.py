import random

import pytest
from pyspark.sql import functions as F

import lectern as L
from lectern.operators import word_index as V

FIELDS = ("title", "description")
SCHEMA = "doc_id string, title string, description string"


def texts(n, seed=1):
    """Common words everywhere, each rare word in few neighbouring documents."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        body = rng.choices(["the", "of", "drill", "patrol", "unit"], k=rng.randrange(3, 30)) + [f"rare{i // 40}"] * rng.randrange(0, 3)
        rng.shuffle(body)
        rows.append((f"d{i:05d}", rng.choice([None, "", "the unit", f"rare{i // 40} É"]), " ".join(body)))
    return rows + [("f", "the the", rows[3][2]), ("e", None, None), ("f", " ", "!!"), (None, "the", "rare7 rare7")]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).coalesce(3)


def asked(spark, queries):
    return spark.createDataFrame(list(enumerate(queries)), "qid int, query string")


def got(found):
    return [(r.qid, r.doc_id, round(r.score, 8), r.rk) for r in found.orderBy("qid", "rk").collect()]


QUERIES = ["rare3", "the rare12 patrol", "THE the of", "é unit", "nothing known here", "", None, "rare7 rare8 rare8 drill"]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    docs = frame(spark, texts(2000))
    return docs, L.build_word_index(docs, str(tmp_path_factory.mktemp("words") / "w"), FIELDS, block_docs=32)


@pytest.mark.parametrize("k", [1, 10, 200])
def test_same_rows_as_the_full_search(spark, built, k):
    docs, index = built
    questions = asked(spark, QUERIES)
    want = L.lexical_search(docs, questions, FIELDS, max_docs=k, page=k)
    assert got(L.indexed_search(index, questions, max_docs=k, page=k)) == got(want)


def test_blocks_are_skipped_and_texts_not_read(spark, built, monkeypatch):
    docs, index = built
    block = asked(spark, ["the rare12 patrol", "rare3", "unit rare30 rare31"]).toArrow()
    hits, head, rest, bounds = V._one_pass(index, spark, block, "int", 10, 2)
    total = index.postings(spark).select("block").distinct().count()
    assert total > 60 and bounds.select("block").distinct().count() == total  # common words are in all
    assert head.count() + rest.count() < 0.2 * total
    files = {f.split("/")[-2] for f in hits.inputFiles()}
    assert all(f == "postings" or f.startswith("hits-") or f.startswith("blocks-") for f in files), files
    plan = index.postings(spark).where("slot = 3 and term = 'the'")._jdf.queryExecution().toString()
    assert "EqualTo(term,the)" in plan


def test_many_terms_and_no_documents(spark, built, tmp_path):
    docs, index = built
    questions = asked(spark, [" ".join(f"rare{i} w{i}" for i in range(150)), "the"])
    want = L.lexical_search(docs, questions, FIELDS, max_docs=5, page=5)
    assert got(L.indexed_search(index, questions, max_docs=5, page=5)) == got(want)
    for rows in ([], [("a", None, "")]):
        empty = L.build_word_index(frame(spark, rows), str(tmp_path / f"none{len(rows)}"), FIELDS)
        assert L.indexed_search(empty, questions).count() == 0
    assert L.indexed_search(index, questions.where("qid < 0")).count() == 0


def test_several_blocks_of_questions(spark, built, monkeypatch):
    docs, index = built
    questions = asked(spark, [f"rare{i} the" for i in range(12)])
    whole = got(L.indexed_search(index, questions, max_docs=3, page=3))
    real = V.passes
    monkeypatch.setattr(V, "passes", lambda q: real(q, rows=4))
    assert got(L.indexed_search(index, questions, max_docs=3, page=3)) == whole
    assert F is not None


def test_ids_are_stored_once_and_files_hold_a_bounded_number_of_postings(spark, built, tmp_path, monkeypatch):
    docs, index = built
    rows = index.postings(spark)
    own = rows.where("term = ''")
    assert rows.where("ids is not null").count() == own.count() == rows.select("block", "field").distinct().count()
    monkeypatch.setattr(V, "PART_POSTINGS", 2000)
    small = L.build_word_index(docs, str(tmp_path / "w"), FIELDS, block_docs=32)
    postings = small.statistics(spark).agg(F.sum("docs")).first()[0]
    assert len(small.postings(spark).inputFiles()) > postings / 2000 / 2
    questions = asked(spark, QUERIES)
    assert got(L.indexed_search(small, questions)) == got(L.indexed_search(index, questions))
