import json

import numpy as np
import pytest
from pyspark.sql import functions as F

import lectern as L
from lectern.sources import vectors as store
from lectern.sources.vectors import quarantine


@pytest.fixture()
def corpus(spark):
    rows = [(f"d{i}", f"title {i}", "words " * i, "x") for i in range(1, 9)] + [("blank", " ", None, "\t")]
    return spark.createDataFrame(rows, "doc_id string, title string, description string, form_type string")


class Picky:
    """Fails on some texts, and counts nothing else."""

    def __call__(self, texts):
        if any("title 3" in t or "title 5" in t for t in texts):
            raise RuntimeError("no")
        return [[1.0, 2.0] for _ in texts]


def test_vector_table(spark, corpus):
    table = L.with_vectors(corpus, Picky(), 2)
    rows = {r.doc_id: r for r in table.collect()}
    assert set(rows) == {f"d{i}" for i in range(1, 9)}
    assert {d for d, r in rows.items() if not r.embed_ok} == {"d3", "d5"}
    assert rows["d3"].embedding == [0.0, 0.0] and rows["d1"].embedding == [1.0, 2.0]
    assert rows["d2"].embedded_text == "words words title 2 x"
    check = L.verify_vectors(table, 2).first()
    assert (check.docs, check.wrong_length, check.zero_vectors, check.no_text) == (8, 0, 2, 0)
    report = {r.status: (r.docs, r.percent) for r in L.ingest_report(table).collect()}
    assert report == {"indexed": (6, 75.0), "error": (2, 25.0)}


def test_stored_text_is_cut_but_embedded_whole(spark):
    seen = {}

    def lengths(texts):
        return [[float(len(t)), 1.0] for t in texts]

    one = spark.createDataFrame([("a", "y" * 12000)], "doc_id string, title string")
    row = L.with_vectors(one, lengths, 2).first()
    assert row.embedding[0] == 12000 and len(row.embedded_text) == 10000 and not seen


def test_embedding_runs_once_per_text(spark, tmp_path):
    marks = tmp_path / "marks"
    marks.mkdir()

    def embed(texts):
        import uuid

        for _ in texts:
            (marks / uuid.uuid4().hex).touch()
        return [[1.0]] * len(texts)

    df = spark.createDataFrame([(i, f"t{i}") for i in range(10)], "doc_id int, text string")
    out = L.embed_table(df, embed, 1).where("embed_ok").select("doc_id", F.explode("embedding").alias("x")).where("x > 0")
    assert out.count() == 10 and len(list(marks.iterdir())) == 10


def test_wrong_lengths_are_failures(spark):
    df = spark.createDataFrame([(1, "a"), (2, "bb")], "doc_id int, text string")
    out = L.embed_table(df, lambda texts: [[1.0] * len(t) for t in texts], 1).orderBy("doc_id").collect()
    assert [(r.embed_ok, r.embedding) for r in out] == [(True, [1.0]), (False, [0.0])]


def test_limit_counts_usable_documents(spark, corpus):
    assert {r.doc_id for r in L.with_vectors(corpus, limit=2).collect()} == {"d1", "d2"}


def test_publish_and_upsert(spark, corpus, tmp_path):
    root = str(tmp_path / "table")
    first = L.build_vector_table(corpus, root, dim=4)
    assert first.count() == 8
    change = spark.createDataFrame(
        [("d1", "new", "text", "x"), ("d1", "newer", "text", "x"), ("d9", "nine", None, None)], corpus.schema
    )
    again = L.build_vector_table(change, root, mode="upsert", dim=4)
    rows = {r.doc_id: r for r in again.collect()}
    assert len(rows) == again.count() == 9 and "new" in rows["d1"].title and rows["d2"].title == "title 2"
    # a reader that opened the first version still has it
    assert first.count() == 8
    assert {r.doc_id for r in L.build_vector_table(change, root, dim=4).collect()} == {"d1", "d9"}


def test_upsert_writes_new_rows_only(spark, corpus, tmp_path):
    root = str(tmp_path / "table")
    first = L.build_vector_table(corpus, root, dim=4)
    files = set(first.inputFiles())
    for i in range(3):
        change = spark.createDataFrame([("d1", f"new {i}", "text", "x"), (f"n{i}", "more", None, None)], corpus.schema)
        table = L.build_vector_table(change, root, mode="upsert", dim=4)
    rows = {r.doc_id: r.title for r in table.collect()}
    assert len(rows) == table.count() == 11 and rows["d1"] == "new 2"
    # the first version's files stay where they are and are still read; the others hold two rows each
    assert files < set(table.inputFiles()) and len(L.unused_folders(spark, root)) == 0
    assert sum(spark.read.parquet(f).count() for f in set(table.inputFiles()) - files) == 6
    compact = L.compact_vectors(spark, root)
    assert {r.doc_id: r.title for r in compact.collect()} == rows and compact.columns == table.columns
    assert len(L.unused_folders(spark, root)) == 4 and not set(compact.inputFiles()) & set(table.inputFiles())


def test_failed_rows_are_kept_out(spark, corpus, tmp_path):
    root, rejected = str(tmp_path / "table"), str(tmp_path / "rejected")
    assert L.build_vector_table(corpus, root, embed=Picky(), dim=2).where("not embed_ok").count() == 2
    table = L.build_vector_table(corpus, root, embed=Picky(), dim=2, rejected=rejected)
    assert table.count() == 6 and spark.read.parquet(rejected).count() == 2
    with pytest.raises(ValueError, match="2 of 8 rows"):
        L.build_vector_table(corpus, root, embed=Picky(), dim=2, max_failed=0.1)
    assert L.read_vectors(spark, root).count() == 6


def test_upsert_keeps_the_newest(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "doc_id int, v string, t int")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 3), (3, "e", 1), (2, "f", 2)], old.schema)
    rows = L.upsert_vectors(old, new, newest=F.desc("t")).orderBy("doc_id").collect()
    assert [(r.doc_id, r.v) for r in rows] == [(1, "a"), (2, "d"), (3, "e")]


def test_quarantine(spark, corpus, tmp_path):
    good = quarantine(L.with_vectors(corpus, Picky(), 2), str(tmp_path / "q"))
    assert good.count() == 6 and spark.read.parquet(str(tmp_path / "q")).count() == 2


def test_try_search(spark, corpus):
    assert L.try_search(L.with_vectors(corpus), "title 4 words").orderBy("rk").first().doc_id == "d4"


def test_verify_finds_bad_vectors(spark):
    df = spark.createDataFrame(
        [(1, [1.0, 0.0], "t"), (2, [0.0, 0.0], None), (3, [1.0], "t"), (4, None, "t")],
        "doc_id int, embedding array<float>, embedded_text string",
    )
    row = L.verify_vectors(df, 2).first()
    assert (row.docs, row.wrong_length, row.zero_vectors, row.no_text) == (4, 2, 1, 1)


def test_json_corpus(spark, tmp_path):
    docs = [
        {"doc_id": "a", "title": " T ", "keywords": ["k"], "name": None, "odd": {"x": 1}},
        {"doc_id": "b", "title": 5, "status": "open", "flag": True},
    ]
    path = tmp_path / "d.jsonl"
    path.write_text("\n".join(json.dumps(d) for d in docs) + "\n\n")
    rows = {r.doc_id: r for r in L.load_corpus(spark, str(path), "json").collect()}
    assert rows["a"].title == " T " and rows["a"].keywords is None and rows["a"].name is None
    assert json.loads(rows["a"].extra["odd"]) == {"x": 1} and json.loads(rows["a"].extra["keywords"]) == ["k"]
    assert rows["b"].title is None and rows["b"].extra["title"] == "5" and rows["b"].status == "open"
    assert set(rows["b"].extra) == {"title", "flag"}


def test_preview(spark, corpus):
    rows = L.preview_text(corpus, 2).collect()
    assert [(r.doc_id, r.text_chars) for r in rows] == [("blank", 0), ("d1", 15)]
    assert L.corpus_count(corpus) == 9


def test_hashed_words_are_unit_vectors():
    out = L.HashedWords(16)(["a b b", "", "Ä ä"])
    assert np.allclose(np.linalg.norm(out, axis=1), [1, 0, 1]) and (out[2] > 0).sum() == 1


def test_upserts_touch_only_their_folders(spark, tmp_path):
    root = str(tmp_path / "buckets")
    docs = spark.range(400).select(F.col("id").cast("string").alias("doc_id"), F.format_string("title %d", "id").alias("title"))
    table = L.build_vector_table(docs, root, buckets=16)
    rows = {r.doc_id: r.title for r in table.collect()}
    assert len(rows) == 400 and "__bucket" not in table.columns
    first = store.versions(spark, root)[0]
    assert len(first.buckets) == 16 and set(first.buckets.values()) == {first.path}

    new = spark.createDataFrame([("7", "seven"), ("x", "new"), ("7", "seven")], "doc_id string, title string")
    touched = {r.b for r in new.select(F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("string").alias("b")).collect()}
    table = L.build_vector_table(new, root, mode="upsert")
    rows |= {"7": "seven", "x": "new"}
    assert {r.doc_id: r.title for r in table.collect()} == rows and table.count() == 401
    base, *newer = store.versions(spark, root)
    changed, found = store._changed(spark, base, newer)
    assert found == touched and len(touched) < 3
    # the join reads nothing of the other folders
    assert {f.split("__bucket=")[1].split("/")[0] for f in changed.inputFiles()} == touched

    before = set(store._part(spark, base, base.buckets.keys() - touched).inputFiles())
    compact = L.compact_vectors(spark, root)
    assert {r.doc_id: r.title for r in compact.collect()} == rows and compact.columns == table.columns
    now = store.versions(spark, root)
    assert len(now) == 1 and {b for b, f in now[0].buckets.items() if f != base.path} == touched
    assert before < set(compact.inputFiles())
    assert L.unused_folders(spark, root) == [newer[0].path]
    # a second round on top of the compacted table
    again = L.build_vector_table(new.limit(1).withColumn("title", F.lit("again")), root, mode="upsert")
    assert {r.doc_id: r.title for r in again.collect()} == rows | {"7": "again"}


def test_empty_and_whole_upserts_with_buckets(spark, tmp_path):
    root = str(tmp_path / "buckets")
    docs = spark.range(30).select(F.col("id").cast("string").alias("doc_id"), F.lit("text").alias("title"))
    L.build_vector_table(docs, root, buckets=4)
    L.build_vector_table(docs.limit(0), root, mode="upsert")
    assert L.read_vectors(spark, root).count() == 30
    L.build_vector_table(docs.withColumn("title", F.lit("other")), root, mode="upsert")
    assert L.read_vectors(spark, root).where("title = 'other'").count() == 30
    assert L.compact_vectors(spark, root).where("title = 'other'").count() == 30
    assert L.compact_vectors(spark, root).count() == 30


def _shuffled(spark, df):
    """Columns of the rows that exchanges of the plan move."""
    plan = df._jdf.queryExecution().executedPlan()
    found, todo = [], [plan]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.inputPlan())
        if node.nodeName() == "Exchange":
            out = node.output()
            found.append({out.apply(i).name() for i in range(out.size())})
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_documents_are_dealt_before_they_are_embedded(spark, corpus, tmp_path, monkeypatch):
    built = []
    monkeypatch.setattr(store, "_written", lambda df, *a, real=store._written: built.append(df) or real(df, *a))
    table = L.build_vector_table(corpus, str(tmp_path / "few"), dim=4, buckets=4)
    moved = _shuffled(spark, built[0])
    assert len(moved) == 1 and "title" in moved[0] and not moved[0] & {"embedding", "embedded_text", "__text"}
    assert {r.doc_id: r.embedded_text for r in table.collect()} == {
        r.doc_id: r.embedded_text for r in L.with_vectors(corpus, dim=4).collect()}


def test_compaction_moves_ids_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "BROADCAST_BYTES", 4 * 64)  # several passes
    root = str(tmp_path / "buckets")
    docs = spark.range(60).selectExpr("IF(id = 59, NULL, CAST(id AS string)) AS doc_id", "concat('title ', id) AS title")
    L.build_vector_table(docs, root, dim=4, buckets=3)
    written, merged = [], store._dealt
    monkeypatch.setattr(store, "_dealt", lambda *a: written.append(a[3:]) or merged(*a))
    for n in range(5):
        new = [("7", f"seven {n}"), ("7", f"other {n}"), (f"x{n}", "new"), (None, f"none {n}"), (None, f"no {n}"), ("8", f"eight {n}")]
        for some in (new[:4], new[3:]):
            L.build_vector_table(spark.createDataFrame(some, "doc_id string, title string"), root, mode="upsert", dim=4)
        read = sorted((r.doc_id or "", r.title, r.embedded_text) for r in L.read_vectors(spark, root).collect())
        monkeypatch.setattr(store, "MOST_FILES", 32 if n < 3 else 0)  # then all buckets are crowded
        before = len(written)
        compact = L.compact_vectors(spark, root)
        assert sorted((r.doc_id or "", r.title, r.embedded_text) for r in compact.collect()) == read
        assert set(written[before:]) == ({("embedding",)} if n >= 3 else set())  # only rows of crowded buckets are dealt anew


def test_compaction_does_not_shuffle_the_table(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "buckets")
    docs = spark.range(50).selectExpr("CAST(id AS string) AS doc_id", "concat('title ', id) AS title")
    L.build_vector_table(docs, root, dim=4, buckets=2)
    L.build_vector_table(docs.limit(5).withColumn("title", F.lit("new")), root, mode="upsert", dim=4)
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    plans, save = [], type(docs).write.fget
    monkeypatch.setattr(type(docs), "write", property(lambda df: plans.append(_shuffled(spark, df)) or save(df)))
    spark.conf.set(threshold, "-1")  # as with a table whose ids Spark reckons too many
    try:
        compact = L.compact_vectors(spark, root)
    finally:
        spark.conf.unset(threshold)
    assert plans and not [m for found in plans for m in found if "embedding" in m]
    assert compact.where("title = 'new'").count() == 5 and compact.count() == 50
