import pytest
from pyspark.sql import functions as F

import lectern as L
from lectern.operators import synthesis
from lectern.rules import MODE_INSTRUCTIONS

QUESTION = "qid bigint, query string, mode string, filters map<string,string>"


def chunk_rows(qid, n):
    return [(qid, "why", "answer", i, n, f"[Source {i}] (score: 0.5)\nPart {i} of {qid}. More.") for i in range(1, n + 1)]


def test_synthesis_by_number_of_chunks(spark):
    rows = [r for q, n in ((1, 1), (2, 3), (3, 4), (4, 8)) for r in chunk_rows(q, n)]
    chunks = spark.createDataFrame(
        rows, "qid bigint, query string, mode string, chunk_no int, n_chunks int, chunk string"
    )

    def number(prompts):
        # what kind of prompt it was and which parts it saw
        out = []
        for p in prompts:
            kind = "final" if "last share" in p else "part" if "this is number" in p else "whole"
            out.append(f"{kind}:{p.count('(Share ')}")
        return out

    got = {r.qid: r.answer for r in L.synthesize(chunks, number).collect()}
    line = "\n\n---\n\n"
    assert got == {1: "whole:0", 2: line.join(["part:0", "part:0", "final:2"]), 3: "final:3", 4: "final:7"}


def test_default_generator_cites(spark):
    prompt = (
        f"do\n\n{synthesis.PASSAGES}\n[Source 1] (score: 0.9000)\na: One. Two.\n\n[Source 3] (score: 0.1000)\nb: Three\n\n"
        f"{synthesis.QUESTION}\nq"
    )
    assert synthesis.extract([prompt, "nothing"]) == ["a: One. [Source 1]\nb: Three [Source 3]", ""]


def test_prompts(spark):
    one = spark.range(1).select(
        synthesis.chunk_prompt(
            F.lit("odd"), F.lit("C"), F.lit("Q"), F.lit(2), F.lit(2), F.lit("E"), F.array(F.lit("n1"), F.lit("n2"))
        ).alias("final"),
        synthesis.chunk_prompt(F.lit("odd"), F.lit("C"), F.lit("Q"), F.lit(1), F.lit(2), F.lit("")).alias("part"),
    ).first()
    assert f"{synthesis.WARNINGS}\n- n1\n- n2\n" in one.final and "[Written about shares 1 to 1]\nE\n" in one.final
    assert "[Texts, last share: 2 of 2]\nC\n" in one.final and "2 shares; this is number 1." in one.part
    assert synthesis.WARNINGS not in one.part


class Counting:
    def __call__(self, texts):
        return [[float(t.lower().count("red")), float(t.lower().count("blue")), 1.0] for t in texts]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, f"Paper {i}", "red " * (i % 5) + "blue " * (i % 3) + "end.", "ab"[i % 2], f"L{i % 4}") for i in range(60)]
    rows += [(100 + i, "Copy", "red red blue", "c", "L9") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, title string, description string, form_type string, location_name string")
    return L.with_vectors(docs, Counting(), 3).persist()


@pytest.fixture(scope="module")
def reports(spark, table):
    asked = [
        (1, "List all locations", "analyze", {}),
        (2, "List all locations", "answer", {"form_type": "c"}),
        (3, "Distribution of types", "answer", {}),
        (4, "what is red", "summarize", {}),
        (5, "red " * 30, "answer", {"form_type": " a "}),
        (6, "compare red with blue", "answer", {}),
        (7, "compare red with blue", "predict", {"location_name": "L2"}),
        (8, "compare red with blue", "predict", {"location_name": "nowhere"}),
        (9, "what is red", "answer", {"location_name": "nowhere"}),
        (10, "compare zebras", "answer", {"form_type": " "}),
        (11, "compare zebras", "answer", None),
    ]
    asked += [(12, " ", "answer", {}), (13, "what is red", "shout", {}), (14, "what is red", "answer", {"colour": "x"}),
              (15, "what is red", "answer", {"source_type": "x"}), (16, "compare red", " ", {})]
    made = L.answer_questions(spark.createDataFrame(asked, QUESTION), table, Counting())
    return {r.qid: r for r in made.collect()}


def test_every_question_is_answered_once(reports):
    assert sorted(reports) == list(range(1, 17))


def test_listing(reports):
    r = reports[1]
    assert r.title == "📋 Enumeration: location_name (5 values)" and r.mode == "answer" and r.mode_label == "Enumeration"
    assert "1. **L9** — 40 documents" in r.answer and r.sources == [] and r.metadata.model == "direct-enumeration"
    assert r.metadata.strategy == "direct_enumeration" and r.metadata.aggregation.total_unique == 5
    assert r.metadata.is_enumeration and r.metadata.index_total_docs == 100
    assert "**Total: 1 distinct values**" in reports[2].answer and reports[2].metadata.filters == {"form_type": "c"}


def test_distribution(reports):
    r = reports[3]
    assert "1. c (40 documents) 40.00%" in r.answer and len(r.sources) == 10
    assert r.metadata.aggregation.returned_values == 3 and not r.metadata.is_enumeration


def test_single_pass_answers(reports):
    r = reports[4]
    assert r.title == "📝 Summarize Report: what is red" and r.mode_label == "Summarize"
    assert [s.idx for s in r.sources] == list(range(1, 11)) and r.metadata.total_hits == 10
    assert "[Source 1]" in r.answer and r.metadata.context_chars > 0 and r.metadata.aggregation is None
    odd = reports[5]
    assert odd.mode == "answer" and odd.mode_label == "Answer" and odd.title.endswith("...")
    assert {s.type for s in odd.sources} == {"a"} and odd.metadata.filters == {"form_type": " a "}


def test_chunked_answers(reports):
    r = reports[6]
    # 99 documents with red or blue, or near the question; the 40 copies count once
    assert r.metadata.total_hits > 80 and r.metadata.deduplicated_hits <= r.metadata.total_hits - 39
    assert len(r.sources) == r.metadata.selected_hits == 30
    assert sum(s.title == "Copy" for s in r.sources) == 1
    assert {s.location for s in reports[7].sources} == {"L2"}
    assert reports[7].metadata.total_hits == 15


def test_blank_filters_read_a_page_of_everything(reports):
    # no word matches; the blank filter brings the whole table, at score 1
    assert reports[10].metadata.total_hits == 100 and reports[10].sources[5].score == 1.0
    assert reports[11].metadata.total_hits == 10


def test_questions_without_hits(reports):
    for q in (8, 9):
        r = reports[q]
        assert r.answer.startswith("No relevant documents") and r.sources == [] and r.metadata.total_hits == 0
    assert reports[9].title == "💬 Answer Report: what is red"


def test_optional_sources(spark, table):
    asked = spark.createDataFrame(
        [(1, "List all locations", "answer", {}), (2, "compare red with blue", "answer", {})], QUESTION
    )
    got = {r.qid: r for r in L.answer_questions(
        asked, table, Counting(), dim=3, with_sources=True, max_sources=8, max_buckets=3
    ).collect()}
    assert "## Supporting Sources (10 documents sampled)" in got[1].answer and len(got[1].sources) == 10
    assert got[1].completeness_notes == ["Showing top 3 of 5 values."] and "- Showing top 3 of 5" in got[1].answer
    assert len(got[2].sources) == 8


def test_store(spark, table, tmp_path):
    asked = spark.createDataFrame([(i, f"List all locations {i} " + "x" * 90, "answer", {}) for i in range(5)], QUESTION)
    made = L.answer_questions(asked, table, Counting(), dim=3)
    path = str(tmp_path / "reports")
    ids = L.save_reports(made, path).collect()
    assert len({r.report_id for r in ids}) == 5
    (tmp_path / "reports" / "broken.json").write_text('{"report_id": \n{"title": "half')
    stored = L.read_reports(spark, path)
    assert stored.count() == 5
    one = L.load_report(stored, ids[0].report_id).collect()
    assert len(one) == 1 and one[0].qid == ids[0].qid and one[0].metadata.aggregation.total_unique == 5
    assert L.load_report(stored, "none").count() == 0
    listed = L.list_reports(stored, 3).collect()
    assert len(listed) == 3 and all(len(r["query"]) == 80 and r.timestamp is not None for r in listed)
    L.save_reports(made.limit(1), path)
    assert L.read_reports(spark, path).count() == 6
    L.save_reports(made, str(tmp_path / "p"), "parquet")
    assert L.read_reports(spark, str(tmp_path / "p"), "parquet").count() == 5
    L.save_reports(made, str(tmp_path / "t"), "text")
    assert spark.read.text(str(tmp_path / "t")).where("value like '## Complete%'").count() == 5


def test_bad_questions_get_a_report(reports):
    told = {q: reports[q].answer for q in (12, 13, 14, 15)}
    assert told == {12: "Please enter a query", 13: "Invalid mode: shout", 14: "Unknown filter: colour", 15: "Unknown filter: source_type"}
    assert all(reports[q].sources == [] and reports[q].metadata.strategy == "refused" for q in told)
    assert reports[12].completeness_notes == [told[12]] and reports[16].sources


def test_no_questions_no_reports(spark, table):
    none = L.answer_questions(spark.createDataFrame([], QUESTION), table, Counting())
    one = L.answer_questions(spark.createDataFrame([(1, "", "answer", {})], QUESTION), table, Counting())
    assert none.count() == 0 and none.columns == one.columns and one.count() == 1


def test_unread_parts_are_told_and_not_cited(spark, table):
    asked = spark.createDataFrame([(1, "compare red with blue", "answer", {})], QUESTION)
    whole = L.answer_questions(asked, table, Counting(), chunk_chars=200, max_chunks=None).first()
    cut = L.answer_questions(asked, table, Counting(), chunk_chars=200, max_chunks=2).first()
    assert whole.completeness_notes == [] and len(whole.sources) == 30
    assert cut.completeness_notes[0].endswith("parts of the documents found were not read")
    read = {s.idx for s in cut.sources}
    assert 0 < len(read) < 30 and read == set(range(1, len(read) + 1))
    assert cut.metadata.context_chars < whole.metadata.context_chars and cut.metadata.selected_hits == len(read)


def test_generator_is_called_once_per_prompt(spark, table, tmp_path):
    asked = spark.createDataFrame(
        [(1, "what is red", "answer", {}), (2, "Distribution of types", "answer", {}), (3, "compare red with blue", "answer", {})], QUESTION)

    def noted(prompts):
        import uuid
        for p in prompts:
            (tmp_path / uuid.uuid4().hex).write_text(p)
        return ["text"] * len(prompts)

    made = L.answer_questions(asked, table, Counting(), noted, chunk_chars=10_000)
    made.collect()
    made.select("answer", "sources").collect()
    prompts = [f.read_text() for f in tmp_path.iterdir()]
    assert len(prompts) == len(set(prompts)) == 3
    assert made.first().metadata.generation_time > 0


def test_another_length_of_vectors_is_an_error(spark, table):
    asked = spark.createDataFrame([(1, "what is red", "answer", {})], QUESTION)
    with pytest.raises(Exception, match="numbers where|length"):
        L.answer_questions(asked, table, dim=8).collect()


def test_modes_are_stripped_and_folded(spark, table):
    asked = spark.createDataFrame(
        [(1, " compare red with blue ", " Analyze ", {}), (2, "what is red", "  ", {"colour": " "}), (3, "Distribution of types", "PREDICT", {})], QUESTION)
    prompts = lambda texts: list(texts)
    got = {r.qid: r for r in L.answer_questions(asked, table, Counting(), prompts, chunk_chars=10_000).collect()}
    assert [(got[q].mode, got[q].mode_label) for q in (1, 2, 3)] == [("analyze", "Analyze"), ("answer", "Answer"), ("predict", "Predict")]
    for q, mode in ((1, "analyze"), (2, "answer"), (3, "predict")):
        assert MODE_INSTRUCTIONS[mode] in got[q].answer
    assert got[1].query == "compare red with blue" and got[2].metadata.strategy == "knn_single"


def test_a_save_that_is_run_again_adds_nothing(spark, table, tmp_path):
    path = str(tmp_path / "saved")
    asked = spark.createDataFrame([(i, f"List all locations {i}", "answer", {}) for i in range(4)], QUESTION)
    made = L.answer_questions(asked, table, Counting(), dim=3)
    first = {r.qid: r.report_id for r in L.save_reports(made, path, run="monday").collect()}
    again = {r.qid: r.report_id for r in L.save_reports(made, path, run="monday").collect()}
    assert first == again and len(set(first.values())) == 4
    assert L.read_reports(spark, path).count() == 4 and L.read_manifest(spark, path).count() == 1
    # a run that failed half-way left files, but no line in the manifest
    half = L.read_reports(spark, path).limit(2)
    half.write.json(f"{path}/run=tuesday")
    assert L.newest_reports(spark, path, 50).count() == 4
    assert L.find_report(spark, path, "tuesday.x").count() == 0
    L.save_reports(made, path, run="tuesday")
    L.save_reports(made, path, run="tuesday")
    assert L.read_reports(spark, path).count() == 8 == L.newest_reports(spark, path, 50).count()


def test_lookups_read_only_the_runs_that_can_hold_them(spark, table, tmp_path):
    path = str(tmp_path / "saved")
    asked = spark.createDataFrame([(i, f"List all locations {i}", "answer", {}) for i in range(3)], QUESTION)
    made = L.answer_questions(asked, table, Counting(), dim=3)
    assert L.newest_reports(spark, path).count() == 0
    for run in ("a", "b", None):
        ids = L.save_reports(made, path, run=run).collect()
    L.save_reports(made.limit(0), path, run="empty")
    runs = lambda df: {f.split("run=")[1].split("/")[0] for f in df.inputFiles()}
    newest = L.newest_reports(spark, path, 4)
    assert newest.count() == 4 and runs(newest) == {"b", ids[0].report_id.split(".")[0]}
    whole = L.list_reports(L.read_reports(spark, path), 4).collect()
    assert {r.report_id for r in newest.collect()} == {r.report_id for r in whole}
    one = L.find_report(spark, path, ids[1].report_id)
    assert [r.qid for r in one.collect()] == [ids[1].qid] and runs(one) == {ids[1].report_id.split(".")[0]}
    assert L.find_report(spark, path, "b.none").count() == 0 and L.find_report(spark, path, "none").count() == 0
