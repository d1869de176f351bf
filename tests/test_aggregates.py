import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

import lectern as L
from lectern.operators import aggregates as agg


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "abcde"[i % 5] if i % 7 else None, "xy"[i % 2], i % 3) for i in range(70)]
    return spark.createDataFrame(rows, "doc_id int, kind string, side string, n int")


def test_counts_skip_nulls_and_break_ties_by_value(docs):
    rows = L.terms_agg(docs, "kind").collect()
    assert [r.value for r in rows] == ["a", "b", "c", "d", "e"] and sum(r["count"] for r in rows) == 60


def test_blank_filters_are_ignored(docs):
    all_rows = L.apply_filters(docs, {"side": "  ", "kind": None}).count()
    assert all_rows == 70 and L.apply_filters(docs, {"side": " x ", "n": "1"}).count() == 11


def test_unknown_columns_fail(docs):
    with pytest.raises(AnalysisException):
        L.apply_filters(docs, {"nope": "1"}).count()
    with pytest.raises(AnalysisException):
        L.terms_agg(docs, "nope").count()


def test_filter_reaches_the_scan(docs, spark, tmp_path):
    docs.write.parquet(str(tmp_path / "d"))
    plan = L.terms_agg(spark.read.parquet(str(tmp_path / "d")), "kind", filters={"n": "1"})
    text = plan._jdf.queryExecution().toString()
    assert "EqualTo(n,1)" in text and "ReadSchema: struct<kind:string,n:int>" in text


@pytest.mark.parametrize("cap, complete, exact, returned", [(6, True, True, 5), (5, False, True, 5), (4, False, False, 4)])
def test_completeness(docs, cap, complete, exact, returned):
    asks = docs.sparkSession.createDataFrame([(1, "kind", {})], "qid int, enum_field string, filters map<string,string>")
    lists, sums = agg.terms_for_questions(docs, asks, cap)
    row = sums.first()
    assert (row.total_unique, row.returned, row.is_complete, row.is_exact_complete) == (5, returned, complete, exact)
    assert lists.count() == returned
    assert row.notes == ([] if complete else [f"Showing top {returned} of 5 values."])


def test_many_questions_share_lists(docs, spark):
    asks = [
        (1, "kind", {}), (2, "kind", {"side": " x"}), (3, "kind", {"side": "x", "n": ""}), (4, "n", {"side": "y", "n": "2"}),
        (5, "kind", {"side": "none"}), (6, "side", {}),
    ]
    asked = spark.createDataFrame(asks, "qid int, enum_field string, filters map<string,string>")
    lists, sums = agg.terms_for_questions(docs, asked)
    keyed = agg.with_spec(asked)
    joined = keyed.join(lists, (keyed.spec == lists.spec) & (keyed.enum_field == lists.field))
    got = {q: {r.value: r["count"] for r in joined.where(F.col("qid") == q).collect()} for q, *_ in asks}
    for q, field, filters in asks:
        want = {r.value: r["count"] for r in L.terms_agg(docs, field, filters=filters).collect()}
        assert got[q] == want, q
    assert sums.count() == 5  # questions 2 and 3 ask for the same list
    empty = sums.where(F.col("spec").contains("none")).first()
    assert (empty.total, empty.total_unique, empty.is_complete) == (0, 0, True)


def test_long_lists_of_filters_take_the_join(docs, spark, monkeypatch):
    import lectern.operators.filters as filters

    asks = spark.createDataFrame(
        [(i, "kind", {"n": str(i)}) for i in range(3)] + [(9, "kind", {})],
        "qid int, enum_field string, filters map<string,string>",
    )
    short = agg.terms_for_questions(docs, asks)[0].collect()
    monkeypatch.setattr(filters, "IN_LIST_VALUES", 1)
    long = agg.terms_for_questions(docs, asks)[0].collect()
    assert sorted(map(str, short)) == sorted(map(str, long)) and short


def test_lists_longer_than_the_native_limit(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), (F.col("id") % 3000).cast("string").alias("v"))
    asks = spark.createDataFrame([(1, "v", {})], "qid int, enum_field string, filters map<string,string>")
    lists, sums = agg.terms_for_questions(docs, asks, 2000)
    got = [r.value for r in lists.orderBy("rk").collect()]
    assert got == sorted(str(i) for i in range(3000))[:2000] and sums.first().total_unique == 3000


def test_distinct_counts(docs):
    got = {r.field: r.total_unique for r in L.distinct_count(docs, ["kind", "side", "n"]).collect()}
    assert got == {"kind": 5, "side": 2, "n": 3}
    near = {r.field: r.total_unique for r in L.distinct_count(docs, ["kind", "n"], approximate=True).collect()}
    assert near == {"kind": 5, "n": 3}


def test_multi_terms_and_facets(docs):
    rows = L.multi_terms_agg(docs, {"kind": 2, "side": 5}).collect()
    assert {(r.field, r.value, r.rk, r.is_complete) for r in rows} >= {("kind", "a", 1, False), ("side", "x", 1, True)}
    assert len(rows) == 4
    got = {r.field: r.options for r in L.facets(docs, {"kind": 3, "n": 2}).collect()}
    assert got == {"kind": ["a", "b", "c"], "n": ["0", "1"]}


def test_shares_and_coverage(docs, spark):
    rows = L.distribution(docs, "side").collect()
    assert [(r.value, r.percent) for r in rows] == [("x", 50.0), ("y", 50.0)]
    df = spark.createDataFrame([(True, 3, 3), (False, 2, 1000), (False, 99, 100), (False, 0, 0)], "c boolean, r bigint, t bigint")
    got = [r.p for r in df.select(L.coverage_percent(F.col("c"), F.col("r"), F.col("t")).alias("p")).collect()]
    assert got == [100.0, 0.0, 95.0, 0.0]


def test_list_texts(spark):
    one = spark.range(1).select(
        agg.agg_context(F.lit("f"), F.lit("  1. a (1 document)"), F.lit(3), F.lit(1), F.lit(False)).alias("c"),
        agg.enumeration_answer(
            F.lit("f"), F.lit("1. **a** — 1 document"), F.lit(3), F.lit(1), F.lit(False), F.array(F.lit("note")),
            F.lit(1234567), F.lit("ix"), F.lit("- [1] t | l"), F.lit(1),
        ).alias("a"),
    ).first()
    assert one.c == (
        "Complete list of 3 distinct f values found in the index:\n\n  1. a (1 document)\n\n"
        "[NOTE: Showing top 1 of 3 total unique values. List may be incomplete.]"
    )
    assert one.a == (
        "## Complete List of f\n\n**Total: 3 distinct values**\n\n1. **a** — 1 document\n\n"
        "⚠ Showing top 1 of 3 total values. Some values may be missing.\n\n## Data Quality Notes\n\n- note\n\n"
        "_Searched 1,234,567 documents in index 'ix'_\n\n## Supporting Sources (1 documents sampled)\n\n- [1] t | l"
    )
