from pyspark.sql import functions as F

import lectern as L
from lectern.rules import FIELD_WORDS, INTENT_PATTERNS

DIRECT, SPREAD, SINGLE, CHUNKED = "direct_aggregation", "aggregation_plus_llm", "knn_single", "knn_chunked"

CASES = [
    ("List all locations", "enumeration", "location_name", DIRECT, 0.95),
    ("  LIST ALL\tLOCATIONS \n", "enumeration", "location_name", DIRECT, 0.95),
    ("Summarize all activities", "enumeration", "activity_name", DIRECT, 0.95),
    ("What are the key deployment activities?", "enumeration", "activity_name", DIRECT, 0.95),
    ("Distribution of activity types", "distribution", "activity_name", SPREAD, 0.9),
    ("distribution of activity_type", "distribution", "activity_type", SPREAD, 0.9),
    ("List all equipment types", "enumeration", "form_type", DIRECT, 0.95),
    ("Predict maintenance needs", "unknown", None, SINGLE, 0.4),
    ("Top 5 most frequent locations", "top_n", "location_name", DIRECT, 0.95),
    ("ten small cats", "enumeration", None, SINGLE, 0.4),
    ("how many sites", "count", "location_name", DIRECT, 0.95),
    ("how much", "count", None, SINGLE, 0.4),
    ("total count", "count", None, SINGLE, 0.4),
    ("least used asset", "top_n", "equipment_name", DIRECT, 0.95),
    ("ranked by size", "top_n", None, SINGLE, 0.4),
    ("breakdown by colour", "distribution", None, SINGLE, 0.4),
    ("grouped by status", "distribution", "status", SPREAD, 0.9),
    ("analyze losses", "analytical", None, CHUNKED, 0.9),
    ("dig into losses", "analytical", None, CHUNKED, 0.9),
    ("red vs. blue", "comparison", None, CHUNKED, 0.9),
    ("dissimilarities between red and blue", "comparison", None, CHUNKED, 0.9),
    ("time series", "trend", None, CHUNKED, 0.9),
    ("rising prices", "trend", None, CHUNKED, 0.9),
    ("prospects for trade", "prediction", None, CHUNKED, 0.9),
    ("what is next", "prediction", None, CHUNKED, 0.9),
    ("what was said", "lookup", None, SINGLE, 0.85),
    ("how do they fly", "lookup", None, SINGLE, 0.85),
    ("find a boat", "search", None, SINGLE, 0.85),
    ("find", "unknown", None, SINGLE, 0.4),
    ("particulars about boats", "detail", None, SINGLE, 0.85),
    ("recap of boats", "summary", None, CHUNKED, 0.9),
    ("high-lights of boats", "summary", None, CHUNKED, 0.9),
    ("latest boats", "recent", None, SINGLE, 0.85),
    ("today's boats", "recent", None, SINGLE, 0.85),
    ("linked with boats", "related", None, SINGLE, 0.85),
    ("regarding boats", "related", None, SINGLE, 0.85),
    ("statuses", "unknown", "status", SINGLE, 0.5),
    ("typeset", "unknown", None, SINGLE, 0.4),
    ("every café", "enumeration", None, SINGLE, 0.4),
    ("highest éclat", "top_n", None, SINGLE, 0.4),
    ("éarea", "unknown", None, SINGLE, 0.4),
    ("origin_type", "unknown", "source_type", SINGLE, 0.5),
    ("origin_types", "unknown", None, SINGLE, 0.4),
    ("", "unknown", None, SINGLE, 0.4),
]


def test_routes(spark):
    asked = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "qid int, query string")
    rows = L.route(asked).orderBy("qid").collect()
    for row, (query, *want) in zip(rows, CASES):
        assert [row.intent, row.enum_field, row.strategy, row.confidence] == want, query


def test_routing_needs_no_shuffle(spark):
    plan = L.route(spark.createDataFrame([(1, "x")], "qid int, query string"))._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_rule_sizes():
    assert len(INTENT_PATTERNS) == 14 and sum(map(len, INTENT_PATTERNS.values())) == 227
    assert len(FIELD_WORDS) == 94


def test_question_checks(spark):
    rows = [
        (1, " hi ", None, {"form_type": " a ", "other": "x", "source_type": " "}),
        (2, " \t", "answer", {}),
        (3, "hi", "Shout", None),
        (4, "hi", " PREDICT ", {}),
    ]
    asked = spark.createDataFrame(rows, "qid int, query string, mode string, filters map<string,string>")
    out = {r.qid: r for r in L.check_questions(asked).collect()}
    assert (out[1].query, out[1].mode, out[1].filters, out[1].problem) == ("hi", "answer", {"form_type": "a"}, None)
    assert out[2].problem and out[3].problem == "Invalid mode: shout"
    assert out[4].mode == "predict" and out[4].problem is None and out[3].filters == {}


def test_parse_filters(spark):
    row = spark.range(1).select(
        L.parse_filters(F.array(*[F.lit(x) for x in ("a=b", "c=d=e", "none", "a=z", "f=", "=g")])).alias("f")
    ).first()
    assert row.f == {"a": "z", "c": "d=e", "f": "", "": "g"}
