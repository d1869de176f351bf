import random

import pytest
from test_routing import CASES

import lectern as L
from lectern.rules import FIELD_WORDS

ASKED = "qid int, query string"


def fields(questions, rules, **how):
    return {r.qid: r.enum_field for r in L.resolve_by_rules(questions, rules, **how).collect()}


@pytest.mark.parametrize("how", [{}, {"rule_rows": 1}, {"rule_bytes": 100, "salts": 3}])
def test_same_as_one_branch_for_each(spark, how):
    rng = random.Random(5)
    words = [*FIELD_WORDS, "of", "all", "é", "typeset", "sites-of", "x_y"]
    texts = [c[0] for c in CASES] + [rng.choice(["", " ", "-", ", "]).join(rng.choices(words, k=rng.randrange(7))) for _ in range(300)]
    asked = spark.createDataFrame(list(enumerate(texts)), ASKED)
    want = {r.qid: r.enum_field for r in L.resolve_field(asked).collect()}
    assert fields(asked, FIELD_WORDS, **how) == want and len(set(want.values())) > 7


@pytest.mark.parametrize("how", [{}, {"rule_rows": 1}])
def test_fifty_thousand_words(spark, how):
    rng = random.Random(6)
    rules = {f"word{i}": f"column{i % 977}" for i in range(50_000)} | {f"word{i} of word{i + 1}": "phrase" for i in range(9)}
    texts = [" ".join(rng.choices([f"Word{i}" for i in range(0, 60_000, 7)] + ["of", "the"], k=rng.randrange(1, 9))) for _ in range(400)]
    asked = spark.createDataFrame(list(enumerate(texts)), ASKED)
    order = {w: i for i, w in enumerate(rules)}
    hits = [min((order[w] for w in t.lower().split() if w in order), default=None) for t in texts]
    names = list(rules.values())
    assert fields(asked, rules, **how) == {i: None if h is None else names[h] for i, h in enumerate(hits)}
    plan = L.resolve_by_rules(asked, rules, **how)._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" not in plan and plan.count("word4999") == 0 and len(plan) < 20_000


def test_phrases_and_order(spark):
    rules = spark.createDataFrame(
        [("b", "late", 9), ("new york", "city", 2), ("york", "shire", 3), ("new york", "other", 2), (" B ", "early", 1), ("-x", "no", 0),
         (None, "no", 0), ("york", None, 0), ("c", "no", None), ("r&d-lab", "unit", 5), ("ÉTÉ", "season", 7)],
        "word string, column string, place int")
    texts = ["New  York", "in New York.", "a b c", "x", "-x", "newyork", "the R&D-Lab", "r&d lab", "en été!", None, "", "  ", "new york"]
    asked = spark.createDataFrame([(i, t, "old", {"a": "b"}) for i, t in enumerate(texts)],
                                  "qid int, query string, enum_field string, filters map<string,string>")
    want = ["shire", "city", "early", None, None, None, "unit", None, "season", None, None, None, "city"]
    assert fields(asked, rules) == dict(enumerate(want)) == fields(asked, rules, rule_rows=0)
    out = L.resolve_by_rules(asked, rules)
    assert sorted(out.columns) == sorted(asked.columns)
    assert set(fields(asked, rules.limit(0)).values()) == {None} and fields(asked.limit(0), rules) == {}


def test_repeated_questions_stay(spark):
    asked = spark.range(5000).selectExpr("id AS qid", "IF(id % 3 = 0, 'all sites', concat('risk ', id % 7)) AS query")
    got = L.resolve_by_rules(asked, FIELD_WORDS).groupBy("enum_field").count().collect()
    assert {r.enum_field: r["count"] for r in got} == {"location_name": 1667, "status": 3333}
