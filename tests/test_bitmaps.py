import random

import pytest
from pyspark.sql import functions as F

import lectern as L
from lectern.operators import aggregates as agg
from lectern.operators import bitmaps as B

FIELDS = ["kind", "place", "size", "rare"]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "b", None, ""]), rng.choice(["x", " y", "É"]), rng.randrange(5), f"r{i % 700}") for i in range(5000)]
    # a third has the same values, and the rows span several blocks of bits
    rows += [(i, "hot", "x", 1, "hot") for i in range(5000, 7500)]
    docs = spark.createDataFrame(rows, "doc_id int, kind string, place string, size int, rare string").repartition(5).cache()
    return docs, L.build_value_index(docs, str(tmp_path_factory.mktemp("values") / "v"), FIELDS)


def specs(spark, asked):
    rows = [(str(i), filters, FIELDS) for i, filters in enumerate(asked)]
    return spark.createDataFrame(rows, "spec string, filters map<string,string>, fields array<string>")


ASKED = [{}, {"kind": "a"}, {"kind": "a", "place": "É"}, {"size": "03"}, {"size": "3", "kind": "b", "place": "x"}, {"kind": "none"}, {"size": "x"},
         {"kind": "hot", "rare": "hot"}, {"rare": "r7", "size": "2"}]


def test_counts_of_conjunctions(spark, built):
    docs, index = built
    got = {(r.spec, r.field, r.value): r["count"] for r in B.value_counts(index, specs(spark, ASKED)).collect()}
    want = {}
    for i, filters in enumerate(ASKED):
        for f in FIELDS:
            for r in L.apply_filters(docs, filters).where(F.col(f).isNotNull()).groupBy(F.col(f).cast("string").alias("v")).count().collect():
                want[str(i), f, r.v] = r["count"]
    assert got == want
    assert index.table(spark).select("block").distinct().count() > 3


def test_facets_and_lists_without_the_documents(spark, built):
    docs, index = built
    limits = {"kind": 10, "size": 3, "rare": 50}
    key = lambda found: sorted((r.field, *r.options) for r in found.collect())
    for filters in (None, {"place": "x"}, {"size": "1", "place": " "}):
        found = L.facets(docs, limits, filters, index)
        assert key(found) == key(L.facets(docs, limits, filters))
        assert all("bitmaps" in f for f in found.inputFiles())
    asks = spark.createDataFrame(
        [(1, "kind", {"place": "x"}), (2, "size", {"place": "x"}), (3, "rare", {}), (4, "kind", {"size": "99"})],
        "qid int, enum_field string, filters map<string,string>")
    for mine, plain in zip(agg.terms_for_questions(docs, asks, 20, index=index), agg.terms_for_questions(docs, asks, 20)):
        assert sorted(map(str, mine.collect())) == sorted(map(str, plain.select(mine.columns).collect()))


def test_stored_empty_and_unknown(spark, built, tmp_path):
    docs, index = built
    again = L.load_value_index(spark, index.root)
    assert again == index and again.holds(["kind", "size"]) and not again.holds(["doc_id"])
    with pytest.raises(ValueError, match="not indexed"):
        B.value_counts(index, specs(spark, [{"doc_id": "1"}])).collect()
    none = L.build_value_index(docs.limit(0), str(tmp_path / "none"), FIELDS)
    assert B.value_counts(none, specs(spark, ASKED)).count() == 0
    assert B.value_counts(index, specs(spark, ASKED).limit(0)).count() == 0
