import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import lectern as L
from lectern.operators import heavy as H


def frame(spark, values, parts=4):
    return spark.createDataFrame([(v,) for v in values], "v string").repartition(parts)


def key(found):
    return [tuple(r) for r in found.select("value", "count", "rk").orderBy("rk").collect()]


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(4)
    values = [f"v{int(rng.paretovariate(0.7)) % 5000}" for _ in range(30_000)] + [None] * 500 + [""] * 40 + ["hot"] * 15_000
    return frame(spark, values).cache()


@pytest.mark.parametrize("n,keep", [(10, 50), (10, 300), (100, 20_000), (1, 5)])
def test_same_rows_as_counting_all(spark, skewed, n, keep):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        assert key(L.top_values(skewed, "v", n, keep)) == key(L.terms_agg(skewed, "v", n))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_only_candidates_are_shuffled(spark, skewed):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        parts = H.summarised(skewed, 300).collect()
        found = L.top_values(skewed, "v", 10, 300)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(parts) <= 4 * 301 and sum(r.error for r in parts) > 0
    plan = found._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan or "ResolvedHint (strategy=broadcast)" in plan
    # a summary is never over the true count, and at most the errors under it
    true = Counter(r.v for r in skewed.collect() if r.v is not None)
    merged, error = Counter(), sum(r.error for r in parts)
    for r in parts:
        if r.value is not None:
            merged[r.value] += r["count"]
    assert all(true[v] - error <= merged[v] <= true[v] for v in true)


def test_equally_frequent_values_are_counted_whole(spark):
    values = frame(spark, [f"v{i % 3000}" for i in range(9000)])
    assert key(L.top_values(values, "v", 5, 10)) == key(L.terms_agg(values, "v", 5))


def test_few_values_null_and_empty(spark):
    for values in ([], [None], ["a", "a", "b", None], ["b", "a"]):
        assert key(L.top_values(frame(spark, values), "v", 3)) == key(L.terms_agg(frame(spark, values), "v", 3))
    numbers = spark.range(100).select((F.col("id") % 7).alias("v"))
    assert key(L.top_values(numbers, "v", 3)) == key(L.terms_agg(numbers, "v", 3))
