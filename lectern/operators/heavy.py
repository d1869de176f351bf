"""The most frequent of very many values, exactly, without shuffling all of them.

Every task keeps a bounded summary of its values (Misra-Gries: where it overflows, the first count beyond it is taken off all others and
added to the task's error), so a value's merged count is at most the sum of the errors too low. With the n-th
greatest merged count as bar, a value further below it than that error can't be among the first n. What is left is counted
again, exactly, in a second pass. Where the error reaches the bar, as with values that are all about equally
frequent, summaries can't tell values apart; then all values are counted by a shuffle, as :func:`terms_agg` does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.aggregates import terms_agg
from lectern.plans.sizing import broadcast_within, staged, top_per_group

SUMMARY = 20_000  # values a task keeps
CANDIDATE_BYTES = 256


def _cut(table: pa.Table, keep: int) -> tuple[pa.Table, int]:
    """The ``keep`` most frequent of distinct values, and what was taken off their counts."""
    if table.num_rows <= keep:
        return table, 0
    count = table["count"].to_numpy()
    off = int(np.partition(count, len(count) - keep - 1)[len(count) - keep - 1])  # the greatest count beyond them
    left = pa.table({"value": table["value"], "count": pa.array(count - off)})
    return left.filter(pa.array(count > off)).combine_chunks(), off


def summarised(values: DataFrame, keep: int = SUMMARY) -> DataFrame:
    """``value, count, error`` of every task's summary of the one string column of ``values``; nulls don't count.

    A row without a value has the task's error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = pa.table({"value": pa.array([], pa.string()), "count": pa.array([], pa.int64())})
        error = 0
        for batch in batches:
            column = batch.column(0).drop_null().cast(pa.string())
            ones = pa.table({"value": column, "count": pa.array(np.ones(len(column), np.int64))})
            both = pa.concat_tables([kept, ones]).group_by("value").aggregate([("count", "sum")])
            kept, off = _cut(both.rename_columns({"value": "value", "count_sum": "count"}), keep)
            error += off
        zero = pa.array(np.zeros(kept.num_rows, np.int64))
        yield pa.RecordBatch.from_pydict({"value": pa.array([None], pa.string()), "count": pa.array([0], pa.int64()), "error": pa.array([error], pa.int64())})
        for part in kept.append_column("error", zero).to_batches():
            yield part

    return values.mapInArrow(run, "value string, count bigint, error bigint")


def top_values(df: DataFrame, field: str, n: int, keep: int = SUMMARY) -> DataFrame:
    """What ``terms_agg(df, field, n)`` gives: ``value, count, rk`` of the ``n`` most frequent values, ties by value."""
    values = df.select(F.col(field).cast("string").alias("value"))
    merged = staged(summarised(values, keep).groupBy("value").agg(F.sum("count").alias("count"), F.sum("error").alias("error")), "summaries")
    error = merged.agg(F.coalesce(F.sum("error"), F.lit(0))).first()[0]
    first = merged.where("value is not null").orderBy(F.desc("count")).limit(n).agg(F.min("count"), F.count("*")).first()
    bar = first[0] if first[1] == n else 0
    if error and error >= bar:
        return terms_agg(df, field, n)
    near = merged.where(F.col("value").isNotNull() & (F.col("count") >= bar - error)).select("value")
    if not error:  # nothing was cut: the merged counts are exact
        return _first(merged.where("value is not null").select("value", "count"), n)
    counts = values.join(broadcast_within(near, near.count(), CANDIDATE_BYTES), "value").groupBy("value").agg(F.count(F.lit(1)).alias("count"))
    return _first(counts, n)


def _first(counts: DataFrame, n: int) -> DataFrame:
    """The first ``n`` of counted values, numbered."""
    return top_per_group(counts.withColumn("all", F.lit(0)), ["all"], [F.desc("count"), F.asc("value")], n, spread_on=["value"]).select(
        "value", "count", "rk")
