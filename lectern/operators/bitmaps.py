"""Counts under filters from bitmaps: which documents hold a value, one bit each.

For every field, value and block of 32768 documents that holds it there are 4096 bytes of bits. A conjunction of filters is the AND of
its values' bitmaps, and a value's count under it the number of bits left, so lists and facets of any number of questions are
taken without the documents. Every block is worked on by itself; only counts are shuffled.

An index is of one state of the documents. It is meant for fields to filter and list by: one whose values are all different
takes 4096 bytes (mostly zeros, compressed) for each document.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.knn import _as_column_text
from lectern.operators.questions import passes

BLOCK_BYTES = 4096  # of Spark's bitmap functions
ALL = ""  # the field whose one value every document holds


@dataclass(frozen=True)
class ValueIndex:
    """Bitmaps at ``root`` of the fields in ``types``, which has each one's type."""

    root: str
    types: dict[str, str]

    def table(self, spark: SparkSession) -> DataFrame:
        """``field, value, block, bits``."""
        return spark.read.parquet(f"{self.root}/bitmaps")

    def holds(self, fields: Sequence[str]) -> bool:
        return set(fields) <= self.types.keys()


def build_value_index(corpus: DataFrame, root: str, fields: Sequence[str]) -> ValueIndex:
    """Index ``fields`` of every document of ``corpus`` at the new folder ``root``, in one scan. Null holds no value."""
    types = {f: dict(corpus.dtypes)[f] for f in fields}
    held = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]
    every = F.struct(F.lit(ALL).alias("field"), F.lit("").alias("value"))
    place = (F.monotonically_increasing_id() + 1).alias("place")
    rows = corpus.select(place, F.array(every, *held).alias("held")).select("place", F.inline("held")).where("value is not null")
    bits = rows.groupBy("field", "value", F.bitmap_bucket_number("place").alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    bits.sortWithinPartitions("field", "block").write.option("compression", "zstd").parquet(f"{root}/bitmaps")
    spark = corpus.sparkSession
    spark.createDataFrame([(json.dumps(types),)], "types string").coalesce(1).write.parquet(f"{root}/about")
    return ValueIndex(root, types)


def load_value_index(spark: SparkSession, root: str) -> ValueIndex:
    return ValueIndex(root, json.loads(spark.read.parquet(f"{root}/about").first().types))


def value_counts(index: ValueIndex, specs: DataFrame) -> DataFrame:
    """``spec, field, value, count`` of the documents that satisfy each spec.

    ``specs`` has ``spec``, ``filters`` (cleaned) and ``fields``, the fields to count; one row a spec.
    """
    spark = specs.sparkSession
    parts = [_one_pass(index, spark, block) for block in passes(specs.select("spec", "filters", "fields"), key="spec")]
    if not parts:
        return spark.createDataFrame([], "spec string, field string, value string, count bigint")
    counts = reduce(DataFrame.unionByName, parts)
    return counts.groupBy("spec", "field", "value").agg(F.sum("count").alias("count"))


def _one_pass(index: ValueIndex, spark: SparkSession, block: pa.Table) -> DataFrame:
    asked = [(spec, dict(pairs or []), list(fields)) for spec, pairs, fields in zip(*(block[c].to_pylist() for c in ("spec", "filters", "fields")))]
    named = sorted({f for _, filters, fields in asked for f in [*filters, *fields]})
    if not index.holds(named):
        raise ValueError(f"not indexed: {sorted(set(named) - index.types.keys())}")
    shape = spark.createDataFrame([], ", ".join(f"`{f}` {t}" for f, t in index.types.items()) or "none int")
    texts = _as_column_text(shape, {pair for _, filters, _ in asked for pair in filters.items()})
    shared = spark.sparkContext.broadcast(
        [(spec, [(f, texts[f, v]) for f, v in filters.items()], fields) for spec, filters, fields in asked])

    def count(table: pa.Table) -> pa.Table:
        fields, values = table["field"].to_pylist(), table["value"].to_pylist()
        bits = np.frombuffer(b"".join(table["bits"].to_pylist()), np.uint64).reshape(-1, BLOCK_BYTES // 8)
        row_of = {key: i for i, key in enumerate(zip(fields, values))}
        rows_of: dict[str, np.ndarray] = {}
        for f in {f for _, _, wanted in shared.value for f in wanted}:
            rows_of[f] = np.array([i for i, name in enumerate(fields) if name == f], np.int64)
        out: list[tuple[str, str, str, int]] = []
        for spec, pairs, wanted in shared.value:
            held = [row_of.get(pair) for pair in [(ALL, ""), *pairs]]
            if None in held:
                continue
            left = np.bitwise_and.reduce(bits[held], axis=0)
            for f in wanted:
                numbers = np.bitwise_count(bits[rows_of[f]] & left).sum(axis=1)
                out += [(spec, f, values[i], int(n)) for i, n in zip(rows_of[f], numbers) if n]
        columns = list(zip(*out)) or [(), (), (), ()]
        return pa.table({"spec": pa.array(columns[0], pa.string()), "field": pa.array(columns[1], pa.string()),
                         "value": pa.array(columns[2], pa.string()), "count": pa.array(columns[3], pa.int64())})

    table = index.table(spark).where(F.col("field").isin([ALL, *named]))
    return table.groupBy("block").applyInArrow(count, "spec string, field string, value string, count bigint")
