"""Distinct counts that add up: stored sketches of the values of each field.

A sketch has a few kilobytes, whatever the number of rows; sketches of parts are merged into one of the whole, so that a new version of a
table only sketches its new rows. Counts are estimates: their relative standard error is ``1.04 / sqrt(2 ** precision)``, and
:func:`sketch_counts` gives it with each count. Values that were replaced or removed stay counted until the table is sketched anew.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRECISION = 14  # an error of 0.8 %
SKETCH = "field string, precision int, version bigint, sketch binary"


def field_sketches(df: DataFrame, fields: Sequence[str], version: int = 0, precision: int = PRECISION) -> DataFrame:
    """``field, precision, version, sketch`` of each field's values, in one scan; nulls don't count."""
    each = df.agg(*[F.hll_sketch_agg(F.col(f).cast("string"), F.lit(precision)).alias(f) for f in fields])
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("sketch")) for f in fields])
    return each.select(F.inline(rows)).select(
        "field", F.lit(precision).alias("precision"), F.lit(version).cast("bigint").alias("version"), "sketch")


def save_sketches(sketches: DataFrame, root: str) -> str:
    """Append sketches to the table at ``root``; rows of a version that is saved again count once, as merging equal values does."""
    path = f"{root}/sketches"
    sketches.withColumn("batch", F.lit(uuid.uuid4().hex)).write.mode("append").parquet(path)
    return path


def read_sketches(spark: SparkSession, root: str, since: int | None = None) -> DataFrame:
    """Stored sketches, or those of versions from ``since`` on."""
    found = spark.read.schema(SKETCH).parquet(f"{root}/sketches")
    return found if since is None else found.where(F.col("version") >= since)


def merged_sketches(sketches: DataFrame) -> DataFrame:
    """One sketch a field, of the values of all its versions."""
    return sketches.groupBy("field").agg(
        F.min("precision").alias("precision"), F.max("version").alias("version"), F.hll_union_agg("sketch", F.lit(True)).alias("sketch"))


def sketch_counts(sketches: DataFrame) -> DataFrame:
    """``field, total_unique, error``: estimated distinct values and their relative standard error."""
    one = merged_sketches(sketches)
    return one.select(
        "field", F.hll_sketch_estimate("sketch").alias("total_unique"), (1.04 / F.sqrt(F.pow(F.lit(2.0), F.col("precision")))).alias("error"))
