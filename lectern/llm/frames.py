"""Helpers the operators share: schemas of Arrow maps, null-safe row keys, size-checked joins."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.plans.sizing import broadcast_within


def mapped_schema(df: DataFrame, keep: Sequence[str], added: Sequence[T.StructField]) -> T.StructType:
    """Schema of ``keep`` columns of ``df`` followed by ``added``; equal names are refused."""
    clash = sorted(set(keep) & {f.name for f in added})
    if clash:
        raise ValueError(f"columns {clash} are made by this operator; rename the carried ones")
    return T.StructType([df.schema[c] for c in keep] + list(added))


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that a worker holds the Python objects of a few rows only."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)
        pa.default_memory_pool().release_unused()


def text_or_empty(name: str) -> Column:
    """The text column as a string, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def same(left: DataFrame, right: DataFrame, on: Sequence[str]) -> Column:
    """Join condition: equal in every column, nulls equal nulls."""
    condition = F.lit(True)
    for c in on:
        condition = condition & left[c].eqNullSafe(right[c])
    return condition


def joined(left: DataFrame, right: DataFrame, on: Sequence[str], how: str, rows: int | None = None) -> DataFrame:
    """Null-safe join that keeps ``left``'s columns and the rest of ``right``'s.

    ``rows`` is the known number of rows of ``right``; it is broadcast only while that
    number is small, else Spark shuffles both sides.
    """
    renamed = right.select(*[F.col(c).alias(f"__r_{c}" if c in on else c) for c in right.columns])
    if rows is not None:
        renamed = broadcast_within(renamed, max(rows, 1), 64)
    condition = F.lit(True)
    for c in on:
        condition = condition & left[c].eqNullSafe(renamed[f"__r_{c}"])
    out = left.join(renamed, condition, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"__r_{c}" for c in on])
