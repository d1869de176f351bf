"""Embedding a text column with a caller-supplied function."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.batches import in_parts, words

Embed = Callable[[Sequence[str]], Sequence[Sequence[float]]]


class HashedWords:
    """Offline default: word counts hashed into ``dim`` slots, scaled to unit length."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def _slot(self, word: str) -> int:
        return int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % self.dim

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], names=["text"])
        parts = [self._vectors(part.column(0)) for part in in_parts([batch])]
        return np.concatenate(parts) if parts else np.zeros((0, self.dim))

    def _vectors(self, texts: pa.Array) -> np.ndarray:
        row, flat = words(texts)
        coded = flat.dictionary_encode()
        slot = np.array([self._slot(w) for w in coded.dictionary.to_pylist()], dtype=np.int64)
        cell = row.astype(np.int64) * self.dim + slot[coded.indices.to_numpy()]
        counts = np.bincount(cell, minlength=len(texts) * self.dim).reshape(len(texts), self.dim).astype(float)
        norm = np.linalg.norm(counts, axis=1, keepdims=True)
        return np.divide(counts, norm, out=counts, where=norm > 0)


def embed_table(
    df: DataFrame,
    embed: Embed | None = None,
    dim: int = 64,
    text_col: str = "text",
    vector_col: str = "embedding",
    batch_size: int = 256,
    strict: bool = False,
) -> DataFrame:
    """Adds ``vector_col`` and ``embed_ok``.

    Only the text goes to Python, in Arrow batches; ``embed`` gets up to ``batch_size``
    texts at a time. A call that fails is repeated on its halves, down to single texts; a
    text that fails alone gets a zero vector and ``embed_ok`` false, and zero vectors never
    enter a search. A vector of the wrong length is a failure. With ``strict`` a failure
    fails the job, as it should for questions.
    """
    embed = embed or HashedWords(dim)

    def attempt(texts: list[str]) -> tuple[list, list[bool]]:
        try:
            found = [np.asarray(v, np.float32) for v in embed(texts)]
            if len(found) == len(texts) and all(v.shape == (dim,) for v in found):
                return found, [True] * len(texts)
            problem = ValueError(f"embedding is not {len(texts)} vectors of length {dim}")
        except Exception as e:
            problem = e  # the halves are tried again below
        if strict:
            raise problem
        if len(texts) == 1:
            return [np.zeros(dim, np.float32)], [False]
        half = len(texts) // 2
        first, rest = attempt(texts[:half]), attempt(texts[half:])
        return first[0] + rest[0], first[1] + rest[1]

    @F.arrow_udf("struct<vector:array<float>,ok:boolean>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for at in range(0, len(texts), batch_size):  # a result batch for each call: Spark's own have up to 10,000 rows
                found, good = attempt(pc.fill_null(texts.slice(at, batch_size), "").to_pylist())
                flat = pa.array(np.concatenate(found), pa.float32())
                ends = pa.array(np.arange(len(found) + 1, dtype=np.int32) * dim)
                yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, flat), pa.array(good)], ["vector", "ok"])
            pa.default_memory_pool().release_unused()

    # declared non-deterministic so that the optimizer never copies the call, say into a filter
    out = df.withColumn("__embedded", run.asNondeterministic()(F.col(text_col)))
    return out.select(
        *df.columns, F.col("__embedded.vector").alias(vector_col), F.col("__embedded.ok").alias("embed_ok")
    )
