"""Exact vector search for any number of questions in one scan, skipping rows that can't be among the best.

The rows come from a vector index, so neighbours lie side by side. A task takes them in chunks; those of one list get the
direction of their mean as pivot and are cut into rings of equal distance from it. By the triangle inequality a question at
an angle of ``t`` from the pivot is at least ``t - outer`` and at least ``inner - t`` away from every row of a ring, which bounds their
scores. Each question first meets the ring of its highest bound; the k-th score found there, and in earlier chunks, is the bar
for all others. What is left out scores below k rows that were found, so the result is the full search's.

The questions are written to the shared folder in blocks, and every task goes through them for each of its chunks; neither the driver
nor a task holds more than one block and the bars (one number a question).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import Accumulator
from pyspark.sql import DataFrame

from lectern.functions.batches import BestRows, vectors
from lectern.operators.knn import RANK_DECIMALS
from lectern.operators.vector_index import VectorIndex
from lectern.plans.sizing import staged
from lectern.settings import QUESTIONS_PER_PASS

CHUNK_BYTES = 64 << 20
RING_ROWS = 256
SLACK = 1e-9  # of a bound, for rounding


def rings(x: np.ndarray, lst: np.ndarray, size: int = RING_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order of the rows, start of every ring and the end, pivot, least and greatest angle by ring) of unit vectors."""
    order = np.argsort(lst, kind="stable")
    ends = np.flatnonzero(np.append(lst[order][1:] != lst[order][:-1], True)) + 1
    starts, pivots, reach = [], [], []
    for a, b in zip([0, *ends[:-1]], ends):
        mean = x[order[a:b]].mean(axis=0)
        norm = np.linalg.norm(mean)
        pivot = mean / norm if norm > 1e-9 else x[order[a]]
        angle = np.arccos(np.clip(x[order[a:b]] @ pivot, -1, 1))
        by_angle = np.argsort(angle, kind="stable")
        order[a:b], angle = order[a:b][by_angle], angle[by_angle]
        for low in range(0, b - a, size):
            part = angle[low : low + size]
            starts.append(a + low)
            pivots.append(pivot)
            reach.append((part[0], part[-1]))
    return order, np.array([*starts, len(order)]), np.array(pivots), np.array(reach)


def bounds(asked: np.ndarray, pivots: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Greatest score that a row of each ring can have for each question."""
    angle = np.arccos(np.clip(asked @ pivots.T, -1, 1))
    least = np.maximum(np.maximum(angle - reach[:, 1], reach[:, 0] - angle), 0)
    return (1 + np.cos(least)) / 2 + SLACK


def _best_of_chunk(asked: np.ndarray, x: np.ndarray, ids: pa.Array, cut, best: BestRows) -> int:
    """Offer every row that may count to ``best``; the number of pairs scored."""
    order, start, pivots, reach = cut
    limit = bounds(asked, pivots, reach)
    first = limit.argmax(axis=1)
    pairs = 0
    for seeding in (True, False):
        for ring in range(len(pivots)):
            here = first == ring
            who = np.flatnonzero(here if seeding else ~here & (limit[:, ring] >= best.floor))
            if len(who):
                rows = order[start[ring] : start[ring + 1]]
                best.offer_some(who, (1 + asked[who] @ x[rows].T) / 2, ids.take(pa.array(rows)))
                pairs += len(who) * len(rows)
        best.settle()
    return pairs


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    kept, size = [], 0
    for batch in batches:
        kept.append(batch)
        size += batch.nbytes
        if size >= CHUNK_BYTES:
            yield pa.Table.from_batches(kept)
            kept, size = [], 0
    if kept:
        yield pa.Table.from_batches(kept)


def pivot_search(index: VectorIndex, questions: DataFrame, k: int, counted: Accumulator | None = None) -> DataFrame:
    """``qid``, id and score of every task's best ``k`` rows for each question (``qid, vector``).

    The scores are the exact search's. ``counted`` adds up the pairs scored.
    """
    spark = questions.sparkSession
    table = index.table(spark).select("lst", index.id_col, index.vector_col)
    qid, kind = dict(questions.dtypes)["qid"], dict(table.dtypes)[index.id_col]
    schema = f"qid {qid}, {index.id_col} {kind}, score double"
    blocks = staged(questions.select("qid", "vector"), "questions", rows_per_file=QUESTIONS_PER_PASS)
    files, dim = sorted(blocks.inputFiles()), index.dim
    if not files or not index.rows:
        return spark.createDataFrame([], schema)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors: dict[str, np.ndarray] = {}
        for chunk in _chunks(batches):
            kept, x = vectors(chunk.column(2).combine_chunks(), dim)
            if not len(kept):
                continue
            ids = chunk.column(1).combine_chunks().take(pa.array(kept))
            cut = rings(x, chunk.column(0).to_numpy()[kept])
            for file in files:
                disk, path = pyarrow.fs.FileSystem.from_uri(file)
                block = pq.read_table(path, filesystem=disk, partitioning=None)
                rows, asked = vectors(block["vector"].combine_chunks(), dim)
                best = BestRows(len(rows), k, RANK_DECIMALS)
                best.floor = floors.get(file, best.floor)
                pairs = _best_of_chunk(asked, x, ids, cut, best)
                floors[file] = best.floor
                if counted is not None:
                    counted.add(pairs)
                yield from best.result(block["qid"].combine_chunks().take(pa.array(rows)), index.id_col)

    return table.mapInArrow(search, schema)
