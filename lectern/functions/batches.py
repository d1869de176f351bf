"""Small helpers that run inside tasks on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PART_BYTES = 1 << 20  # of text that a task splits into words at once; its words take some twenty times as much

# Characters between words. Letters, marks, digits and the underscore of any script make up words.
WORD_BREAK = r"[^\p{L}\p{M}\p{N}_]+"


def in_parts(batches: Iterable[pa.RecordBatch], limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``limit`` bytes of text (PART_BYTES), or of one row.

    Spark's batches have up to 10,000 rows, whatever their length; a task that splits a whole one into words
    takes memory in proportion.
    """
    limit = limit or PART_BYTES
    for batch in batches:
        size = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
                size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size)
        low = 0
        while low < batch.num_rows:
            done = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(low, high - low)
            low = high
        pa.default_memory_pool().release_unused()


def words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Lower-cased words of every text: (row of each word, the words), in no set order."""
    lowered = pc.utf8_lower(pc.cast(texts, pa.large_string()))
    # white space is part of every break, and most pieces between are words already
    row, pieces = _split(lowered, pc.ascii_split_whitespace)
    plain = pc.utf8_is_alnum(pieces)
    is_plain = plain.to_numpy(zero_copy_only=False)
    mixed = pieces.filter(pc.invert(plain))
    inner, parts = _split(mixed, lambda a: pc.split_pattern_regex(a, WORD_BREAK))
    real = pc.not_equal(parts, "")
    inner = inner[real.to_numpy(zero_copy_only=False)]
    all_rows = np.concatenate([row[is_plain], row[~is_plain][inner]])
    return all_rows, pa.concat_arrays([pieces.filter(plain), parts.filter(real)])


def _split(texts: pa.Array, split) -> tuple[np.ndarray, pa.Array]:
    lists = split(texts)
    return pc.list_parent_indices(lists).to_numpy(zero_copy_only=False), pc.list_flatten(lists)


def vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Usable unit vectors of a list column: (their rows, matrix).

    Null, non-finite and zero vectors have no cosine and are left out; another length is an error.
    """
    length = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    other = length[(length >= 0) & (length != dim)]
    if dim and len(other):
        raise ValueError(f"a vector has {other[0]} numbers where {dim} are expected")
    rows = np.flatnonzero(length == dim)
    kept = column.take(pa.array(rows))
    flat = pc.list_flatten(kept).to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = flat.reshape(len(rows), dim)
    norm = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    good = np.isfinite(norm) & (norm > 0)
    return rows[good], matrix[good] / norm[good, None]


class BestRows:
    """The best ``k`` rows per question seen by one task, ties broken by id."""

    PENDING_ROWS = 1 << 18

    def __init__(self, questions: int, k: int, decimals: int):
        self.k = k
        self.decimals = decimals
        self.floor = np.full(questions, -np.inf)
        self.kept: pa.Table | None = None
        self.fresh: list[pa.Table] = []
        self.waiting = 0

    def offer(self, scores: np.ndarray, ids: pa.Array, usable: np.ndarray | None = None) -> None:
        """``scores`` is questions x rows; rows not ``usable`` do not count.

        Scores are rounded only where they can matter, and compared after rounding.
        """
        if usable is not None:
            scores = np.where(usable, scores, -np.inf)
        slack = 10.0 ** -self.decimals
        reached = scores >= self.floor[:, None]
        # where many rows pass, the k-th best of this batch is a better bar
        many = np.flatnonzero(np.count_nonzero(reached, axis=1) > 4 * self.k)
        if len(many):
            cut = scores.shape[1] - self.k
            bar = np.partition(scores[many], cut, axis=1)[:, cut] - slack
            self.floor[many] = np.maximum(self.floor[many], bar)
            reached[many] = scores[many] >= self.floor[many, None]
        # rows level with the bar stay in: the id decides between them
        question, row = np.nonzero(reached)
        self._take(question, np.round(scores[question, row], self.decimals), row, ids)

    def offer_some(self, questions: np.ndarray, scores: np.ndarray, ids: pa.Array) -> None:
        """``scores`` is rows of some ``questions`` x rows."""
        slack = 10.0 ** -self.decimals
        if scores.shape[1] > 4 * self.k:
            cut = scores.shape[1] - self.k
            bar = np.partition(scores, cut, axis=1)[:, cut] - slack
            self.floor[questions] = np.maximum(self.floor[questions], bar)
        place, row = np.nonzero(scores >= self.floor[questions, None])
        self._take(questions[place], np.round(scores[place, row], self.decimals), row, ids)

    def _take(self, question: np.ndarray, score: np.ndarray, row: np.ndarray, ids: pa.Array) -> None:
        real = np.isfinite(score)
        if not real.any():
            return
        self.fresh.append(pa.table({
            "question": pa.array(question[real], pa.int32()),
            "score": pa.array(score[real]),
            "id": ids.take(pa.array(row[real])),
        }))
        self.waiting += int(real.sum())
        if self.waiting > max(self.PENDING_ROWS, self.kept.num_rows if self.kept is not None else 0):
            self.settle()

    def settle(self) -> None:
        """Cut what was offered to the best rows, and raise the bars of questions that have ``k`` of them."""
        if not self.fresh:
            return
        table = pa.concat_tables(([self.kept] if self.kept is not None else []) + self.fresh)
        self.fresh, self.waiting = [], 0
        order = [("question", "ascending"), ("score", "descending"), ("id", "ascending")]
        table = table.take(pc.sort_indices(table, sort_keys=order)).combine_chunks()
        question = table["question"].to_numpy()
        place = np.arange(len(question)) - np.searchsorted(question, question)
        self.kept = table.filter(pa.array(place < self.k)).combine_chunks()
        full = place == self.k - 1
        bar = table["score"].to_numpy()[full] - 10.0 ** -self.decimals
        self.floor[question[full]] = np.maximum(self.floor[question[full]], bar)

    def result(self, names: pa.Array, id_col: str) -> list[pa.RecordBatch]:
        """``qid, id, score`` with the questions' own ids from ``names``."""
        self.settle()
        if self.kept is None:
            return []
        return pa.table({
            "qid": names.take(self.kept["question"].combine_chunks()),
            id_col: self.kept["id"],
            "score": self.kept["score"],
        }).to_batches()
