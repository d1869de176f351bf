"""The question table: checks, and bounded hand-over to tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import folded, strip
from lectern.operators.filters import accepted
from lectern.plans.sizing import staged
from lectern.rules import DEFAULT_MODE, MODES
from lectern.settings import FILTER_FIELDS, QUESTION_BYTES_PER_PASS, QUESTIONS_PER_PASS


def check_questions(questions: DataFrame, fields: Sequence[str] = FILTER_FIELDS) -> DataFrame:
    """Stripped query, known mode, accepted filters; ``problem`` says why a question cannot be answered."""
    mode = folded(F.coalesce("mode", F.lit("")))
    checked = questions.withColumns({
        "query": strip(F.coalesce("query", F.lit(""))),
        "mode": F.when(mode == "", F.lit(DEFAULT_MODE)).otherwise(mode),
        "filters": accepted(F.col("filters"), fields),
    })
    return checked.withColumn("problem", _problem())


def _problem() -> Column:
    unknown = F.concat(F.lit("Invalid mode: "), F.col("mode"))
    return F.when(F.col("query") == "", F.lit("Please enter a query")).when(~F.col("mode").isin(*MODES), unknown)


def passes(
    questions: DataFrame,
    key: str = "qid",
    rows: int = QUESTIONS_PER_PASS,
    size: int = QUESTION_BYTES_PER_PASS,
) -> Iterator[pa.Table]:
    """The question table in Arrow blocks small enough to hand to every task.

    One block is the normal case. More questions are split by hash into several
    blocks, each answered in its own pass over the corpus; the driver holds one at a time.
    """
    head = questions.limit(rows + 1).toArrow()
    if head.num_rows <= rows:
        yield from _slices(head, size)
        return
    questions = staged(questions, "questions")  # every block reads them again
    blocks = -(-questions.count() // (rows // 2))
    slot = F.pmod(F.xxhash64(key), F.lit(blocks))
    for b in range(blocks):
        yield from _slices(questions.where(slot == b).toArrow(), size)


def _slices(table: pa.Table, size: int) -> Iterator[pa.Table]:
    step = max(1, table.num_rows * size // max(table.nbytes, size))
    for at in range(0, table.num_rows, step):
        yield table.slice(at, step)
