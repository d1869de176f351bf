"""From ranked hits to a length-limited context and its chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.folds import pack_entries, pack_passages, pieces
from lectern.functions.text import entry, passage, strip
from lectern.settings import CHUNK_CHARS, CONTEXT_CHARS, MAX_CHUNKS


def passages(hits: DataFrame) -> DataFrame:
    """Hits with their ``passage`` text; hits without one are dropped, ranks stay as they were."""
    return hits.withColumn("passage", passage(hits)).where(strip(F.col("passage")) != "")


def build_context(hits: DataFrame, max_chars: int = CONTEXT_CHARS) -> DataFrame:
    """``qid, context`` from hits with ``qid, rk, score`` and document columns.

    An entry's share is at most ``max_chars``, so the text beyond that cannot show
    up and one more character is enough to tell that an entry is too long; it is
    cut there before it is shuffled. A question has as many entries as ranked hits.
    """
    text = entry(F.col("rk"), F.col("score"), F.col("passage"))
    shown = passages(hits).select("qid", "rk", F.left(text, F.lit(max_chars + 1)).alias("entry"))
    listed = F.array_sort(F.collect_list(F.struct("rk", "entry")))
    grouped = shown.groupBy("qid").agg(listed.alias("entries"))
    return grouped.select("qid", pack_entries(F.transform("entries", lambda e: e["entry"]), max_chars).alias("context"))


def chunk_context(
    contexts: DataFrame, chunk_chars: int = CHUNK_CHARS, max_chunks: int | None = MAX_CHUNKS
) -> DataFrame:
    """``qid, chunk_no, chunk, n_chunks, n_dropped``, numbered from 1; ``max_chunks`` None keeps all."""
    packed = contexts.select("qid", pack_passages(F.col("context"), chunk_chars).alias("chunks"))
    count = F.size("chunks")
    kept = count if max_chunks is None else F.least(count, F.lit(max_chunks))
    return packed.select(
        "qid",
        F.posexplode(F.slice("chunks", F.lit(1), kept)).alias("chunk_no", "chunk"),
        kept.alias("n_chunks"),
        (count - kept).alias("n_dropped"),
    ).withColumn("chunk_no", F.col("chunk_no") + 1)


def fixed_chunks(array: Column, size: int) -> Column:
    """An array column cut into arrays of ``size`` items."""
    return pieces(array, size)
