"""Word search over a stored inverted index that skips blocks of documents.

Documents are taken in blocks of at most ``BLOCK_DOCS``, in the order in which they are stored, so no text is shuffled. For every block, field
and word there is one row: the places of the documents that hold it, how often (null: once each), and the greatest impact
(BM25 weight without the word's own) among them. The ids and lengths of the block's documents are in one more row, of the empty
word. Rows are sorted by word, so a search reads those of its words and of the blocks it scores only.

A search first adds up the greatest impacts: no document of a block can score more for a question than that bound. The few
blocks with the highest bounds are scored; the k-th score found there is a bar, and of the rest only blocks whose bound reaches it
are read. What is left out cannot be among the best k, so the result is the full search's, and no text is read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.batches import BestRows, in_parts, words
from lectern.functions.text import text_fields
from lectern.operators import lexical
from lectern.operators.questions import passes
from lectern.plans.sizing import broadcast_within, spread_small, staged, top_per_group
from lectern.settings import BM25_B, BM25_K1, IN_LIST_VALUES, LEXICAL_DOCS, LEXICAL_FIELDS, LEXICAL_PAGE

BLOCK_DOCS = 512
SLOTS = 1024  # of words, so that their rows stand close together
FIRST_BLOCKS = 4  # blocks scored for each question before the bar is known
BLOCK_BYTES = 8 << 20  # of text in a block, or one document
PART_POSTINGS = 1 << 20  # of a file; up to 200 bytes each while they are sorted, where words are rare
WHOLE = lexical.TOTALS  # the word of a block's own row


@dataclass(frozen=True)
class WordIndex:
    """An index at ``root`` over ``fields``."""

    root: str
    id_col: str
    fields: tuple[str, ...]

    def postings(self, spark: SparkSession) -> DataFrame:
        """``slot, term, field, block, most, places, times``, and ``ids, lengths`` in the rows of the empty word."""
        return spark.read.parquet(f"{self.root}/postings")

    def statistics(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.root}/terms")


def _slot(term: str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(SLOTS)).cast("int")


def build_word_index(
    corpus: DataFrame,
    root: str,
    fields: Sequence[str] = LEXICAL_FIELDS,
    id_col: str = "doc_id",
    block_docs: int = BLOCK_DOCS,
) -> WordIndex:
    """Index every document of ``corpus`` at the new folder ``root``; two scans of the text fields."""
    spark = corpus.sparkSession
    fields = text_fields(corpus, fields)
    index = WordIndex(root, id_col, tuple(fields))
    lexical.term_statistics(corpus, fields).write.parquet(f"{root}/terms")
    stats = index.statistics(spark)
    totals = {r.field: r for r in stats.where(F.col("term") == lexical.TOTALS).collect()}  # a row a field
    mean = [totals[f].words / totals[f].docs if f in totals else 1.0 for f in fields]
    postings = stats.agg(F.sum("docs")).first()[0] or 0
    parts = max(1, -(-postings // PART_POSTINGS), min(spark.sparkContext.defaultParallelism, postings >> 16))

    small = block_docs <= 1 << 15

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            cuts = (batch.slice(low, block_docs) for low in range(0, batch.num_rows, block_docs))
            for part in in_parts(cuts, BLOCK_BYTES):
                for i in range(len(fields)):
                    made = _posting_rows(part.column(i + 1), part.column(0), mean[i], small)
                    if made is not None:
                        n = len(made[0])
                        yield pa.RecordBatch.from_arrays(
                            [made[0], pa.array([i] * n, pa.int32()), pa.array([block] * n, pa.int64()), *made[1:]],
                            names=["term", "field", "block", "most", "places", "times", "ids", "lengths"])
                block += 1

    kind = dict(corpus.dtypes)[id_col]
    schema = f"term string, field int, block bigint, most double, places array<{'smallint' if small else 'int'}>, times array<int>, ids array<{kind}>, lengths array<int>"
    rows = spread_small(corpus.select(id_col, *fields)).mapInArrow(deal, schema).withColumn("slot", _slot("term"))
    # words that many documents of a block hold have rows in most blocks: these are spread over all files, as are the blocks' own;
    # the other words of a slot over some, where there are many files
    spread = (F.col("term") == WHOLE) | (F.size("places") * 8 > block_docs)
    some = F.pmod(F.xxhash64("term", F.lit(1)), F.lit(max(1, 8 * parts // SLOTS)))
    salt = F.when(spread, F.pmod(F.xxhash64("block"), F.lit(parts))).otherwise(some)
    rows = rows.withColumn("salt", salt).repartition(parts, "slot", "salt").drop("salt")
    rows.sortWithinPartitions("slot", "term", "block").write.parquet(f"{root}/postings")
    return index


def _posting_rows(texts: pa.Array, ids: pa.Array, mean: float, small: bool):
    """(terms, greatest impacts, places in the block, times, ids, lengths) of a block's field; its own row comes last."""
    row, flat = words(texts)
    if not len(flat):
        return None
    n = len(texts)
    length = np.bincount(row, minlength=n)
    coded = flat.dictionary_encode()
    terms = len(coded.dictionary)
    cell, times = np.unique(coded.indices.to_numpy().astype(np.int64) * n + row, return_counts=True)
    holder = cell % n
    start = np.searchsorted(cell // n, np.arange(terms + 1)).astype(np.int32)
    most = np.maximum.reduceat(_impact(times, length[holder], mean), start[:-1])
    # times are left out where they all are 1
    often = np.maximum.reduceat(times, start[:-1]) > 1
    kept = np.repeat(often, np.diff(start))
    times_start = np.append(np.concatenate([[0], np.cumsum(np.diff(start) * often)]), kept.sum()).astype(np.int32)
    none = np.zeros(terms, np.int32)
    whole = pa.array(np.append(none, [0, n]).astype(np.int32), mask=np.append(np.ones(terms, bool), [False, False]))
    return (
        pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.array([WHOLE])]),
        pa.array(np.append(most, 0.0)),
        pa.ListArray.from_arrays(pa.array(np.append(start, start[-1])), pa.array(holder, pa.int16() if small else pa.int32())),
        pa.ListArray.from_arrays(pa.array(times_start, mask=np.concatenate([~often, [True, False]])), pa.array(times[kept], pa.int32())),
        pa.ListArray.from_arrays(whole, ids),
        pa.ListArray.from_arrays(whole, pa.array(length, pa.int32())),
    )


def _impact(times: np.ndarray, length: np.ndarray, mean: float) -> np.ndarray:
    return times * (BM25_K1 + 1) / (times + BM25_K1 * (1 - BM25_B + BM25_B * length / mean))


@dataclass
class _Asked:
    """The words of a block of questions."""

    names: pa.Array
    terms: pa.Array
    start: np.ndarray  # of every word's askers
    asker: np.ndarray
    times: np.ndarray
    weights: np.ndarray
    mean: np.ndarray
    table: DataFrame  # slot, term, no


def _asked(index: WordIndex, spark: SparkSession, block: pa.Table) -> _Asked:
    asker, flat = words(block["query"].combine_chunks())
    coded = flat.dictionary_encode()
    terms, n_q = coded.dictionary.cast(pa.string()), block.num_rows
    cell, times = np.unique(coded.indices.to_numpy().astype(np.int64) * n_q + asker, return_counts=True)
    start = np.searchsorted(cell // n_q, np.arange(len(terms) + 1))
    table = spark.createDataFrame(pa.table({"term": terms, "no": pa.array(range(len(terms)), pa.int32())}))
    table = table.select(_slot("term").alias("slot"), "term", "no")
    known = table.select("term").union(spark.range(1).select(F.lit(lexical.TOTALS)))
    stats = index.statistics(spark).join(broadcast_within(known, len(terms) + 1), "term")
    weights, mean = lexical._weights(stats.select("field", "term", "docs", "words").toArrow(), list(index.fields), terms)
    return _Asked(block["qid"].combine_chunks(), terms, start, cell % n_q, times.astype(float), weights, mean, table)


def _rows(index: WordIndex, spark: SparkSession, asked: _Asked) -> DataFrame:
    """Posting rows of the questions' words, with the word's number."""
    rows = index.postings(spark)
    if len(asked.terms) <= IN_LIST_VALUES:
        terms = asked.terms.to_pylist()
        slots = sorted({r.slot for r in asked.table.select("slot").collect()})
        rows = rows.where(F.col("slot").isin(slots) & F.col("term").isin(terms))
    return rows.join(broadcast_within(asked.table, len(asked.terms)), ["slot", "term"])


def _bounds(index: WordIndex, spark: SparkSession, asked: _Asked) -> DataFrame:
    """``question, block, bound`` of every block that holds a word of the question; ids and counts are not read."""
    no = np.repeat(np.arange(len(asked.terms)), np.diff(asked.start))
    share = pa.table({"no": pa.array(no, pa.int32()), "question": pa.array(asked.asker, pa.int32())} | {
        f"w{i}": pa.array(asked.times * asked.weights[i][no]) for i in range(len(index.fields))})
    weights = F.array(*[F.col(f"w{i}") for i in range(len(index.fields))])
    askers = spark.createDataFrame(share).select("no", "question", weights.alias("w"))
    rows = _rows(index, spark, asked).select("no", "field", "block", "most")
    rows = rows.join(broadcast_within(askers, len(no), 64 + 8 * len(index.fields)), "no")
    sums = rows.groupBy("question", "block", "field").agg(F.sum(F.col("most") * F.get("w", F.col("field"))).alias("bound"))
    return sums.groupBy("question", "block").agg(F.max("bound").alias("bound"))


def _slot_of_whole(spark: SparkSession) -> int:
    return spark.range(1).select(F.pmod(F.xxhash64(F.lit(WHOLE)), F.lit(SLOTS)).cast("int")).first()[0]


def _scored(index: WordIndex, spark: SparkSession, asked: _Asked, blocks: DataFrame, n_blocks: int | None, qid: str, k: int) -> DataFrame:
    """``qid``, id and score of every task's best ``k`` documents of ``blocks`` for each question."""
    wanted = blocks if n_blocks is None else broadcast_within(blocks, n_blocks, 32)
    own = index.postings(spark).where((F.col("slot") == _slot_of_whole(spark)) & (F.col("term") == WHOLE))
    rows = _rows(index, spark, asked).unionByName(own.withColumn("no", F.lit(-1)))
    rows = rows.join(wanted, "block", "left_semi").select("block", "no", "field", "places", "times", "ids", "lengths")
    # a block's rows come together; there are at most as many as words asked and its own, whatever the corpus
    rows = rows.repartition("block").sortWithinPartitions("block")
    shared = spark.sparkContext.broadcast(
        (asked.names, asked.start, asked.asker, asked.times, asked.weights, asked.mean))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, start, asker, asked_times, weights, mean = shared.value
        best = BestRows(len(names), k, lexical.RANK_DECIMALS)

        def one(block: pa.Table) -> None:
            block = block.combine_chunks()
            no, field = block["no"].to_numpy(), block["field"].to_numpy()
            places, times, ids, lengths = (block[c].combine_chunks() for c in ("places", "times", "ids", "lengths"))
            if not (no >= 0).any():
                return
            found = {}  # by row: places and times
            for i in np.flatnonzero(no >= 0):
                at = places[i].values.to_numpy()
                found[i] = at, times[i].values.to_numpy() if times[i].is_valid else np.ones(len(at))
            held = np.unique(np.concatenate([at for at, _ in found.values()]))
            own = {field[i]: i for i in np.flatnonzero(no < 0)}
            out = np.zeros((len(held), len(names)))
            for f in np.unique(field[no >= 0]):
                sums, length = np.zeros_like(out), lengths[own[f]].values.to_numpy()
                for i in np.flatnonzero((field == f) & (no >= 0)):
                    at, often = found[i]
                    who = slice(start[no[i]], start[no[i] + 1])
                    weight = weights[f][no[i]] * _impact(often, length[at], mean[f])
                    sums[np.searchsorted(held, at)[:, None], asker[who]] += weight[:, None] * asked_times[who]
                np.maximum(out, sums, out=out)
            ids = ids[next(iter(own.values()))].values.take(pa.array(held))
            best.offer(np.where(out > 0, out, -np.inf).T, ids)

        rest = None  # rows of the last block, which may go on
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            at = table["block"].to_numpy()
            cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist()]
            for low, high in zip(cuts, cuts[1:]):
                one(table.slice(low, high - low))
            rest = table.slice(cuts[-1])
        if rest is not None and rest.num_rows:
            one(rest)
        yield from best.result(names, index.id_col)

    kind = dict(index.postings(spark).dtypes)["ids"].removeprefix("array<").removesuffix(">")
    return rows.mapInArrow(score, f"qid {qid}, {index.id_col} {kind}, score double")


def _one_pass(index: WordIndex, spark: SparkSession, block: pa.Table, qid: str, k: int, first_blocks: int):
    """(hits, blocks scored first, blocks scored after the bar was known, bounds)."""
    asked = _asked(index, spark, block)
    if not len(asked.terms):
        return None
    order = [F.desc("score"), F.asc(index.id_col)]
    bounds = staged(_bounds(index, spark, asked), "bounds")
    head = top_per_group(bounds, ["question"], [F.desc("bound"), F.asc("block")], first_blocks, spread_on=["block"])
    head = staged(head.select("block").distinct(), "blocks")
    found = _scored(index, spark, asked, head, block.num_rows * first_blocks, qid, k)
    found = staged(top_per_group(found, ["qid"], order, k, spread_on=[index.id_col]), "hits")
    # the k-th score of every question that has one; bounds are sums in another order, hence the slack
    bars = found.where(F.col("rk") == k).select("qid", (F.col("score") - 10.0 ** -(lexical.RANK_DECIMALS - 1)).alias("bar"))
    number = spark.createDataFrame(pa.table({"qid": asked.names, "question": pa.array(range(len(asked.names)), pa.int32())}))
    bars = number.join(bars, "qid").select("question", "bar")
    rest = (
        bounds.join(broadcast_within(bars, block.num_rows, 32), "question", "left").where(F.col("bar").isNull() | (F.col("bound") >= F.col("bar")))
        .select("block").distinct().join(broadcast_within(head, block.num_rows * first_blocks, 32), "block", "left_anti")
    )
    rest = staged(rest, "blocks")
    more = _scored(index, spark, asked, rest, None, qid, k)
    return found.drop("rk").unionByName(more), head, rest, bounds


def indexed_search(
    index: WordIndex,
    questions: DataFrame,
    max_docs: int = LEXICAL_DOCS,
    page: int = LEXICAL_PAGE,
    first_blocks: int = FIRST_BLOCKS,
) -> DataFrame:
    """What :func:`lexical_search` gives over the indexed documents: ``qid, doc_id, score, rk``."""
    spark = questions.sparkSession
    k = lexical.page_limit(max_docs, page)
    qid = dict(questions.dtypes)["qid"]
    made = [_one_pass(index, spark, b, qid, k, max(first_blocks, math.ceil(k / BLOCK_DOCS))) for b in passes(questions.select("qid", "query"))]
    found = [m[0] for m in made if m is not None]
    if not found:
        kind = dict(index.postings(spark).dtypes)["ids"].removeprefix("array<").removesuffix(">")
        found = [spark.createDataFrame([], f"qid {qid}, {index.id_col} {kind}, score double")]
    top = top_per_group(
        reduce(DataFrame.unionByName, found), ["qid"], [F.desc("score"), F.asc(index.id_col)], k, spread_on=[index.id_col])
    return top.withColumnRenamed(index.id_col, "doc_id")
