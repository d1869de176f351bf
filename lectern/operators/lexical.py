"""Lexical search: best-field BM25 over several text fields, and plain filtered pages."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.batches import BestRows, in_parts, words
from lectern.functions.text import text_fields
from lectern.operators.filters import clean, filter_key, match_filters
from lectern.operators.questions import passes
from lectern.plans.sizing import broadcast_within, spread_small, top_per_group
from lectern.settings import BM25_B, BM25_K1, LEXICAL_DOCS, LEXICAL_FIELDS, LEXICAL_PAGE

RANK_DECIMALS = 9
CELLS_PER_STEP = 1 << 18
PAIRS_PER_STEP = 1 << 18
TALLY_ROWS = 1 << 17  # counts that a task adds up before it hands them on
TOTALS = ""  # the row of a field's totals in the statistics


def page_limit(max_docs: int = LEXICAL_DOCS, page: int = LEXICAL_PAGE) -> int:
    """Pages are read whole until ``max_docs`` is reached."""
    return math.ceil(max_docs / page) * page


def term_statistics(
    corpus: DataFrame,
    fields: Sequence[str] = LEXICAL_FIELDS,
    terms: pa.Array | None = None,
) -> DataFrame:
    """``field, term, docs, words``: in how many documents a field holds each term.

    The row with an empty term has the field's totals: documents with any word, and
    words. Save it beside the corpus and pass it to :func:`lexical_search` to spare
    that search a scan. ``terms`` limits it to the terms of some questions.
    """
    fields = text_fields(corpus, fields)
    only = corpus.sparkSession.sparkContext.broadcast(terms) if terms is not None else None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = only.value if only is not None else None
        made, waiting = [], 0
        for part in in_parts(batches):
            for i, field in enumerate(fields):
                counts = _counts(part.column(i), field, vocabulary)
                if counts is not None:
                    made.append(counts)
                    waiting += counts.num_rows
            if waiting > TALLY_ROWS:
                made = [_added_up(made)]
                waiting = made[0].num_rows
                if waiting > TALLY_ROWS // 2:  # adding up doesn't help: hand them on
                    yield from made[0].to_batches()
                    made, waiting = [], 0
        if made:
            yield from _added_up(made).to_batches()

    schema = "field string, term string, docs bigint, words bigint"
    counted = spread_small(corpus.select(*fields)).mapInArrow(count, schema)
    return counted.groupBy("field", "term").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words"))


def _counts(texts: pa.Array, field: str, only: pa.Array | None) -> pa.Table | None:
    """Rows of the statistics for some texts of a field; of the terms in ``only``, if given, and the totals."""
    row, flat = words(texts)
    if not len(flat):
        return None
    docs = len(np.unique(row))
    if only is not None:
        code = pc.index_in(flat, value_set=only.cast(flat.type))
        row = row[pc.is_valid(code).to_numpy(zero_copy_only=False)]
        vocabulary, code = only, code.drop_null().to_numpy()
    else:
        coded = flat.dictionary_encode()
        vocabulary, code = coded.dictionary.cast(pa.string()), coded.indices.to_numpy()
    size = max(len(vocabulary), 1)
    term, holders = np.unique(np.unique(row.astype(np.int64) * size + code) % size, return_counts=True)
    n = len(term) + 1
    return pa.table({
        "field": pa.repeat(pa.scalar(field), n),
        "term": pa.concat_arrays([pa.array([TOTALS]), vocabulary.take(pa.array(term))]),
        "docs": pa.array(np.append(docs, holders), pa.int64()),
        "words": pa.array(np.append(len(flat), np.zeros(n - 1, np.int64)), pa.int64()),
    })


def _added_up(counts: list[pa.Table]) -> pa.Table:
    sums = pa.concat_tables(counts).group_by(["field", "term"], use_threads=False)
    summed = sums.aggregate([("docs", "sum"), ("words", "sum")])
    return summed.select(["field", "term", "docs_sum", "words_sum"]).rename_columns(["field", "term", "docs", "words"])


def lexical_search(
    corpus: DataFrame,
    questions: DataFrame,
    fields: Sequence[str] = LEXICAL_FIELDS,
    max_docs: int = LEXICAL_DOCS,
    page: int = LEXICAL_PAGE,
    id_col: str = "doc_id",
    statistics: DataFrame | None = None,
) -> DataFrame:
    """``qid, doc_id, score, rk`` of the documents sharing a word with the question.

    BM25 per field, summed over the question's words; a document counts with its
    best field. Tasks score their own documents whole, so no text and no word is
    shuffled, only each task's best rows.
    """
    fields = text_fields(corpus, fields)
    found = [
        _one_pass(corpus, block, questions, fields, page_limit(max_docs, page), id_col, statistics)
        for block in passes(questions.select("qid", "query"))
    ]
    schema = f"qid {_ddl(questions, 'qid')}, {id_col} {_ddl(corpus, id_col)}, score double"
    if not found:
        found = [corpus.sparkSession.createDataFrame([], schema)]
    scored = reduce(DataFrame.unionByName, found)
    order = [F.desc("score"), F.asc(id_col)]
    top = top_per_group(scored, ["qid"], order, page_limit(max_docs, page), spread_on=[id_col])
    return top.withColumnRenamed(id_col, "doc_id")


def _ddl(df: DataFrame, col: str) -> str:
    return df.schema[col].dataType.simpleString()


def _one_pass(
    corpus: DataFrame,
    block: pa.Table,
    questions: DataFrame,
    fields: list[str],
    k: int,
    id_col: str,
    statistics: DataFrame | None,
) -> DataFrame:
    spark = corpus.sparkSession
    asker, flat = words(block["query"].combine_chunks())
    coded = flat.dictionary_encode()
    terms = coded.dictionary.cast(pa.string())
    # term -> (questions holding it, how often), laid out by term
    n_q, n_t = block.num_rows, max(len(terms), 1)
    cell, times = np.unique(coded.indices.to_numpy().astype(np.int64) * n_q + asker, return_counts=True)
    by_term = cell // n_q
    start = np.searchsorted(by_term, np.arange(n_t + 1))
    holders = (start, cell % n_q, times.astype(np.float64))

    if statistics is None:
        stats = term_statistics(corpus, fields, terms)
    else:
        asked = spark.createDataFrame(pa.table({"term": pa.concat_arrays([terms, pa.array([TOTALS])])}))
        stats = statistics.where(F.col("field").isin(fields))
        stats = stats.join(broadcast_within(asked, len(terms) + 1), "term")
    weights, mean_words = _weights(stats.select("field", "term", "docs", "words").toArrow(), fields, terms)
    shared = spark.sparkContext.broadcast((terms, holders, weights, mean_words, block["qid"].combine_chunks()))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, holders, weights, mean_words, names = shared.value
        best = BestRows(len(names), k, RANK_DECIMALS)
        step = max(k + 1, CELLS_PER_STEP // max(len(names), 1))
        for batch in in_parts(batches):
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                score = np.zeros((part.num_rows, len(names)))
                for i in range(len(fields)):
                    if mean_words[i]:
                        field = _field_scores(part.column(i + 1), terms, holders, weights[i], mean_words[i], len(names))
                        np.maximum(score, field, out=score)
                best.offer(np.where(score > 0, score, -np.inf).T, part.column(0))
        yield from best.result(names, id_col)

    schema = f"qid {_ddl(questions, 'qid')}, {id_col} {_ddl(corpus, id_col)}, score double"
    return spread_small(corpus.select(id_col, *fields)).mapInArrow(search, schema)


def _weights(stats: pa.Table, fields: list[str], terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Inverse document frequency per field and term, and mean words per document of each field."""
    place = pc.index_in(stats["field"], value_set=pa.array(fields)).to_numpy()
    term = pc.index_in(stats["term"], value_set=terms)
    docs, count = stats["docs"].to_numpy(), stats["words"].to_numpy()
    total = pc.equal(stats["term"], TOTALS).to_numpy()
    known = pc.is_valid(term).to_numpy() & ~total
    n, length = np.zeros(len(fields)), np.zeros(len(fields))
    n[place[total]], length[place[total]] = docs[total], count[total]
    df = np.zeros((len(fields), max(len(terms), 1)))
    df[place[known], pc.fill_null(term, 0).to_numpy()[known]] = docs[known]
    idf = np.log1p((n[:, None] - df + 0.5) / (df + 0.5))
    return idf, np.divide(length, n, out=np.zeros_like(n), where=n > 0)


def _field_scores(texts: pa.Array, terms, holders, idf: np.ndarray, mean: float, n_q: int) -> np.ndarray:
    """BM25 of one field, rows x questions."""
    row, flat = words(texts)
    n_rows, n_t = len(texts), max(len(terms), 1)
    length = np.bincount(row, minlength=n_rows)
    code = pc.index_in(flat, value_set=terms.cast(flat.type))
    known = pc.is_valid(code).to_numpy(zero_copy_only=False)
    cell, times = np.unique(row[known].astype(np.int64) * n_t + code.drop_null().to_numpy(), return_counts=True)
    row, term = cell // n_t, cell % n_t
    damp = BM25_K1 * (1 - BM25_B + BM25_B * length[row] / mean)
    weight = idf[term] * times * (BM25_K1 + 1) / (times + damp)
    # hand each term's weight to the questions that ask for it, a bounded number of pairs at a time
    start, asker, asked_times = holders
    fan = start[term + 1] - start[term]
    out = np.zeros((n_rows, n_q))
    ends = np.cumsum(fan)
    steps = np.arange(PAIRS_PER_STEP, ends[-1] if len(ends) else 0, PAIRS_PER_STEP)
    cuts = np.unique(np.concatenate([[0], np.searchsorted(ends, steps), [len(fan)]]))
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        f, r, first = fan[lo:hi], row[lo:hi], start[term[lo:hi]]
        if not f.sum():
            continue
        at = np.arange(f.sum()) - np.repeat(np.cumsum(f) - f, f) + np.repeat(first, f)
        to = np.repeat(r - r[0], f) * n_q + asker[at]
        share = np.repeat(weight[lo:hi], f) * asked_times[at]
        span = r[-1] - r[0] + 1
        out[r[0]:r[-1] + 1] += np.bincount(to, share, minlength=span * n_q).reshape(span, n_q)
    return out


def filtered_page(
    corpus: DataFrame,
    questions: DataFrame,
    max_docs: int = LEXICAL_DOCS,
    page: int = LEXICAL_PAGE,
    id_col: str = "doc_id",
) -> DataFrame:
    """Documents that satisfy a question's filters, in id order; the question's words play no part.

    Score 0, or 1 where all filter values are blank and every document qualifies.
    """
    asked = questions.select("qid", clean(F.col("filters")).alias("filters"))
    asked = asked.withColumn("spec", filter_key(F.col("filters")))
    specs = asked.select("spec", "filters").dropDuplicates(["spec"])
    docs = match_filters(corpus, specs).select("spec", id_col)
    pages = top_per_group(docs, ["spec"], [F.asc(id_col)], page_limit(max_docs, page), spread_on=[id_col])
    score = F.when(F.size("filters") > 0, F.lit(0.0)).otherwise(F.lit(1.0))
    joined = asked.join(pages, "spec").select("qid", F.col(id_col).alias("doc_id"), score.alias("score"), "rk")
    return joined
