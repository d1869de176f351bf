"""Vector search: the k nearest documents of every question by cosine."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.batches import BestRows, vectors
from lectern.operators.filters import clean, equals, filter_key, match_filters
from lectern.operators.hits import fetch_docs
from lectern.operators.questions import passes
from lectern.plans.sizing import broadcast_within, top_per_group
from lectern.settings import IN_LIST_VALUES, KNN_K

if TYPE_CHECKING:
    from lectern.operators.vector_index import VectorIndex

# Scores are rounded before ranking so that equal vectors tie whatever order they are summed in.
RANK_DECIMALS = 12
CELLS_PER_STEP = 1 << 18


def cosine_score(a: Column, b: Column) -> Column:
    """``(1 + cosine) / 2`` of two array columns; null where a vector is zero."""
    def total(x, y):
        products = F.zip_with(x.cast("array<double>"), y.cast("array<double>"), lambda p, q: p * q)
        return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)

    cosine = F.try_divide(total(a, b), F.sqrt(total(a, a)) * F.sqrt(total(b, b)))
    return F.round((1 + cosine) / 2, RANK_DECIMALS)


def unit(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(vector, lambda x: x / norm)


def knn_search(
    corpus: DataFrame,
    questions: DataFrame,
    k: int = KNN_K,
    id_col: str = "doc_id",
    vector_col: str = "embedding",
    min_score: float | None = None,
    mode: str = "exact",
    order_by: Column | None = None,
    index: VectorIndex | None = None,
    **lsh,
) -> DataFrame:
    """``qid, doc_id, score, rk`` of the k best documents per question.

    ``questions`` has ``qid``, ``vector`` and optionally ``filters``; filters hold
    before ranking. ``min_score`` cuts afterwards; none or 0 is off. ``order_by``
    renumbers the k hits by an expression over the corpus columns. ``mode="approx"`` with an ``index`` of the corpus
    (:func:`build_vector_index`) answers unfiltered questions from it, the others exactly; without one it uses
    random-projection buckets. ``mode="exact"`` with an index reads the index once for all unfiltered questions and skips
    what can't be among the best (:mod:`lectern.operators.pivots`).
    """
    if "filters" not in questions.columns:
        questions = questions.withColumn("filters", F.create_map().cast("map<string,string>"))
    questions = questions.select("qid", "vector", clean(F.col("filters")).alias("filters"))
    if index is not None:
        found = _indexed(corpus, questions, k, id_col, vector_col, index, mode)
    elif mode == "approx":
        found = _approximate(corpus, questions, k, id_col, vector_col, **lsh)
    else:
        found = _exact(corpus, questions, k, id_col, vector_col)
    hits = top_per_group(found, ["qid"], [F.desc("score"), F.asc(id_col)], k, spread_on=[id_col])
    if min_score:
        hits = hits.where(F.col("score") >= min_score)
    if order_by is not None:
        dated = fetch_docs(hits, corpus.select(id_col, order_by.alias("__order")), id_col=id_col)
        order = [F.col("__order").desc_nulls_last(), F.asc("rk")]
        hits = top_per_group(dated, ["qid"], order, k, rank="__rk").drop("rk").withColumnRenamed("__rk", "rk")
        hits = hits.select("qid", id_col, "score", "rk")
    return hits.withColumnRenamed(id_col, "doc_id")


def _exact(corpus: DataFrame, questions: DataFrame, k: int, id_col: str, vector_col: str) -> DataFrame:
    """Every task scores its own documents against the block of questions and keeps k rows per question."""
    found = [_one_pass(corpus, block, questions, k, id_col, vector_col) for block in passes(questions)]
    if not found:
        schema = f"qid {_ddl(questions, 'qid')}, {id_col} {_ddl(corpus, id_col)}, score double"
        return corpus.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, found)


def _indexed(
    corpus: DataFrame, questions: DataFrame, k: int, id_col: str, vector_col: str, index: VectorIndex, mode: str
) -> DataFrame:
    """Unfiltered questions by the index (exactly, if asked or if the index says so), the others by exact passes."""
    from lectern.operators.pivots import pivot_search
    from lectern.operators.vector_index import index_search

    plain = F.size("filters") == 0
    if mode == "exact" or index.exact:
        near = pivot_search(index, questions.where(plain), k)
    else:
        near = index_search(index, questions.where(plain))
    near = near.withColumnRenamed(index.id_col, id_col)
    return near.unionByName(_exact(corpus, questions.where(~plain), k, id_col, vector_col))


def _dimension(questions: DataFrame) -> int | None:
    row = questions.select(F.max(F.size("vector")).alias("d")).first()
    return row["d"]


def _ddl(df: DataFrame, col: str) -> str:
    return df.schema[col].dataType.simpleString()


def _one_pass(
    corpus: DataFrame, block: pa.Table, questions: DataFrame, k: int, id_col: str, vector_col: str
) -> DataFrame:
    lengths = pc.unique(pc.list_value_length(block["vector"])).drop_null().to_pylist()
    if len(lengths) > 1:
        raise ValueError(f"question vectors differ in length: {sorted(lengths)}")
    dim = lengths[0] if lengths else 0
    rows, matrix = vectors(block["vector"].combine_chunks(), dim)
    block = block.take(pa.array(rows))
    qids = block["qid"].combine_chunks()
    groups: dict[str, tuple[dict[str, str], list[int]]] = {}
    for i, pairs in enumerate(block["filters"].to_pylist()):
        wanted = dict(pairs or [])
        groups.setdefault(json.dumps(wanted, sort_keys=True), (wanted, []))[1].append(i)
    fields = sorted({f for wanted, _ in groups.values() for f in wanted})
    for f in fields:
        corpus[f]  # an unknown column fails here

    docs = corpus
    if groups and all(w for w, _ in groups.values()) and len(groups) <= IN_LIST_VALUES:
        # every question is filtered: let the scan skip what none of them wants
        each = [reduce(lambda a, b: a & b, [equals(corpus, f, v) for f, v in w.items()]) for w, _ in groups.values()]
        docs = corpus.where(reduce(lambda a, b: a | b, each))
    docs = docs.select(id_col, vector_col, *[F.col(f).cast("string").alias(f"__{f}") for f in fields])
    # a filter value as the column type prints it, so that "07" finds the number 7
    texts = _as_column_text(corpus, {pair for wanted, _ in groups.values() for pair in wanted.items()})
    shared = corpus.sparkSession.sparkContext.broadcast(
        (matrix, qids, [({f: texts[f, v] for f, v in w.items()}, np.array(ix)) for w, ix in groups.values()])
    )

    def usable_rows(part, rows, by_filter):
        if not fields:
            return None
        usable = np.zeros((sum(len(ix) for _, ix in by_filter), len(rows)), bool)
        for wanted, ix in by_filter:
            fits = np.ones(len(rows), bool)
            for f, v in wanted.items():
                same = pc.fill_null(pc.equal(part.column(f"__{f}"), v), False)
                fits &= same.to_numpy(zero_copy_only=False)[rows]
            usable[ix] = fits
        return usable

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, names, by_filter = shared.value
        best = BestRows(len(names), k, RANK_DECIMALS)
        step = max(k + 1, CELLS_PER_STEP // max(len(names), 1))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                rows, known = vectors(part.column(1), dim)
                scores = (1 + asked @ known.T) / 2
                best.offer(scores, part.column(0).take(pa.array(rows)), usable_rows(part, rows, by_filter))
        yield from best.result(names, id_col)

    schema = f"qid {_ddl(questions, 'qid')}, {id_col} {_ddl(corpus, id_col)}, score double"
    return docs.mapInArrow(search, schema)


def _as_column_text(corpus: DataFrame, wanted: set[tuple[str, str]]) -> dict[tuple[str, str], str]:
    """Text of every (field, value) as the field's column prints it, in one job for all of them."""
    found = {(f, v): v for f, v in wanted if _ddl(corpus, f) == "string"}
    other = sorted(wanted - found.keys())
    if other:
        texts = F.array(*[F.lit(v).try_cast(_ddl(corpus, f)).cast("string") for f, v in other])
        row = corpus.sparkSession.range(1).select(texts.alias("texts")).first()
        found.update({pair: "\0" if text is None else text for pair, text in zip(other, row.texts)})
    return found


def _approximate(
    corpus: DataFrame,
    questions: DataFrame,
    k: int,
    id_col: str,
    vector_col: str,
    bucket_length: float = 0.5,
    tables: int = 6,
    seed: int = 42,
) -> DataFrame:
    """Candidates that share a random-projection bucket with the question, scored exactly.

    Unit vectors, so Euclidean order is cosine order. Wider buckets and more tables find more.
    """
    ok = lambda c: F.exists(F.col(c), lambda x: x != 0)
    specs = questions.select(filter_key(F.col("filters")).alias("spec"), "filters").dropDuplicates(["spec"])
    docs = match_filters(corpus.where(ok(vector_col)), specs)
    docs = docs.select("spec", id_col, array_to_vector(unit(F.col(vector_col))).alias("v"))
    asked = questions.where(ok("vector")).select(
        "qid", filter_key(F.col("filters")).alias("q_spec"), array_to_vector(unit(F.col("vector"))).alias("v")
    )
    hasher = BucketedRandomProjectionLSH(
        inputCol="v", outputCol="buckets", bucketLength=bucket_length, numHashTables=tables, seed=seed
    )
    model = hasher.fit(asked)

    def hashed(df):
        buckets = model.transform(df).withColumn("hs", F.transform("buckets", lambda b: vector_to_array(b)[0]))
        return buckets.select("*", F.posexplode("hs").alias("table", "bucket"))

    left = hashed(docs).select("spec", id_col, "table", "bucket", F.col("hs").alias("dh"), F.col("v").alias("dv"))
    right = hashed(asked).select("qid", "q_spec", "table", "bucket", F.col("hs").alias("qh"), F.col("v").alias("qv"))
    right = broadcast_within(right, questions.count() * tables, 8 * (_dimension(questions) or 1) + 256)
    met = (
        (left["table"] == right["table"]) & (left["bucket"] == right["bucket"]) & (left["spec"] == right["q_spec"])
    )
    # a pair that meets in several tables counts in the first one, so nothing has to be shuffled to drop repeats
    first = F.array_position(F.zip_with("dh", "qh", lambda a, b: a == b), True) - 1
    near = left.join(right, met).where(first == left["table"])
    return near.select("qid", id_col, cosine_score(vector_to_array("dv"), vector_to_array("qv")).alias("score"))
