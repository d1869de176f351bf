"""Approximate vector search: an inverted file with product quantisation.

Vectors are dealt to the nearest of some hundred centroids; what is left of each (its residual) is cut into
segments, and every segment becomes the number of the nearest entry of its codebook. A question looks at the lists of
its nearest centroids only, scores their vectors by adding up entries of a small table of its own, and has the best of
them scored exactly. Centroids and codebooks are fitted on at most ``SAMPLE_ROWS`` rows, picked by hash; every row is indexed.

How many lists are probed, and how many candidates are scored exactly, is measured when the index is built: rows of the
sample are asked against all rows, and the fewest are taken whose recall keeps a lower bound of ``recall``. Where that takes over
``WORTH`` of all pairs, as on vectors without neighbourhoods, or where the codes are too coarse, the index says so
(``exact``, ``reason``) and searches exactly.

Rows of one list lie side by side, so Parquet's statistics let a search skip the others. A list that holds a large share
of the rows is spread over as many files as it needs.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.batches import BestRows, vectors
from lectern.operators import knn
from lectern.operators.questions import passes
from lectern.plans.sizing import broadcast_within, staged, top_per_group
from lectern.settings import IN_LIST_VALUES, KNN_K

SAMPLE_ROWS = 20_000
MOST_LISTS = 1024
SEGMENTS, CODES = 8, 256
ASKED = 100  # rows of the sample that measure the recall
RECALL, WORTH = 0.9, 0.25
MOST_CANDIDATES = 1024
FILE_BYTES = 128 << 20
CELLS_PER_STEP = 1 << 20
Z = 1.64  # one-sided 95 %


@dataclass(frozen=True)
class VectorIndex:
    """An index at ``root``; ``recall`` and ``share`` of pairs scored are those measured, at ``probes`` and ``candidates``."""

    root: str
    id_col: str
    vector_col: str
    dim: int
    rows: int
    centroids: np.ndarray
    codebooks: list[np.ndarray] = field(repr=False)
    sizes: np.ndarray = field(repr=False)
    probes: int = 0
    candidates: int = 0
    recall: float = 1.0
    share: float = 1.0
    exact: bool = True
    reason: str = "no rows"

    def table(self, spark: SparkSession) -> DataFrame:
        """``lst``, id, ``code`` and vector of every row that has a usable vector."""
        return spark.read.parquet(f"{self.root}/rows")

    def closeness(self, asked: np.ndarray) -> np.ndarray:
        """Of every question to every centroid; the largest is the nearest."""
        return asked @ self.centroids.T - (self.centroids**2).sum(axis=1) / 2

    def probed(self, asked: np.ndarray, probes: int) -> np.ndarray:
        """Whether a question looks at a list."""
        near = np.argsort(-self.closeness(asked), axis=1, kind="stable")[:, :probes]
        out = np.zeros((len(asked), len(self.centroids)), bool)
        np.put_along_axis(out, near, True, axis=1)
        return out


# --- fitting -------------------------------------------------------------------

def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    step = max(1, CELLS_PER_STEP // len(centres))
    parts = [(x[i : i + step] @ centres.T - half).argmax(axis=1) for i in range(0, len(x), step)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def k_means(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """``k`` centres of the rows of ``x``, at most one for each row."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        of = nearest(x, centres)
        count = np.bincount(of, minlength=k)
        sums = np.stack([np.bincount(of, x[:, d], k) for d in range(x.shape[1])], axis=1)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], x[rng.choice(len(x), k)])
    return centres


def _segments(dim: int) -> list[slice]:
    ends = np.linspace(0, dim, min(SEGMENTS, dim) + 1).astype(int)
    return [slice(a, b) for a, b in zip(ends[:-1], ends[1:])]


def encoded(x: np.ndarray, centroids: np.ndarray, codebooks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(list, codes) of unit vectors."""
    lst = nearest(x, centroids)
    rest = x - centroids[lst]
    codes = [nearest(rest[:, s], book) for s, book in zip(_segments(x.shape[1]), codebooks)]
    return lst, np.stack(codes, axis=1).astype(np.uint8)


def build_vector_index(
    corpus: DataFrame,
    root: str,
    id_col: str = "doc_id",
    vector_col: str = "embedding",
    lists: int | None = None,
    k: int = KNN_K,
    recall: float = RECALL,
    sample_rows: int = SAMPLE_ROWS,
    seed: int = 42,
) -> VectorIndex:
    """Index every row of ``corpus`` with a usable vector at the new folder ``root``.

    Vectors of several lengths are an error. Rows with equal ids are all indexed.
    """
    spark = corpus.sparkSession
    order = F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(1 << 30)).alias("__h")
    source = corpus.select(id_col, vector_col, order).where(F.exists(vector_col, lambda v: v != 0))
    rows = source.count()
    cut = int(min(1.0, 2 * sample_rows / max(rows, 1)) * (1 << 30))
    sample = source.where(F.col("__h") < cut).orderBy("__h", id_col).limit(sample_rows).toArrow()
    lengths = sample[vector_col].combine_chunks().value_lengths().unique().to_pylist() if sample.num_rows else []
    if len(lengths) > 1:
        raise ValueError(f"vectors differ in length: {sorted(lengths)}")
    dim = lengths[0] if lengths else 0
    used, x = vectors(sample[vector_col].combine_chunks(), dim) if dim else (np.zeros(0, int), np.zeros((0, 0)))
    lists = max(1, min(lists or int(2 * rows**0.5), MOST_LISTS, max(len(x) // 8, 1)))
    centroids = k_means(x, lists, seed) if len(x) else np.zeros((1, dim))
    of = nearest(x, centroids)
    books = [k_means((x - centroids[of])[:, s], CODES, seed + 1) for s in _segments(dim)] if len(x) else []
    # files of about equal size: every list has the files that its share of the sample asks for
    parts = max(1, rows * (4 * dim + 32) // FILE_BYTES, min(spark.sparkContext.defaultParallelism, rows // 2048))
    filled = np.cumsum(np.append(0, (np.bincount(of, minlength=len(centroids)) + 1) / (len(x) + len(centroids)) * parts))
    first, last = np.floor(filled[:-1]).astype(int), np.minimum(np.ceil(filled[1:]).astype(int) - 1, parts - 1)
    shared = spark.sparkContext.broadcast((centroids, books, first, last))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, books, first, last = shared.value
        for batch in batches:
            kept, x = vectors(batch.column(1), dim)
            if not len(kept):
                continue
            lst, codes = encoded(x, centroids, books)
            some = batch.column(2).to_numpy()[kept]
            yield pa.RecordBatch.from_arrays([
                pa.array(first[lst] + some % (last - first + 1)[lst], pa.int32()), pa.array(lst, pa.int32()),
                batch.column(0).take(pa.array(kept)), pa.array([c.tobytes() for c in codes], pa.binary()),
                batch.column(1).take(pa.array(kept))], names=["part", "lst", id_col, "code", vector_col])

    kinds = dict(corpus.dtypes)
    schema = f"part int, lst int, {id_col} {kinds[id_col]}, code binary, {vector_col} {kinds[vector_col]}"
    dealt = source.mapInArrow(deal, schema).repartitionById(parts, "part").sortWithinPartitions("lst").drop("part")
    dealt.write.parquet(f"{root}/rows")
    table = spark.read.parquet(f"{root}/rows")
    sizes = np.zeros(len(centroids), np.int64)
    for r in table.groupBy("lst").count().collect():
        sizes[r.lst] = r["count"]
    index = VectorIndex(root, id_col, vector_col, dim, int(sizes.sum()), centroids, books, sizes)
    if len(x):
        index = _measured(spark, index, sample[id_col].take(pa.array(used[:ASKED])).to_pylist(), x[:ASKED], k, recall)
    _save(spark, index)
    return index


def _lower(values: np.ndarray) -> float:
    """Lower bound of the mean at 95 %."""
    return float(values.mean() - Z * values.std() / len(values) ** 0.5)


def _measured(spark: SparkSession, index: VectorIndex, ids: list, x: np.ndarray, k: int, recall: float) -> VectorIndex:
    """The fewest probes and candidates whose recall stays over ``recall`` on the rows ``x``; each row itself doesn't count."""
    table = index.table(spark)
    asked = spark.createDataFrame(
        [(i, v.tolist(), {}) for i, v in enumerate(x)], "qid int, vector array<double>, filters map<string,string>")
    found = knn._exact(table, asked, k + 1, index.id_col, index.vector_col)
    best = top_per_group(found, ["qid"], [F.desc("score"), F.asc(index.id_col)], k + 1)
    truth = table.select(index.id_col, "lst").join(F.broadcast(best), index.id_col).dropDuplicates(["qid", index.id_col])
    truth = staged(truth, "truth")  # at most ASKED * (k + 1) rows
    wanted = [[] for _ in x]
    for r in truth.orderBy("qid", "rk").collect():
        if r[index.id_col] != ids[r.qid] and len(wanted[r.qid]) < k:
            wanted[r.qid].append((r[index.id_col], r.lst))
    kept = [q for q, hits in enumerate(wanted) if hits]
    if not kept:
        return replace(index, reason="too few rows to measure")
    order = np.argsort(-index.closeness(x), axis=1, kind="stable")
    place = np.argsort(order, axis=1)  # of every list in a question's order
    share = np.cumsum(index.sizes[order], axis=1)[kept].mean(axis=0) / index.rows
    # half of what may be missed is left to the codes
    aim, probes = (1 + recall) / 2, len(index.centroids)
    for p in range(1, len(index.centroids) + 1):
        if _lower(np.array([np.mean([place[q, lst] < p for _, lst in wanted[q]]) for q in kept])) >= aim:
            probes = p
            break
    cost = float(share[probes - 1])
    if cost > WORTH:
        return replace(index, probes=probes, share=cost, reason=f"recall {recall} takes {cost:.0%} of all pairs")
    near = top_per_group(
        _candidates(spark, index, asked.toArrow(), "int", MOST_CANDIDATES, probes), ["qid"], [F.desc("score"), F.asc(index.id_col)],
        MOST_CANDIDATES, spread_on=[index.id_col])
    placed = {(r.qid, r[index.id_col]): r.rk
              for r in near.select("qid", index.id_col, "rk").join(F.broadcast(truth.select("qid", index.id_col)), ["qid", index.id_col]).collect()}
    n = 2 * k
    while n <= MOST_CANDIDATES:
        hits = np.array([np.mean([placed.get((q, i), n + 1) <= n for i, _ in wanted[q]]) for q in kept])
        if _lower(hits) >= recall:
            return replace(index, probes=probes, candidates=n, recall=float(hits.mean()), share=cost, exact=False,
                           reason=f"{probes} of {len(index.centroids)} lists, {n} candidates")
        n *= 2
    return replace(index, probes=probes, share=cost, reason=f"codes too coarse for recall {recall}")


# --- storing -------------------------------------------------------------------

def _save(spark: SparkSession, index: VectorIndex) -> None:
    plain = {k: v for k, v in asdict(index).items() if k not in ("root", "centroids", "codebooks", "sizes")}
    arrays = [index.centroids, index.sizes, *index.codebooks]
    row = (json.dumps(plain), [a.astype(np.float64).tobytes() for a in arrays], [list(a.shape) for a in arrays])
    spark.createDataFrame([row], "about string, arrays array<binary>, shapes array<array<int>>").coalesce(1).write.parquet(f"{index.root}/about")


def load_vector_index(spark: SparkSession, root: str) -> VectorIndex:
    row = spark.read.parquet(f"{root}/about").first()
    centroids, sizes, *books = [np.frombuffer(bytes(a), np.float64).reshape(s) for a, s in zip(row.arrays, row.shapes)]
    return VectorIndex(root=root, centroids=centroids, codebooks=books, sizes=sizes.astype(np.int64), **json.loads(row.about))


# --- searching -------------------------------------------------------------------

def _bytes_of(column: pa.Array, width: int) -> np.ndarray:
    """Rows of equally long binaries as a matrix."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, width)


def _lists(table: DataFrame, probed: np.ndarray) -> DataFrame:
    """Rows of the lists that any question looks at; a few of them reach the scan as a predicate."""
    wanted = np.flatnonzero(probed.any(axis=0)).tolist()
    return table.where(F.col("lst").isin(wanted)) if len(wanted) <= IN_LIST_VALUES else table


def _candidates(spark: SparkSession, index: VectorIndex, block: pa.Table, qid: str, n: int, probes: int) -> DataFrame:
    """``qid``, id and score by codes of every task's best ``n`` rows for each question of the block, whose ids are of type ``qid``."""
    rows, asked = vectors(block["vector"].combine_chunks(), index.dim)
    names = block["qid"].combine_chunks().take(pa.array(rows))
    probed = index.probed(asked, probes)
    near = (asked @ index.centroids.T).astype(np.float32)
    segments = _segments(index.dim)
    tables = [(asked[:, s] @ book.T).astype(np.float32) for s, book in zip(segments, index.codebooks)]
    shared = spark.sparkContext.broadcast((probed, near, tables, names))  # some KB for each question of a block

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probed, near, tables, names = shared.value
        best = BestRows(len(names), n, knn.RANK_DECIMALS)
        for batch in batches:
            lst, codes = batch.column(0).to_numpy(), _bytes_of(batch.column(2), len(tables))
            order = np.argsort(lst, kind="stable")
            starts = np.flatnonzero(np.append(True, lst[order][1:] != lst[order][:-1])) if len(order) else []
            for a, b in zip(starts, [*starts[1:], len(order)]):
                here = lst[order[a]]
                asking = np.flatnonzero(probed[:, here])
                step = max(n + 1, CELLS_PER_STEP // max(len(asking), 1))
                for low in range(a, b if len(asking) else a, step):
                    some = order[low : min(low + step, b)]
                    score = np.repeat(near[asking, here][:, None], len(some), axis=1)
                    for m, table in enumerate(tables):
                        score += table[asking][:, codes[some, m]]
                    best.offer_some(asking, score.astype(np.float64), batch.column(1).take(pa.array(some)))
        yield from best.result(names, index.id_col)

    table = _lists(index.table(spark), probed).select("lst", index.id_col, "code")
    return table.mapInArrow(search, f"qid {qid}, {index.id_col} {dict(table.dtypes)[index.id_col]}, score double")


def index_search(index: VectorIndex, questions: DataFrame) -> DataFrame:
    """``qid``, id and exact score of the candidates of every question (``qid, vector``); the best are among them."""
    spark = questions.sparkSession
    found = []
    for block in passes(questions.select("qid", "vector")):
        near = _candidates(spark, index, block, dict(questions.dtypes)["qid"], index.candidates, index.probes)
        best = top_per_group(near, ["qid"], [F.desc("score"), F.asc(index.id_col)], index.candidates, spread_on=[index.id_col])
        best = staged(best.select("qid", index.id_col).distinct(), "candidates")
        _, asked = vectors(block["vector"].combine_chunks(), index.dim)
        rows = _lists(index.table(spark), index.probed(asked, index.probes)).select(index.id_col, index.vector_col)
        pairs = rows.join(broadcast_within(best, block.num_rows * index.candidates, 32), index.id_col)
        vectors_of = broadcast_within(questions.select("qid", "vector"), block.num_rows, 8 * index.dim + 64)
        score = knn.cosine_score(F.col(index.vector_col), F.col("vector")).alias("score")
        found.append(pairs.join(vectors_of, "qid").select("qid", index.id_col, score))
    if not found:
        kinds = {**dict(questions.dtypes), **dict(index.table(spark).dtypes)}
        return spark.createDataFrame([], f"qid {kinds['qid']}, {index.id_col} {kinds[index.id_col]}, score double")
    return reduce(DataFrame.unionByName, found)
