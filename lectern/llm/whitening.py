"""Whitening of embeddings: eigenvectors of the covariance by contour integration (FEAST).

Entries become integers, ``floor(1024 * entry) + 100000``, so that counts, sums and deviations are exact. One
pass sums them, a second one adds up centred products; both leave a table of dimension x dimension at most,
whatever the number of rows. On that matrix

1. inertia counts (signs of the pivots of a symmetric factorisation of ``V - sI``) cut the upper end of the spectrum
   into intervals that hold a few eigenvalues each,
2. every interval is a Spark task of its own: solves with ``zI - V`` at the points of a half circle around the interval,
   added up with their quadrature weights, project a block of random vectors onto the interval's eigenvectors;
   Rayleigh-Ritz takes them out; both repeat until the residuals are small,
3. a task's find must have as many eigenvalues as the inertia counts say, or it goes on with a larger block (a block of
   all dimensions is exact), so none is missed.

The matrix is handed to the tasks: 8 bytes times dimension squared, which doesn't grow with the rows.

Defined results: rows whose vector is null, empty, or holds null or non-finite entries (or one whose integer doesn't
fit 62 bits) are left out; of vectors of several lengths those of the most common one stay (of equally common ones the longest).
A direction whose variance is zero to rounding is no component, so equal vectors, a single row or an empty table
give no rows. Repeated rows count each time; null ids are carried. Equal eigenvalues have any basis, the same for all rows.
``deviation`` is null where it doesn't fit a long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.frames import mapped_schema

COMPONENTS = 8
SCALE, OFFSET = 1024, 100_000
SAFE = 2.0**62
NODES = 8  # quadrature points on the half circle
PER_INTERVAL = 4
ROUNDS = 40
PIVOT = (1 + 17**0.5) / 8  # bounds the growth of the factorisation


# --- vectors of a batch ------------------------------------------------------

def integers(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, integers of their entries) of the usable vectors of length ``dim``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    length = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(length == dim)
    flat = pc.list_flatten(column.take(pa.array(rows, pa.int64()))).cast(pa.float64()).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(SCALE * flat.reshape(len(rows), dim))
    good = (np.abs(scaled) < SAFE / 2).all(axis=1)  # false for NaN too
    return rows[good], scaled[good].astype(np.int64) + OFFSET


def _largest(values: np.ndarray) -> float:
    return float(np.abs(values.astype(np.float64)).max(initial=0.0))


def deviations(x: np.ndarray, n: int, sums: Sequence[int]) -> np.ndarray:
    """``n * x - sums``, exact: 64-bit integers where they fit, Python's beyond."""
    if n * _largest(x) + max(map(abs, sums)) < SAFE:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def squared_lengths(deviation: np.ndarray) -> list[int | None]:
    """Exact sum of squares of every row, None where it passes 63 bits."""
    if _largest(deviation) ** 2 * deviation.shape[1] < SAFE:
        return (deviation.astype(np.int64) ** 2).sum(axis=1).tolist()
    totals = (sum(int(v) ** 2 for v in row) for row in deviation)
    return [t if t < 1 << 63 else None for t in totals]


def centred(x: np.ndarray, n: int, sums: Sequence[int]) -> np.ndarray:
    return deviations(x, n, sums).astype(np.float64) / n


# --- sums over all rows ------------------------------------------------------

def _totals(vectors: DataFrame, column: str) -> tuple[int, list[int]]:
    """(n, sums by dimension) over the usable vectors of the most common length."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            vector = batch.column(0)
            for dim in pc.unique(pc.list_value_length(vector)).drop_null().to_pylist():
                _, x = integers(vector, dim)
                if not dim or not len(x):
                    continue
                exact = x if _largest(x) * len(x) < SAFE else x.astype(object)
                n, sums = found.get(dim, (0, [0] * dim))
                found[dim] = n + len(x), [a + int(b) for a, b in zip(sums, exact.sum(axis=0))]
        for dim, (n, sums) in found.items():
            yield pa.RecordBatch.from_pydict({
                "length": pa.array([dim] * dim, pa.int32()), "at": pa.array(range(dim), pa.int32()),
                "n": pa.array([n] * dim, pa.int64()), "total": pa.array(sums, pa.decimal128(38, 0))})

    parts = vectors.select(column).mapInArrow(add, "length int, at int, n bigint, total decimal(38,0)")
    sums = parts.groupBy("length", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    best = sums.groupBy("length").agg(
        F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "total"))).alias("totals"))
    row = best.orderBy(F.desc("n"), F.desc("length")).first()
    return (0, []) if row is None else (row.n, [int(t.total) for t in row.totals])


def _products(vectors: DataFrame, column: str, size: int, rows: Callable[[pa.Array], np.ndarray]) -> np.ndarray:
    """Sum over all vectors of ``r r^T``, for the ``size`` numbers r that ``rows`` makes of each one."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            r = rows(batch.column(0))
            total += r.T @ r
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_pydict({
            "i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "v": pa.array(total[i, j])})

    parts = vectors.select(column).mapInArrow(add, "i int, j int, v double")
    out = np.zeros((size, size))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r.i, r.j] = out[r.j, r.i] = r.v
    return out


# --- the spectrum ------------------------------------------------------------

def above(matrix: np.ndarray, shift: float) -> int:
    """Number of eigenvalues over ``shift``: the positive pivots of ``matrix - shift I`` (Sylvester's law).

    Symmetric elimination with complete pivoting; a pivot of two rows has one eigenvalue of either sign.
    """
    a = matrix - shift * np.eye(len(matrix))
    found = 0
    while len(a):
        size = np.abs(a)
        diagonal = np.diag(size).copy()
        np.fill_diagonal(size, 0)
        one, flat = int(diagonal.argmax()), int(size.argmax())
        if not max(diagonal[one], size.flat[flat]):
            break
        if diagonal[one] >= PIVOT * size.flat[flat]:
            pivot = [one]
            found += a[one, one] > 0
        else:
            pivot = list(divmod(flat, len(a)))
            found += 1
        rest = np.delete(np.arange(len(a)), pivot)
        side = a[np.ix_(rest, pivot)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(a[np.ix_(pivot, pivot)], side.T)
        a = (a + a.T) / 2
    return int(found)


def intervals(matrix: np.ndarray, wanted: int, per_interval: int = PER_INTERVAL) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues between) from the upper end, until ``wanted`` eigenvalues are covered.

    Only those over rounding error count. A cluster narrower than that stays in one interval, however many it holds.
    """
    top = float(np.abs(matrix).sum(axis=1).max(initial=0.0)) * (1 + 1e-12)  # no eigenvalue lies beyond
    least = float(top * len(matrix) * np.finfo(float).eps * 4)
    waiting, out, covered = [(least, top, above(matrix, least), 0)] if top else [], [], 0
    while waiting and covered < wanted:
        low, high, over_low, over_high = waiting.pop()
        inside = over_low - over_high
        if inside <= per_interval or high - low <= 8 * least:
            if inside:
                out.append((low, high, inside))
            covered = over_low
            continue
        middle = (low + high) / 2
        over_middle = above(matrix, middle)
        waiting += [(low, middle, over_low, over_middle), (middle, high, over_middle, over_high)]
    return out


def feast(matrix: np.ndarray, low: float, high: float, expected: int, nodes: int = NODES) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, vectors as rows) in (low, high], ``expected`` of them."""
    dim, centre, radius = len(matrix), (low + high) / 2, (high - low) / 2
    points, weights = np.polynomial.legendre.leggauss(nodes)
    turns = np.exp(1j * np.pi / 2 * (1 + points))
    scale = np.abs(matrix).sum(axis=1).max()
    block = min(dim, 2 * expected + 4)
    while True:
        space = np.random.default_rng(block).standard_normal((dim, block))
        for _ in range(ROUNDS if block < dim else 2):
            if block < dim:
                image = np.zeros_like(space)
                for turn, weight in zip(turns, weights):
                    solved = np.linalg.solve((centre + radius * turn) * np.eye(dim) - matrix, space.astype(complex))
                    image += weight / 2 * radius * (turn * solved).real
                space = image
            basis, _ = np.linalg.qr(space)
            small = basis.T @ matrix @ basis
            values, turned = np.linalg.eigh((small + small.T) / 2)
            space = basis @ turned
            inside = np.flatnonzero((values > low) & (values <= high))
            miss = np.linalg.norm(matrix @ space[:, inside] - space[:, inside] * values[inside], axis=0)
            if len(inside) == expected and miss.max(initial=0.0) <= 64 * np.finfo(float).eps * scale:
                return values[inside], space[:, inside].T
        if block == dim:
            # rounding decides on which side of a bound an eigenvalue lies: the nearest ones to the interval
            inside = np.sort(np.argsort(np.abs(values - centre))[:expected])
            return values[inside], space[:, inside].T
        block = min(dim, 2 * block)


def leading(spark: SparkSession, matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest ``wanted`` eigenvalues over rounding error, falling, and their unit vectors as rows."""
    cuts = intervals(matrix, wanted)
    if not cuts:
        return np.zeros(0), np.zeros((0, len(matrix)))
    shared = spark.sparkContext.broadcast(matrix)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in batch.to_pylist():
                values, rows = feast(shared.value, cut["low"], cut["high"], cut["inside"])
                yield pa.RecordBatch.from_pydict({
                    "low": pa.array([cut["low"]] * len(values)), "value": pa.array(values),
                    "vector": pa.array(rows.tolist(), pa.list_(pa.float64()))})

    asked = spark.createDataFrame(cuts, "low double, high double, inside int").repartitionByRange(len(cuts), "low")
    found = asked.mapInArrow(solve, "low double, value double, vector array<double>").collect()
    for low, _, inside in cuts:
        if sum(r.low == low for r in found) != inside:
            raise ArithmeticError(f"{inside} eigenvalues expected over {low}")
    # neighbours from two intervals are made orthogonal by one more projection
    basis, _ = np.linalg.qr(np.array([r.vector for r in sorted(found, key=lambda r: -r.value)]).T)
    small = basis.T @ matrix @ basis
    values, turned = np.linalg.eigh((small + small.T) / 2)
    vectors = (basis @ turned).T[::-1][:wanted]
    signs = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])
    return values[::-1][:wanted], vectors * signs[:, None]


# --- whitening ---------------------------------------------------------------

@dataclass(frozen=True)
class Whitening:
    """Rows fitted on, their sums, and the components: eigenvalues falling, unit vectors as rows, the covariance's trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums) @ self.vectors.T / np.sqrt(self.values)


def fit(vectors: DataFrame, components: int = COMPONENTS, column: str = "embedding") -> Whitening:
    """Components of all usable vectors."""
    n, sums = _totals(vectors, column)
    dim = len(sums)
    if not n:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    covariance = _products(vectors, column, dim, lambda v: centred(integers(v, dim)[1], n, sums)) / n
    values, rows = leading(vectors.sparkSession, covariance, min(components, dim))
    return Whitening(n, sums, values, rows, float(np.trace(covariance)))


def identity_error(vectors: DataFrame, model: Whitening, column: str = "embedding") -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, over the fitted rows."""
    k, dim = len(model.values), len(model.sums)
    if not k:
        return 0.0
    # the first number is always one: its products with the others are their sums
    ones = _products(vectors, column, k + 1, lambda v: _with_one(model.project(integers(v, dim)[1])))
    mean = ones[0, 1:] / model.n
    spread = _products(vectors, column, k, lambda v: model.project(integers(v, dim)[1]) - mean) / model.n
    return float(np.abs(spread - np.eye(k)).max())


def _with_one(rows: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones((len(rows), 1)), rows], axis=1)


def whitened(vectors: DataFrame, model: Whitening, keep: Sequence[str] = ("vec_id",), column: str = "embedding") -> DataFrame:
    """``keep`` columns, ``component, n, deviation, whitened, explained, identity_error``: a row for each usable vector and component."""
    schema = mapped_schema(vectors, keep, [
        T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
        T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()),
        T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())])
    k, dim = len(model.values), len(model.sums)
    if not k:
        return vectors.sparkSession.createDataFrame([], schema)
    error = identity_error(vectors, model, column)
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        explained = known.values / known.trace
        for batch in batches:
            rows, x = integers(batch.column(len(keep)), dim)
            if not len(rows):
                continue
            far = squared_lengths(deviations(x, known.n, known.sums))
            times = np.repeat(np.arange(len(rows)), k)
            yield pa.RecordBatch.from_arrays([
                *(c.take(pa.array(rows[times])) for c in batch.columns[: len(keep)]),
                pa.array(np.tile(np.arange(1, k + 1), len(rows)), pa.int32()),
                pa.array(np.full(len(times), known.n)),
                pa.array(far, pa.int64()).take(pa.array(times)),
                pa.array(known.project(x).ravel()),
                pa.array(np.tile(explained, len(rows))),
                pa.array(np.full(len(times), error))], names=schema.names)

    return vectors.select(*keep, F.col(column)).mapInArrow(run, schema)
