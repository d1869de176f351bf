import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import whitening as W
from lectern.llm.queries import QUERIES

NAN = float("nan")


def exact(rows):
    """(n, sums, integers by row, covariance) in plain Python and numpy."""
    kept = [(i, [math.floor(1024 * c) + 100000 for c in v]) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([v for _, v in kept], object)
    n, sums = len(kept), [sum(c) for c in x.T]
    centred = np.array([[(n * a - s) / n for a, s in zip(v, sums)] for _, v in kept], float)
    return n, sums, kept, centred, centred.T @ centred / n


def held(found, rows, k=8):
    """Compare with numpy's own eigenvectors; components of equal eigenvalues are left to the residual."""
    n, sums, kept, centred, v = exact(rows)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    found = sorted(found, key=lambda r: (r.component, str(r.vec_id), r.deviation, r.whitened))
    for c in range(1, k + 1):
        mine = [r for r in found if r.component == c]
        projected = centred @ vectors[:, c - 1] / np.sqrt(values[c - 1])
        far = [sum((n * a - s) ** 2 for a, s in zip(x, sums)) for _, x in kept]
        sign = 1 if abs(next(r.whitened for r in mine if r.vec_id == kept[0][0]) - projected[0]) < 1e-6 else -1
        want = sorted((str(i), f, sign * p) for (i, _), f, p in zip(kept, far, projected))
        assert [(str(r.vec_id), r.deviation) for r in mine] == [w[:2] for w in want]
        assert np.allclose([r.whitened for r in mine], [w[2] for w in want], atol=1e-8)
        assert all(r.n == n and abs(r.explained / (values[c - 1] / np.trace(v)) - 1) < 1e-9 for r in mine)
    assert len(found) == k * n and found[0].identity_error < 1e-9


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_query_equals_plain(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    held(QUERIES["op12_feast_whitening"](spark, sf).collect(), rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    good = [[float(c) for c in v] for v in rng.standard_normal((40, 5)) * [5, 4, 3, 2, 1]]
    rows = [(i, v) for i, v in enumerate(good)]
    rows += [(0, good[0]), (None, good[1]), (90, None), (91, []), (92, [1.0, None, 0.0, 0.0, 0.0]), (93, [1.0, NAN, 0.0, 0.0, 0.0]),
             (94, [1.0, float("inf"), 0.0, 0.0, 0.0]), (95, [1.0, 2.0]), (96, [1e300, 0.0, 0.0, 0.0, 0.0])]
    schema = "vec_id bigint, embedding array<double>, component string, n string"
    frame = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], schema)
    kept = [(i, v) for i, v in rows if v and len(v) == 5 and None not in v and i != 96]
    held(W.whitened(frame, W.fit(frame)).collect(), kept, k=5)
    with pytest.raises(ValueError, match="rename"):
        W.whitened(frame, W.fit(frame), keep=("vec_id", "n"))


def test_nothing_to_whiten(spark):
    schema = "vec_id bigint, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]):
        frame = spark.createDataFrame(rows, schema)
        assert W.whitened(frame, W.fit(frame)).count() == 0


def test_flat_directions_are_no_components(spark):
    rows = [(i, [float(i % 7), float(i % 5), 3.0, float(i % 7)]) for i in range(70)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    model = W.fit(frame)
    assert len(model.values) == 2 and W.identity_error(frame, model) < 1e-9


def test_large_entries_stay_exact(spark):
    rows = [(i, [1e9 + i, -1e15 * (i % 3), float(i)]) for i in range(9)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    n, sums, kept, _, _ = exact(rows)
    model = W.fit(frame)
    assert (model.n, model.sums) == (n, sums)
    want = {i: sum((n * a - s) ** 2 for a, s in zip(x, sums)) for i, x in kept}
    got = {r.vec_id: r.deviation for r in W.whitened(frame, model).where("component = 1").collect()}
    assert got == {i: w if w < 1 << 63 else None for i, w in want.items()}


@settings(max_examples=30, deadline=None)
@given(st.integers(2, 12), st.integers(0, 10**6), st.booleans())
def test_inertia_counts_and_intervals(dim, seed, clustered):
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
    values = rng.integers(1, 4, dim).astype(float) if clustered else rng.uniform(0.1, 9, dim)
    matrix = q @ np.diag(values) @ q.T
    matrix = (matrix + matrix.T) / 2
    for shift in (0.05, 1.5, 2.5, 8.0):
        assert W.above(matrix, shift) == (values > shift).sum()
    found = np.concatenate([W.feast(matrix, *cut)[0] for cut in W.intervals(matrix, dim)])
    assert np.allclose(np.sort(found), np.sort(values))


def test_projection_needs_only_part_of_the_space():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.standard_normal((200, 200)))
    values = np.linspace(1, 100, 200)
    matrix = q @ np.diag(values) @ q.T
    got, rows = W.feast(matrix, 98.0, 99.0, int(((values > 98) & (values <= 99)).sum()))
    assert np.allclose(got, values[(values > 98) & (values <= 99)])
    assert np.abs(matrix @ rows.T - rows.T * got).max() < 1e-10
