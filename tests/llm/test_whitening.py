"""Whitening against a dense eigendecomposition in numpy."""
import math

import numpy as np
import pytest

from codemap.llm import whitening
from codemap.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, wanted=16):
    """{row number: (n, deviation, whitened up to sign)}, explained, components"""
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1000000 for c in v]) for i, v in enumerate(rows) if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), dtype=object)
    n, S = len(fit), fit.sum(axis=0)
    centred = (n * fit - S).astype(float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:wanted], vectors[:, ::-1][:, :wanted]
    out = {}
    for i, x in kept:
        y = n * np.array(x, dtype=object) - S
        out[i] = (n, int((y * y).sum()), (y.astype(float) / n) @ vectors / np.sqrt(values))
    return out, values / np.trace(centred.T @ centred / n), values


def check(rows_of, got, explained, exact=1e-6):
    """All components agree up to one sign for each; ids are row numbers."""
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert sorted(by) == sorted(rows_of)
    k = len(explained)
    mine = np.array([[by[i][c + 1].whitened for c in range(k)] for i in sorted(by)])
    want = np.array([rows_of[i][2] for i in sorted(by)])
    sign = np.sign((mine * want).sum(axis=0))
    assert np.abs(mine * sign - want).max() < exact
    for i in by:
        assert sorted(by[i]) == list(range(1, k + 1))
        for c, r in by[i].items():
            assert (r.n, r.deviation) == rows_of[i][:2]
            assert abs(r.explained / explained[c - 1] - 1) < 1e-4 and 0 <= r.identity_error < 1e-6


@pytest.mark.parametrize("n,d,spread", [(300, 24, 1.0), (40, 5, 0.7), (12, 20, 1.0)])
def test_against_eigenvectors(spark, n, d, spread):
    rng = np.random.default_rng(n)
    data = (rng.standard_normal((n, d)) * spread ** np.arange(d) * 2).tolist()
    data += data[:9] * 3
    df = spark.createDataFrame(list(enumerate(data)), SCHEMA).repartition(7)
    want, explained, values = brute(data)
    real = values > 1e-12 * values[0]
    want = {i: (a, b, w[real]) for i, (a, b, w) in want.items()}
    check(want, whitening.whiten(df).collect(), explained[real])


def test_equal_eigenvalues_are_all_found(spark):
    """Points at the same distance on every axis: one eigenvalue, d times."""
    d = 6
    data = [[float(s * 10 * (i == j)) for j in range(d)] for i in range(d) for s in (1, -1)]
    got = whitening.whiten(spark.createDataFrame(list(enumerate(data)), SCHEMA)).collect()
    assert {r.component for r in got} == set(range(1, d + 1)) and max(r.identity_error for r in got) < 1e-9
    assert all(abs(r.explained - 1 / d) < 1e-9 for r in got)


def test_unusable_rows_and_clashing_names(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], 0, 0), (2, [1.5, -2.0], 0, 0), (None, [0.0, 1.0], None, None), (2, [1.5, -2.0], 1, 1), (5, None, 1, 1), (6, [None, 1.0], 1, 1), (7, [nan, 1.0], 1, 1),
            (8, [1.0, -inf], 1, 1), (9, [], 1, 1), (10, [1.0], 1, 1), (11, [3e38, 0.0], 1, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, x int, d int").withColumnRenamed("d", "meta.n")
    got = whitening.whiten(df).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.component) for r in got) == sorted((i is None, i or 0, c) for i in (1, 2, None, 2) for c in (1, 2))
    assert {r.n for r in got} == {3}
    assert whitening.whiten(df.limit(0)).collect() == [] and whitening.whiten(df.limit(1)).collect() == []


def test_large_entries_are_exact(spark):
    data = [[2.0 ** 40 + 1, 0.5], [-(2.0 ** 41), 0.25], [2.0 ** 42, 1.0]]
    got = whitening.whiten(spark.createDataFrame(list(enumerate(data)), "vec_id long, embedding array<double>")).collect()
    x = [[int(64 * c) + 1000000 for c in v] for v in data]
    sums = [sum(c) for c in zip(*x)]
    assert {(r.vec_id, int(r.deviation)) for r in got} == {(i, sum((3 * c - s) ** 2 for c, s in zip(v, sums))) for i, v in enumerate(x)}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    data = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    got = QUERIES["op12_whitening"](spark, sf)
    assert dict(got.dtypes)["deviation"] == "bigint"
    order = sorted(data)
    want, explained, _ = brute([data[i] for i in order])
    check({order[i]: w for i, w in want.items()}, got.collect(), explained)
