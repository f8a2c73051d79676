"""Exact top-k search against all inner products."""
import math

import numpy as np
import pytest

from codemap.llm import topk_search
from codemap.llm.queries import QUERIES


def brute(rows, k, every):
    """Sorted (query id, rank, id, score) over rows (id, vector)."""
    kept = [(i, [math.floor(64 * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for a, (i, x) in enumerate(kept):
        if i is None or i % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), j is None, j or 0) for b, (j, y) in enumerate(kept) if b != a)
        out += [(i, r + 1, None if null else j, -s) for r, (s, null, j) in enumerate(scored[:k])]
    return sorted(out, key=str)


def check(spark, rows, k=5, every=4, schema="vec_id long, embedding array<double>"):
    got = topk_search.search(spark.createDataFrame(rows, schema).repartition(5), k, every)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, k, every)


@pytest.fixture
def small_blocks(monkeypatch):
    for name, value in (("BLOCK", 16), ("QUERIES", 4), ("PART", 48), ("DIMS", 3)):
        monkeypatch.setattr(topk_search, name, value)


@pytest.mark.parametrize("seed,spread", [(1, 1.0), (3, 0.3)])
def test_random(spark, small_blocks, seed, spread):
    rng = np.random.default_rng(seed)
    data = rng.standard_normal((400, 13)) * spread ** np.arange(13) * rng.choice([0.1, 1, 3], (400, 1))
    check(spark, [(i, v) for i, v in enumerate(data.tolist())])


def test_ties_copies_and_repeated_rows(spark, small_blocks):
    rng = np.random.default_rng(4)
    data = [(i, v) for i, v in enumerate((rng.integers(-1, 2, (200, 4)) / 64).tolist())]
    data += [(i, [1.0, 1.0, 1.0, 1.0]) for i in range(200, 290)] + [(204, [1.0, 1.0, 1.0, 1.0]), (None, [1.0] * 4), (None, [-1.0] * 4), (8, [0.0] * 4)]
    check(spark, data)


def test_large_values_and_lengths(spark, small_blocks):
    rng = np.random.default_rng(5)
    data = [(i, v) for i, v in enumerate((rng.standard_normal((90, 6)) * 2.0 ** 22).tolist())]
    data += [(100, [2.0 ** 20]), (104, []), (108, [0.0] * 9), (112, [3.0] * 9)]
    check(spark, data)


def test_fewer_than_k_and_unusable_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (4, None), (8, [None, 1.0]), (12, [nan, 1.0]), (16, [inf, 0.0])]
    check(spark, rows)
    check(spark, [(0, [1.0])])
    check(spark, [(1, [1.0]), (2, [2.0])])
    check(spark, [])
    extra = spark.createDataFrame([(0, [1.0], 1, 2), (1, [2.0], 3, 4)], "vec_id long, embedding array<float>, c int, need int").withColumnRenamed("need", "meta.x")
    assert [tuple(r) for r in topk_search.search(extra).collect()] == [(0, 1, 1, 64 * 128)]


def test_bounds_drop_most_pairs():
    """Vectors whose mass is in few dimensions: the pairs left after the first block of dimensions are few."""
    rng = np.random.default_rng(6)
    data = np.floor(rng.standard_normal((600, 24)) * 300 * 0.5 ** np.arange(24)).astype(np.int64)
    scores = data[:40] @ data.T
    need = np.sort(scores, axis=1)[:, -5].astype(float)
    a, b, s = topk_search.cell(data[:40], np.ascontiguousarray(data.T), np.arange(600), need, 5)
    want = [(i, j, scores[i, j]) for i in range(40) for j in np.lexsort((np.arange(600), -scores[i]))[:5]]
    assert list(zip(a.tolist(), b.tolist(), s.tolist())) == [(i, int(j), int(v)) for i, j, v in want]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, [float(c) for c in r.embedding]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op13_topk"](spark, sf).collect()), key=str) == brute(rows, 20, 20)
