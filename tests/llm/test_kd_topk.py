from __future__ import annotations

import math

import numpy as np

from adpulse.llm import kd_topk as t


def brute(rows, asked, k):
    q = lambda v: [math.floor(256 * x) for x in v]
    ok = [(i, q(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in ok:
        if asked(i):
            best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in ok if j != i and len(v) == len(w))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def test_search_of_one_shard_with_ties():
    rng = np.random.default_rng(0)
    v = rng.integers(-3, 4, (700, 6)).astype(float)
    v[100:400] = v[100]
    ids = rng.permutation(2000)[:700]
    got = t.search(ids, v, ids[:50], v[:50], np.full(50, -np.inf), 5, leaf_rows=8)
    for a in range(50):
        want = sorted((-int(v[a] @ v[b]), int(ids[b])) for b in range(700) if b != a)[:5]
        assert sorted((-s, i) for q, i, s in got if q == ids[a]) == want


def test_large_components_are_exact():
    v = np.array([[1e12, 3.0], [1e12, 2.0], [-1e12, 1.0], [1e300, 0.0]])
    got = t.search(np.arange(4), v, np.array([0]), v[:1], np.array([-np.inf]), 2)
    assert got == [(0, 1, (1 << 63) - 1), (0, 3, (1 << 63) - 1)]
    small = np.array([[3e9, 1.0], [3e9, 2.0]])
    assert t.search(np.arange(2), small, np.array([0]), small[:1], np.array([-np.inf]), 2) == [(0, 1, 9 * 10**18 + 2)]


def test_spark_result_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    vec = [[float(x) for x in v] for v in rng.normal(0, .2, (260, 16)).astype(np.float32)]
    vec[40:130] = [vec[40]] * 90
    rows = list(enumerate(vec)) + [(300, None), (350, [float("nan")] * 16), (351, [None] * 16), (352, [float("inf")] * 16), (None, vec[3]), (400, [1.0, 2.0]), (401, [0.5, -1.0]), (450, [])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, _floor int").repartition(2)
    got = t.top_k(df, df.where("vec_id % 50 = 0"), shard_rows=60, query_rows=3)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 50 == 0, 5)
    assert t.top_k(df.limit(0), df.limit(0)).count() == 0
