import math

import numpy as np
from pyspark.sql import functions as F

from siftwell.llm import topk
from siftwell.llm.permindex import InvertedFiles, greatest, nearest
from siftwell.llm.topk import NONE, cheapest_lead, search, top_inner

SCHEMA = "vec_id long, embedding array<float>"


def vectors(n=700, d=16, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * rng.lognormal(size=(n, 1))
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    rows[10] = (10, rows[11][1])
    rows[20] = (20, rows[21][1])
    return rows + [(800, None), (900, [1.0, None]), (1000, [float("nan")] * d), (1100, [math.inf] + [0.0] * (d - 1)), (1200, [1.0, 2.0])]


def test_exact_top_k(spark):
    rows = vectors()
    got = top_inner(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", F.col("vec_id") % 100 == 0, 10).collect()
    ok = {i: [math.floor(1024 * x) for x in v] for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in (i for i in ok if i % 100 == 0):
        s = sorted((-sum(a * b for a, b in zip(ok[q], v)), i) for i, v in ok.items() if i != q)[:10]
        want += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def ranked(q, x, ids, own, k):
    s = x @ q
    order = [i for i in np.lexsort((ids, -s)) if ids[i] != own][:k]
    return [(int(ids[i]), int(s[i])) for i in order]


def test_search_prunes_and_stays_exact():
    """Vectors of few directions and many lengths: most pairs are left out, with ties and several blocks."""
    rng = np.random.default_rng(4)
    x = np.floor(1024 * (rng.normal(size=(9000, 6)) @ rng.normal(size=(6, 32)) * rng.lognormal(size=(9000, 1)) + rng.normal(size=(9000, 32)) * 0.01)).astype(np.int64)
    x[100:140] = x[100]
    x = x[np.argsort(-np.linalg.norm(x, axis=1), kind="stable")]
    ids = rng.permutation(9000)
    some = x[rng.choice(9000, 500, replace=False)].astype(np.float64)
    basis = np.linalg.eigh(some.T @ some)[1][:, ::-1]
    lead = cheapest_lead(some, basis, 10)
    assert lead < 32
    stripe = []
    for i in range(0, 9000, 2500):
        b = x[i : i + 2500]
        xr = b.astype(np.float64) @ basis
        stripe.append((ids[i : i + 2500], b, xr, np.linalg.norm(b.astype(np.float64), axis=1), np.linalg.norm(xr[:, lead:], axis=1)))
    pick = rng.choice(9000, 50, replace=False)
    row, got, score, work = search(ids[pick], x[pick], np.full(50, float(NONE)), stripe, 10, basis, lead)
    for j, i in enumerate(pick):
        assert list(zip(got[row == j].tolist(), score[row == j].tolist())) == ranked(x[i], x, ids, ids[i], 10)
    assert work < 0.4 * 50 * 9000, work


def test_exact_top_k_of_several_stripes(spark):
    rng = np.random.default_rng(7)
    x = rng.integers(-3, 4, size=(3000, 5)) * rng.integers(1, 6, size=(3000, 1))
    rows = [(i if i != 77 else 78, (v / 1024).tolist()) for i, v in enumerate(x)]  # many ties, a repeated id
    old = topk.STRIPE_ROWS, topk.ROW_BLOCK, topk.QUERY_BLOCK, topk.BLOCK_VALUES
    topk.STRIPE_ROWS, topk.ROW_BLOCK, topk.QUERY_BLOCK, topk.BLOCK_VALUES = 700, 128, 7, 5 * 150
    try:
        got = {}
        for r in top_inner(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", F.col("vec_id") % 100 == 0).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    finally:
        topk.STRIPE_ROWS, topk.ROW_BLOCK, topk.QUERY_BLOCK, topk.BLOCK_VALUES = old
    ids = np.array([i for i, _ in rows])
    for q in range(0, 3000, 100):
        assert [(v, s) for _, v, s in sorted(got[q])] == ranked(x[q], x, ids, q, 10)


def test_few_candidates_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 1.0])], SCHEMA)
    assert [tuple(r) for r in top_inner(df, "vec_id", "embedding", F.col("vec_id") % 100 == 0).collect()] == [(0, 1, 1, 1024 * 1024 * 5)]
    assert top_inner(df.limit(0), "vec_id", "embedding", F.col("vec_id") % 100 == 0).count() == 0
    assert [(r.query_id, r.vec_id, r.score) for r in nearest(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 5.0)]
    assert nearest(df.limit(0), "vec_id", "embedding", F.col("vec_id") % 20 == 0).count() == 0


def recall(spark, x, **parameters):
    df = spark.createDataFrame([(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)] + [(6020, [0.0] * x.shape[1])], SCHEMA)
    got = nearest(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0, **parameters).collect()
    y = x.astype(np.float32).astype(np.float64)
    hit = total = 0
    found = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
        assert abs(r.score - y[r.query_id] @ y[r.vec_id]) < 1e-12
    for q in range(0, len(x), 20):
        s = y @ y[q]
        s[q] = -9
        hit, total = hit + len(set(np.argsort(-s)[:20].tolist()) & found[q]), total + 20
    assert 6020 not in found
    return hit / total


def test_permutation_recall(spark):
    """Of one block and of several, the least number of rows to rerank being off."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6000, 64)) + 1.2 * rng.normal(size=(10, 64))[rng.integers(0, 10, 6000)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for parameters in ({}, {"least": 1}, {"least": 1, "row_block": 1000}):
        assert recall(spark, x, **parameters) >= 0.9, parameters


def test_permutation_ties_and_repeated_ids(spark):
    rng = np.random.default_rng(9)
    x = rng.integers(-1, 2, size=(300, 4)).astype(float)
    x[x.any(axis=1) == 0] = 1
    rows = [(i if i != 41 else 40, v.tolist()) for i, v in enumerate(x)]
    got = {}
    for r in nearest(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", F.col("vec_id") % 20 == 0, rerank=1.0, row_block=64).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, int(r.score)))
    ids = np.array([i for i, _ in rows])
    for q in set(range(0, 300, 20)) - {40}:
        assert [(v, s) for _, v, s in sorted(got[q])] == ranked(x[q], x, ids, q, 20)


def test_greatest():
    rng = np.random.default_rng(3)
    for n in (1, 5, 200):
        v = rng.integers(0, 7, n)
        for take in (1, n // 2 + 1, n, n + 3):
            got = greatest(v, take)
            assert len(set(got.tolist())) == len(got) == min(take, n) and sorted(v[got].tolist()) == sorted(v.tolist())[n - len(got) :]


def test_footrule():
    rng = np.random.default_rng(1)
    order = np.argsort(rng.random((50, 30)), axis=1)
    files, q = InvertedFiles(order[:, :6], 30), order[:3, :9]
    place = lambda row, p, n: row.tolist().index(p) if p in row.tolist() else n
    for a in q:
        near = files.overlap(a)
        foot = [sum(abs(place(a, p, 9) - place(b[:6], p, 9)) for p in set(a.tolist()) | set(b[:6].tolist())) for b in order]
        most = sum(9 - i for i in range(9)) + sum(9 - i for i in range(6))
        assert [most - 2 * o for o in near.tolist()] == foot
