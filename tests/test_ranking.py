"""Literal results of ranking, fusion, grouping and the output budget."""

import pytest
from pyspark.sql import functions as F

from siftwell.operators import postings as P
from siftwell.operators import ranking as R
from siftwell.operators import vectors as V

SYMBOL = "id long, name string, qualified_name string, path string, start_line long"
POOL = "retriever string, rank long, path string, id string, score double"


def test_exact_order(spark):
    rows = [(0, "run", "package.first", "a.py", 1), (1, "other", "run", "b.py", 1), (2, "run", "run", "c.py", 1), (3, "run", "package.last", "d.py", 1)]
    got = R.exact(spark.createDataFrame(rows, SYMBOL), " run ", 10).collect()
    assert [r.id for r in got] == [1, 2, 0, 3] and {r.score for r in got} == {1.0}
    assert R.exact(spark.createDataFrame(rows, SYMBOL), "  ", 10).count() == 0


def test_fuzzy_order_and_limits(spark):
    rows = [(0, "load", "m.load", "b.py", 1), (1, "load", "m.load", "a.py", 1), (2, "loads", "loads", "a.py", 2), (3, "zzz", "zzz", "a.py", 3), (4, "x" * 600, "load" + "x" * 600, "a.py", 1)]
    df = spark.createDataFrame(rows, SYMBOL)
    assert [r.id for r in R.fuzzy(df, "load", 10).collect()] == [1, 0, 2]
    with pytest.raises(OverflowError):
        R.fuzzy(df, "load", 10, most_candidates=3)
    with pytest.raises(ValueError):
        R.fuzzy(df, "q" * 257, 10)
    assert R.fuzzy(df, "load", 10, least=0.0).count() == 5


def test_unit_vectors(spark):
    rows = [([3.0, 4.0],), ([0.0, 0.0],), ([],), (None,), ([float("nan"), 1.0],), ([float("inf"), 1.0],), ([1.0],), ([1.0, None],)]
    got = [r[0] for r in spark.createDataFrame(rows, "v array<double>").select(V.unit_column(F.col("v"), 2)).collect()]
    assert got == [[0.6, 0.8]] + [None] * 7


def test_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [-2.0, 0.0]), (3, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    assert [(r.id, r.score) for r in V.top_k(df, V.unit([1, 0], 2), "id", "v", 3).collect()] == [(0, 1.0), (1, 1.0), (3, 1.0)]
    assert [(r.query_id, r.id, r.score, r["rank"]) for r in V.batch_top_k(df, F.col("id") == 2, "id", "v", 2).collect()] == [(2, 0, -1.0, 1), (2, 1, -1.0, 2)]
    for bad in ([], [0, 0], [float("nan")]):
        with pytest.raises(ValueError):
            V.unit(bad)


def test_rrf(spark):
    rows = [("lexical", 1, "a.py", "a", 0.9), ("lexical", 2, "b.py", "b", 0.8), ("semantic", 3, "c.py", "c", 0.9), ("semantic", 1, "a.py", "a", 0.8)]
    rows[2] = ("semantic", 2, "c.py", "c", 0.9)
    got = R.reciprocal_rank_fusion(spark.createDataFrame(rows, POOL), {"lexical": 0.5, "semantic": 0.5}).collect()
    assert [r.id for r in got] == ["a", "b", "c"] and got[0].score == 1.0 and got[0].raw == pytest.approx(1 / 61) and got[1].raw == pytest.approx(0.5 / 62)
    for order in (rows[:2], rows[1::-1]):
        pass
    tie = [("lexical", 1, "b.py", "b", 0.5), ("semantic", 1, "a.py", "a", 0.5)]
    for rows in (tie, tie[::-1]):
        assert [r.path for r in R.reciprocal_rank_fusion(spark.createDataFrame(rows, POOL), {"lexical": 0.5, "semantic": 0.5}).collect()] == ["a.py", "b.py"]


def test_weighted(spark):
    rows = [("lexical", 1, "a", "a", 0.4), ("lexical", 2, "b", "b", 0.4), ("semantic", 1, "b", "b", 0.2)]
    assert [(r.id, r.score) for r in R.weighted_fusion(spark.createDataFrame(rows, POOL), {"lexical": 0.5, "semantic": 0.5}).collect()] == [("b", 1.0), ("a", 0.5)]
    assert R.weights_to_one(a=3, b=1) == {"a": 0.75, "b": 0.25}
    for bad in ({"a": 0, "b": 0}, {"a": -1, "b": 3}, {"a": float("inf")}):
        with pytest.raises(ValueError):
            R.weights_to_one(**bad)


def test_groups_and_representatives(spark):
    rows = [
        (1, 10, 5, "a", 1, 9, "f", 3, False), (2, 11, 5, "a", 1, 9, "f", 8, False), (3, 12, None, "b", 1, 2, "g", 1, False), (4, 13, None, "b", 2, 5, "g", 1, True),
        (5, 14, None, "b", 5, 6, "g", 1, False), (6, 15, None, "b", 9, 9, None, 1, False), (7, 16, None, "c", 9, 9, None, 1, False),
    ]
    df = spark.createDataFrame(rows, "ordinal long, id long, symbol_id long, path string, start_line long, end_line long, name string, snippet_length long, truncated boolean")
    groups = R.candidate_groups(df)
    assert {r.ordinal: r.group for r in groups.collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3, 6: 6, 7: 7}
    assert sorted(r.id for r in R.representatives(df, groups).collect()) == [11, 12, 15, 16]


def test_budget(spark):
    def kept(sizes, per, total):
        df = spark.createDataFrame([(i, i, n, False) for i, n in enumerate(sizes)], "rank long, id long, size long, truncated boolean")
        return [r.id for r in R.output_budget(df, per, total).orderBy("rank").collect() if r.kept]

    assert kept([40, 30, 5], 50, 50) == [0, 2] and kept([40, 40, 40], 30, 50) == [] and kept([10, 20, 20], 30, 50) == [0, 1, 2]


def test_kinds_need_their_words(spark):
    kinds = spark.createDataFrame([("imports",), ("symbol_comment",), ("module_docstring",), ("symbol",), (None,)], "k string")
    passed = lambda *words: [r.k for r in kinds.filter(R.wanted_kind(set(words), F.col("k"))).collect()]
    assert passed("run") == ["symbol", None] and passed("import") == ["imports", "symbol", None] and passed("comments") == ["symbol_comment", "symbol", None]


def test_bm25_index_equals_inline(spark):
    rows = [(1, "a b c", "x"), (2, "a a", "b"), (3, "", "c c"), (4, None, "é É e")]
    docs = spark.createDataFrame(rows, "id long, body string, title string")
    weights = {"body": 1.0, "title": 3.0}
    postings, sizes = P.build(docs, "id", ["body", "title"])
    a = {r.id: round(r.bm25, 12) for r in P.bm25(docs, "id", weights, ["a", "b", "e"]).collect()}
    b = {r.id: round(r.bm25, 12) for r in P.bm25_indexed(postings, sizes, "id", weights, ["a", "b", "e"]).collect()}
    assert a == b and set(a) == {1, 2, 4}


def test_batch_search_is_bounded_in_memory():
    import tracemalloc

    import numpy as np

    v = np.random.default_rng(1).normal(size=(32_768, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids = np.arange(len(v))
    tracemalloc.start()
    q, found, score = V.nearest(ids[:1024], v[:1024], ids, v, 3)
    assert tracemalloc.get_traced_memory()[1] < 40e6  # all scores at once would be 268 MB
    tracemalloc.stop()
    for i in (0, 63, 1023):
        want = np.round(np.clip(v @ v[i], -1, 1), 6)
        want[i] = -np.inf
        assert found[q == i].tolist() == np.lexsort((ids, -want))[:3].tolist() and score[q == i].tolist() == np.sort(want)[::-1][:3].tolist()


def test_batch_search_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "QUERY_BYTES", 160)
    monkeypatch.setattr(V, "ROW_BYTES", 480)
    rows = [(i, [float(i % 7 - 3) / 4, float(i % 5 - 2) / 4]) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got = {(r.query_id, r["rank"]): (r.id, r.score) for r in V.batch_top_k(df, F.col("id") % 20 == 0, "id", "v", 3).collect()}
    assert len(got) == 30
    for q in range(0, 200, 20):
        dots = sorted((-round(max(-1.0, min(1.0, sum(a * b for a, b in zip(v, rows[q][1])))), 6), i) for i, v in rows if i != q)
        assert [got[q, n + 1] for n in range(3)] == [(i, -s) for s, i in dots[:3]]
