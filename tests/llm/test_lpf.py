import hashlib
import random

import numpy as np

from siftwell.llm.buffers import words64
from siftwell.llm.lpf import common_prefixes, longest_previous_factors, previous_smaller, removal_report, without_repeats

WIDTH = 50


def brute(docs):
    first = {}
    for d, t in docs:
        b = (t or "").encode()
        if d is not None:
            for i in range(len(b) - WIDTH + 1):
                w = b[i : i + WIDTH]
                first[w] = min(first.get(w, d), d)
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - WIDTH + 1) if d is not None else ():
            if first[b[i : i + WIDTH]] < d:
                gone[i : i + WIDTH] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((d, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randrange(2, 9)))
    passages = [" ".join(word() for _ in range(rng.randrange(6, 40))) for _ in range(12)]
    docs = []
    for d in range(150):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            p = rng.choice(passages)
            cut = rng.randrange(len(p))
            parts.append(rng.choice([p, p[cut:], p[:cut], " ".join(word() for _ in range(9))]))
        docs.append((d, " ".join(parts)))
    return docs + [(200, None), (201, ""), (None, docs[3][1]), (5, docs[5][1]), (5, "x" + docs[6][1]), (202, "a" * 400), (203, "a" * 60), (204, docs[0][1] * 40), (199, docs[1][1] + " end")]


def test_against_brute_force(spark):
    docs = corpus()
    got = removal_report(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(docs), key=str)


def test_long_text_in_stretches(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefgh") for _ in range(2_100_000))
    docs = [(1, long[999_000:1_002_000]), (2, long), (3, long[2_050_000:2_050_100])]
    got = {r.doc_id: r for r in removal_report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[3].n_removed) == (0, 3000, 100)


def test_text_keeps_whole_characters_and_columns(spark):
    a = "é" * 40
    docs = spark.createDataFrame([(1, a, "x", 40), (2, "b" + a + "c", "y", 42), (3, a, "z", 40), (4, None, "n", None)], "doc_id long, text string, row string, n_chars long")
    got = {r.doc_id: r for r in without_repeats(docs).collect()}
    assert got[1].text == a and got[2].text == "bc" and got[2].n_chars == 2 and got[2].row == "y" and 3 not in got and got[4].text is None


def test_empty(spark):
    assert removal_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def factors(values, lcp):
    """Of every suffix with every other."""
    n = len(values)
    shared = lambda i, j: min(lcp[min(i, j) + 1 : max(i, j) + 1])
    return [max((shared(i, j) for j in range(n) if values[j] < values[i]), default=0) for i in range(n)]


def test_factors_equal_brute_force():
    rng = np.random.default_rng(3)
    for n, docs in ((1, 1), (2, 2), (60, 5), (200, 300)):
        for _ in range(5):
            values, lcp = rng.integers(0, docs, n), rng.integers(0, 9, n)
            lcp[0] = 0
            assert longest_previous_factors(values, lcp).tolist() == factors(values, lcp)
            capped = [f if f >= 5 else 0 for f in factors(values, lcp)]
            assert longest_previous_factors(values, lcp, 5).tolist() == capped


def test_neighbours():
    at, low = previous_smaller(np.array([3, 1, 2, 2, 0, 5]), np.array([0, 4, 7, 6, 8, 3]))
    assert at.tolist() == [-1, -1, 1, 1, -1, 4] and low.tolist() == [0, 0, 7, 6, 0, 3]
    chain = np.append(np.arange(1000), -1)  # pointers of the last one would be followed one by one
    at, low = previous_smaller(chain, np.full(1001, 5))
    assert at.tolist() == [-1, *range(999), -1] and set(low[1:-1]) == {5}


def test_common_prefixes():
    texts = sorted([b"a" * 50, b"a" * 49 + b"b", b"a" * 17 + b"z" * 33, b"b" * 50, b"b" * 50, b"b" * 41 + b"\xff" * 9])
    data = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
    words = [words64(data)[np.arange(6) * 50 + min(d, 42)].byteswap() for d in range(0, 50, 8)]
    want = [0] + [next((i for i in range(50) if a[i] != b[i]), 50) for a, b in zip(texts, texts[1:])]
    assert common_prefixes(words, 50).tolist() == want
