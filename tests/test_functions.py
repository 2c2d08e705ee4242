"""Literal results of the scalar functions."""

import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from siftwell.functions import text as T


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x"))).first()[0]


@pytest.mark.parametrize("candidate, score", [("loadHTTPServer", 1.0), ("load_http_server.helper", 0.95), ("unrelated", 0.0), ("buscarValor", 0.0)])
def test_fuzzy_names(spark, candidate, score):
    assert one(spark, candidate, lambda c: T.fuzzy_score("load-http-server", c)) == score


@pytest.mark.parametrize("query, candidate, least, score", [("run-task", "runTask", 0.55, 1.0), ("load", "loadValue", 0.55, 0.95), ("value", "loadValue", 0.55, 0.85), ("kitten", "sitting", 0.7, 0.0), ("kitten", "sitting", 0.5, 1 - 3 / 7), ("", "x", 0.5, 0.0)])
def test_fuzzy_pairs(spark, query, candidate, least, score):
    assert one(spark, candidate, lambda c: T.fuzzy_score(query, c, least)) == pytest.approx(score, abs=1e-12)


def test_levenshtein_bound(spark):
    assert one(spark, "kitten", lambda c: T.levenshtein_bounded(c, F.lit("sitting"), 2)) == 3
    assert one(spark, "kitten", lambda c: T.levenshtein_bounded(c, F.lit("sitting"), 3)) == 3


def test_identifier_terms(spark):
    got = one(spark, "HTTPClient.fetch_userID", lambda c: T.identifier_terms(c))
    assert got[0] == "httpclient.fetch_userid" and {"http", "client", "fetch", "user", "id"} <= set(got) and len(got) == len(set(got))


def test_query_terms():
    assert T.query_terms("The HTTP_client the café") == ["the", "http", "client", "café"]
    assert len(T.query_terms(" ".join(f"t{i}" for i in range(50)))) == 32 and T.query_terms("x" * 129) == []
    assert T.folded_query("Café") == ["cafe"]


def test_uuid5_and_hash(spark):
    for name in ("a", "café", "x" * 300):
        assert one(spark, name, lambda c: T.uuid5(T.NAMESPACE, c)) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))
        assert one(spark, name, T.content_hash) == hashlib.sha256(name.encode()).hexdigest()


@pytest.mark.parametrize("text", ["", "a", "a\n", "a\nb", "a\r\nb\r", "a\x0bb\u2028c", "\n\n", "a\x1cb"])
def test_lines(spark, text):
    assert one(spark, text, T.lines) == text.splitlines()
    assert one(spark, text, T.line_count) == max(1, len(text.splitlines()))


def test_paths(spark):
    rows = spark.createDataFrame([("package/inside.py",), ("package_extra.py",), ("outside.py",), ("PACKAGE/x.py",), ("package",)], "p string")
    assert [r.p for r in rows.filter(T.under_path(F.col("p"), T.valid_path("package/"))).collect()] == ["package/inside.py", "PACKAGE/x.py", "package"]
    assert T.valid_path(" . ") is None and T.valid_path("a\\b/") == "a/b"
    for bad in ("../x", "/x", "c:/x", "a\0"):
        with pytest.raises(ValueError):
            T.valid_path(bad)
    assert T.is_path_like("src/app") and T.is_path_like("Service.run") and not T.is_path_like("plain words")
    assert T.is_identifier_like("load_x.y-z") and not T.is_identifier_like("two words") and not T.is_identifier_like("9x")


def test_hashed_vector(spark):
    v = one(spark, "text", lambda c: T.hashed_vector(c, 48))
    raw = [b / 127.5 - 1 for r in range(2) for b in hashlib.sha256(f"text:{r}".encode()).digest()][:48]
    norm = sum(x * x for x in raw) ** 0.5
    assert v == pytest.approx([x / norm for x in raw])


def test_module_names(spark):
    for path, name in (("a/b.py", "a.b"), ("a/__init__.py", "a"), ("__init__.py", "__root__")):
        assert one(spark, path, T.module_name) == name


def test_hashed_vector_hashes_each_text_once(spark):
    texts = ["", "a", "é" * 70_000, None]
    df = spark.createDataFrame([(x,) for x in texts], "text string").select("text", T.hashed_vector(F.col("text"), 40).alias("v"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert "sha2(" in plan and "sha2(" not in plan.partition("lambdafunction(")[2]  # a lambda's body is evaluated per element
    for r in df.collect():
        if r.text is None:
            assert r.v == [None] * 40
        else:
            raw = [x / 127.5 - 1 for i in (0, 1) for x in hashlib.sha256(r.text.encode() + f":{i}".encode()).digest()][:40]
            assert r.v == pytest.approx([x / sum(y * y for y in raw) ** 0.5 for x in raw], abs=1e-12)
