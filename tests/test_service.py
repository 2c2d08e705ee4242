"""Tools, allowed roots, leases, progress, embedders and synthetic inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.engine import Candidates, Engine, Event, Incompatible, Throttle
from siftwell.functions import embedding as B
from siftwell.operators import maintenance as M
from siftwell.service import TOOLS, UNAVAILABLE, Repositories, SearchRequest, Service, ServiceError
from siftwell.sources import synthetic


letters = lambda texts: np.array([[t.count(c) + 1 for c in "abc"] for t in texts], float)  # noqa: E731  (sent by value)


def test_throttle():
    seen = []
    tell = Throttle(seen.append)
    for i in range(0, 101):
        tell(Event("a", i, 100))
    tell(Event("b", 0, 0))
    tell(Event("b", 0, 0))
    assert [e.current for e in seen if e.stage == "a"] == list(range(0, 101, 10)) and len([e for e in seen if e.stage == "b"]) == 1


def test_allowed_roots(tmp_path):
    inside, outside = tmp_path / "roots" / "repo", tmp_path / "elsewhere"
    inside.mkdir(parents=True)
    outside.mkdir()
    (tmp_path / "roots" / "file").write_text("x")
    (tmp_path / "roots" / "out").symlink_to(outside)
    (tmp_path / "in").symlink_to(inside)
    engine = type("E", (), {"place": staticmethod(lambda root: "p")})()
    r = Repositories([str(tmp_path / "roots")])
    assert r.resolve(str(inside), engine).root == r.resolve(str(tmp_path / "in"), engine).root == str(inside.resolve())
    said = set()
    for bad in (str(outside), str(tmp_path / "none"), str(tmp_path / "roots" / "none"), str(tmp_path / "roots" / "file"), str(tmp_path / "roots" / "out"), str(tmp_path / "rootsx"), "", "a" * 5000, "x\0y", str(inside / ".." / ".." / "elsewhere")):
        with pytest.raises(ServiceError) as e:
            r.resolve(bad, engine)
        said.add(str(e.value))
    assert said == {UNAVAILABLE}


def test_requests():
    for bad in ({"mode": "none"}, {"top_k": 0}, {"top_k": True}, {"top_k": 21}, {"query": ""}, {"query": " "}, {"query": "x" * 2001}, {"max_snippet_chars": 0}, {"backend": "none"}, {"mode": "fuzzy", "query": "x" * 257}):
        with pytest.raises(ServiceError):
            SearchRequest(**{"repository_path": "a", "query": "b"} | bad)


def test_tools(spark, tmp_path):
    root = tmp_path / "repo"
    (root / "app").mkdir(parents=True)
    (root / "app" / "util.py").write_text("def helper(x):\n    return x\n")
    (root / "app" / "main.py").write_text("from app.util import helper\n\n\ndef run():\n    return helper(1)\n")
    events, replaced = [], []
    engine = Engine(spark, str(tmp_path / "data"), events=events.append, replaced=replaced.append)
    service = Service(engine, [str(tmp_path)])
    assert set(TOOLS) == {"index_repository", "get_index_status", "search_code"} and service.get_index_status(str(root)) == {"status": "missing"}
    with pytest.raises(ServiceError, match="isn't indexed"):
        service.search_code(str(root), "helper")
    report = service.call("index_repository", {"repository_path": str(root)})
    assert report["files"] == 2 and replaced == [str(root.resolve())] and [e.stage for e in events if e.current == 0] == ["walk", "compare", "parse", "embed", "graph", "promote"]
    found = service.call("search_code", {"repository_path": str(root), "query": "helper", "mode": "lexical"})
    assert found["results"][0]["name"] == "helper" and service.search_code(str(root), "helper", mode="graph")["results"] and set(found["timings"]) == {"route", "plan", "run"}
    assert [n["root"] for n in service.list_available_indexes()] == [str(root.resolve())]
    snaps = engine.snapshots(str(root))
    assert snaps.read("graph_nodes").filter("kind = 'repository' and path is null and name = 'repo'").count() == 1
    with M.Lease(snaps):
        assert service.get_index_status(str(root)) == {"status": "indexing"}
        with pytest.raises(ServiceError, match="being indexed"):
            service.index_repository(str(root))
    for tool, arguments in (("none", {}), ("search_code", {"query": "x"}), ("search_code", {"repository_path": str(root), "query": "x", "more": 1})):
        with pytest.raises(ServiceError):
            service.call(tool, arguments)
    # another model: the index is stale, isn't searched by vectors, and is made anew
    other = Engine(spark, str(tmp_path / "data"), embedder=B.ArrowEmbedder("test", "letters", 3, lambda: letters, "query: "))
    assert other.status(str(root))["status"] == "stale"
    with pytest.raises(Incompatible):
        other.search(str(root), "how is it", mode="semantic")
    with pytest.raises(ServiceError, match="another model"):
        Service(other, [str(tmp_path)]).search_code(str(root), "how is it", mode="semantic")
    assert other.index(str(root))["embedded"] == report["chunks"] and other.status(str(root))["status"] == "ready"
    assert other.search(str(root), "how is it", mode="semantic").results
    assert other.in_memory(str(root))["graph_nodes"].count() == snaps.read("graph_nodes").count()


def test_cancelled_between_stages(spark, tmp_path):
    from siftwell.sources.repository import Cancelled

    (tmp_path / "repo").mkdir()
    (tmp_path / "repo" / "a.py").write_text("x = 1\n")

    def stop():
        if seen and seen[-1] == "embed":
            raise Cancelled

    seen = []
    engine = Engine(spark, str(tmp_path / "data"), progress=seen.append, check=stop)
    with pytest.raises(Cancelled):
        engine.index(str(tmp_path / "repo"))
    assert seen[-1] == "embed" and engine.status(str(tmp_path / "repo")) == {"status": "missing"}  # the lease is given back


def test_candidates_are_bounded(spark):
    c, rows = Candidates(2, 1000), [spark.range(i + 1) for i in range(4)]
    a = c.get(("a", 1), rows[0], 8)
    assert c.get(("a", 1), rows[0], 8) is a
    c.get(("b", 1), rows[1], 8)
    c.get(("a", 1), rows[0], 8)
    c.get(("c", 1), rows[2], 8)
    assert list(c.held) == [("a", 1), ("c", 1)]
    c.get(("a", 2), rows[3], 8)  # a newer version of an index takes the place of the old one
    assert list(c.held) == [("c", 1), ("a", 2)] and c.get(("d", 1), rows[3], 1000) is rows[3] and not rows[3].filter("id < 0").count()
    c.clear()
    assert not c.held


def test_embedders(spark):
    df = spark.createDataFrame([("a",), ("abc",), (None,)], "t string")
    e = B.ArrowEmbedder("test", "letters", 3, lambda: letters, batch=2)
    got = [r.v for r in df.select(e.embed(F.col("t")).alias("v")).collect()]
    want = letters(["a", "abc", ""])
    assert np.allclose(got, want / np.linalg.norm(want, axis=1, keepdims=True))
    for bad in (lambda t: np.zeros((len(t), 3)), lambda t: np.ones((len(t), 2)), lambda t: np.full((len(t), 3), np.nan)):
        with pytest.raises(ValueError):
            B.ArrowEmbedder("test", "bad", 3, lambda bad=bad: bad).embed_query(spark, "x")
    h = B.HashEmbedder(16)
    assert abs(np.linalg.norm(h.embed_query(spark, "x")) - 1) < 1e-12 and B.identity(h) == {"provider": "deterministic", "model": "sha256", "dimension": 16}


def test_vector_codec(spark):
    rows = spark.createDataFrame([([1.0, -0.5, 0.1],), ([],), (None,)], "v array<double>")
    got = rows.select(B.packed(F.col("v")).alias("b")).select("b", B.unpacked(F.col("b")).alias("v")).collect()
    assert bytes(got[0].b) == np.array([1.0, -0.5, 0.1], "<f4").tobytes() and np.allclose(got[0].v, [1.0, -0.5, 0.1]) and got[1].v == [] and got[2].v is None
    with pytest.raises(Exception):
        spark.createDataFrame([([1e300],)], "v array<double>").select(B.packed(F.col("v"))).collect()


def test_synthetic(spark):
    def letter(seed, n):
        v, out = (seed + n * 2_654_435_761) & 0xFFFFFFFF, ""
        for _ in range(8):
            out, v = out + chr(97 + v % 26), v // 26
        return out

    rows = spark.range(200_000, 200_050).select("id", synthetic.token(synthetic.SEED, F.col("id")).alias("t")).collect()
    assert all(r.t == letter(synthetic.SEED, r.id) for r in rows)
    v = synthetic.vectors(spark, 20, 8)
    assert v.count() == 20 and v.filter("abs(aggregate(embedding, 0d, (s, x) -> s + x * x) - 1) > 1e-9").isEmpty()
    e = synthetic.exact_names(spark, 50)
    assert e.filter("name = 'target'").count() == e.filter("qualified_name = 'target'").count() == 1 and synthetic.names(spark, 30).select("name").distinct().count() == 30
    t = spark.createDataFrame([(2.0, 4.0, 100), (0.0, 1.0, 5)], "m double, r double, n long").select(*synthetic.throughput(F.col("m"), F.col("n")), synthetic.speed_up(F.col("r"), F.col("m"))).collect()
    assert tuple(t[0]) == (500.0, 50_000.0, 2.0) and tuple(t[1]) == (None, None, None)
