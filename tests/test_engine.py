"""Walk, extraction and the engine from end to end on a small repository."""

import os

import pytest
from pyspark.sql import functions as F

from siftwell.engine import Engine
from siftwell.schema import Settings
from siftwell.sources import extract, repository

SERVICE = '''"""Service module."""
import os
from .util import helper as h

LIMIT = 3

# makes things
class Service(Base):
    """A service."""

    async def run(self):
        self.stop()
        return h(os.path)

    def stop(self):
        pass


print(LIMIT)
'''


@pytest.fixture()
def repo(tmp_path):
    files = {
        "app/__init__.py": "", "app/base.py": "class Base:\n    pass\n", "app/util.py": "def helper(x):\n    return x\n", "app/service.py": SERVICE.replace("(Base)", "(Base)").replace("import os\n", "import os\nfrom app.base import Base\n"),
        "tests/test_service.py": "from app.service import Service\n\n\ndef test_service():\n    Service().run()\n    Service()\n", "README.md": "# Usage\nCall the helper.\n\n# More\ntext\n", "data/skip.py": "x = 1\n", "pkg/data/keep.py": "x = 1\n",
        "node_modules/a.py": "x = 1\n", "out/gen.py": "x = 1\n", "bad.py": "def (:\n", ".gitignore": "out/\n*.tmp.py\n!keep.tmp.py\n", "a.tmp.py": "", "keep.tmp.py": "y = 2\n", "notes.txt": "no",
    }
    root = tmp_path / "repo"
    for p, t in files.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)
    (root / "bin.py").write_bytes(b"x\0y")
    os.symlink(root / "app", root / "link")
    return root


def test_walk(repo):
    assert repository.walk(str(repo)) == ["README.md", "app/__init__.py", "app/base.py", "app/service.py", "app/util.py", "bad.py", "keep.tmp.py", "pkg/data/keep.py", "tests/test_service.py"]
    with pytest.raises(ValueError):
        repository.walk(str(repo), most_files=3)
    with pytest.raises(ValueError):
        repository.walk(str(repo), most_entries=5)
    with pytest.raises(FileNotFoundError):
        repository.walk(str(repo / "none"))

    def stop():
        raise repository.Cancelled

    with pytest.raises(repository.Cancelled):
        repository.walk(str(repo), check=stop)


@pytest.mark.parametrize("rules, path, out", [
    ("*.py", "a/b.py", True), ("*.py\n!a/*", "a/b.py", False), ("/a.py", "b/a.py", False), ("/a.py", "a.py", True), ("b/", "a/b/c.py", True), ("b/", "b", False), ("a/b", "x/a/b", True), ("/a*", "a/b/c.py", True), ("[ab].py", "x/a.py", True), ("# c\n\n", "c", False), ("b", "a/b/c.py", True),
])
def test_ignore_rules(spark, rules, path, out):
    parsed = repository.parse_rules(rules)
    assert repository.is_ignored(path, False, parsed) is out
    assert spark.createDataFrame([(path,)], "p string").select(repository.ignored(F.col("p"), parsed)).first()[0] is out


def test_extraction():
    got = extract.python("app/service.py", SERVICE)
    assert [(s["qualified_name"], s["kind"]) for s in got["symbols"]] == [("Service", "class"), ("Service.run", "async_method"), ("Service.stop", "method")]
    kinds = [u["kind"] for u in got["units"]]
    assert set(kinds) == {"assignment", "imports", "module_code", "module_docstring", "symbol", "symbol_comment", "symbol_docstring"}
    facts = {(f["kind"], f["target_reference"], f["hint"], f["hint_method"]) for f in got["facts"]}
    assert ("inherits", "Base", None, None) in facts and ("imports", "app.util", "app.util", "explicitly_imported_module") in facts
    assert ("calls", "h", "app.util.helper", "explicitly_imported_symbol") in facts and ("calls", "self.stop", "app.service.Service.stop", "same_scope_qualified") in facts
    assert ("references", "os.path", "os.path", "explicitly_imported_module_member") in facts
    test = extract.python("tests/test_x.py", "def test_run(client):\n    client.go()\n")
    assert {n["kind"] for n in test["nodes"]} == {"test_file", "module", "test_symbol"}
    assert {("tests", "run", 0.65), ("tests", "client", 0.55), ("tests", "client.go", 0.85)} <= {(f["kind"], f["target_reference"], f["confidence"]) for f in test["facts"]}
    assert extract.python("x.py", "def (")["diagnostics"][0]["stage"] == "parse"
    assert [u["start_line"] for u in extract.documentation("a.md", "# A\nx\n# B\ny\n")["units"]] == [1, 3]
    with pytest.raises(ValueError):
        extract.register("python", extract.python)


def test_index_search_and_update(spark, repo, tmp_path):
    stages = []
    engine = Engine(spark, str(tmp_path / "data"), progress=stages.append)
    assert engine.status(str(repo)) == {"status": "missing"}
    with pytest.raises(FileNotFoundError):
        engine.search(str(repo), "x")
    report = engine.index(str(repo))
    assert report["errors"] == ["bad.py: parse: invalid syntax (<unknown>, line 1)"] and report["files"] == 8 and report["embedded"] == report["chunks"] == report["embeddings"]
    assert stages == ["walk", "compare", "parse", "embed", "graph", "promote"]
    edges = engine.snapshots(str(repo)).read("graph_edges")
    assert {r.kind for r in edges.select("kind").distinct().collect()} == {"tests", "depends_on", "references", "inherits", "imports", "calls"}
    s = lambda *a, **k: engine.search(str(repo), *a, **k)
    exact = s("helper")
    assert exact.mode == "exact" and exact.results[0]["qualified_name"] == "helper" and s("helpr").mode == "fuzzy" and s("how is it done").mode == "semantic"
    assert s("helper", mode="lexical").results[0]["name"] == "helper"
    assert all(s("helper", mode=m).results for m in ("hybrid_weighted", "graph"))
    assert {r["path"] for r in s("Service", mode="lexical", path="tests").results} == {"tests/test_service.py"}
    assert s("Service", max_snippet_chars=10).warnings == ["Omitted 1 results beyond the output budget"]
    with pytest.raises(ValueError):
        s("x", mode="none")
    (repo / "app/util.py").write_text("def helper2(x):\n    return x\n")
    (repo / "README.md").unlink()
    assert engine.status(str(repo))["status"] == "stale"
    report = engine.index(str(repo))
    assert report["changes"]["changed"] == 1 and report["changes"]["deleted"] == 1 and report["embedded"] == 1 and not s("helper", mode="exact").results and s("helper2").mode == "exact"
    (repo / "app/util.py").write_text("def broken(\n")
    engine.index(str(repo))
    assert s("helper2").mode == "exact"  # a file that fails keeps its rows


def test_settings():
    for bad in ({"graph_hops": 3}, {"fuzzy_threshold": 2.0}, {"window_lines": 5, "window_overlap": 5}):
        with pytest.raises(ValueError):
            Settings(**bad)


@pytest.mark.parametrize("compact_every", [16, 2])
def test_stream(spark, tmp_path, compact_every):
    from siftwell.streaming import current, follow

    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    assert current(spark, target) is None
    for rows in ([("a", "1"), ("b", "1")], [("b", "2"), ("c", "1"), ("c", "0")], [("a", "3")]):
        spark.createDataFrame(rows, "path string, content_hash string").coalesce(1).write.mode("append").parquet(source)
        follow(spark, source, "path string, content_hash string", target, str(tmp_path / "check"), ["path"], compact_every=compact_every).awaitTermination()
    assert sorted(map(tuple, current(spark, target).collect())) == [("a", "3"), ("b", "2"), ("c", "1")]
    assert spark.read.parquet(f"{target}/kind=delta").filter("batch = 2").count() == 1  # a batch writes its own rows alone
