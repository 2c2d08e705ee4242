"""Queries over a small repository of known content, whose results are written out as SQL values.

They cover what needs files, an index or the driver: walking, extraction, indexing, updating, searching. The repository
is written anew for each session, into the shared folder.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.engine import Engine
from siftwell.functions import embedding as codec
from siftwell.functions import text as T
from siftwell.functions.embedding import identity
from siftwell.operators import graph as G
from siftwell.operators import maintenance as M
from siftwell.operators import units as U
from siftwell.operators import vectors as V
from siftwell.plans.catalog import query
from siftwell.plans.golden_rows import EXPECTED
from siftwell.plans.modes import config_id
from siftwell.schema import Settings
from siftwell.service import TOOLS, Repositories, SearchRequest, ServiceError
from siftwell.session import shared_dir, table
from siftwell.sources import extract, repository, synthetic

FILES = {
    ".gitignore": "out/\n*.tmp.py\n!keep.tmp.py\n",
    "README.md": "# Usage\nCall the helper.\n\nMore\n----\ntext\n",
    "app/__init__.py": "",
    "app/base.py": "class Base:\n    pass\n",
    "app/util.py": "def helper(x):\n    return x\n",
    "app/service.py": (
        '"""Service module."""\nimport os\nfrom .base import Base\nfrom .util import helper as h\n\nLIMIT = 3\n\n# makes\n# things\nclass Service(Base):\n    """A service."""\n\n'
        "    async def run(self):\n        self.stop()\n        return h(os.path)\n\n    def stop(self):\n        pass\n\n\nprint(LIMIT)\n"
    ),
    "tests/test_service.py": "from app.service import Service\n\n\ndef test_service(client):\n    Service().run()\n",
    "a.tmp.py": "x = 1\n", "keep.tmp.py": "y = 2\n", "out/gen.py": "x = 1\n", "data/skip.py": "x = 1\n", "pkg/data/kept.rst": "Title\n=====\ntext\n", "node_modules/a.py": "x = 1\n", "notes.txt": "no\n", "bad.py": "def (:\n",
}
#: Files that are walked, in order.
WALKED = ["README.md", "app/__init__.py", "app/base.py", "app/service.py", "app/util.py", "bad.py", "keep.tmp.py", "pkg/data/kept.rst", "tests/test_service.py"]
_made: dict[str, str] = {}


def sql_text(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def values(columns: str, rows: list[tuple], types: dict[str, str] | None = None) -> str:
    """SELECT of literal rows; whole numbers are BIGINT unless ``types`` says otherwise."""
    names, types = columns.split(), types or {}

    def one(x, name: str) -> str:
        body = "NULL" if x is None else str(x).lower() if isinstance(x, bool) else sql_text(x) if isinstance(x, str) else repr(x)
        kind = types.get(name) or ("BOOLEAN" if isinstance(x, bool) else "BIGINT" if isinstance(x, int) else "DOUBLE" if isinstance(x, float) else None)
        return f"CAST({body} AS {kind})" if kind else body

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(one(x, n) for x, n in zip(r, names)) + ')' for r in rows)}) v({', '.join(names)})"


def folder(s: SparkSession) -> str:
    """The session's folder with the repository in it."""
    key = s.sparkContext.applicationId
    if key not in _made:
        base = os.path.join(shared_dir(s).removeprefix("file://").removeprefix("file:"), f"golden-{uuid.uuid4().hex}")
        for path, text in FILES.items():
            at = os.path.join(base, "repo", path)
            os.makedirs(os.path.dirname(at), exist_ok=True)
            with open(at, "w") as f:
                f.write(text)
        with open(os.path.join(base, "repo", "binary.py"), "wb") as f:
            f.write(b"x = 1\0")
        os.symlink(os.path.join(base, "repo", "app"), os.path.join(base, "repo", "link"))
        _made[key] = base
    return _made[key]


_engines: dict[str, tuple[Engine, str, dict]] = {}


def indexed(s: SparkSession) -> tuple[Engine, str, dict]:
    """(engine, repository, report) of the repository's index, made once a session."""
    base = folder(s)
    if base not in _engines:
        engine = Engine(s, f"{base}/index")
        _engines[base] = engine, f"{base}/repo", engine.index(f"{base}/repo")
    return _engines[base]


def sources(s: SparkSession) -> DataFrame:
    """Each session's Python and documentation texts, as rows."""
    rows = [(p, repository.SUFFIXES[os.path.splitext(p)[1]], FILES[p]) for p in WALKED]
    return extract.parsed(s.createDataFrame(rows, "relative_path string, language string, text string"))


def sql_files() -> str:
    rows = ", ".join(f"({sql_text(p)}, {sql_text(repository.SUFFIXES[os.path.splitext(p)[1]])}, {sql_text(FILES[p])})" for p in WALKED)
    return f"files AS (SELECT * FROM (VALUES {rows}) v(path, language, body))"


@query(f"""WITH {sql_files()} SELECT path, language, CAST(strlen(body) AS BIGINT) AS size_bytes, sha256(body) AS content_hash, CAST(greatest(1, len(body) - len(replace(body, chr(10), ''))) AS INTEGER) AS line_count, path LIKE 'tests/%' AS is_test
FROM files ORDER BY path""")
def repository_files(s, d):
    """Walk, ignore rules, bounded reads, binary check, suffixes, hashes, line counts: what an index starts from."""
    rows = repository.manifest(repository.files(s, f"{folder(s)}/repo"))
    return rows.select("path", "language", "size_bytes", "content_hash", "line_count", repository.is_test_path(F.col("path")).alias("is_test")).orderBy("path")


def python_symbols(s, d):
    return extract.exploded(sources(s), "symbols").select("path", "name", "qualified_name", "kind", "start_line", "end_line", "source_snippet")


def python_units(s, d):
    return extract.exploded(sources(s), "units").select("path", "kind", "start_line", "end_line", "symbol", "text")


def graph_nodes(s, d):
    return extract.exploded(sources(s), "nodes").select("path", "kind", "qualified_name", "name", "start_line", "end_line", "symbol")


def graph_facts(s, d):
    return extract.exploded(sources(s), "facts").select("path", "ordinal", "kind", "source_reference", "target_reference", "start_line", "confidence", "target_kind", "hint", "hint_method", "evidence")


def diagnostics(s, d):
    return extract.exploded(sources(s), "diagnostics").select("path", "stage", "line")


def index_tables(s, d):
    engine, root, report = indexed(s)
    return s.createDataFrame(sorted((k, v) for k, v in engine.counts(root).items() if k != "postings"), "table_name string, n long")


def index_report(s, d):
    _, _, report = indexed(s)
    return s.createDataFrame([("embedded", report["embedded"]), ("errors", len(report["errors"])), *((k, v) for k, v in report["changes"].items())], "what string, n long")


def graph_edges(s, d):
    engine, root, _ = indexed(s)
    snaps = engine.snapshots(root)
    nodes = snaps.read("graph_nodes")
    a, b = nodes.select(F.col("id").alias("source"), F.col("qualified_name").alias("source_name"), F.col("kind").alias("source_kind")), nodes.select(F.col("id").alias("target"), F.col("qualified_name").alias("target_name"), F.col("kind").alias("target_kind"))
    e = snaps.read("graph_edges").join(a, "source").join(b, "target")
    return e.select("kind", "source_kind", "source_name", "target_kind", "target_name", "start_line", "method", F.round("confidence", 6).alias("confidence"))


def fact_states(s, d):
    engine, root, _ = indexed(s)
    return engine.snapshots(root).read("graph_status").groupBy("path", "status").agg(F.count("*").alias("n"))


def chunk_rows(s, d):
    engine, root, _ = indexed(s)
    return engine.vectors(engine.snapshots(root)).orderBy("path", "start_line", "end_line", "id").select("path", "start_line", "end_line", "kind", "name", "qualified_name", F.size("vector").alias("dimension"))


def search_modes(s, d):
    """The first result of every mode, and how many there are; without meaning in the vectors, those of names decide."""
    engine, root, _ = indexed(s)
    rows = []
    for query_text, mode in (("helper", "auto"), ("Service.stop", "exact"), ("helpr", "auto"), ("how is a thing done", "auto"), ("Service", "lexical"), ("app/util.py", "lexical"), ("stop", "fuzzy"), ("imports of Base", "lexical")):
        r = engine.search(root, query_text, mode=mode)
        first = r.results[0] if r.results and r.mode != "semantic" else {}
        rows.append((query_text, mode, r.mode, first.get("path"), first.get("qualified_name"), len(r.warnings)))
    return s.createDataFrame(rows, "query string, requested string, mode string, path string, qualified_name string, warnings long")


def graph_search(s, d):
    """Expansion from a symbol: what calls, tests or holds it, through the engine's own seeds and edges."""
    engine, root, _ = indexed(s)
    snaps = engine.snapshots(root)
    symbol = snaps.read("symbols").filter("qualified_name = 'helper'").select(F.concat(F.lit("symbol:"), "id").alias("identity"), "path", F.lit(1.0).alias("score"))
    found = engine.expanded(snaps, symbol, 20)
    names = snaps.read("symbols").select(F.concat(F.lit("symbol:"), "id").alias("identity"), "qualified_name").unionByName(snaps.read("files").select(F.concat(F.lit("file:"), "path").alias("identity"), F.col("path").alias("qualified_name")))
    return found.join(names, "identity").select("rank", "qualified_name", F.round("score", 6).alias("score"))


def index_life(s, d):
    """Missing, ready, stale, updated: a file changes, one goes, one breaks and keeps its rows."""
    base = folder(s)
    root = f"{base}/life-{uuid.uuid4().hex}"
    engine = Engine(s, f"{root}-index")
    os.makedirs(root)

    def put(name: str, text: str) -> None:
        with open(f"{root}/{name}", "w") as f:
            f.write(text)

    def state(step: str) -> tuple:
        got = engine.status(root)
        return step, got["status"], ", ".join(got.get("changed", [])), got.get("files"), got.get("symbols")

    put("a.py", "def one():\n    pass\n")
    put("b.py", "def two():\n    pass\n")
    rows = [state("before")]
    engine.index(root)
    rows.append(state("indexed"))
    put("a.py", "def one():\n    pass\n\n\ndef three():\n    return one()\n")
    os.remove(f"{root}/b.py")
    rows.append(state("edited"))
    engine.index(root)
    rows.append(state("again"))
    put("a.py", "def (\n")
    engine.index(root)
    rows.append(state("broken"))
    copy = M.Snapshots(s, f"{root}-copy")
    engine.snapshots(root).backup(copy.root)
    rows.append(("copied", copy.note()["format"], ", ".join(n["place"].rsplit("/", 1)[-1][:5] for n in M.available(s, engine.data_dir)), copy.read("files").count(), copy.read("symbols").count()))
    with M.Lease(engine.snapshots(root)):
        rows.append(state("being written"))
    M.removed(engine.snapshots(root))
    rows.append(state("removed"))
    return s.createDataFrame(rows, "step string, status string, changed string, files long, symbols long")


GOLDEN = (python_symbols, python_units, graph_nodes, graph_facts, diagnostics, index_tables, index_report, graph_edges, fact_states, chunk_rows, search_modes, graph_search, index_life)
for _f in GOLDEN:
    _columns, _types, _rows = EXPECTED[_f.__name__]
    query(values(_columns, _rows, _types))(_f)

# --- rules that need no repository, over the driver's tables


@query("""WITH s AS (SELECT l_orderkey, l_suppkey * 2 AS a, l_suppkey * 2 + CAST(l_quantity AS BIGINT) AS b, l_returnflag AS k, l_linenumber AS n FROM lineitem),
f AS (SELECT *, CASE WHEN lag(b) OVER w IS NULL OR a - lag(b) OVER w > 2 OR k <> lag(k) OVER w THEN 1 ELSE 0 END AS new FROM s WINDOW w AS (PARTITION BY l_orderkey ORDER BY a, b, n, k))
SELECT l_orderkey, CAST(n AS BIGINT) AS line, CAST(sum(new) OVER (PARTITION BY l_orderkey ORDER BY a, b, n, k ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM f""")
def statement_islands(s, d):
    """Statements of a kind no more than 2 lines apart form a unit."""
    rows = table(s, d, "lineitem").select("l_orderkey", (F.col("l_suppkey") * 2).alias("start"), (F.col("l_suppkey") * 2 + F.col("l_quantity").cast("long")).alias("end"), F.col("l_returnflag").alias("kind"), F.col("l_linenumber").cast("long").alias("line"))
    return U.islands(rows, ["l_orderkey"], 2, "kind", ties=["line", "kind"]).select("l_orderkey", "line", "island")


@query("""WITH u AS (SELECT l_orderkey AS path, l_returnflag AS kind, l_linenumber % 2 AS a, l_linenumber % 2 + 1 AS b, CASE WHEN l_linenumber = 3 THEN ' ' ELSE l_returnflag || l_linenumber % 2 END AS text, l_linenumber AS o FROM lineitem)
SELECT path, kind, CAST(min(o) AS BIGINT) AS ordinal FROM u WHERE trim(text) <> '' GROUP BY path, kind, a, b, text""")
def unit_dedupe(s, d):
    n = F.col("l_linenumber").cast("long")
    units = table(s, d, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_returnflag").alias("kind"), (n % 2).alias("start_line"), (n % 2 + 1).alias("end_line"), F.when(n == 3, " ").otherwise(F.concat("l_returnflag", (n % 2).cast("string"))).alias("text"), n.alias("ordinal"))
    return U.distinct_units(units).select("path", "kind", "ordinal")


@query("""WITH l AS (SELECT doc_id, string_split(rtrim(text, chr(10)), chr(10)) AS l FROM documents WHERE text <> ''),
w AS (SELECT doc_id, l, len(l) AS n, unnest(range(0, CAST(greatest(1, ceil((len(l) - 2) / 6.0)) AS BIGINT))) AS i FROM l),
c AS (SELECT doc_id, 1 + i * 6 AS a, least(1 + i * 6 + 7, n) AS b, array_to_string(list_slice(l, 1 + i * 6, least(1 + i * 6 + 7, n)), chr(10)) AS t FROM w)
SELECT CAST(doc_id AS VARCHAR) AS path, CAST(a AS BIGINT) AS start, CAST(b AS BIGINT) AS "end", md5(t) AS text_md5 FROM c WHERE trim(t, E' \\t\\n\\r\\v\\f') <> ''""")
def chunk_units(s, d):
    """Units cut into overlapping windows of whole lines, blank ones left out."""
    t = table(s, d, "documents").filter("text <> ''").select(F.col("doc_id").cast("string").alias("path"), F.rtrim("text", F.lit("\n")).alias("text"))
    units = t.select("path", F.lit("documentation").alias("kind"), F.lit(1).cast("long").alias("start_line"), F.size(F.split("text", "\n", -1)).cast("long").alias("end_line"), F.lit(None).cast("string").alias("symbol"))
    return U.chunks(units, t, 8, 2)[0].select("path", "start", "end", F.md5("text").alias("text_md5"))


@query("""WITH c AS (SELECT DISTINCT 'p' || o_custkey % 50 AS path, o_orderkey % 400 AS a, o_orderkey % 400 + o_custkey % 3 AS b FROM orders),
y AS (SELECT 'p' || c_custkey % 50 AS path, c_custkey AS id, c_custkey % 380 AS a, c_custkey % 380 + c_custkey % 37 AS b FROM customer),
o AS (SELECT c.path, c.a, c.b, y.id, CASE WHEN y.a BETWEEN c.b + 1 AND c.b + 2 THEN 0 WHEN y.a <= c.a AND y.b >= c.b THEN 1 END AS p, CASE WHEN y.a BETWEEN c.b + 1 AND c.b + 2 THEN y.a - c.b ELSE y.b - y.a END AS q FROM c LEFT JOIN y USING (path))
SELECT path, CAST(a AS BIGINT) AS start, CAST(b AS BIGINT) AS "end", CAST(arg_min(id, [p, q, id]) FILTER (p IS NOT NULL) AS BIGINT) AS symbol_id FROM o GROUP BY path, a, b""")
def comment_owner(s, d):
    """A comment belongs to the symbol that starts within 2 lines after it, else to the smallest around it, else to none."""
    o, y = table(s, d, "orders"), table(s, d, "customer")
    c = o.select(F.concat(F.lit("p"), (F.col("o_custkey") % 50).cast("string")).alias("path"), (F.col("o_orderkey") % 400).alias("start"), (F.col("o_orderkey") % 400 + F.col("o_custkey") % 3).alias("end")).distinct()
    k = F.col("c_custkey")
    symbols = y.select(F.concat(F.lit("p"), (k % 50).cast("string")).alias("path"), k.alias("id"), (k % 380).alias("start_line"), (k % 380 + k % 37).alias("end_line"))
    return U.attach_comments(c, symbols)


@query("""SELECT p_partkey, left(p_name, 7) AS snippet, length(p_name) > 7 AS truncated, left(p_name, 4096) AS shown, left(trim(regexp_replace(p_name || '  ' || p_type, '\\s+', ' ', 'g')), 256) AS evidence,
CASE WHEN length(repeat(p_name, p_size)) <= 512 THEN p_name ELSE '' END AS candidate FROM part""")
def bounded_texts(s, d):
    """Snippets, names and evidence within their bounds; names too long to compare are blank."""
    short, cut = T.snippet(F.col("p_name"), 7)
    long_name = F.length(F.repeat("p_name", F.col("p_size").cast("int"))) <= 512
    return table(s, d, "part").select("p_partkey", short.alias("snippet"), cut.alias("truncated"), T.symbol_name(F.col("p_name")).alias("shown"), T.evidence_text(F.concat("p_name", F.lit("  "), "p_type")).alias("evidence"), F.when(long_name, F.col("p_name")).otherwise("").alias("candidate"))


@query("""WITH p AS (SELECT p_partkey, lower(replace(p_type, ' ', '/')) || '/' || CASE p_size % 4 WHEN 0 THEN '__init__.py' WHEN 1 THEN 'test_a.py' WHEN 2 THEN 'b_test.py' ELSE 'c.py' END AS path FROM part)
SELECT p_partkey, replace(regexp_replace(regexp_replace(path, '\\.py$', ''), '(^|/)__init__$', ''), '/', '.') AS module, regexp_matches(path, '(^|/)tests?/|(^|/)test_|_test\\.py$') AS is_test FROM p""")
def module_names(s, d):
    kind = F.element_at(F.array(F.lit("__init__.py"), F.lit("test_a.py"), F.lit("b_test.py"), F.lit("c.py")), (F.col("p_size") % 4 + 1).cast("int"))
    p = table(s, d, "part").select("p_partkey", F.concat(F.lower(F.replace("p_type", F.lit(" "), F.lit("/"))), F.lit("/"), kind).alias("path"))
    return p.select("p_partkey", T.module_name(F.col("path")).alias("module"), repository.is_test_path(F.col("path")).alias("is_test"))


@query("WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 3) AS v FROM embeddings) SELECT vec_id, round(v[1] / sqrt(list_dot_product(v, v)), 9) AS first, round(v[64] / sqrt(list_dot_product(v, v)), 9) AS last FROM q")
def query_vectors(s, d):
    """Vectors brought to unit length, as queries are; those that can't be are null, as a query they are an error."""
    u = table(s, d, "embeddings").select("vec_id", V.unit_column(F.transform("embedding", lambda x: x.cast("double") * 3), 64).alias("u"))
    return u.select("vec_id", F.round(F.get("u", F.lit(0)), 9).alias("first"), F.round(F.get("u", F.lit(63)), 9).alias("last"))


@query("SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS id, 'o' || l_orderkey AS source, 'p' || l_partkey AS target FROM lineitem ORDER BY source, l_returnflag, target, l_shipdate, l_linenumber, id")
def edge_listing(s, d):
    e = table(s, d, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"), F.col("l_returnflag").alias("kind"), F.col("l_shipdate").alias("source_file"), F.col("l_linenumber").alias("start_line"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("id"))
    return G.listed_edges(e).select("id", "source", "target")


@query("SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS id, 'f' || l_suppkey AS source_file FROM lineitem ORDER BY source_file, l_linenumber, l_linenumber + CAST(l_quantity AS INTEGER), l_returnflag, id")
def fact_listing(s, d):
    f = table(s, d, "lineitem").select(F.concat(F.lit("f"), "l_suppkey").alias("source_file"), F.col("l_linenumber").alias("start_line"), (F.col("l_linenumber") + F.col("l_quantity").cast("int")).alias("end_line"), F.col("l_returnflag").alias("kind"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("id"))
    return G.listed_facts(f).select("id", "source_file")


@query("SELECT p_partkey AS id, CASE WHEN p_size % 10 <> 0 THEN p_type END AS path FROM part ORDER BY path NULLS FIRST, p_brand, p_name, p_partkey")
def node_listing(s, d):
    n = table(s, d, "part").select(F.when(F.col("p_size") % 10 != 0, F.col("p_type")).alias("path"), F.col("p_brand").alias("qualified_name"), F.col("p_name").alias("kind"), F.col("p_partkey").alias("id"))
    return G.listed_nodes(n).select("id", "path")


@query("""SELECT event_type, round(1000.0::DOUBLE / quantile_cont(value, 0.5), 6) AS calls_per_second, round(1000.0::DOUBLE / quantile_cont(value, 0.5) * count(*), 3) AS rows_per_second, round(max(value) / quantile_cont(value, 0.5), 6) AS speed_up FROM events GROUP BY event_type HAVING quantile_cont(value, 0.5) > 0""")
def throughput_ratios(s, d):
    e = table(s, d, "events").groupBy("event_type").agg(F.percentile("value", 0.5).alias("m"), F.count("*").alias("n"), F.max("value").alias("r")).filter("m > 0")
    calls, rows = synthetic.throughput(F.col("m"), F.col("n"))
    return e.select("event_type", F.round(calls, 6).alias("calls_per_second"), F.round(rows, 3).alias("rows_per_second"), F.round(synthetic.speed_up(F.col("r"), F.col("m")), 6).alias("speed_up"))


@query(f"""WITH v AS (SELECT i, ({synthetic.SEED} + i * 2654435761) % 4294967296 AS x FROM range(1000) r(i))
SELECT i AS id, array_to_string(list_transform(range(0, 8), lambda k: chr(CAST(97 + (x // CAST(pow(26, k) AS BIGINT)) % 26 AS INTEGER))), '') AS token FROM v""")
def synthetic_tokens(s, d):
    return s.range(1000).select("id", synthetic.token(synthetic.SEED, F.col("id")).alias("token"))


@query("SELECT vec_id, CAST(4 * len(embedding) AS BIGINT) AS bytes, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 9)) AS vector FROM embeddings")
def vector_codec(s, d):
    """Vectors as bytes of 32-bit floats, and back."""
    packed = table(s, d, "embeddings").select("vec_id", codec.packed(F.col("embedding")).alias("b"))
    return packed.select("vec_id", F.octet_length("b").cast("long").alias("bytes"), F.transform(codec.unpacked(F.col("b")), lambda x: F.round(x.cast("double"), 9)).alias("vector"))


@query("""WITH o AS (SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey, -o_custkey AS o_custkey, 'new' AS o_orderpriority FROM orders WHERE o_orderkey % 2 = 0)
SELECT * FROM o WHERE o_orderkey NOT IN (SELECT o_orderkey FROM n) UNION ALL SELECT * FROM n""")
def repository_upsert(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    new = o.filter("o_orderkey % 2 = 0").select("o_orderkey", (-F.col("o_custkey")).alias("o_custkey"), F.lit("new").alias("o_orderpriority"))
    return M.upsert(o.filter("o_orderkey % 3 <> 0"), new, ["o_orderkey"])


@query(f"""SELECT 'config' AS what, 'fuzzy:' || left(sha256('{{"a":1,"b":[2,null]}}'), 12) AS said UNION ALL SELECT 'embedder', 'deterministic/sha256/64' UNION ALL SELECT 'tools', 'get_index_status,index_repository,search_code'
UNION ALL SELECT 'settings', 'graph_hops,fuzzy_threshold,window_lines,pool' UNION ALL SELECT 'requests', 'mode,top_k,query,backend' UNION ALL SELECT 'paths', 'ok,no,no,no' UNION ALL SELECT 'language twice', 'no' UNION ALL SELECT 'terms', 'httpclient http client' """)
def validation(s, d):
    """What is refused: settings out of bounds, requests, paths outside the allowed roots, a language registered twice."""

    def refused(what) -> bool:
        try:
            what()
        except (ValueError, ServiceError):
            return True
        return False

    base = folder(s)
    engine = Engine(s, f"{base}/index")
    roots = Repositories([f"{base}/repo"])
    settings = {"graph_hops": 3, "fuzzy_threshold": 2.0, "window_lines": 5, "pool": 0}
    requests = {"mode": "none", "top_k": 21, "query": " ", "backend": "none"}
    paths = [f"{base}/repo", base, f"{base}/repo/README.md", f"{base}/repo/../index"]
    own = identity(engine.embedder)
    rows = [
        ("config", config_id("fuzzy", {"b": [2, None], "a": 1})), ("embedder", f"{own['provider']}/{own['model']}/{own['dimension']}"), ("tools", ",".join(sorted(TOOLS))),
        ("settings", ",".join(k for k, v in settings.items() if refused(lambda k=k, v=v: Settings(**{k: v})))), ("requests", ",".join(k for k, v in requests.items() if refused(lambda k=k, v=v: SearchRequest(**({"repository_path": "a", "query": "b"} | {k: v}))))),
        ("paths", ",".join("no" if refused(lambda p=p: roots.resolve(p, engine)) else "ok" for p in paths)), ("language twice", "no" if refused(lambda: extract.register("python", extract.python)) else "yes"), ("terms", " ".join(extract.registry_terms("HTTPClient"))),
    ]
    return s.createDataFrame(rows, "what string, said string")


@query("SELECT path, md5(text) AS content_hash FROM (SELECT CAST(doc_id AS VARCHAR) AS path, text || '!' AS text FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT CAST(doc_id AS VARCHAR), text FROM documents WHERE doc_id % 2 = 1)")
def stream_of_updates(s, d):
    """A file stream of manifests, applied a batch at a time; later batches replace rows of the same path."""
    from siftwell.streaming import current, follow

    base = f"{folder(s)}/stream-{uuid.uuid4().hex}"
    docs = table(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "doc_id", "text")
    for part in (docs, docs.filter("doc_id % 2 = 0").withColumn("text", F.concat("text", F.lit("!")))):
        part.select("path", F.md5("text").alias("content_hash")).write.mode("append").parquet(f"{base}/in")
        follow(s, f"{base}/in", "path string, content_hash string", f"{base}/out", f"{base}/check", ["path"]).awaitTermination()
    return current(s, f"{base}/out")
