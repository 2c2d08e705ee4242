"""Graph expansion, fact resolution, spans, windows, sections and comments on literal inputs."""

import pytest
from pyspark.sql import functions as F

from siftwell.operators import graph as G
from siftwell.operators import maintenance as M
from siftwell.operators import units as U

EDGE = "source string, target string, kind string, confidence double, id long"
FACT = "id long, target_reference string, target_kind string, hint string, hint_method string, source_scope string, module string"


def test_chain_over_hops(spark):
    e = spark.createDataFrame([("first", "second", "calls", 1.0, 1), ("second", "third", "calls", 1.0, 2), ("third", "first", "calls", 0.4, 3)], EDGE)
    seeds = spark.createDataFrame([("first", "first", 1.0)], "node string, seed string, score double")
    one, two = ({r.node: round(r.contribution, 6) for r in G.expand(seeds, e, h, 20).collect()} for h in (1, 2))
    assert one == {"second": 0.63} and two == {"second": 0.63, "third": round(0.81 * 0.49, 6)}
    merged = [(r.node, r.is_seed, r["rank"]) for r in G.merge_results(seeds, G.expand(seeds, e, 2, 20), 5).collect()]
    assert merged == [("first", True, 1), ("second", False, 2), ("third", False, 3)]
    third = spark.createDataFrame([("third", "third", 1.0)], "node string, seed string, score double")
    assert [r.node for r in G.expand(third, e, 1, 20).collect()] == ["second"]


def test_adjacency_puts_outgoing_first(spark):
    e = spark.createDataFrame([("a", "b", "calls", 0.6, 1), ("a", "c", "calls", 0.9, 2), ("d", "a", "calls", 1.0, 3), ("a", "e", "imports", 0.9, 4)], EDGE)
    f = spark.createDataFrame([("a",)], "node string")
    assert [r.neighbour for r in G.adjacency(e, f, 3).orderBy("place").collect()] == ["c", "e", "b"]
    assert [r.neighbour for r in G.adjacency(e, f, 3, direction="incoming").collect()] == ["d"]


def test_resolution_priorities(spark):
    nodes = spark.createDataFrame([(1, "symbol", "helper", "a.helper"), (2, "symbol", "helper", "b.helper"), (3, "symbol", "only", "b.only"), (4, "module", "b", "b"), (5, "symbol", "run", "c.K.run")], "id long, kind string, name string, qualified_name string")
    facts = [
        (1, "helper", "symbol", None, None, "caller.f", "caller"), (2, "helper", "symbol", "b.helper", "explicitly_imported_symbol", "caller.f", "caller"), (3, "only", "symbol", None, None, "caller", "caller"), (4, "helper", "symbol", None, None, "a.f", "a"),
        (5, "nothing", "any", None, None, "a.f", "a"), (6, "run", "symbol", None, None, "c.K.other", "c"), (7, "b", "symbol", None, None, "", "a"), (8, "b", "any", None, None, "", "a"),
    ]
    got = {r.id: (r.status, r.method, r.target) for r in G.resolve(spark.createDataFrame(facts, FACT), nodes).collect()}
    assert got[1] == ("ambiguous", None, None) and got[2] == ("resolved", "explicitly_imported_symbol", 2) and got[3] == ("resolved", "unique_short_name_match", 3)
    assert got[4] == ("resolved", "same_scope_qualified", 1) and got[5] == ("unresolved", None, None) and got[6][:3] == ("resolved", "same_scope_qualified", 5)
    assert got[7] == ("unresolved", None, None) and got[8] == ("resolved", "unique_repository_qualified_match", 4)


def test_spans(spark):
    owners = spark.createDataFrame([("f", 1, 12), ("g", 1, 3)], "p string, low long, high long")
    spans = spark.createDataFrame([("f", 3, 5), ("f", 8, 10), ("f", 4, 4)], "p string, start long, end long")
    assert sorted((r.p, r.start, r.end) for r in U.span_gaps(owners, spans, ["p"]).collect()) == [("f", 1, 2), ("f", 6, 7), ("f", 11, 12), ("g", 1, 3)]
    spans = spark.createDataFrame([("f", 1, 3), ("f", 4, 7)], "p string, start long, end long")
    merged = U.merged_spans(spans, ["p"]).select(F.explode(U.windows(F.col("start"), F.col("end"), 4, 1)).alias("w")).collect()
    assert [(r.w.start, r.w.end) for r in merged] == [(1, 4), (4, 7)]
    rows = spark.createDataFrame([("f", 1, 2, "a"), ("f", 4, 4, "a"), ("f", 5, 5, "b"), ("f", 9, 9, "b")], "p string, start long, end long, k string")
    assert [r.island for r in U.islands(rows, ["p"], 2, "k").orderBy("start").collect()] == [1, 1, 2, 3]


def test_sections(spark):
    text = "intro\n\n# One\nbody\nTitle\n=====\nmore\n"
    got = U.sections(spark.createDataFrame([(1, text), (2, ""), (3, "\n\n")], "k long, t string"), "k", F.col("t")).collect()
    assert [(r.k, r.start_line, r.end_line, r.text) for r in got] == [(1, 1, 2, "intro\n"), (1, 3, 4, "# One\nbody"), (1, 5, 7, "Title\n=====\nmore")]


def test_comments_find_their_symbol(spark):
    comments = spark.createDataFrame([("a", 1, 1), ("a", 5, 5), ("a", 50, 50)], "path string, start long, end long")
    symbols = spark.createDataFrame([("a", 9, 3, 20), ("a", 8, 4, 8)], "path string, id long, start_line long, end_line long")
    assert [r.symbol_id for r in U.attach_comments(comments, symbols).orderBy("start").collect()] == [9, 8, None]


def test_manifest_updates(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, content_hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, content_hash string")
    diff = M.manifest_diff(old, new)
    assert {r.path: r.change for r in diff.collect()} == {"a": "unchanged", "b": "changed", "c": "deleted", "d": "added"}
    assert sorted(map(tuple, M.apply_updates(old, new, diff).collect())) == [("a", "1"), ("b", "2"), ("d", "1")]
    failed = spark.createDataFrame([("b",)], "path string")
    assert sorted(map(tuple, M.apply_updates(old, new, M.without_failed(diff, failed)).collect())) == [("a", "1"), ("b", "1"), ("d", "1")]


def test_snapshots(spark, tmp_path):
    s = M.Snapshots(spark, str(tmp_path / "index"))
    assert s.current() is None
    first = s.write({"t": spark.range(3)}, {"n": 1})
    second = s.write({"t": spark.range(5)}, {"n": 2})
    assert s.current() == second != first and s.read("t").count() == 5 and s.note() == {"n": 2}
    try:
        s.write({"t": spark.range(2).selectExpr("assert_true(id < 1)")})
    except Exception:
        pass
    assert s.current() == second
    s.backup(str(tmp_path / "copy"))
    s.prune()
    assert s.read("t").count() == 5 and M.Snapshots(spark, str(tmp_path / "copy")).read("t").count() == 5
    for name, root, at in (("a", "/x/Beta", 1), ("b", "/x/Beta", 2), ("c", "/y/alpha", 1), ("d", "/y/gamma", 1)):
        M.Snapshots(spark, str(tmp_path / "all" / name)).write({"t": spark.range(1)}, {"root": root, "timestamp": at})
    with M.Lease(M.Snapshots(spark, str(tmp_path / "all" / "d"))):
        assert [n["place"].rsplit("/", 1)[-1] for n in M.available(spark, str(tmp_path / "all"))] == ["c", "b"]  # the newest of each; d is being written
    assert M.available(spark, str(tmp_path / "none")) == []
    assert M.removed(s) and s.current() is None and not M.removed(s)


def test_one_writer(spark, tmp_path):
    s = M.Snapshots(spark, str(tmp_path / "index"))
    with M.Lease(s):
        assert M.writing(s)
        with pytest.raises(M.Busy), M.Lease(s):
            pass
        assert M.writing(s)
        with M.Lease(s, stale=-1):  # its writer is taken for lost
            pass
    assert not M.writing(s)


def test_listings(spark):
    edges = spark.createDataFrame([("b", "x", "calls", "f", 2, "1"), ("a", "x", "calls", "f", 9, "2"), ("a", "x", "calls", "e", 9, "3"), ("a", "w", "imports", "e", 1, "4")], "source string, target string, kind string, source_file string, start_line int, id string")
    assert [r.id for r in G.listed_edges(edges).collect()] == ["3", "2", "4", "1"]
    nodes = G.root_node(spark.createDataFrame([("b.py", "b", "module", "2"), ("a.py", "a", "module", "3"), ("a.py", "a", "file", "1"), (None, "old", "repository", "0")], "path string, qualified_name string, kind string, id string"), "00000000-0000-0000-0000-000000000000", "repo")
    assert [(r.path, r.kind, r.qualified_name) for r in G.listed_nodes(nodes).collect()] == [(None, "repository", "repo"), ("a.py", "file", "a"), ("a.py", "module", "a"), ("b.py", "module", "b")]
    facts = spark.createDataFrame([("b", 1, 1, "calls", "1"), ("a", 2, 2, "calls", "2"), ("a", 2, 2, "calls", "0"), ("a", 1, 3, "tests", "4")], "source_file string, start_line int, end_line int, kind string, id string")
    assert [r.id for r in G.listed_facts(facts).collect()] == ["4", "0", "2", "1"]


def most_rows(df, metric="numOutputRows", of=""):
    """The most rows that any step of the plan gave, as it ran; of another metric, or of steps whose kind begins with ``of``."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(p.plan())
        m = p.metrics().get(metric)
        most = max(most, m.get().value() if m.isDefined() and kind.startswith(of) else 0)
        todo.extend(p.children().apply(i) for i in range(p.children().size()))
    return most


def test_resolution_of_a_name_that_all_nodes_share(spark):
    n = 2000
    nodes = spark.range(n).select("id", F.lit("symbol").alias("kind"), F.lit("run").alias("name"), F.concat(F.lit("a.run"), F.when(F.col("id") > 1, F.col("id").cast("string")).otherwise("")).alias("qualified_name"))
    none = F.lit(None).cast("string")
    facts = spark.range(n).select("id", F.when(F.col("id") % 2 == 0, "run").otherwise(F.concat(F.lit("a.run"), F.col("id").cast("string"))).alias("target_reference"), F.lit("symbol").alias("target_kind"), none.alias("hint"), none.alias("hint_method"), F.lit("").alias("source_scope"), F.lit("b").alias("module"))
    df = G.resolve(facts, nodes)
    assert most_rows(df) <= 4 * n
    got = {r.id: (r.status, r.target) for r in df.collect()}
    assert len(got) == n and got[0] == got[2] == ("ambiguous", None) and got[1] == ("unresolved", None) and got[3] == ("resolved", 3)


def test_facts_by_status_of_repeated_names(spark, tmp_path):
    from siftwell.plans.catalog import QUERIES

    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    n = part.count()
    part.crossJoin(spark.range(40).select(F.col("id").alias("r"))).withColumn("p_partkey", F.col("p_partkey") + F.col("r") * 1_000_000).drop("r").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    df = QUERIES["facts_by_status"](spark, str(tmp_path))
    assert most_rows(df) <= 8 * 40 * n
    got = {r.status: r.n for r in df.collect()}
    assert sum(got.values()) == 40 * n and set(got) <= {"ambiguous", "unresolved"}  # each node has 39 namesakes


def most_rows_of_a_task(df):
    return max(r.n for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect())


def test_spans_of_a_task_do_not_follow_the_input(spark, monkeypatch):
    from siftwell import session

    monkeypatch.setattr(session, "TASK_ROWS", 100)
    spans = spark.range(20_000).select((F.col("id") % 5000).alias("p"), (F.col("id") % 7 * 3).alias("start"), (F.col("id") % 7 * 3 + F.col("id") % 4).alias("end"))
    merged = U.merged_spans(spans, ["p"])
    assert most_rows_of_a_task(merged) <= 300
    want = {}
    for i in range(20_000):
        want.setdefault(i % 5000, []).append((i % 7 * 3, i % 7 * 3 + i % 4))
    out = set()
    for p, each in want.items():
        a, b = None, None
        for s, e in sorted(each):
            if a is None or s > b + 1:
                out |= {(p, a, b)} if a is not None else set()
                a, b = s, e
            b = max(b, e)
        out.add((p, a, b))
    assert sorted(map(tuple, merged.collect())) == sorted(out)
    owners = spark.range(5000).select(F.col("id").alias("p"), F.lit(0).cast("long").alias("low"), F.lit(30).cast("long").alias("high"))
    covered = {p: {x for q, e in each for x in range(q, e + 1)} for p, each in want.items()}
    gaps = U.span_gaps(owners, spans, ["p"]).collect()
    assert all({x for r in gaps if r.p == p for x in range(r.start, r.end + 1)} == set(range(31)) - covered[p] for p in range(0, 5000, 500))


def test_dependencies_of_a_task_do_not_follow_the_input(spark, monkeypatch):
    from siftwell import session

    monkeypatch.setattr(session, "TASK_ROWS", 100)
    files = spark.range(200).select(F.concat(F.lit("f"), "id").alias("path"), "id")
    imports = spark.range(20_000).select(F.concat(F.lit("f"), F.col("id") % 200).alias("source_path"), F.concat(F.lit("f"), F.col("id") % 77).alias("target_path"), (F.col("id") % 3 / 4).alias("confidence"), F.col("id").alias("fact"))
    want = {}
    for i in range(20_000):
        if i % 200 != i % 77:
            want[i % 200, i % 77] = min(want.get((i % 200, i % 77), (1, 0)), (-(i % 3 / 4), i))
    for rows in (None, 20_000):
        found = G.dependencies(imports, files, rows)
        assert most_rows_of_a_task(found) <= 300
        assert {(r.source, r.target): (-r.confidence, r.fact) for r in found.collect()} == want


def test_facts_by_status_resolves_what_is_asked_once(spark, tmp_path):
    from siftwell.plans.catalog import QUERIES

    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    n = part.count()
    part.crossJoin(spark.range(40).select(F.col("id").alias("r"))).withColumn("p_partkey", F.col("p_partkey") + F.col("r") * 1_000_000).drop("r").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    df = QUERIES["facts_by_status"](spark, str(tmp_path))
    assert 0 < most_rows(df, "shuffleRecordsWritten") <= 40 * n  # one row per fact, not one per key of it
    assert 0 < most_rows(df, of="BroadcastExchange") <= 4 * n  # names and questions, no facts


def test_facts_of_one_id_and_of_none(spark, tmp_path):
    import duckdb

    from siftwell.plans.catalog import QUERIES, SQL

    duckdb.sql(f"""COPY (WITH p AS (FROM '/root/testdata/sf0.001/part.parquet') FROM p UNION ALL SELECT p_partkey, 'hot bolt', 'Brand#3', 'PROMO', p_size + 1, 1 FROM p WHERE p_partkey % 3 = 0
    UNION ALL SELECT NULL, p_name, p_brand, p_type, p_size, 1 FROM p WHERE p_partkey % 7 = 0 UNION ALL SELECT 1000 + p_partkey, NULL, p_brand, p_type, NULL, 1 FROM p WHERE p_partkey % 11 = 0
    UNION ALL SELECT 2000 + p_partkey, p_name, NULL, NULL, p_size, 1 FROM p WHERE p_partkey % 11 = 1 UNION ALL FROM p WHERE p_partkey % 13 = 0) TO '{tmp_path}/part.parquet' (FORMAT parquet)""")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS FROM '{tmp_path}/part.parquet'")
    for name in ("facts_by_status", "fact_resolution"):
        key = lambda r: tuple(map(str, r))
        assert sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect()), key=key) == sorted(con.execute(SQL[name]).fetchall(), key=key)
