"""Fact resolution, adjacency and bounded expansion over a property graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.text import uuid5
from siftwell.session import parted, spread

METHODS = [("same_scope_qualified", 1.0), ("explicitly_imported_symbol", 1.0), ("explicitly_imported_module", 1.0), ("same_module_symbol", 0.95), ("unique_repository_qualified_match", 0.9), ("unique_short_name_match", 0.7)]
EDGE_WEIGHTS = {"calls": 0.9, "imports": 0.6, "inherits": 0.9, "references": 0.65, "depends_on": 0.55, "tests": 1.0}


def kind_allowed(wanted: Column, kind: Column) -> Column:
    symbol, file = kind.isin("symbol", "test_symbol"), kind.isin("file", "test_file")
    return F.when(wanted == "any", kind != "repository").when(wanted == "symbol", symbol).when(wanted == "module", kind == "module").when(wanted == "file", file).otherwise(kind == wanted)


def resolve(facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """``facts`` with status, method, factor and target: the first priority with a match decides, and is ambiguous if it has several.

    facts: id, target_reference, target_kind, hint, hint_method, source_scope, module. nodes: id, kind, name, qualified_name.
    Each priority is one equality on the qualified or the short name, so all of them are one join of exploded keys. Only
    the least and the greatest node of a name and kind can matter, so a key meets one row per kind, however many nodes share its name.
    """
    f = F.col
    names = F.explode(F.array(F.struct(F.lit(False).alias("short"), f("qualified_name").alias("key")), F.struct(F.lit(True).alias("short"), f("name").alias("key"))))
    ends = nodes.select("id", "kind", names.alias("k")).groupBy("k.short", "k.key", "kind").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(F.split("source_scope", r"\."))), lambda n: F.concat_ws(".", F.slice(F.split("source_scope", r"\."), 1, n)))
    scoped = F.when(F.coalesce(f("source_scope"), F.lit("")) != "", F.transform(prefixes, lambda p: F.struct((F.lit(2000) - F.length(p)).alias("p"), F.lit("same_scope_qualified").alias("m"), F.concat(p, F.lit("."), f("target_reference")).alias("key")))).otherwise(F.expr("cast(array() as array<struct<p:int,m:string,key:string>>)"))
    fixed = F.array(
        F.struct(F.lit(0).alias("p"), F.coalesce("hint_method", F.lit("same_scope_qualified")).alias("m"), f("hint").alias("key")),
        F.struct(F.lit(3000).alias("p"), F.lit("same_module_symbol").alias("m"), F.concat("module", F.lit("."), "target_reference").alias("key")),
        F.struct(F.lit(3001).alias("p"), F.lit("unique_repository_qualified_match").alias("m"), f("target_reference").alias("key")),
    )
    brief = F.array(F.struct(F.lit(4000).alias("p"), F.lit("unique_short_name_match").alias("m"), F.element_at(F.split("target_reference", r"\."), -1).alias("key")))
    keys = spread(facts.select("id", "target_reference", "target_kind", "hint", "hint_method", "source_scope", "module")).select(f("id").alias("fact"), "target_kind", F.explode(F.concat(fixed, brief, scoped)).alias("k")).filter("k.key is not null")
    found = keys.select("fact", "target_kind", f("k.p").alias("p"), f("k.m").alias("m"), (f("k.p") == 4000).alias("short"), f("k.key").alias("key")).join(ends, ["short", "key"]).filter(kind_allowed(f("target_kind"), f("kind")))
    # per priority: how many different nodes, then the first priority; counts combine before the shuffle
    per = found.groupBy("fact", "p", "m").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    first = per.groupBy("fact").agg(F.min(F.struct("p", "m", "low", "high")).alias("b"))
    factor = F.element_at(F.create_map(*[x for m, w in METHODS for x in (F.lit(m), F.lit(w))]), f("b.m"))
    joined = facts.join(first, facts["id"] == first["fact"], "left")
    unique = f("b.low") == f("b.high")
    return joined.select(*[facts[c] for c in facts.columns], F.when(f("b").isNull(), "unresolved").when(unique, "resolved").otherwise("ambiguous").alias("status"), F.when(unique, f("b.m")).alias("method"), F.when(unique, factor).alias("factor"), F.when(unique, f("b.low")).alias("target"))


def asked(facts: DataFrame) -> DataFrame:
    """``facts`` with ``n``, the number of them: facts that differ in their id alone are one row, with the least id.

    Facts of one id are resolved together, so those that share theirs keep it; those without one are never resolved.
    """
    what = [c for c in facts.columns if c != "id"]
    rows = facts.withColumn("own", F.when(F.count("*").over(Window.partitionBy("id")) > 1, F.col("id")))
    rows = rows.groupBy(*what, "own", F.col("id").isNull().alias("none")).agg(F.min("id").alias("id"), F.count("*").alias("n"))
    # always true: resolve() reads these rows twice, and as both need n the shuffles are the same and run once
    return rows.filter("n > 0").select("id", *what, "n")


def listed_facts(facts: DataFrame) -> DataFrame:
    return facts.orderBy("source_file", "start_line", "end_line", "kind", "id")


def listed_edges(edges: DataFrame) -> DataFrame:
    return edges.orderBy("source", "kind", "target", "source_file", "start_line", "id")


def listed_nodes(nodes: DataFrame) -> DataFrame:
    """By path, the repository's own node, which has none, first."""
    return nodes.orderBy(F.asc_nulls_first("path"), "qualified_name", "kind", "id")


def root_node(nodes: DataFrame, repository: str, name: str) -> DataFrame:
    """``nodes`` with the node of the repository itself, which no file owns."""
    spark = nodes.sparkSession
    own = spark.range(1).select(uuid5(repository, F.lit(f"graph-node:repository:{name}:")).alias("id"), F.lit("repository").alias("kind"), F.lit(name).alias("qualified_name"), F.lit(name).alias("name"))
    return nodes.filter(F.col("kind") != "repository").unionByName(own, allowMissingColumns=True)


def dependencies(imports: DataFrame, files: DataFrame, rows: int | None = None) -> DataFrame:
    """(source, target, confidence, fact): the strongest import between two files, ties to the earliest fact.

    imports: source_path, target_path, confidence, fact. files: path, id. Files that import themselves have none. ``rows``
    is the number of imports, or a bound of it; they are counted if it isn't given.
    """
    a = files.select(F.col("path").alias("source_path"), F.col("id").alias("source"))
    b = files.select(F.col("path").alias("target_path"), F.col("id").alias("target"))
    pairs = imports.join(a, "source_path").join(b, "target_path").filter("source <> target")
    pairs = parted(pairs, imports.count() if rows is None else rows, "source", "target")
    best = pairs.groupBy("source", "target").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "fact")).alias("b"))
    return best.select("source", "target", (-F.col("b.c")).alias("confidence"), F.col("b.fact").alias("fact"))


def both_ways(edges: DataFrame, direction: str = "both") -> DataFrame:
    """(node, neighbour, kind, confidence, id, way: 0 outgoing, 1 incoming)."""
    out = edges.select(F.col("source").alias("node"), F.col("target").alias("neighbour"), "kind", "confidence", "id", F.lit(0).alias("way"))
    into = edges.select(F.col("target").alias("node"), F.col("source").alias("neighbour"), "kind", "confidence", "id", F.lit(1).alias("way"))
    return out if direction == "outgoing" else into if direction == "incoming" else out.unionByName(into)


def adjacency(edges: DataFrame, frontier: DataFrame, most: int, kinds: list[str] | None = None, least_confidence: float = 0.0, direction: str = "both") -> DataFrame:
    """Up to ``most`` neighbours of each frontier node, outgoing first, by confidence; with ``place`` from 1."""
    e = edges.filter(F.col("confidence") >= least_confidence)
    if kinds is not None:
        e = e.filter(F.col("kind").isin(kinds))
    rows = both_ways(e, direction).join(frontier.select("node").distinct(), "node", "left_semi")
    order = Window.partitionBy("node").orderBy("way", F.desc("confidence"), "kind", "neighbour", "id")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def expand(seeds: DataFrame, edges: DataFrame, hops: int, most: int, weights: dict[str, float] | None = None, decay: float = 0.7, least_confidence: float = 0.55, most_new: int | None = None) -> DataFrame:
    """(node, contribution, hop, kind, way, seed, edge): the best expansion of each node that is reached.

    seeds: node, seed, score. A hop's contribution is min(1, score * product of weight and confidence * decay^hop); a
    path goes on from (node, seed) only where it is strictly better there than before.
    """
    weights = weights or EDGE_WEIGHTS
    if hops < 1 or hops > 2 or not 0 < decay <= 1:
        raise ValueError("1 or 2 hops, and a decay in (0, 1]")
    weight = F.element_at(F.create_map(*[x for k, w in weights.items() for x in (F.lit(k), F.lit(float(w)))]), F.col("kind"))
    frontier = seeds.select("node", "seed", "score", F.lit(1.0).alias("factor"))
    best, all_found = seeds.select("node", "seed", F.col("score").alias("known")), None
    for hop in range(1, hops + 1):
        near = adjacency(edges, frontier, most, list(weights), least_confidence)
        step = frontier.join(near, "node").select(F.col("neighbour").alias("node"), "seed", "score", (F.col("factor") * weight * F.col("confidence")).alias("factor"), F.lit(hop).cast("long").alias("hop"), "kind", F.col("way").cast("long").alias("way"), F.col("id").alias("edge"))
        step = step.withColumn("contribution", F.least(F.lit(1.0), F.col("score") * F.col("factor") * F.lit(decay**hop)))
        by = Window.partitionBy("node", "seed").orderBy(F.desc("contribution"), "kind", "way", "edge")
        step = step.withColumn("nth", F.row_number().over(by)).filter("nth = 1").drop("nth")
        step = step.join(best, ["node", "seed"], "left").filter("known is null or contribution > known").drop("known")
        all_found = step if all_found is None else all_found.unionByName(step)
        if hop < hops:
            best = best.unionByName(step.select("node", "seed", F.col("contribution").alias("known"))).groupBy("node", "seed").agg(F.max("known").alias("known"))
            frontier = step.select("node", "seed", "score", "factor")
    fresh = all_found.join(seeds.select("node").distinct(), "node", "left_anti")
    choice = Window.partitionBy("node").orderBy(F.desc("contribution"), "hop", "kind", "way", "seed", "edge")
    out = fresh.withColumn("nth", F.row_number().over(choice)).filter("nth = 1").select("node", "contribution", "hop", "kind", "way", "seed", "edge")
    return out if most_new is None else out.orderBy("hop", F.desc("contribution"), "node").limit(most_new)


def merge_results(seeds: DataFrame, expansions: DataFrame, top_k: int) -> DataFrame:
    """(node, score, is_seed, rank): the better of seed and expansion, a seed on ties."""
    rows = seeds.select("node", "score", F.lit(0).alias("o")).unionByName(expansions.select("node", F.col("contribution").alias("score"), F.lit(1).alias("o")))
    best = rows.groupBy("node").agg(F.min(F.struct((-F.col("score")).alias("s"), "o")).alias("b")).select("node", (-F.col("b.s")).alias("score"), (F.col("b.o") == 0).alias("is_seed"))
    order = [F.desc("score"), F.desc("is_seed"), "node"]
    return best.orderBy(*order).limit(top_k).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
