"""Index a repository, tell its freshness, search it: the driver's side."""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell import schema as S
from siftwell.functions import text as T
from siftwell.functions.embedding import Embedder, HashEmbedder, identity
from siftwell.operators import graph as G
from siftwell.operators import maintenance as M
from siftwell.operators import postings as P
from siftwell.operators import ranking as R
from siftwell.operators import units as U
from siftwell.operators import vectors as V
from siftwell.plans.modes import MODES, config_id, route
from siftwell.session import stored
from siftwell.sources import extract, repository

FIELD_WEIGHTS = {"name": 8.0, "qualified_name": 6.0, "identifier_terms": 4.0, "path": 2.0, "content": 1.0}


class Event(NamedTuple):
    """How far a stage of indexing has come."""

    stage: str
    current: int
    total: int
    message: str = ""


class Throttle:
    """Passes on a stage's first event and those that cross a tenth of it."""

    def __init__(self, to: Callable[[Event], None]):
        self.to, self.last = to, {}

    def __call__(self, event: Event) -> None:
        tenth = 10 * min(max(event.current, 0), event.total) // event.total if event.total > 0 else 0
        if tenth > self.last.get(event.stage, -1):
            self.last[event.stage] = tenth
            self.to(event)


class Incompatible(ValueError):
    """The index holds another model's vectors."""


class Candidates:
    """The vectors of the indexes searched last, kept by Spark: at most ``most`` of them, and none beyond ``most_bytes``."""

    def __init__(self, most: int = 4, most_bytes: int = 1 << 30):
        self.most, self.most_bytes, self.held = most, most_bytes, {}

    def get(self, key: tuple, rows: DataFrame, dimension: int) -> DataFrame:
        if key in self.held:
            self.held[key] = self.held.pop(key)  # the latest goes last
            return self.held[key]
        for stale in [k for k in self.held if k[0] == key[0]]:  # another version of the same index
            self.held.pop(stale).unpersist()
        if rows.count() * dimension * 8 > self.most_bytes:
            return rows
        while len(self.held) >= self.most:
            self.held.pop(next(iter(self.held))).unpersist()
        self.held[key] = rows.persist()
        return self.held[key]

    def clear(self) -> None:
        while self.held:
            self.held.popitem()[1].unpersist()


@dataclass
class Response:
    query: str
    requested_mode: str
    mode: str
    results: list[dict]
    warnings: list[str] = field(default_factory=list)
    elapsed: float = 0.0
    config: str = ""
    timings: dict[str, float] = field(default_factory=dict)


class Engine:
    def __init__(
        self, spark: SparkSession, data_dir: str, settings: S.Settings | None = None, progress: Callable[[str], None] = lambda stage: None, check: Callable[[], None] = lambda: None,
        embedder: Embedder | None = None, events: Callable[[Event], None] = lambda event: None, replaced: Callable[[str], None] = lambda root: None,
    ):
        """``progress`` is told each stage, ``events`` how far it is; ``check`` may raise to stop; ``replaced`` follows a new version."""
        self.spark, self.data_dir, self.settings, self.progress, self.check = spark, data_dir, settings or S.Settings(), progress, check
        self.embedder = embedder or HashEmbedder(self.settings.dimension)
        self.events, self.replaced, self.candidates = Throttle(events), replaced, Candidates()

    def stage(self, name: str, current: int = 0, total: int = 0, message: str = "") -> None:
        """A stage begins (current 0) or has come further; a caller that wants to stop says so here."""
        if current == 0:
            self.progress(name)
        self.events(Event(name, current, total, message))
        self.check()

    # --- index

    def place(self, root: str) -> str:
        import re

        real = os.path.realpath(os.path.expanduser(root))
        return os.path.join(self.data_dir, f"{re.sub('[^A-Za-z0-9_.-]', '-', os.path.basename(real)).strip('-')[:64]}-{repository.digest(real.encode())[:12]}")

    def snapshots(self, root: str) -> M.Snapshots:
        return M.Snapshots(self.spark, self.place(root))

    def embed(self, text):
        return self.embedder.embed(text)

    def records(self, files: DataFrame, repo: str) -> tuple[dict[str, DataFrame], DataFrame]:
        """(tables of the files' own rows, (path, stage, message) of failures)."""
        good = files.filter("error is null")
        nested = stored(extract.parsed(good.select(F.col("path").alias("relative_path"), "language", F.col("source_text").alias("text"))))
        failed = extract.exploded(nested, "diagnostics").select("path", "stage", "message").unionByName(files.filter("error is not null").select("path", F.lit("read").alias("stage"), F.col("error").alias("message")))
        ident = lambda *parts: T.uuid5(repo, F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
        c, lit = F.col, F.lit
        symbols = extract.exploded(nested, "symbols").select(ident(c("path"), lit("symbol"), c("qualified_name"), c("start_line"), c("end_line")).alias("id"), "name", "qualified_name", "kind", "path", "start_line", "end_line", "source_snippet", "language")
        units = extract.exploded(nested, "units").withColumn("start_line", c("start_line").cast("long")).withColumn("end_line", c("end_line").cast("long"))
        cut, over = U.chunks(units, good.select("path", c("source_text").alias("text")), self.settings.window_lines, self.settings.window_overlap, self.settings.chunks_per_file)
        failed = failed.unionByName(over.select("path", lit("chunk").alias("stage"), lit("too many chunks").alias("message")))
        # a name that is declared twice in a file belongs to its last declaration
        owner = symbols.groupBy("path", c("qualified_name").alias("symbol")).agg(F.max_by("id", "start_line").alias("symbol_id"))
        chunks = cut.join(owner, ["path", "symbol"], "left").join(good.select("path", "language"), "path")
        whole = T.embedding_text(c("language"), c("path"), c("kind"), c("symbol"), c("text"))
        chunks = chunks.select(ident(c("language"), c("path"), c("kind"), c("start"), c("end"), c("symbol")).alias("id"), "path", c("start").alias("start_line"), c("end").alias("end_line"), "symbol_id", "text", T.content_hash(whole).alias("content_hash"), "language", "kind")
        node_id = lambda kind, name, path: T.uuid5(repo, F.concat(lit("graph-node:"), kind, lit(":"), name, lit(":"), path))
        nodes = extract.exploded(nested, "nodes").join(owner, ["path", "symbol"], "left")
        nodes = nodes.select(node_id(c("kind"), c("qualified_name"), c("path")).alias("id"), "path", "kind", "qualified_name", "name", "start_line", "end_line", "symbol_id").dropDuplicates(["id"])
        facts = extract.exploded(nested, "facts")
        source = nodes.filter(c("kind").isin("module", "symbol", "test_symbol")).groupBy("path", c("qualified_name").alias("source_reference")).agg(F.min("id").alias("source_node"))
        facts = facts.join(source, ["path", "source_reference"]).withColumn("module", T.module_name(c("path")))
        facts = facts.select(ident(lit("graph-fact"), c("path"), c("start_line"), c("end_line"), c("kind"), c("source_reference"), c("target_reference"), c("ordinal")).alias("id"), "path", "ordinal", "kind", "source_node", "target_reference", "source_scope", "module", "start_line", "end_line", "confidence", "target_kind", "hint", "hint_method", "evidence")
        rows = good.select("path", T.ascii_lower(c("path")).alias("path_lc"), "modified_time_ns", "size_bytes", "content_hash", "language", "source_text", "line_count")
        symbols, chunks = stored(symbols), stored(chunks)
        postings, sizes = P.build(self.documents(symbols, chunks), "document", list(FIELD_WEIGHTS), ("path",))
        tables = {"files": rows, "symbols": symbols, "chunks": chunks, "graph_nodes": nodes, "graph_facts": facts, "postings": postings, "document_sizes": sizes}
        bad = failed.select("path").distinct()
        return {n: df.join(bad, "path", "left_anti") for n, df in tables.items()}, failed

    def resolved(self, nodes: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(status of every fact, edges with those between files)."""
        found = stored(G.resolve(facts, nodes.filter("kind <> 'repository'")))
        c = F.col
        own = found.filter("status = 'resolved'").select(
            T.uuid5(T.NAMESPACE, F.concat(F.lit("graph-edge:"), "id", F.lit(":"), "target")).alias("id"), c("source_node").alias("source"), "target", "kind", c("path").alias("source_file"), "start_line", "end_line", "method", (c("confidence") * c("factor")).alias("confidence"),
        )
        at = nodes.select(c("id").alias("target"), c("path").alias("target_path"))
        files = nodes.filter(c("kind").isin("file", "test_file")).select("path", "id")
        imports = own.filter("kind = 'imports'").join(at, "target").select(c("source_file").alias("source_path"), "target_path", "confidence", c("id").alias("fact"))
        between = G.dependencies(imports, files)
        between = between.join(own.select(c("id").alias("fact"), "source_file", "start_line", "end_line"), "fact").select(
            T.uuid5(T.NAMESPACE, F.concat(F.lit("graph-dependency:"), "source", F.lit(":"), "target")).alias("id"), "source", "target", F.lit("depends_on").alias("kind"), "source_file", "start_line", "end_line", F.lit("resolved_import").alias("method"), "confidence",
        )
        return found.select("id", "path", "status", "method"), own.unionByName(between)

    def made(self, real: str, repo: str, old: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame, DataFrame, int]:
        """(tables of the index that follows ``old``, what changed, failures, texts embedded)."""
        self.stage("walk")
        fresh = stored(repository.manifest(repository.files(self.spark, real)))
        self.stage("compare")
        diff = stored(M.manifest_diff(old["files"], fresh.select("path", "content_hash")))
        touched = fresh.join(diff.filter(F.col("change").isin("added", "changed")).select("path"), "path", "left_semi")
        total = touched.count()
        self.stage("parse", 0, total)
        new, failed = self.records(touched, repo)
        failed = stored(failed)
        for n in new:
            new[n] = stored(new[n])
            self.check()
        self.stage("parse", total, total)
        done = M.without_failed(diff, failed.select("path").distinct())
        self.stage("embed")
        known = old["embeddings"].select("content_hash", "chunk_id", "vector")
        vectors = M.reuse_vectors(new["chunks"], known, self.embed)
        new["embeddings"] = stored(vectors.select(F.col("id").alias("chunk_id"), "path", "content_hash", "vector", "reused"))
        embedded = new["embeddings"].filter("not reused").count()
        new["embeddings"] = new["embeddings"].drop("reused")
        self.stage("embed", embedded, embedded)
        tables = {n: stored(M.apply_updates(old[n].select(*new[n].columns), new[n], done)) for n in S.TABLES}
        self.stage("graph")
        # terms lie together, so that a query's filter skips most of the files
        tables["postings"] = tables["postings"].repartitionByRange("term").sortWithinPartitions("term", "document")
        tables["graph_nodes"] = G.root_node(tables["graph_nodes"], repo, os.path.basename(real))
        tables["graph_status"], tables["graph_edges"] = self.resolved(tables["graph_nodes"], tables["graph_facts"])
        return tables, diff, failed, embedded

    def empty(self) -> dict[str, DataFrame]:
        return {n: self.spark.createDataFrame([], ddl) for n, ddl in S.TABLES.items()}

    def in_memory(self, root: str) -> dict[str, DataFrame]:
        """All tables of a repository's index, of which nothing is kept."""
        import uuid

        return self.made(os.path.realpath(os.path.expanduser(root)), str(uuid.uuid4()), self.empty())[0]

    def index(self, root: str) -> dict:
        """Bring the index up to date: only files whose content changed are parsed, only unknown texts embedded.

        One writer at a time: a second one gets ``Busy``.
        """
        import uuid

        began = time.time()
        real = os.path.realpath(os.path.expanduser(root))
        snaps = self.snapshots(root)
        settings = {"format": S.FORMAT, "root": real} | identity(self.embedder)
        with M.Lease(snaps):
            usable = snaps.current() is not None and {k: snaps.note().get(k) for k in settings} == settings
            repo = snaps.note().get("repository") if usable else str(uuid.uuid4())
            tables, diff, failed, embedded = self.made(real, repo, {n: snaps.read(n) for n in S.TABLES} if usable else self.empty())
            self.stage("promote")
            snaps.write(tables, settings | {"repository": repo, "timestamp": int(time.time())})
        self.replaced(real)
        changes = {r.change: r["n"] for r in diff.groupBy("change").agg(F.count("*").alias("n")).collect()}
        errors = [f"{r.path}: {r.stage}: {r.message}" for r in failed.orderBy("path").limit(20).collect()]
        return {"path": real, "changes": changes, "embedded": embedded, "errors": errors, "elapsed": time.time() - began} | self.counts(root)

    def counts(self, root: str) -> dict:
        snaps = self.snapshots(root)
        names = [*S.TABLES, *S.DERIVED]
        return {r.table_name: r["n"] for r in M.counts({n: snaps.read(n) for n in names}).collect()}

    def status(self, root: str) -> dict:
        """missing, indexing, stale or ready, with counts and up to 20 changed paths. Nothing is parsed or embedded."""
        snaps = self.snapshots(root)
        if M.writing(snaps):
            return {"status": "indexing"}
        if snaps.current() is None:
            return {"status": "missing"}
        note = snaps.note()
        diff = M.manifest_diff(snaps.read("files"), repository.manifest(repository.files(self.spark, root))).filter("change <> 'unchanged'")
        paths = [f"{r.change}: {r.path}" for r in diff.orderBy("path").limit(20).collect()]
        now = {"format": S.FORMAT} | identity(self.embedder)
        same = {k: note.get(k) for k in now} == now
        facts = {r.status: r["n"] for r in snaps.read("graph_status").groupBy("status").agg(F.count("*").alias("n")).collect()}
        return {"status": "ready" if same and not paths else "stale", "changed": paths, "facts": facts, "timestamp": note.get("timestamp")} | self.counts(root)

    # --- search

    def documents(self, symbols: DataFrame, chunks: DataFrame) -> DataFrame:
        """Symbols and chunks as documents with an identity: the symbol, or the file."""
        c, lit = F.col, F.lit
        s = symbols.select(F.concat(lit("symbol:"), "id").alias("document"), F.concat(lit("symbol:"), "id").alias("identity"), c("id").alias("symbol_id"), lit(None).cast("string").alias("unit"), "path", "name", "qualified_name", "start_line", "end_line", c("source_snippet").alias("content"))
        owner = symbols.select(c("id").alias("symbol_id"), "name", "qualified_name")
        k = chunks.join(owner, "symbol_id", "left").select(F.concat(lit("chunk:"), "id").alias("document"), F.when(c("symbol_id").isNotNull(), F.concat(lit("symbol:"), "symbol_id")).otherwise(F.concat(lit("file:"), "path")).alias("identity"), "symbol_id", c("kind").alias("unit"), "path", "name", "qualified_name", c("start_line").cast("int").alias("start_line"), c("end_line").cast("int").alias("end_line"), c("text").alias("content"))
        return s.unionByName(k).withColumn("identifier_terms", F.array_join(T.identifier_terms(F.coalesce("name", lit("")), F.coalesce("qualified_name", lit("")), c("path")), " "))

    def lexical(self, snaps: M.Snapshots, query: str, path: str | None, limit: int) -> tuple[DataFrame, list[str]]:
        q, warnings = query.strip(), []
        c = F.col
        docs = self.documents(snaps.read("symbols"), snaps.read("chunks")).filter(T.under_path(c("path"), path))
        words = set(T.query_terms(q))
        allowed = c("symbol_id").isNotNull() & c("unit").isNull() | R.wanted_kind(words, c("unit"))
        spot = ["path", "start_line", "end_line", "document"]
        out = []

        def add(rows: DataFrame, channel: str, order: list, quality=F.lit(1.0)) -> None:
            hit = R.numbered(rows, order, R.LIMITS[channel]).filter(allowed)  # rows that aren't wanted still take a rank
            out.append(hit.select(F.lit(channel).alias("channel"), "channel_rank", quality.alias("quality"), "identity", "path", "start_line", "end_line", c("document").alias("id")))

        symbols = docs.filter("unit is null")
        for channel, name in (("exact_qualified", "qualified_name"), ("exact_short", "name")):
            add(symbols.filter(c(name) == q), channel, ["path", "qualified_name", "start_line", "document"])
        if T.is_path_like(q):
            p = T.path_query(q)
            add(docs.filter(T.path_prefix(c("path"), p)), "path", [F.when(c("path") == p, 0).otherwise(1), F.length("path"), *spot])
        terms = T.folded_query(q)
        for channel, searched in (("identifier", ["identifier_terms"]), ("bm25", ["content", "identifier_terms", "qualified_name", "name", *(["path"] if T.is_path_like(q) else [])])):
            if terms:  # statistics are the whole index's, the path filter comes after
                weights = {f: FIELD_WEIGHTS[f] for f in searched}
                scores = P.bm25_indexed(snaps.read("postings").drop("path"), snaps.read("document_sizes").drop("path"), "document", weights, terms)
                add(docs.join(scores, "document"), channel, [F.desc("bm25"), *spot])
        try:
            near = R.fuzzy(symbols.withColumn("id", c("document")), q, R.LIMITS["fuzzy_symbol"], self.settings.fuzzy_threshold, self.settings.most_fuzzy_candidates)
            add(near, "fuzzy_symbol", [F.desc("score"), F.length("qualified_name"), "path", "qualified_name", "start_line", "document"], c("score"))
        except OverflowError as error:
            warnings.append(f"fuzzy names were left out: {error}")
        channels = out[0]
        for x in out[1:]:
            channels = channels.unionByName(x)
        return R.merge_channels(channels, limit), warnings

    def vectors(self, snaps: M.Snapshots) -> DataFrame:
        """(id, path, start_line, end_line, symbol_id, name, qualified_name, kind, vector) of every chunk, lazily."""
        c = F.col
        owner = snaps.read("symbols").select(c("id").alias("symbol_id"), T.symbol_name(c("name")).alias("name"), "qualified_name")
        rows = snaps.read("embeddings").drop("path").join(snaps.read("chunks").drop("content_hash"), c("chunk_id") == c("id")).join(owner, "symbol_id", "left")
        return rows.select("id", "path", c("start_line").cast("int").alias("start_line"), c("end_line").cast("int").alias("end_line"), "symbol_id", "name", "qualified_name", "kind", "vector")

    def semantic(self, snaps: M.Snapshots, query: str, path: str | None, limit: int) -> DataFrame:
        note, own = snaps.note(), identity(self.embedder)
        if {k: note.get(k) for k in own} != own:
            raise Incompatible("the index holds vectors of another model; index the repository again")
        vector = self.embedder.embed_query(self.spark, query)
        c = F.col
        rows = self.candidates.get((snaps.root, snaps.current()), self.vectors(snaps), self.embedder.dimension).filter(T.under_path(c("path"), path))
        hits = rows.select("path", "start_line", "end_line", "id", "symbol_id", c("kind").alias("unit"), V.scored(rows, V.unit(vector, self.embedder.dimension), "vector").alias("raw"))
        pool = R.numbered(hits, [F.desc("raw"), "path", "start_line", "end_line", "id"], 8 * limit, "source_rank")
        pool = pool.filter(R.wanted_kind(set(T.query_terms(query)), c("unit")))
        pool = pool.withColumn("identity", F.when(c("symbol_id").isNotNull(), F.concat(F.lit("symbol:"), "symbol_id")).otherwise(F.concat(F.lit("file:"), "path"))).withColumn("owned", c("symbol_id").isNotNull())
        return R.semantic_collapse(pool, limit, floor=self.settings.score_floor)

    def pools(self, snaps, query, path) -> tuple[DataFrame, list[str]]:
        n = self.settings.pool
        lexical, warnings = self.lexical(snaps, query, path, n)
        lexical = R.numbered(lexical, ["best_channel", F.desc("score"), "path", "start_line", "end_line", "id"], n, "rank").select(F.lit("lexical").alias("retriever"), "rank", "path", F.col("identity").alias("id"), "score")
        semantic = self.semantic(snaps, query, path, n)
        semantic = R.numbered(semantic, [F.desc("relevance"), F.desc("similarity"), "source_rank"], n, "rank").select(F.lit("semantic").alias("retriever"), "rank", "path", F.col("identity").alias("id"), F.col("relevance").alias("score"))
        return lexical.unionByName(semantic), warnings

    def search(self, root: str, query: str, top_k: int = 5, mode: str = "auto", path: str | None = None, max_snippet_chars: int | None = None) -> Response:
        began = time.time()
        if mode not in MODES or not 1 <= top_k <= 20 or not query.strip() or len(query) > 2000:
            raise ValueError("a mode of " + ", ".join(MODES) + "; top_k from 1 to 20; a query of 1 to 2,000 characters")
        path = T.valid_path(path)
        snaps = self.snapshots(root)
        symbols = snaps.read("symbols").filter(T.under_path(F.col("path"), path)) if snaps.current() else None
        if symbols is None:
            raise FileNotFoundError("this repository isn't indexed")
        self.check()
        actual = route(symbols, query, self.settings.fuzzy_threshold, self.settings.most_fuzzy_candidates) if mode == "auto" else mode
        timings = {"route": time.time() - began}
        warnings: list[str] = []
        ident = F.concat(F.lit("symbol:"), "id").alias("identity")
        if actual == "exact":
            ranked = R.numbered(R.exact(symbols, query, top_k), [F.when(F.col("channel") == "exact_qualified", 0).otherwise(1), "path", "qualified_name", "start_line", "id"], top_k, "rank").select("rank", ident, "score")
        elif actual == "fuzzy":
            hits = R.fuzzy(symbols, query, top_k, self.settings.fuzzy_threshold, self.settings.most_fuzzy_candidates)
            ranked = R.numbered(hits, [F.desc("score"), F.length("qualified_name"), "path", "qualified_name", "start_line", "id"], top_k, "rank").select("rank", ident, "score")
        elif actual == "lexical":
            hits, warnings = self.lexical(snaps, query, path, top_k)
            ranked = R.numbered(hits, ["best_channel", F.desc("score"), "path", "start_line", "end_line", "id"], top_k, "rank").select("rank", "identity", "score")
        elif actual == "semantic":
            hits = self.semantic(snaps, query, path, top_k)
            ranked = R.numbered(hits, [F.desc("relevance"), F.desc("similarity"), "source_rank"], top_k, "rank").select("rank", "identity", F.col("relevance").alias("score"))
        else:
            pools, warnings = self.pools(snaps, query, path)
            if actual == "hybrid_weighted":
                fused = R.weighted_fusion(pools, R.weights_to_one(**self.settings.weighted_weights), self.settings.missing_value, top_k)
            else:
                fused = R.reciprocal_rank_fusion(pools, R.weights_to_one(**self.settings.rrf_weights), self.settings.rrf_k, top_k if actual == "hybrid_rrf" else self.settings.graph_seeds)
            fused = fused.select(F.col("id").alias("identity"), "path", "score")
            ranked = self.expanded(snaps, fused, top_k) if actual == "graph" else R.numbered(fused, [F.desc("score"), "path", "identity"], top_k, "rank").select("rank", "identity", "score")
        timings["plan"] = time.time() - began - timings["route"]
        self.check()
        results, more = self.completed(snaps, ranked, path, max_snippet_chars or self.settings.snippet_chars)
        timings["run"] = time.time() - began - sum(timings.values())
        return Response(query, mode, actual, results, warnings + more, time.time() - began, config_id(actual, self.settings.as_dict()), timings)

    def expanded(self, snaps: M.Snapshots, seeds: DataFrame, top_k: int) -> DataFrame:
        nodes, c = snaps.read("graph_nodes"), F.col
        by_symbol = nodes.filter("symbol_id is not null").select(c("id").alias("node"), F.concat(F.lit("symbol:"), "symbol_id").alias("identity"))
        own_file = nodes.filter(c("kind").isin("file", "test_file", "module") & c("symbol_id").isNull()).select(c("id").alias("node"), "path")
        at = seeds.join(by_symbol, "identity").select("node", c("identity").alias("seed"), "score").unionByName(seeds.join(own_file, "path").select("node", c("identity").alias("seed"), "score"))
        reached = G.expand(at, snaps.read("graph_edges"), self.settings.graph_hops, self.settings.graph_neighbours, G.EDGE_WEIGHTS, self.settings.graph_decay, self.settings.graph_confidence, self.settings.graph_expanded)
        reached = reached.join(nodes.select(c("id").alias("node"), "kind", "path", "symbol_id").withColumnRenamed("kind", "node_kind"), "node")
        reached = reached.select(F.when(c("symbol_id").isNotNull(), F.concat(F.lit("symbol:"), "symbol_id")).otherwise(F.concat(F.lit("file:"), "path")).alias("node"), "contribution").groupBy("node").agg(F.max("contribution").alias("contribution"))
        return G.merge_results(seeds.select(c("identity").alias("node"), "score"), reached, top_k).select("rank", c("node").alias("identity"), "score")

    def completed(self, snaps: M.Snapshots, ranked: DataFrame, path: str | None, most: int) -> tuple[list[dict], list[str]]:
        """Ranked identities with their whole declaration or file, within the output budget: kept whole or left out."""
        c = F.col
        s = snaps.read("symbols").select(F.concat(F.lit("symbol:"), "id").alias("identity"), "path", T.symbol_name(c("name")).alias("name"), "qualified_name", "kind", "start_line", "end_line", c("source_snippet").alias("snippet"))
        f = snaps.read("files").select(F.concat(F.lit("file:"), "path").alias("identity"), "path", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("qualified_name"), c("language").alias("kind"), F.lit(1).alias("start_line"), c("line_count").alias("end_line"), c("source_text").alias("snippet"))
        rows = ranked.join(s.unionByName(f), "identity").filter(T.under_path(c("path"), path))
        short, longer = T.snippet(c("snippet"), most)
        rows = rows.withColumn("truncated", longer).withColumn("snippet", short).withColumn("size", F.length("snippet").cast("long")).withColumn("id", c("identity"))
        # a page of at most 20 rows
        page = [r.asDict() for r in rows.orderBy("rank").collect()]
        kept, used = [], 0
        for r in page:
            if not r["truncated"] and used + r["size"] <= self.settings.total_chars:
                used += r["size"]
                kept.append({k: v for k, v in r.items() if k not in ("truncated", "size", "id")})
        left = len(page) - len(kept)
        return kept, [f"Omitted {left} results beyond the output budget"] if left else []
