"""Top-k, channels, merges, fusion and the output budget."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.text import clip, fuzzy_ladder, normalize_identifier
from siftwell.session import spread

CHANNELS = {c: i for i, c in enumerate("exact_qualified exact_short path identifier bm25 fuzzy_symbol".split())}
BONUS = {"exact_qualified": 1.0, "exact_short": 0.96, "path": 0.86, "identifier": 0.76, "bm25": 0.66, "fuzzy_symbol": 0.36}
LIMITS = {"exact_qualified": 50, "exact_short": 50, "path": 50, "identifier": 100, "bm25": 100, "fuzzy_symbol": 512}
INTENTS = {
    "imports": {"import", "imports", "dependency", "dependencies"},
    "symbol_comment": {"comment", "comments", "note", "notes", "todo"}, "module_comment": {"comment", "comments", "note", "notes", "todo"},
    "module_docstring": {"doc", "docs", "docstring", "documentation", "module", "overview"},
}


def exact(symbols: DataFrame, query: str, top_k: int) -> DataFrame:
    """Symbols of that qualified or short name, the former first; score 1."""
    q = query.strip()
    hit = symbols.filter((F.col("qualified_name") == q) | (F.col("name") == q)) if q else symbols.limit(0)
    first = F.when(F.col("qualified_name") == q, 0).otherwise(1)
    out = hit.withColumns({"channel": F.when(F.col("qualified_name") == q, "exact_qualified").otherwise("exact_short"), "score": F.lit(1.0)})
    return out.orderBy(first, "path", "qualified_name", "start_line", "id").limit(top_k)


def fuzzy(symbols: DataFrame, query: str, top_k: int, least: float = 0.55, most_candidates: int | None = None) -> DataFrame:
    """Symbols by the better of the scores of both names. More candidates than allowed is an error, not a cut."""
    if len(query) > 256:
        raise ValueError("a fuzzy query has at most 256 characters")
    if most_candidates is not None and symbols.limit(most_candidates + 1).count() > most_candidates:
        raise OverflowError(f"more than {most_candidates} candidates")
    bounded = lambda c: normalize_identifier(F.when(F.length(c) <= 512, F.col(c)).otherwise(""))
    # normal forms are columns, computed once; in one struct they can't clash
    packed = spread(symbols.select(F.struct(*[symbols[f"`{c}`"] for c in symbols.columns]).alias("row")))
    normal = packed.select("row", bounded("row.name").alias("a"), bounded("row.qualified_name").alias("b"))
    scored = normal.select("row", F.greatest(fuzzy_ladder(query, F.col("a"), least), fuzzy_ladder(query, F.col("b"), least)).alias("s"))
    out = scored.select(*[F.col("row").getField(c).alias(c) for c in symbols.columns if c != "score"], F.col("s").alias("score"))
    # the threshold comes last: what falls under it sorts last, and a filter below the limit would compute each score again
    return out.orderBy(F.desc("score"), F.length("qualified_name"), "path", "qualified_name", "start_line", "id").limit(top_k).filter(F.col("score") >= least)


def wanted_kind(query_words: set[str], kind: Column) -> Column:
    """Rows of a kind that needs an intent word pass only with one; other kinds pass."""
    blocked = [k for k, words in INTENTS.items() if not words & query_words]
    return F.coalesce(~kind.isin(blocked), F.lit(True)) if blocked else F.lit(True)


def numbered(rows: DataFrame, order: list, limit: int, alias: str = "channel_rank") -> DataFrame:
    """The first rows of a total order with their places. The limit comes first, so the window sees few rows."""
    return rows.orderBy(*order).limit(limit).withColumn(alias, F.row_number().over(Window.orderBy(*order)).cast("long"))


def merge_channels(channels: DataFrame, result_limit: int, most_identities: int | None = 500, bonus: dict[str, float] = BONUS) -> DataFrame:
    """(identity, path, start_line, end_line, id, best_channel, score) of rows (channel, channel_rank, quality, identity, path, ...).

    Evidence is bonus * clip(quality / rank); a channel's best counts; the score is the greatest evidence and a twentieth
    of the others, at most 1. Base attributes are those of the row that came first, and identities after the first
    ``most_identities`` are left out, as the order of insertion has them; with None all stay.
    """
    number = F.element_at(F.create_map(*[x for c, n in CHANNELS.items() for x in (F.lit(c), F.lit(n))]), F.col("channel"))
    weight = F.element_at(F.create_map(*[x for c, w in bonus.items() for x in (F.lit(c), F.lit(w))]), F.col("channel"))
    rows = channels.withColumns({"channel_no": number, "evidence": weight * clip(F.col("quality") / F.col("channel_rank"), 0.0, 1.0)})
    per = rows.groupBy("identity", "channel_no").agg(F.max("evidence").alias("e"), F.min(F.struct("channel_rank", "path", "start_line", "end_line", "id")).alias("base"))
    merged = per.groupBy("identity").agg(F.min("channel_no").alias("best_channel"), F.max("e").alias("m"), F.sum("e").alias("s"), F.min(F.struct("channel_no", "base")).alias("first"))
    out = merged.orderBy("first.channel_no", "first.base.channel_rank", "identity").limit(most_identities) if most_identities is not None else merged
    out = out.select("identity", "first.base.path", "first.base.start_line", "first.base.end_line", "first.base.id", F.col("best_channel").cast("long").alias("best_channel"), F.least(F.lit(1.0), F.col("m") + 0.05 * (F.col("s") - F.col("m"))).alias("score"))
    return out.orderBy("best_channel", F.desc("score"), "path", "start_line", "end_line", "id").limit(result_limit)


def semantic_collapse(hits: DataFrame, result_limit: int, owned_bonus: float = 0.03, floor: float | None = None) -> DataFrame:
    """Best row per identity of rows (identity, owned, raw, source_rank, path, start_line, end_line, id)."""
    similarity = clip((F.col("raw") + 1) / 2, 0.0, 1.0)
    rows = hits.withColumn("similarity", similarity).withColumn("relevance", clip(similarity + F.when(F.col("owned"), owned_bonus).otherwise(0.0), 0.0, 1.0))
    order = [F.desc("relevance"), F.desc("similarity"), "source_rank", "path", "start_line", "end_line", "id"]
    best = rows.withColumn("nth", F.row_number().over(Window.partitionBy("identity").orderBy(*order))).filter("nth = 1").drop("nth")
    if floor is not None:
        best = best.filter(F.col("relevance") >= floor)
    return best.orderBy(*order).limit(result_limit)


def weights_to_one(**weights: float) -> dict[str, float]:
    total = sum(weights.values())
    if not total > 0 or not math.isfinite(total) or min(weights.values()) < 0:
        raise ValueError("weights must be finite, not negative, and more than 0 together")
    return {k: w / total for k, w in weights.items()}


def reciprocal_rank_fusion(pools: DataFrame, weights: dict[str, float], k: int = 60, top_k: int = 20) -> DataFrame:
    """(path, id, raw, score) of rows (retriever, rank, path, id): the best rank of each retriever counts; the best score is 1."""
    best = pools.groupBy("path", "id", "retriever").agg(F.min("rank").alias("rank"))
    weight = F.element_at(F.create_map(*[x for r, w in weights.items() for x in (F.lit(r), F.lit(w))]), F.col("retriever"))
    fused = best.groupBy("path", "id").agg(F.sum(weight / (k + F.col("rank"))).alias("raw"))
    out = fused.withColumn("score", F.col("raw") / F.max("raw").over(Window.partitionBy()))
    return out.orderBy(F.desc("raw"), "path", "id").limit(top_k)


def min_max(pools: DataFrame) -> DataFrame:
    """``normal``: a retriever's scores stretched to [0, 1]; 1 where they are all equal."""
    w = Window.partitionBy("retriever")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return pools.withColumn("normal", F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low)))


def weighted_fusion(pools: DataFrame, weights: dict[str, float], missing: float = 0.0, top_k: int = 20) -> DataFrame:
    best = min_max(pools).groupBy("path", "id", "retriever").agg(F.max("normal").alias("normal"))
    own = best.groupBy("path", "id").agg(*[F.coalesce(F.max(F.when(F.col("retriever") == r, F.col("normal"))), F.lit(missing)).alias(f"s_{r}") for r in weights])
    raw = sum((F.lit(w) * F.col(f"s_{r}") for r, w in weights.items()), F.lit(0.0))
    return own.select("path", "id", raw.alias("score")).orderBy(F.desc("score"), "path", "id").limit(top_k)


def candidate_groups(candidates: DataFrame) -> DataFrame:
    """(ordinal, group): components of at most some dozens of candidates under identity; the group is its least ordinal.

    Two candidates are one if they share id, symbol, or span, or a name with overlapping spans. Identity is decided in
    one fold over the array of all candidates, which a pool bounds.
    """
    one = F.struct("ordinal", "id", "symbol_id", "path", "start_line", "end_line", "name")
    gathered = candidates.agg(F.array_sort(F.collect_list(one)).alias("all"))

    def same(a: Column, b: Column) -> Column:
        spot = a["path"] == b["path"]
        return F.coalesce(
            (a["id"] == b["id"]) | F.coalesce(a["symbol_id"] == b["symbol_id"], F.lit(False)) | (spot & (a["start_line"] == b["start_line"]) & (a["end_line"] == b["end_line"]))
            | F.coalesce(spot & (a["name"] == b["name"]) & (a["start_line"] <= b["end_line"]) & (b["start_line"] <= a["end_line"]), F.lit(False)),
            F.lit(False),
        )

    # groups so far: arrays of candidates; a new one joins all groups it is the same as
    start = F.expr("cast(array() as array<array<struct<ordinal:bigint,id:bigint,symbol_id:bigint,path:string,start_line:bigint,end_line:bigint,name:string>>>)")

    def step(groups: Column, x: Column) -> Column:
        touched = lambda g: F.exists(g, lambda y: same(x, y))
        joined = F.concat(F.flatten(F.filter(groups, touched)), F.array(x))
        return F.concat(F.filter(groups, lambda g: ~touched(g)), F.array(joined))

    groups = gathered.select(F.explode(F.aggregate("all", start, step)).alias("g"))
    return groups.select(F.array_min(F.transform("g", lambda y: y["ordinal"])).alias("group"), F.explode("g").alias("c")).select(F.col("c.ordinal").alias("ordinal"), "group")


def representatives(candidates: DataFrame, groups: DataFrame) -> DataFrame:
    """The richest member of each group: longest snippet, untruncated, most metadata, then location."""
    facts = sum((F.col(c).isNotNull().cast("int") for c in ("symbol_id", "name")), F.lit(0))
    order = [F.desc("snippet_length"), F.col("truncated").asc(), facts.desc(), "path", "start_line", "end_line", F.coalesce("name", F.lit("")), "id"]
    joined = candidates.join(groups, "ordinal")
    return joined.withColumn("nth", F.row_number().over(Window.partitionBy("group").orderBy(*order))).filter("nth = 1").drop("nth")


def output_budget(results: DataFrame, per_result: int, total: int, order: str = "rank") -> DataFrame:
    """Results with ``kept``: complete, within the limit of one and within what the kept ones before left. A page, so one fold."""
    page = results.agg(F.array_sort(F.collect_list(F.struct(order, "id", "size", "truncated"))).alias("page"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.expr("cast(array() as array<bigint>)").alias("ids"))

    def step(s: Column, x: Column) -> Column:
        fits = ~x["truncated"] & (x["size"] <= per_result) & (s["used"] + x["size"] <= total)
        return F.struct(F.when(fits, s["used"] + x["size"]).otherwise(s["used"]).alias("used"), F.when(fits, F.array_append(s["ids"], x["id"])).otherwise(s["ids"]).alias("ids"))

    kept = page.select(F.aggregate("page", start, step).alias("s"))
    return results.join(F.broadcast(kept), F.lit(True)).select(*results.columns, F.array_contains("s.ids", F.col("id")).alias("kept"))
