"""Inverted index and BM25 over weighted columns.

``postings`` has one row per (document, column, term), ``sizes`` one per document. Every (column, term) of a query is a
phrase of its own: idf = ln((N - n + .5) / (n + .5)), at least 1e-6; f = weight * tf; the length is that of all columns.
Statistics are those of the whole index, whatever is filtered afterwards.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from siftwell.functions.text import tokens
from siftwell.session import cut, spread

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def build(docs: DataFrame, key: str, columns: list[str], keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(postings: key, column, term, tf; sizes: key, dl), both with ``keep``. Term counts combine before the shuffle."""
    spread = docs.select(key, *keep, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), tokens(F.coalesce(F.col(c), F.lit(""))).alias("terms")) for c in columns])).alias("x"))
    postings = spread.select(key, *keep, "x.column", F.explode("x.terms").alias("term")).groupBy(key, *keep, "column", "term").agg(F.count("*").alias("tf"))
    sizes = docs.select(key, *keep, sum((F.size(tokens(F.coalesce(F.col(c), F.lit("")))) for c in columns), F.lit(0)).cast("long").alias("dl"))
    return postings, sizes


def bm25_channels(docs: DataFrame, key: str, weights: dict[str, float], terms: list[str], channels: dict[str, list[str]]) -> DataFrame:
    """(key, one score per channel, null without a hit) of the documents that hold a term in a column of any channel.

    Texts are tokenised once, in one pass that observes the number of documents, their length and the frequency of every
    phrase; only documents with a hit are written, as narrow rows. What is left is arithmetic on them: nothing is shuffled.
    """
    columns = [c for c in weights if any(c in searched for searched in channels.values())]
    docs = spread(docs.select(key, *weights))
    words = docs.select(F.col(key).alias("k"), *[tokens(F.coalesce(F.col(c), F.lit(""))).alias(f"w_{c}") for c in weights])
    dl = sum((F.size(f"w_{c}") for c in weights), F.lit(0)).cast("double")
    # how often a term stands in a column: what removing it takes away
    phrases = [(c, t) for c in columns for t in terms]
    counts = words.select("k", dl.alias("dl"), *[(F.size(f"w_{c}") - F.size(F.array_remove(f"w_{c}", t))).cast("double").alias(f"n{i}") for i, (c, t) in enumerate(phrases)])
    seen = Observation()
    counts = counts.observe(seen, F.count("*").alias("all"), F.sum("dl").alias("length"), *[F.count_if(F.col(f"n{i}") > 0).alias(f"n{i}") for i in range(len(phrases))])
    hits = cut(counts.filter(reduce(or_, [F.col(f"n{i}") > 0 for i in range(len(phrases))], F.lit(False))))
    stats = seen.get
    average = (stats["length"] or 0.0) / max(1, stats["all"])
    scores = []
    for name, searched in channels.items():
        score, hit = F.lit(0.0), F.lit(False)
        for i, (c, t) in enumerate(phrases):
            if c in searched and (n := stats[f"n{i}"]):
                idf = max(LEAST_IDF, math.log((stats["all"] - n + 0.5) / (n + 0.5)))
                f = float(weights[c]) * F.col(f"n{i}")
                score = score + F.when(F.col(f"n{i}") > 0, F.lit(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / average))).otherwise(0.0)
                hit = hit | (F.col(f"n{i}") > 0)
        scores.append(F.when(hit, score).alias(name))
    return hits.select(F.col("k").alias(key), *scores)


def bm25(docs: DataFrame, key: str, weights: dict[str, float], terms: list[str], searched: list[str] | None = None) -> DataFrame:
    """(key, bm25): the scores, larger being better, of the documents that hold a term in a searched column."""
    return bm25_channels(docs, key, weights, terms, {"bm25": searched or list(weights)}).filter("bm25 is not null")


def bm25_indexed(postings: DataFrame, sizes: DataFrame, key: str, weights: dict[str, float], terms: list[str]) -> DataFrame:
    """The same from a stored index: only the query's terms are read (the filter reaches the scan)."""
    hits = postings.filter(F.col("column").isin(list(weights)) & F.col("term").isin(terms)).join(sizes, key)
    stats = sizes.agg(F.count("*").cast("double").alias("all_docs"), F.avg("dl").alias("avgdl"))
    n = hits.groupBy("column", "term").agg(F.count("*").cast("double").alias("n")).join(F.broadcast(stats), F.lit(True))
    raw = F.log((F.col("all_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    idf = n.select("column", "term", "avgdl", F.when(raw > 0, raw).otherwise(LEAST_IDF).alias("idf"))
    weight = F.element_at(F.create_map(*[x for c, w in weights.items() for x in (F.lit(c), F.lit(float(w)))]), F.col("column"))
    f = weight * F.col("tf")
    part = F.col("idf") * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.join(F.broadcast(idf), ["column", "term"]).groupBy(key).agg(F.sum(part).alias("bm25"))
