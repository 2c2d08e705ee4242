"""Vector search with clipped inner products."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.text import clip
from siftwell.session import ship

#: Bytes of a block of queries and of a block of rows, as doubles, and of the scores that a task holds at once.
QUERY_BYTES, ROW_BYTES, SCORE_BYTES = 4 << 20, 8 << 20, 8 << 20


def unit(query: list[float], dimension: int | None = None) -> list[float]:
    """A query vector of length 1; a zero, non-finite or wrongly sized one is an error."""
    q = [float(x) for x in query]
    norm = math.sqrt(sum(x * x for x in q))
    if not q or not math.isfinite(norm) or norm == 0 or (dimension is not None and len(q) != dimension):
        raise ValueError("not a usable query vector")
    return [x / norm for x in q]


def unit_column(vector: Column, dimension: int | None = None) -> Column:
    """The same for a column; null where ``unit`` would be an error."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
    usable = (F.size(vector) > 0) & ~F.isnan(norm) & (norm != float("inf")) & (norm > 0)
    if dimension is not None:
        usable = usable & (F.size(vector) == dimension)
    return F.when(usable, F.transform(vector, lambda x: x / norm))


def scored(vectors: DataFrame, query: list[float], vector: str) -> Column:
    q = F.lit([float(x) for x in query]).cast("array<double>")
    return F.round(clip(F.aggregate(F.zip_with(F.col(vector), q, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x), -1.0, 1.0), 6)


def top_k(vectors: DataFrame, query: list[float], key: str, vector: str, k: int) -> DataFrame:
    """(key, score) of one query, best first, ties by key: a projection and a TakeOrderedAndProject."""
    return vectors.select(key, scored(vectors, query, vector).alias("score")).orderBy(F.desc("score"), key).limit(k)


def matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows of doubles, from the column's own buffer and not by an object for each."""
    flat = vectors.combine_chunks()
    if flat.null_count or not (lengths := flat.value_lengths()).equals(pa.repeat(lengths[0], len(lengths))):
        raise ValueError("vectors of different lengths")
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def nearest(asks: np.ndarray, us: np.ndarray, ids: np.ndarray, them: np.ndarray, k: int) -> list[np.ndarray]:
    """(query, id, score) of each query's k best among other ids, ties by id; as many queries at a time as ``SCORE_BYTES`` hold."""
    out, some = ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]), max(1, SCORE_BYTES // (8 * len(ids)))
    for i in range(0, len(asks), some):
        score = us[i : i + some] @ them.T
        np.round(np.clip(score, -1, 1, out=score), 6, out=score)
        for q, s in zip(asks[i : i + some].tolist(), score):
            s[ids == q] = -np.inf
            kth = np.partition(s, max(0, len(s) - k))[max(0, len(s) - k)]
            at = np.flatnonzero((s >= kth) & np.isfinite(s))
            at = at[np.lexsort((ids[at], -s[at]))][:k]
            for o, x in zip(out, (np.full(len(at), q), ids[at], s[at])):
                o.append(x)
    return [np.concatenate(o) for o in out]


def batch_top_k(vectors: DataFrame, is_query: Column, key: str, vector: str, k: int) -> DataFrame:
    """(query_id, rank, key, score) of many queries: blocks of queries meet blocks of rows as matrices; k of each go on.

    Blocks are bounded by bytes whatever the dimension, and a task scores a few queries at a time, so its memory doesn't follow
    the input. Small inputs get more blocks of queries, until all cores have work.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.filter(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), is_query.alias("q"))
    n, asked, dimension = rows.agg(F.count("*"), F.count_if("q"), F.max(F.size("v"))).first()
    wide = 8 * max(1, dimension or 1)
    rb, qb = max(1, -(-n * wide // ROW_BYTES)), max(1, -(-asked * wide // QUERY_BYTES))
    qb = max(qb, min(-(-asked // 512), -(-3 * spark.sparkContext.defaultParallelism // rb)))
    place = lambda m: F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")
    left = rows.filter("q").select("id", "v", place(qb).alias("qb")).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(rb - 1))))
    right = rows.select("id", "v", place(rb).alias("rb")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qb - 1))))

    def run(ask: pa.Table, own: pa.Table) -> pa.Table:
        if not (ask.num_rows and own.num_rows):
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names=["query_id", key, "score"])
        found = nearest(ask.column("id").to_numpy(), matrix(ask.column("v")), own.column("id").to_numpy(), matrix(own.column("v")), k)
        return pa.table([pa.array(x) for x in found], names=["query_id", key, "score"])

    each = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInArrow(run, f"query_id long, {key} long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return each.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)
