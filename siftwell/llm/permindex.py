"""Approximate nearest neighbours by a permutation index.

Pivots are drawn from a bounded sample (``pivots`` rows of smallest hash, fewer if they are wide). A vector is represented
by its nearest pivots in order and posted, with its place, under the ``posts`` nearest: one set of inverted files per block
of rows, built once and stored; all rows are posted. A query reads the files of its own ``probes`` nearest pivots. With
places counted from 0 and a missing pivot at place ``probes``, the footrule distance of the two lists is a constant less
twice the sum, over the pivots they share, of ``probes`` less the greater place; adding that up over the files ranks the
rows that share any, and the ``rerank`` share of a block's rows that is nearest by footrule, at least ``least`` * k, is
compared by the true measure.

Largest inner products are nearest neighbours once vectors get one more component that makes all lengths equal to the
greatest one, the query's being 0; for vectors of unit length it is 0 as well. Blocks of rows stay in place and blocks of
queries are sent to them, each query's pivots having been found once; the k best of each go on to a window by query.

Cases: null and zero vectors, and those with null, NaN or infinite components, take no part; shorter ones count as
padded with zeros; equal scores go to the smaller id; a query is never its own candidate, by id, so rows that repeat an
id leave each other out and are otherwise candidates of their own; with fewer candidates than k all are given, as a block
gives at least ``least`` * k rows to the true measure, rows that share no pivot among them. An empty table gives no rows.
Only the id, the vector and what tells queries are read, so no name can clash.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.topk import BLOCK_VALUES, best_per_row, blocks, matrix, meet, usable, wide
from siftwell.session import ship, stored

PIVOTS, POSTS, PROBES, RERANK, LEAST, ROW_BLOCK, QUERY_BLOCK = 2048, 32, 56, 0.15, 10, 16_384, 512


def nearest_pivots(x: np.ndarray, extra: np.ndarray, pivots: np.ndarray, pivot_extra: np.ndarray, prefix: int) -> np.ndarray:
    """The ``prefix`` nearest pivots of each vector, nearest first, ties to the smaller number."""
    out = [np.zeros((0, min(prefix, len(pivots))), np.int64)]
    square = (pivots**2).sum(axis=1) + pivot_extra**2
    for i in range(0, len(x), 1024):
        d = square[None, :] - 2 * (x[i : i + 1024] @ pivots.T + np.outer(extra[i : i + 1024], pivot_extra))
        if prefix < d.shape[1]:  # of equal distances at the end of the prefix, any may stay; its order is total again
            near = np.sort(np.argpartition(d, prefix - 1, axis=1)[:, :prefix], axis=1)
            out.append(np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1))
        else:
            out.append(np.argsort(d, axis=1, kind="stable")[:, :prefix])
    return np.concatenate(out)


class InvertedFiles:
    """Rows and places under each pivot, of rows represented by ``order``."""

    def __init__(self, order: np.ndarray, pivots: int):
        self.n, posts = order.shape
        flat = order.ravel()
        by = np.argsort(flat, kind="stable")
        self.row, self.place = (by // posts).astype(np.int32), (by % posts).astype(np.int16)
        self.bounds = np.searchsorted(flat[by], np.arange(pivots + 1))

    def overlap(self, query: np.ndarray) -> np.ndarray:
        """Of a query (its nearest pivots in order) and each row; the footrule distance is a constant less twice this."""
        probes = len(query)
        at = [slice(a, b) for a, b in zip(self.bounds[query].tolist(), self.bounds[query + 1].tolist())]
        rank = np.repeat(np.arange(probes, dtype=np.int16), [s.stop - s.start for s in at])
        weight = probes - np.maximum(np.concatenate([self.place[s] for s in at]), rank)
        return np.bincount(np.concatenate([self.row[s] for s in at]), weights=weight, minlength=self.n).astype(np.int32)


def greatest(values: np.ndarray, take: int) -> np.ndarray:
    """Positions of the ``take`` greatest of small whole numbers, the first of equal ones."""
    if take >= len(values):
        return np.arange(len(values))
    least = len(values) - take
    bar = int(np.searchsorted(np.cumsum(np.bincount(values)), least, "right"))  # the smallest of those taken
    above, equal = np.flatnonzero(values > bar), np.flatnonzero(values == bar)
    return np.concatenate((above, equal[: take - len(above)]))


def found(ids: np.ndarray, x: np.ndarray, files: InvertedFiles, q_ids: np.ndarray, q: np.ndarray, order: np.ndarray, k: int, take: int) -> tuple[np.ndarray, ...]:
    """(query's number, id, score) of the k best of the ``take`` rows nearest by footrule of each query; ids ascend."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for j, own in enumerate(q_ids.tolist()):
        pick = greatest(files.overlap(order[j]), take)
        pick = pick[ids[pick] != own]
        score = x[pick] @ q[j].astype(x.dtype)
        if len(pick) > k:  # products in x's own precision: those near the k-th are added up again, in double
            kth = np.partition(score, len(score) - k)[len(score) - k]
            slack = 1e-4 if x.dtype == np.float32 else 1e-9
            pick = pick[score >= kth - slack * (1 + np.abs(score).max())]
        score = (x[pick].astype(np.float64) * q[j]).sum(axis=1)
        out.append(best_per_row(np.full(len(pick), j), ids[pick], score, k))
    return tuple(np.concatenate(c) for c in zip(*out))


def nearest(
    vectors: DataFrame, id_col: str, vector: str, is_query: Column, k: int = 20, pivots: int = PIVOTS, posts: int = POSTS, probes: int = PROBES, rerank: float = RERANK, least: int = LEAST, row_block: int = ROW_BLOCK
) -> DataFrame:
    """(query_id, rank, vec_id, score)."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.filter(F.col(id_col).isNotNull() & usable(vector) & F.exists(vector, lambda x: x != 0)).select(F.col(id_col).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    count, asked, d, longest = rows.agg(F.count("*"), F.count_if("q"), F.max(F.size("v")), F.max(square)).first()
    if not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # at most ``pivots`` rows and BLOCK_VALUES numbers
    chosen = [r.v + [0.0] * (d - len(r.v)) for r in rows.orderBy(F.xxhash64("id"), "id").select("id", "v").limit(min(pivots, max(1, BLOCK_VALUES // d))).collect()]
    p = np.array(chosen)
    p_extra = np.sqrt(np.maximum(0, longest - (p**2).sum(axis=1)))
    posts, probes = min(posts, len(p)), min(probes, len(p))
    size = max(1, min(row_block, BLOCK_VALUES // d))
    row_blocks, query_blocks = -(-count // size), -(-asked // QUERY_BLOCK)

    def row_block_of(t: pa.Table) -> dict:
        ids, x = t.column("id").to_numpy(), wide(matrix(t.column("v")), d, np.float64)
        by_id = np.argsort(ids, kind="stable")
        ids, x = ids[by_id], x[by_id]
        single = x.astype(np.float32)
        files = InvertedFiles(nearest_pivots(x, np.sqrt(np.maximum(0, longest - (x**2).sum(axis=1))), p, p_extra, posts), len(p))
        return {"blob": pickle.dumps((ids, single if (single == x).all() else x, files))}

    def query_block(t: pa.Table) -> dict:
        q = wide(matrix(t.column("v")), d, np.float64)
        return {"blob": pickle.dumps((t.column("id").to_numpy(), q, nearest_pivots(q, np.zeros(len(q)), p, p_extra, probes)))}

    index = blocks(rows.select("id", "v").repartition(row_blocks, "id"), size, row_block_of, "blob binary").withColumnRenamed("part", "stripe")
    queries = blocks(rows.filter("q").select("id", "v").repartition(query_blocks, "id"), QUERY_BLOCK, query_block, "blob binary").select((F.col("part") + F.col("nth") * query_blocks).alias("nth"), F.lit(row_blocks - 1).alias("last"), "blob")

    def answer(own: list[tuple], block: tuple) -> pa.RecordBatch:
        q_ids, q, order = block
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for ids, x, files in own:
            out.append(found(ids, x, files, q_ids, q, order, k, min(len(ids), max(least * k, int(rerank * len(ids))))))
        row, ids, score = best_per_row(*(np.concatenate(c) for c in zip(*out)), k)
        return pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array(ids), pa.array(score)], ["query_id", "vec_id", "score"])

    each = meet(stored(index), queries, row_blocks, query_blocks, lambda held: held, answer, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
