"""Exact top-k inner products over integer vectors, with norm order and pruning.

Rows are sorted by length, longest first, and stored in blocks, the blocks of a range of lengths making a stripe. Blocks
of queries go to the stripes; a task takes a stripe and answers one block of queries after another, so rows stay in place
and only queries are sent about. A sample (``sample`` rows of smallest hash) gives each query the k-th score of the sample
to begin with, below which nothing counts. By Cauchy-Schwarz no product exceeds the product of lengths: a query isn't sent
to stripes whose longest vector can't reach its bar, and leaves off a stripe at the first such block. Vectors are rotated by
the right singular vectors of the sample; a partial product over the first ``lead`` coordinates plus the product of the
residuals' lengths bounds the whole one, and only pairs whose bound reaches the bar are multiplied out, exactly, as
integers. ``lead`` is what costs least by the sample; where no partial product pays (directions of equal weight, as in
random vectors) it is the whole product. The sample changes the work, not the result.

Every query meets every row that can matter, in blocks; that is the whole job, no limit. Only the k best of each stripe
go on, to a window by query. Blocks are bounded in values as well as rows, so wide vectors make smaller ones.

Cases: vectors that are null or hold null, NaN or infinite components take no part; a shorter vector counts as padded
with zeros; equal scores go to the smaller id; a query is never its own candidate, by id, so rows that repeat an id
leave each other out; with fewer candidates than k all are given; queries with no candidate give no row. An empty table
gives no rows. Only the id, the vector and what tells queries are read, so no name can clash.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.buffers import trim
from siftwell.session import ship, shuffle_partitions, stored

SCALE, QUERY_BLOCK, ROW_BLOCK, STRIPE_ROWS, BLOCK_VALUES = 1024, 512, 4096, 65_536, 1 << 22
NONE = np.iinfo(np.int64).min // 2


def usable(vector: str) -> Column:
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True))


def matrix(batch_column, kind=np.float64) -> np.ndarray:
    """Rows of a list column, shorter ones padded with zeros."""
    column = batch_column.combine_chunks() if isinstance(batch_column, pa.ChunkedArray) else batch_column
    rows = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    n = np.diff(column.offsets.to_numpy()) if rows else np.zeros(0, np.int64)
    d = int(n.max()) if rows else 0
    if (n == d).all():
        return flat.reshape(rows, d)
    out = np.zeros((rows, d), kind)
    out[np.arange(d) < n[:, None]] = flat
    return out


def blocks(rows: DataFrame, size: int, pack: Callable[[pa.Table], dict], schema: str) -> DataFrame:
    """``pack`` of every ``size`` rows of each partition, in order, with (part, nth) of the block in front."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        nth, left, part = 0, [], TaskContext.get().partitionId()

        def out(t: pa.Table) -> pa.RecordBatch:
            nonlocal nth
            nth += 1
            return pa.RecordBatch.from_pylist([{"part": part, "nth": nth - 1, **pack(t)}], kinds)

        for batch in batches:
            left.append(batch)
            while sum(b.num_rows for b in left) >= size:
                t = pa.Table.from_batches(left)
                yield out(t.slice(0, size))
                left = t.slice(size).to_batches()
        if sum(b.num_rows for b in left):
            yield out(pa.Table.from_batches(left))
        trim()

    schema = f"part int, nth int, {schema}"
    kinds = arrow_schema(rows, schema)
    return rows.mapInArrow(run, schema)


def arrow_schema(df: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)


def meet(rows: DataFrame, queries: DataFrame, stripes: int, query_blocks: int, load: Callable[[list], object], answer: Callable[[object, object], pa.RecordBatch], schema: str) -> DataFrame:
    """``answer`` of every block of queries (nth, blob, last: the last stripe it goes to) to every stripe of rows (stripe, nth, blob).

    ``load`` turns a stripe's blocks into what answers need. Where there are fewer stripes than tasks, and beyond 64 blocks
    of queries a stripe, queries are dealt to several shards, to each of which the stripe goes.
    """
    shards = max(1, min(query_blocks, max(-(-query_blocks // 64), -(-2 * shuffle_partitions(rows.sparkSession) // stripes))))
    deal = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    left = rows.select("stripe", deal, F.lit(0).alias("kind"), F.col("nth").cast("long").alias("nth"), "blob")
    right = queries.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.col("last")))).select("stripe", F.pmod(F.col("nth"), F.lit(shards)).cast("int").alias("shard"), F.lit(1).alias("kind"), F.col("nth").cast("long").alias("nth"), "blob")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, blobs, own = None, [], None
        for batch in batches:
            for stripe, shard, kind, blob in zip(*(batch.column(c).to_pylist() for c in ("stripe", "shard", "kind", "blob"))):
                if key != (stripe, shard):
                    key, blobs, own = (stripe, shard), [], None
                if kind == 0:
                    blobs.append(pickle.loads(blob))
                    continue
                if own is None:
                    own, blobs = load(blobs), []
                yield answer(own, pickle.loads(blob))
        trim()

    both = left.unionByName(right).repartition(min(2 * stripes * shards, 1 << 16), "stripe", "shard")
    return both.sortWithinPartitions("stripe", "shard", "kind", "nth").mapInArrow(run, schema)


def narrow(x: np.ndarray) -> np.ndarray:
    """The integers in as few bytes each as hold them."""
    most = int(np.abs(x).max(initial=0))
    return x.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


def wide(x: np.ndarray, d: int, kind=np.int64) -> np.ndarray:
    out = np.zeros((len(x), d), kind)
    out[:, : min(d, x.shape[1])] = x[:, :d]
    return out


def best_per_row(row: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best of each row: greatest score, then smaller id. Equal triples count once each."""
    order = np.lexsort((ids, -scores, row))
    row, ids, scores = row[order], ids[order], scores[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], ids[keep], scores[keep]


def search(q_ids: np.ndarray, q: np.ndarray, bars: np.ndarray, stripe: list[tuple], k: int, basis: np.ndarray, lead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query's number, id, score of what may be the k best of each query; pairs multiplied out).

    bars: scores below which nothing counts. stripe: (ids, integers, rotated, lengths, residuals' lengths) of each block,
    longest first. Bounds are in floating point, with slack; scores are exact.
    """
    d, bar, work = q.shape[1], bars.copy(), 0
    whole = q.astype(np.float64)
    qr = whole @ basis if lead < d else whole
    q_all, q_rest = np.linalg.norm(whole, axis=1), np.linalg.norm(qr[:, lead:], axis=1)
    top = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    most_q = float(np.abs(q).max(initial=0))
    for ids, x, xr, lengths, rest in stripe:
        longest = lengths.max(initial=0)
        slack = 1e-9 * (1 + q_all * longest)
        live = np.flatnonzero(q_all * longest + slack >= bar)
        if not len(live):
            break  # later blocks are shorter still
        exact = most_q * float(np.abs(x).max(initial=0)) * max(1, d) < 2.0**53
        if lead < d:
            part = qr[live, :lead] @ xr[:, :lead].T
            part += np.outer(q_rest[live], rest)
            need = part >= (bar - slack)[live][:, None]
            few = 6 * np.count_nonzero(need) <= need.size
        if lead < d and few:
            r, c = np.nonzero(need)
            work += len(r)
            score = np.concatenate([np.zeros(0, np.int64), *(np.einsum("ij,ij->i", q[live[r[i : i + 65_536]]], x[c[i : i + 65_536]]) for i in range(0, len(r), 65_536))])
            near = score >= (bar - slack)[live[r]]
            r, c, score = r[near], c[near], score[near]
        else:
            work += len(live) * len(ids)
            scores = whole[live] @ x.astype(np.float64).T if exact else q[live] @ x.T
            r, c = np.nonzero(scores >= (bar - slack)[live][:, None])
            score = scores[r, c].astype(np.int64)
        other = ids[c] != q_ids[live[r]]
        found = (live[r[other]], ids[c[other]], score[other])
        top = best_per_row(*(np.concatenate(x) for x in zip(top, found)), k)
        last = np.flatnonzero(np.arange(len(top[0])) - np.searchsorted(top[0], top[0]) == k - 1)
        bar[top[0][last]] = np.maximum(bar[top[0][last]], top[2][last])
    return *top, work


def cheapest_lead(some: np.ndarray, basis: np.ndarray, k: int) -> int:
    """Coordinates of the partial product that cost least, by the sample: their share of the product and 6 times that of the pairs left."""
    d = some.shape[1]
    if len(some) < 4 * k or d < 8:
        return d
    xr = some @ basis
    q = xr[:64]
    scores = q @ xr.T
    scores[np.arange(len(q)), np.arange(len(q))] = -np.inf
    bar = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    best, cost = d, 0.9  # what a partial product must undercut
    for lead in range(4, d, max(4, d // 16)):
        rest = np.linalg.norm(xr[:, lead:], axis=1)
        share = (q[:, :lead] @ xr[:, :lead].T + np.outer(rest[: len(q)], rest) >= bar).mean()
        if lead / d + 6 * share < cost:
            best, cost = lead, lead / d + 6 * share
    return best


def top_inner(vectors: DataFrame, id_col: str, vector: str, is_query: Column, k: int = 10, sample: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score) by the integer vectors floor(SCALE * x)."""
    spark = vectors.sparkSession
    ship(spark)
    whole = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    rows = vectors.filter(F.col(id_col).isNotNull() & usable(vector)).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    count, asked, d = rows.agg(F.count("*"), F.count_if("q"), F.max(F.size("v"))).first()
    if not asked or not d:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # at most ``sample`` rows and BLOCK_VALUES numbers
    got = rows.orderBy(F.xxhash64("id"), "id").select("id", "v").limit(min(sample, max(1, BLOCK_VALUES // d))).collect()
    some, some_ids = np.zeros((len(got), d), np.int64), np.array([r.id for r in got])
    for i, r in enumerate(got):
        some[i, : len(r.v)] = r.v
    real = some.astype(np.float64)
    basis = np.linalg.eigh(real.T @ real)[1][:, ::-1].copy()
    lead = cheapest_lead(real, basis, k)
    stripes = max(1, -(-count // min(STRIPE_ROWS, max(ROW_BLOCK, 4 * BLOCK_VALUES // d))))
    query_blocks = -(-asked // QUERY_BLOCK)

    def row_block(t: pa.Table) -> dict:
        x = narrow(matrix(t.column("v"), np.int64))
        return {"longest": float(np.linalg.norm(x.astype(np.float64), axis=1).max()), "blob": pickle.dumps((t.column("id").to_numpy(), x))}

    order = [F.desc("length"), F.col("id")]
    sorted_rows = rows.select("id", "v", length.alias("length")).repartitionByRange(stripes, *order).sortWithinPartitions(*order)
    kept = stored(blocks(sorted_rows, min(ROW_BLOCK, max(1, BLOCK_VALUES // d)), row_block, "longest double, blob binary").withColumnRenamed("part", "stripe"))
    # one number a stripe
    longest = np.zeros(stripes)
    for r in kept.groupBy("stripe").agg(F.max("longest").alias("longest")).toLocalIterator():
        longest[r.stripe] = r.longest
    longest = np.maximum.accumulate(longest[::-1])[::-1]

    def query_block(t: pa.Table) -> dict:
        ids, q = t.column("id").to_numpy(), wide(matrix(t.column("v"), np.int64), d)
        bars = np.full(len(q), NONE, np.float64)
        exact = float(np.abs(q).max(initial=0)) * float(np.abs(some).max(initial=0)) * d < 2.0**53
        if len(some) > k and exact:
            scores = q.astype(np.float64) @ some.T
            scores[ids[:, None] == some_ids] = NONE
            bars = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
        reach = np.linalg.norm(q.astype(np.float64), axis=1)
        ends = [int(np.flatnonzero(n * longest * (1 + 1e-9) + 1e-6 >= b).max(initial=0)) for n, b in zip(reach, bars)]
        return {"last": max(ends), "blob": pickle.dumps((ids, narrow(q), bars))}

    asked_rows = rows.filter("q").select("id", "v").repartition(query_blocks, "id")
    queries = blocks(asked_rows, QUERY_BLOCK, query_block, "last int, blob binary").withColumn("nth", F.col("part") + F.col("nth") * query_blocks)

    def load(held: list) -> list[tuple]:
        out = []
        for ids, x in held:
            x = wide(x, d)
            xr = x.astype(np.float64) @ basis if lead < d else x
            out.append((ids, x, xr, np.linalg.norm(x.astype(np.float64), axis=1), np.linalg.norm(xr[:, lead:], axis=1)))
        return out

    def answer(stripe: list[tuple], block: tuple) -> pa.RecordBatch:
        ids, q, bars = block
        row, found, score, _ = search(ids, wide(q, d), bars, stripe, k, basis, lead)
        return pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(found), pa.array(score)], ["query_id", "vec_id", "score"])

    each = meet(kept, queries, stripes, query_blocks, load, answer, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
