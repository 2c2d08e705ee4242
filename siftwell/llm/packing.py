"""Related-document packing.

Documents are encoded once and stored with a few minimum hashes of their word pairs. Rows that agree in a hash are linked
along the input's order, an edge's weight being the number of hashes in common; this is the neighbour graph of all rows.
In each connected piece of it a greedy walk starts at the unvisited row of lowest degree and goes on to the unvisited
neighbour of largest weight (then lower degree, then input order) until none is left; then it starts anew. Laid one
after another the paths are one stream of tokens, which windows of ``window`` tokens cut. So each window holds documents
of one path for as long as it lasts, and only the last one has padding (to the next power of two).

Pieces are found from each hash's rows and the least of them, and spread over blocks of about ``block_rows`` rows. Rows
of an equal hash are always in one piece, so a block has all links of its rows, and no link depends on the number of
blocks. A walk is sequential: a piece is walked in one task however large it is, from 48 bytes a row and 4 a neighbour
besides what sorting takes. Offsets come from one total per block, so nothing else leaves a block.

Cases: null text counts as empty and gives the end token alone; repeated documents and repeated or null doc_id stay
separate rows; very long texts are encoded whole and cut by the windows; an empty table gives no pieces. Only doc_id and
text are read, so no name can clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.bpe import encoder
from siftwell.llm.buffers import M1, M2, minima, mix, portions
from siftwell.llm.dartminhash import components
from siftwell.session import cut, ship, spread, stored

SKETCHES = 4
SEEDS = [int(x) for x in mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * M1)]
EMPTY = np.iinfo(np.int64).max


def sketch(ids: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Minimum hashes of the pairs of successive ids of each text."""
    x = ids.astype(np.uint64)
    nxt = np.append(x[1:], np.uint64(0))
    ends = bounds[1:][np.diff(bounds) > 0] - 1
    nxt[ends] = np.uint64(1 << 40)  # a last id has no next
    h = mix(x * M1 ^ nxt * M2)
    return [minima((((h ^ np.uint64(s)) * M2) >> np.uint64(1)).astype(np.int64), bounds, EMPTY) for s in SEEDS]


def encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(rid, doc_id, ids: 16- or 32-bit words, n, s0, s1, ...), stored."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer)
        word = np.uint16 if max(len(bpe.n_bytes), end_id + 1) <= 1 << 16 else np.uint32
        for batch, data, offsets in portions(batches):
            ids, counts = bpe.encode(data, offsets)
            bounds = np.concatenate(([0], np.cumsum(counts)))
            sketches = sketch(ids, bounds)
            full = np.insert(ids, bounds[1:], end_id).astype(word)
            ends = (bounds + np.arange(len(bounds))) * word().itemsize
            if ends[-1] < 1 << 31:
                blob = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(full)])
            else:
                blob = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(full)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), blob, pa.array(counts + 1), *map(pa.array, sketches)], ["doc_id", "ids", "n", *(f"s{i}" for i in range(SKETCHES))])

    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()
    out = spread(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, ids binary, n long, " + ", ".join(f"s{i} long" for i in range(SKETCHES)))
    return stored(out.withColumn("rid", F.monotonically_increasing_id()))


def walk(sketches: np.ndarray) -> np.ndarray:
    """Rows in the order of the greedy low-degree-first paths."""
    n = len(sketches)
    a, b = [], []
    for s in sketches.T:
        order = np.argsort(s, kind="stable")
        same = (s[order[1:]] == s[order[:-1]]) & (s[order[1:]] != EMPTY)
        a.append(order[:-1][same])
        b.append(order[1:][same])
    a, b = np.concatenate(a), np.concatenate(b)
    pairs = np.unique(np.minimum(a, b) * n + np.maximum(a, b)) if len(a) else np.zeros(0, np.int64)
    a, b = pairs // max(n, 1), pairs % max(n, 1)
    weight = (sketches[a] == sketches[b]).sum(axis=1)
    src, dst, w = np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((weight, weight))
    degree = np.bincount(src, minlength=n)
    order = np.lexsort((dst, degree[dst], -w, src))
    dst = memoryview(dst[order].astype(np.int32))  # 4 bytes a neighbour, where a list takes 40
    first = memoryview(np.concatenate(([0], np.cumsum(degree))))
    out, seen = [], bytearray(n)
    for start in np.argsort(degree, kind="stable").tolist():
        at = start
        while at is not None and not seen[at]:
            seen[at] = 1
            out.append(at)
            at = next((d for d in dst[first[at] : first[at + 1]] if not seen[d]), None)
    return np.array(out, np.int64)


def pieces(rows: DataFrame) -> DataFrame:
    """(id, label) of the rows (rid, s0, s1, ...) that agree with another in a hash: the least rid that links lead to."""
    hashes = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"s{i}").alias("s")) for i in range(SKETCHES)])
    keys = rows.select("rid", F.explode(hashes).alias("key")).select("rid", "key.i", "key.s").filter(F.col("s") != EMPTY)
    least = keys.groupBy("i", "s").agg(F.min("rid").alias("least"), F.count("*").alias("size")).filter("size > 1").select("i", "s", "least")
    return components(keys.join(least, ["i", "s"]).filter("rid <> least").select(F.col("rid").alias("a"), F.col("least").alias("b")))


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, block_rows: int = 20_000) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece."""
    spark = docs.sparkSession
    t = encoded(docs, tokenizer, end_id)
    names = [f"s{i}" for i in range(SKETCHES)]
    rows = t.select("rid", "n", *names)
    blocks = max(1, -(-rows.count() // block_rows))

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        batches = [b for b in batches if b.num_rows]
        if batches:
            got = pa.Table.from_batches(batches)
            got = got.take(pa.array(walk(np.column_stack([got[c].to_numpy() for c in names]))))
            n = got["n"].to_numpy()
            block = np.full(len(n), TaskContext.get().partitionId(), np.int32)
            yield pa.RecordBatch.from_arrays([got["rid"].combine_chunks(), pa.array(block), pa.array(np.cumsum(n) - n), pa.array(n)], ["rid", "block", "at", "n"])

    label = pieces(rows)
    rows = rows.join(label, F.col("rid") == F.col("id"), "left").select("rid", "n", *names, F.coalesce("label", "rid").alias("piece"))
    laid = rows.repartition(blocks, "piece").drop("piece").sortWithinPartitions("rid").mapInArrow(order, "rid long, block int, at long, n long")
    laid = cut(laid)
    # one row per block, of which there are rows / block_rows
    bases, total = {}, 0
    for r in laid.groupBy("block").agg(F.sum("n").alias("n")).orderBy("block").toLocalIterator():
        bases[r.block] = total
        total += r.n
    base = spark.createDataFrame(list(bases.items()) or [(0, 0)], "block int, base long")
    laid = laid.join(base, "block").select("rid", (F.col("base") + F.col("at")).alias("at"))
    wide = t.select("rid", "doc_id", "ids", "n").join(laid, "rid")

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = (batch.column(c).to_numpy() for c in ("at", "n"))
            pieces = (at + n - 1) // window - at // window + 1
            row = np.repeat(np.arange(len(n)), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            seq = at[row] // window + nth
            start = np.maximum(at[row], seq * window) - at[row]
            length = np.minimum(at[row] + n[row], (seq + 1) * window) - at[row] - start
            crc = np.empty(len(row), np.int64)
            blobs, k, last = batch.column("ids"), 0, -1
            for r, s, m in zip(row.tolist(), start.tolist(), length.tolist()):
                if r != last:
                    blob, last = blobs[r].as_buffer(), r
                    own = np.frombuffer(blob, np.uint16 if len(blob) == 2 * n[r] else np.uint32).astype("<u4")
                crc[k] = zlib.crc32(own[s : s + m])
                k += 1
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), *(pa.array(x) for x in (start, length, crc, n[row], seq, at[row] + start - seq * window))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    kind = t.schema["doc_id"].dataType.simpleString()
    return wide.mapInArrow(cuts, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
