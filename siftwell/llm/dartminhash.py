"""Near-duplicate classes by DartMinHash signatures and a banded join.

A text's elements are its pairs of successive words, weighted by how often they occur. For each element and each dyadic
stretch of weight ([0,1), [1,2), [2,4), ...) darts fall at ranks that form a Poisson process, all of it a function of
hashes; a dart within the element's weight hits. Of the darts that hit, each of the signature's coordinates keeps the
one of lowest rank; two texts agree in a coordinate with the probability of their weighted Jaccard similarity. Ranks
are searched up to a limit in inverse proportion to the total weight, which is raised for texts that leave a coordinate
empty, so work follows the number of elements, not that of coordinates times elements.

Texts are linked if a band (some successive coordinates) is equal and at least ``threshold`` of all coordinates are.
All pairs of a band's bucket are compared; a pair counts in the first band that it shares, so once. Of buckets with the
same members only that of the first band is compared, which has all of their pairs. A bucket of more than ``block``
members is split by a hash into parts of about that size, each pair of which is a block of its own. Blocks give a row a
member, the number of its links and one member that it is connected with, so pairs are never stored. Texts of equal
signatures are one node throughout. Classes are the connected components.

Cases: texts without a word (null, empty, marks alone) have no signature; each is a class of its own with 0 links, as are
texts of a single word unless that is equal. Ties between documents go to the smaller doc_id (null first), then to the
row that was read first. Repeated rows are separate members of a class. Very long texts are taken whole. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.buffers import M1, M2, M3, mix, padded, portions, ragged, runs_of, slice_hash, words64
from siftwell.session import cut, ship, spread, stored

COORDINATES, ROWS, THRESHOLD = 125, 5, 0.55
CHUNK, TEXTS = 1_000_000, 1 << 16  # of bytes and texts at once
BLOCK, PAIRS = 2048, 1 << 15  # members of a part of a bucket, pairs compared at once
S16, S48 = np.uint64(16), np.uint64(48)


def _folded() -> np.ndarray:
    """Bytes of words, letters in lower case; 0 for what separates them."""
    t = np.zeros(256, np.uint8)
    for b in (*range(48, 58), *range(97, 123)):
        t[b] = b
    for b in range(65, 91):
        t[b] = b + 32
    t[128:] = np.arange(128, 256)
    return t


FOLD = _folded()


def elements(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, element hash, weight) of every distinct element of every text, in order of text; up to TEXTS texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data = FOLD[data]
    word = data != 0
    first = np.zeros(len(data), bool)
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(word & (first | ~np.concatenate(([False], word[:-1]))))
    last = np.zeros(len(data), bool)
    last[offsets[1:][np.diff(offsets) > 0] - 1] = True
    ends = np.flatnonzero(word & (last | ~np.concatenate((word[1:], [False])))) + 1
    h = slice_hash(words64(padded(data)), starts, ends - starts)
    text = np.searchsorted(offsets, starts, "right") - 1
    pair = text[1:] == text[:-1]
    both = mix(h[:-1] * M1 ^ mix(h[1:] + M3))[pair]
    n = np.bincount(text, minlength=len(offsets) - 1)
    alone = n[text] == 1
    key = (np.concatenate((text[:-1][pair], text[alone])).astype(np.uint64) << S48) | (np.concatenate((both, h[alone])) >> S16)
    key.sort()
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    key, weight = key[at], np.diff(at, append=len(key))
    return (key >> S48).astype(np.int64), mix(key << S16), weight


def uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def darts(text: np.ndarray, h: np.ndarray, weight: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, rank, dart hash) of the darts that hit, of rank up to limit[text]."""
    found, level = [], 0
    at = np.arange(len(h))
    while len(at):
        low, width = (0.0, 1.0) if level == 0 else (2.0 ** (level - 1), 2.0 ** (level - 1))
        at = at[weight[at] > low]
        row, rank, nth = at, np.zeros(len(at)), 0
        while len(row):
            dart = mix(h[row] ^ np.uint64(((level << 32) + nth + 1) * int(M2) % (1 << 64)))
            rank = rank - np.log(uniform(dart)) / width
            near = rank <= limit[text[row]]
            row, rank, dart = row[near], rank[near], dart[near]
            hit = low + width * uniform(mix(dart ^ M1)) <= weight[row]
            found.append((text[row[hit]], rank[hit], mix(dart + M3)[hit]))
            nth += 1
        level += 1
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint64))


def signatures(data: np.ndarray, offsets: np.ndarray, t: int = COORDINATES) -> tuple[np.ndarray, np.ndarray]:
    """(int32 signatures by text, whether a text has one)."""
    n = len(offsets) - 1
    text, h, weight = elements(data, offsets)
    total = np.bincount(text, weights=weight, minlength=n)
    has = total > 0
    out = np.zeros((n, t), np.int32)
    todo, more = np.flatnonzero(has), 1.0
    while len(todo):
        new = np.full(n, -1, np.int64)
        new[todo] = np.arange(len(todo))
        own = new[text] >= 0
        who, rank, dart = darts(new[text[own]], h[own], weight[own], more * (np.log(t) + 2) * t / total[todo])
        coordinate = (dart % np.uint64(t)).astype(np.int64)
        cell = who * t + coordinate
        least = np.full(len(todo) * t, np.inf)
        np.minimum.at(least, cell, rank)
        won = rank == least[cell]
        got = np.zeros(len(todo) * t, np.uint32)
        got[cell[won]] = (dart[won] >> np.uint64(32)).astype(np.uint32)
        whole = np.isfinite(least).reshape(-1, t).all(axis=1)
        out[todo[whole]] = got.reshape(-1, t)[whole].view(np.int32)
        todo, more = todo[~whole], more * 2
    return out, has


def signed(docs: DataFrame, t: int, rows: int) -> DataFrame:
    """(rid, doc_id, th, sig: int32 words, whole: hash of sig, bands), stored; sig is null without words."""
    ship(docs.sparkSession)
    bands = t // rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in portions(batches, CHUNK, TEXTS):
            sig, has = signatures(data, offsets, t)
            keys = np.zeros((batch.num_rows, bands), np.uint64)
            parts = sig.view(np.uint32).astype(np.uint64).reshape(-1, bands, rows)
            for k in range(rows):
                keys = mix(keys * M1 ^ parts[:, :, k])
            keys = mix(keys ^ np.arange(1, bands + 1, dtype=np.uint64) * M2)
            whole = np.zeros(batch.num_rows, np.uint64)
            for k in range(bands):
                whole = mix(whole * M3 ^ keys[:, k])
            blob = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * t), batch.num_rows, [None, pa.py_buffer(np.ascontiguousarray(sig))]).cast(pa.binary())
            none = pa.array(~has)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands * batch.num_rows + 1, bands, dtype=np.int32)), pa.array(keys.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), *(pc.if_else(none, None, x) for x in (blob, pa.array(whole.view(np.int64)), lists))], ["doc_id", "th", "sig", "whole", "bands"])

    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()
    rows_in = spread(docs.select("doc_id", "text")).select("doc_id", F.xxhash64("text").alias("th"), "text")
    out = rows_in.mapInArrow(run, f"doc_id {kind}, th long, sig binary, whole long, bands array<long>")
    return stored(out.withColumn("rid", F.monotonically_increasing_id()))


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id of each connected component of the edges (a, b).

    Labels fall to the least among neighbours and are then replaced by their own label, so that a chain's length is
    halved, until none changes. Each round's labels are cut off in the shared folder.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("label"))
    labels = cut(labels)
    while True:
        near = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, F.col("id") == F.col("a")).select("id", "label", F.least("label", "near").alias("low"))
        own = lower.select(F.col("id").alias("key"), F.col("low").alias("jump"))
        new = cut(lower.join(own, F.col("low") == F.col("key"), "left").select("id", F.col("label").alias("old"), F.least("low", F.coalesce("jump", "low")).alias("label")))
        labels = new.select("id", "label")
        if new.filter("old <> label").isEmpty():
            return labels


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Make ``label``, the least member of each one's set, that of the sets after a[i] and b[i] are connected."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, up := label[label]):
            label[:] = up


def compared(block: np.ndarray, first: np.ndarray, nth: np.ndarray, sig: np.ndarray, texts: np.ndarray, rows: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(least member connected with each member, links of each) in blocks of members that stand one after another.

    ``first`` is 0 in a block of one part, where all pairs count; else 1 for the members of the first part, which come
    first, and 2 for those of the second, and pairs of the two parts count. A link counts the partner's ``texts``.
    """
    n, bands = len(block), sig.shape[1] // rows
    starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    nr = np.repeat(np.arange(len(starts)), np.diff(starts, append=n))
    end = np.append(starts[1:], n)[nr]
    second = (starts + np.bincount(nr, first == 1, len(starts)).astype(np.int64))[nr]
    start = np.where(first == 0, np.arange(n) + 1, np.where(first == 1, second, end))
    count = end - start
    label, links = np.arange(n), np.zeros(n, np.int64)
    for i, j in runs_of(np.concatenate(([0], np.cumsum(count))), PAIRS):
        a, b = np.repeat(np.arange(i, j), count[i:j]), ragged(start[i:j], count[i:j])
        same = sig[a] == sig[b]
        near = same.mean(axis=1) >= threshold
        a, b, same = a[near], b[near], same[near]
        band = same[:, : bands * rows].reshape(-1, bands, rows).all(axis=2)
        once = band[np.arange(len(a)), nth[a]] & (band.argmax(axis=1) == nth[a])
        a, b = a[once], b[once]
        np.add.at(links, a, texts[b])
        np.add.at(links, b, texts[a])
        joined(label, a, b)
    return label, links


def links(nodes: DataFrame, t: int, rows: int, threshold: float, block: int = BLOCK) -> DataFrame:
    """(a, b, links) of nodes (node, texts, sig, bands) with links: these add up by a; the edges (a, b) connect classes."""
    member = nodes.select("node", F.posexplode("bands").alias("nth", "band"))
    bucket = member.groupBy("band", "nth").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y")).filter("size > 1")
    bucket = bucket.groupBy("size", "x", "y").agg(F.min(F.struct("nth", "band")).alias("b")).select("b.band", "b.nth", "size")
    parts = F.ceil(F.col("size") / block).cast("int")
    spots = cut(member.join(bucket, ["band", "nth"]).select("node", "nth", "band", parts.alias("parts"), F.pmod(F.xxhash64("band", "node"), parts).cast("int").alias("own")))
    wide = spots.join(nodes.select("node", "texts", "sig"), "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    first = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    wide = wide.select("node", "texts", "sig", "nth", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), first.alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judged(got: pa.Table) -> pa.RecordBatch:
            node, texts, nth, side, *key = (got[c].to_numpy() for c in ("node", "texts", "nth", "first", "band", "i", "j"))
            new = np.concatenate(([False], np.logical_or.reduce([k[1:] != k[:-1] for k in key])))
            sig = np.frombuffer(b"".join(got["sig"].to_pylist()), np.int32).reshape(-1, t)
            label, n = compared(np.cumsum(new), side, nth, sig, texts, rows, threshold)
            has = n > 0
            return pa.RecordBatch.from_arrays([pa.array(x[has]) for x in (node, node[label], n)], ["a", "b", "links"])

        left = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # the last block may go on in the next batch
            last = np.logical_and.reduce([(k := batch.column(c).to_numpy()) == k[-1] for c in ("band", "i", "j")])
            if left and last.all() and all(left[-1].column(c)[-1] == batch.column(c)[0] for c in ("band", "i", "j")):
                left.append(batch)
                continue
            at = int(np.argmax(last))
            whole = pa.Table.from_batches([*left, batch.slice(0, at)])
            if whole.num_rows:
                yield judged(whole)
            left = [batch.slice(at)]
        if left:
            yield judged(pa.Table.from_batches(left))

    return wide.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "first").mapInArrow(run, "a long, b long, links long")


def classes(docs: DataFrame, t: int = COORDINATES, rows: int = ROWS, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(rid, doc_id, th, class_id, n_links, keep): th is xxhash64 of the text, keep marks a class's first row.

    class_id is the smallest doc_id of the class. n_links counts the other texts that the document's text is linked to,
    those of equal signature among them, and one more if other rows have the same text.
    """
    signs = signed(docs, t, rows)
    alike = cut(signs.filter("whole is not null").groupBy("whole", "th").agg(F.min("rid").alias("node"), F.count("*").alias("copies")))
    same = cut(alike.groupBy("whole").agg(F.min("node").alias("node"), F.count("*").alias("texts")))
    nodes = signs.select(F.col("rid").alias("node"), "sig", "bands").join(same.select("node", "texts"), "node")
    edges = cut(links(nodes, t, rows, threshold, block))
    label = components(edges)
    degree = edges.groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    node = same.join(label.join(degree, "id"), F.col("node") == F.col("id"), "left").select("whole", F.coalesce("label", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("texts") - 1).alias("links"))
    node = alike.select("whole", "th", "copies").join(node, "whole").select("whole", "th", "component", (F.col("links") + F.when(F.col("copies") > 1, 1).otherwise(0)).cast("long").alias("n_links"))
    rows_out = signs.select("rid", "doc_id", "th", "whole").join(node, ["whole", "th"], "left").select("rid", "doc_id", "th", F.coalesce("component", "rid").alias("component"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    rows_out = cut(rows_out)
    first = rows_out.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("o"), F.col("doc_id").alias("d"), F.col("rid").alias("r"))).alias("first"), F.min("doc_id").alias("class_id"))
    return rows_out.join(first, "component").select("rid", "doc_id", "th", "class_id", "n_links", (F.col("rid") == F.col("first.r")).alias("keep"))


def first_of_each(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` with one document of each class left: that of the smallest doc_id. Columns and other rows as they are.

    Of rows that repeat doc_id and text one stays. Rows travel in one struct, so no column name can clash.
    """
    judged = classes(docs, **parameters)
    kept = judged.filter("keep").select("doc_id", "th")
    gone = cut(judged.filter("not keep").select("doc_id", "th").subtract(kept))
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs["doc_id"].alias("id"), F.xxhash64(docs["text"]).alias("th"))
    out = rows.join(gone.toDF("gone_id", "gone_th"), F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("th") == F.col("gone_th")), "left_anti")
    # rows repeated with the same doc_id and text: one of them stays
    twice = judged.groupBy("doc_id", "th").agg(F.count("*").alias("n"), F.max("keep").alias("k")).filter("n > 1 and k")
    twice = cut(twice.select(F.col("doc_id").alias("twice_id"), F.col("th").alias("twice_th"), F.lit(True).alias("is")))
    if not twice.isEmpty():
        marked = out.join(twice, F.col("id").eqNullSafe(F.col("twice_id")) & (F.col("th") == F.col("twice_th")), "left")
        out = marked.filter("is is null").select("row", "id", "th").unionByName(marked.filter("is").select("row", "id", "th").dropDuplicates(["id", "th"]))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
