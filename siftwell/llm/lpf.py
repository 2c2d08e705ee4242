"""Deduplication of repeated stretches by longest-previous-factor arrays.

Of every string of ``width`` bytes that also starts in a document of smaller doc_id, all bytes are removed; strings are
judged on the input. In suffix order, the nearest positions before and after with a smaller doc_id are those earlier
documents' suffixes that share most with a suffix: the longest previous factor is the greater of the two least common
prefixes on the way there. A string goes if its factor has ``width`` bytes; the first copy has none, so it stays.

No suffix array of the whole corpus is built. Each string belongs to its minimizer, the ``K``-byte piece of least hash
in it, and equal strings have equal minimizers, so the suffixes of one minimizer at a time are ordered (to a depth of
``width``) and their factors found:

1. Each bucket of documents gives its distinct minimizers as 6-byte hashes; parts by hash tell which ones occur in
   several documents, as one bit each, which go back to the buckets.
2. For those only, the stretch of text over which a minimizer lasts goes to the part, each distinct one of a bucket
   once, with its smallest doc_id. There, equal stretches are merged, and where a minimizer has several, the factors of
   all their suffixes are found. One bit a string goes back, or one a stretch whose strings agree.
3. Each bucket marks the strings that have an earlier copy, there or in the bucket itself.

Hot passages are one row a bucket however many documents hold them; buckets and parts have a bounded size, their
number growing with the input. Steps use one shuffle of the texts, which the plan reuses.

Cases: null text counts as empty; null doc_id neither removes nor is removed; rows of equal doc_id don't remove from
each other; texts shorter than ``width`` stay; very long texts are scanned in overlapping stretches. An empty table
gives no rows. ``removal_report`` reads doc_id and text alone; ``without_repeats`` carries the other columns in one
struct, so no name can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.buffers import M1, M2, M3, mix, padded, ragged, runs_of, slice_hash, sums, text_bytes, trim, words64
from siftwell.session import ship, shuffle_partitions, size_in_bytes

K, BUCKET_BYTES, TASK_BYTES, CHUNK, STRINGS = 20, 2_000_000, 32_000_000, 250_000, 200_000
NEVER = np.iinfo(np.int64).max
LOW48, LOW20 = np.uint64((1 << 48) - 1), np.uint64((1 << 20) - 1)


def previous_smaller(values: np.ndarray, lcp: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(nearest position before with a smaller value, or -1; least of ``lcp`` on the way) of each position.

    lcp[i] belongs to positions i - 1 and i. Where the least falls under ``least``, the search ends there and it is 0.
    """
    n = len(values)
    at, low = np.arange(n) - 1, lcp.copy()
    low[:1] = 0
    live = np.flatnonzero(low >= least)
    low[low < least] = 0
    live = live[values[at[live]] >= values[live]]
    for _ in range(64):
        # between a position and its pointer all values are at least as great, so pointers can be followed
        j = at[live]
        low[live], at[live] = np.minimum(low[live], low[j]), at[j]
        live = live[low[live] >= least]
        live = live[values[at[live]] >= values[live]]
        if not len(live):
            break
    else:
        _by_stack(values, lcp, least, at, low)
    at[low < least], low[low < least] = -1, 0
    return at, low


def _by_stack(values: np.ndarray, lcp: np.ndarray, least: int, at: np.ndarray, low: np.ndarray) -> None:
    """The same in one pass, for values whose pointers form long chains."""
    stack: list[tuple[int, int, int]] = []
    for i, (v, shared) in enumerate(zip(values.tolist(), lcp.tolist())):
        if shared < least:
            stack.clear()
        while stack and stack[-1][1] >= v:
            shared = min(shared, stack.pop()[2])
        at[i], low[i] = (stack[-1][0], shared) if stack and shared >= least else (-1, 0)
        stack.append((i, v, shared))


def longest_previous_factors(values: np.ndarray, lcp: np.ndarray, least: int = 1) -> np.ndarray:
    """What each suffix shares with those of smaller value, at most; suffixes are in order, lcp[i] being that of i - 1 and i."""
    _, before = previous_smaller(values, lcp, least)
    _, after = previous_smaller(values[::-1], np.append(lcp[1:], 0)[::-1], least)
    return np.maximum(before, after[::-1])


def common_prefixes(words: list[np.ndarray], width: int) -> np.ndarray:
    """Bytes that each string shares with the one before it; words: big-endian, 8 bytes each, the last ending at ``width``."""
    n = len(words[0])
    lcp = np.zeros(n, np.int64)
    live = np.arange(1, n)
    for k, word in enumerate(words):
        first = min(8 * k, width - 8)
        x = word[live] ^ word[live - 1]
        end = np.flatnonzero(x != 0)
        zeros = np.zeros(len(end), np.int64)
        for t in range(1, 8):
            zeros += x[end] < np.uint64(1) << np.uint64(8 * t)
        lcp[live[end]] = first + zeros
        live = live[x == 0]
    lcp[live] = width
    return lcp


def stretches(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first string's start, number of strings, hash of the minimizer) of every run of strings with one minimizer."""
    span = width - K + 1
    out: list[tuple] = []
    for i, j in runs_of(offsets, CHUNK):
        lo, hi = int(offsets[i]), int(offsets[j])
        step = CHUNK - width + 1 if hi - lo > CHUNK else hi - lo
        for at in range(lo, max(lo + 1, hi - width + 1), max(1, step)):
            end = min(hi, at + step + width - 1)
            n = end - at
            if n < width:
                continue
            w = words64(padded(data[at:end]))
            h = (w[: n - K + 1] * M1) ^ (w[8 : n - K + 9] * M2)
            h = (h ^ (h >> np.uint64(29))) + (w[K - 8 : n - 7] * M3)
            h = (h ^ (h >> np.uint64(32))) * M1
            h = (h & ~LOW20) | np.arange(len(h), dtype=np.uint64)  # 44 bits of hash, then the position
            least, size = h, 1
            while size < span:
                more = min(size, span - size)
                least = np.minimum(least[: len(least) - more], least[more:])
                size += more
            n = len(least)
            # strings that lie in one text: the next boundary isn't within them
            cuts = offsets[i : j + 1] - at
            cuts = cuts[(cuts > 0) & (cuts < end - at)]
            ok = np.ones(n, bool)
            if len(cuts):
                bad = np.zeros(n + 1, np.int32)
                np.add.at(bad, np.clip(cuts - width + 1, 0, n), 1)
                np.add.at(bad, np.clip(cuts, 0, n), -1)
                ok = np.cumsum(bad[:-1]) == 0
            new = np.ones(n, bool)
            new[1:] = (least[1:] != least[:-1]) | (ok[1:] & ~ok[:-1])
            edge = np.ones(n, bool)
            edge[1:] = new[1:] | (ok[1:] != ok[:-1])
            first = np.flatnonzero(edge)
            count = np.diff(first, append=n)
            keep = ok[first]
            first, count = first[keep], count[keep]
            anchor = (least[first] & LOW20).astype(np.int64)
            hashed = mix(w[anchor] ^ mix(w[anchor + 8] + M1) ^ mix(w[anchor + K - 8] * M2 + M3))
            out.append((np.searchsorted(offsets, first + at, "right") - 1, first + at, count, hashed))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


def repeated(minimizer: np.ndarray, stretch: np.ndarray, bounds: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(whether each string also starts in a document before ``doc``, bounds of each stretch's strings); stretches are ragged bytes.

    Equal stretches are merged. Strings of a minimizer that has several are put in suffix order to a depth of ``width``.
    """
    n = np.diff(bounds)
    strings = n - width + 1
    string_bounds = np.concatenate(([0], np.cumsum(strings)))
    if not len(n):
        return np.zeros(0, bool), string_bounds
    w = words64(padded(stretch))
    content = slice_hash(w, bounds[:-1], n)
    order = np.lexsort((content, minimizer))
    m, c = minimizer[order], content[order]
    new_m = np.concatenate(([True], m[1:] != m[:-1]))
    new = new_m | np.concatenate(([True], c[1:] != c[:-1]))
    lead = np.flatnonzero(new)
    group = np.empty(len(n), np.int64)
    group[order] = np.cumsum(new) - 1
    own = np.minimum.reduceat(doc[order], lead)[group]
    out = np.repeat(doc > own, strings)
    # minimizers with several different stretches
    family = np.cumsum(new_m) - 1
    several = np.bincount(family[lead]) > 1
    rep = order[lead][several[family[lead]]]
    if len(rep):
        # back to every stretch through its representative
        found = np.zeros(int(strings[rep].sum()), bool)
        ends = np.cumsum(strings[rep])
        # whole minimizers at a time, of some hundred thousand strings together unless one has more
        last = np.flatnonzero(np.append(minimizer[rep[1:]] != minimizer[rep[:-1]], True))
        for i, j in runs_of(np.concatenate(([0], ends[last])), STRINGS):
            lo, hi = (last[i - 1] + 1 if i else 0), last[j - 1] + 1
            own_strings = slice(int(ends[lo] - strings[rep[lo]]), int(ends[hi - 1]))
            found[own_strings] = _earlier(minimizer, w, bounds, strings, own, rep[lo:hi], width)
        place = np.full(len(lead), -1, np.int64)
        place[group[rep]] = ends - strings[rep]
        these = np.flatnonzero(place[group] >= 0)
        out[ragged(string_bounds[:-1][these], strings[these])] |= found[ragged(place[group[these]], strings[these])]
    return out, string_bounds


def _earlier(minimizer: np.ndarray, w: np.ndarray, bounds: np.ndarray, strings: np.ndarray, doc: np.ndarray, rep: np.ndarray, width: int) -> np.ndarray:
    """Whether each string of the stretches ``rep`` has an earlier copy among them, of the same minimizer: by suffix order and factors."""
    at = ragged(bounds[:-1][rep], strings[rep])
    which = np.repeat(rep, strings[rep])
    words = [w[at + min(d, width - 8)].byteswap() for d in range(0, width, 8)]
    suffixes = np.lexsort((*words[::-1], minimizer[which]))
    which = which[suffixes]
    lcp = common_prefixes([x[suffixes] for x in words], width)
    lcp[1:][minimizer[which[1:]] != minimizer[which[:-1]]] = 0
    found = np.empty(len(at), bool)
    found[suffixes] = longest_previous_factors(doc[which], lcp, width) >= width
    return found


def _ids(table: pa.Table) -> np.ndarray:
    return np.asarray(table.column("doc_id").cast(pa.int64()).fill_null(NEVER).combine_chunks().to_numpy(zero_copy_only=False)).astype(np.int64)


class Bucket:
    """A bucket's texts and runs; order and numbering are the same in each step."""

    def __init__(self, table: pa.Table, width: int, parts: int):
        self.table = table.take(pa.array(np.lexsort((table.column("th").to_numpy(), _ids(table)))))
        self.ids = _ids(self.table)
        self.data, self.offsets = text_bytes(self.table.column("text"))
        self.text, self.start, self.count, self.hash = stretches(self.data, self.offsets, width)
        known = self.ids[self.text] != NEVER
        self.text, self.start, self.count, self.hash = (x[known] for x in (self.text, self.start, self.count, self.hash))
        self.width, self.parts = width, parts

    def minimizers(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(48-bit hashes, whether in several documents here, part), ordered by part and hash."""
        short = self.hash & LOW48
        part = (short % np.uint64(self.parts)).astype(np.int64)
        doc = self.ids[self.text]
        order = np.lexsort((short, part))
        s, d = short[order], doc[order]
        lead = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
        if not len(lead):
            return s, np.zeros(0, bool), part
        return s[lead], np.minimum.reduceat(d, lead) != np.maximum.reduceat(d, lead), part[order][lead]

    def shared(self, answers: dict[int, bytes]) -> np.ndarray:
        """Which runs' minimizers occur in several documents."""
        s, _, part = self.minimizers()
        bit = np.zeros(len(s), bool)
        for p, blob in answers.items():
            lo, hi = np.searchsorted(part, (p, p + 1))
            bit[lo:hi] = np.unpackbits(np.frombuffer(blob, np.uint8), count=hi - lo)
        few = np.sort(s[bit])
        at = np.minimum(np.searchsorted(few, self.hash & LOW48), max(0, len(few) - 1))
        return few[at] == (self.hash & LOW48) if len(few) else np.zeros(len(self.hash), bool)

    def requests(self, shared: np.ndarray) -> tuple[np.ndarray, ...]:
        """(distinct stretch of each shared run, and of the distinct ones, in order of part: run, part, smallest doc)."""
        run = np.flatnonzero(shared)
        length = self.count[run] + self.width - 1
        content = slice_hash(words64(padded(self.data)), self.start[run], length)
        part = ((self.hash[run] & LOW48) % np.uint64(self.parts)).astype(np.int64)
        order = np.lexsort((content, self.hash[run], part))
        h, c = self.hash[run][order], content[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1]))) if len(run) else np.zeros(0, bool)
        lead = np.flatnonzero(new)
        group = np.empty(len(run), np.int64)
        group[order] = np.cumsum(new) - 1
        low = np.minimum.reduceat(self.ids[self.text[run]][order], lead) if len(lead) else np.zeros(0, np.int64)
        return run, group, run[order[lead]], part[order[lead]], low


def _blobs(parts: np.ndarray, pieces) -> Iterator[tuple[int, bytes]]:
    edges = np.flatnonzero(np.concatenate(([True], parts[1:] != parts[:-1]))) if len(parts) else np.zeros(0, np.int64)
    for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(parts)]):
        yield int(parts[lo]), pieces(lo, hi)


def _rows(bucket: int, found: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"part": pa.array([p for p, _ in found], pa.int32()), "b": pa.array([bucket] * len(found), pa.int32()), "blob": pa.array([x for _, x in found], pa.binary())})


def _six(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _answers(table: pa.Table) -> dict[int, bytes]:
    return dict(zip(table.column("part").to_pylist(), table.column("blob").to_pylist()))


def _by_bucket(b: pa.Table) -> int:
    return b.column("b")[0].as_py()


BLOBS = "part int, b int, blob binary"


def marked(docs: DataFrame, output, schema: str, width: int = 50) -> DataFrame:
    """``output(table, data, offsets, removed)`` of every bucket of documents, removed being a mask of its bytes."""
    if width < K + 8:
        raise ValueError(f"width must be at least {K + 8}")
    spark = docs.sparkSession
    ship(spark)
    size = size_in_bytes(docs)
    buckets = max(2 * shuffle_partitions(spark), -(-size // BUCKET_BYTES))
    parts = buckets
    tasks = max(shuffle_partitions(spark), -(-size // TASK_BYTES))  # a task's input stays the same however large the whole is
    texts = docs.withColumn("th", F.xxhash64("text")).withColumn("b", F.pmod(F.xxhash64(F.col("th"), F.col("doc_id")), F.lit(buckets)).cast("int")).repartition(tasks, "b")

    def ask(table: pa.Table) -> pa.Table:
        own = Bucket(table, width, parts)
        s, many, part = own.minimizers()

        def piece(lo: int, hi: int) -> bytes:
            return _six(s[lo:hi]) + np.packbits(many[lo:hi]).tobytes()

        return _rows(_by_bucket(table), list(_blobs(part, lambda lo, hi: (hi - lo).to_bytes(4, "little") + piece(lo, hi))))

    def tell(table: pa.Table) -> pa.Table:
        blobs = table.column("blob").to_pylist()
        n = [int.from_bytes(x[:4], "little") for x in blobs]
        hashes = np.concatenate([_from_six(x[4 : 4 + 6 * k]) for x, k in zip(blobs, n)])
        many = np.concatenate([np.unpackbits(np.frombuffer(x[4 + 6 * k :], np.uint8), count=k) for x, k in zip(blobs, n)]).astype(bool)
        ordered = np.sort(hashes)
        shared = np.unique(np.concatenate((ordered[1:][ordered[1:] == ordered[:-1]], hashes[many])))
        bits = np.zeros(len(hashes), bool)
        if len(shared):
            bits = shared[np.minimum(np.searchsorted(shared, hashes), len(shared) - 1)] == hashes
        bounds = np.cumsum([0, *n])
        return pa.table({"part": table.column("part"), "b": table.column("b"), "blob": pa.array([np.packbits(bits[i:j]).tobytes() for i, j in zip(bounds[:-1], bounds[1:])], pa.binary())})

    def send(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _rows(0, [])
        own = Bucket(table, width, parts)
        _, _, runs, part, low = own.requests(own.shared(_answers(answers)))
        length = own.count[runs] + width - 1

        def piece(lo: int, hi: int) -> bytes:
            body = own.data[ragged(own.start[runs[lo:hi]], length[lo:hi])]
            return (hi - lo).to_bytes(4, "little") + own.hash[runs[lo:hi]].tobytes() + low[lo:hi].tobytes() + length[lo:hi].astype(np.uint16).tobytes() + len(body).to_bytes(8, "little") + pa.compress(body, "zstd", asbytes=True)

        return _rows(_by_bucket(table), list(_blobs(part, piece)))

    def judge(table: pa.Table) -> pa.Table:
        minimizers, lows, lengths, bodies, n = [], [], [], [], []
        for x in table.column("blob").to_pylist():
            k = int.from_bytes(x[:4], "little")
            n.append(k)
            minimizers.append(np.frombuffer(x, np.uint64, k, 4))
            lows.append(np.frombuffer(x, np.int64, k, 4 + 8 * k))
            lengths.append(np.frombuffer(x, np.uint16, k, 4 + 16 * k).astype(np.int64))
            size = int.from_bytes(x[4 + 18 * k : 12 + 18 * k], "little")
            bodies.append(np.frombuffer(pa.decompress(x[12 + 18 * k :], size, "zstd", asbytes=True), np.uint8))
        length = np.concatenate(lengths)
        gone, bounds = repeated(np.concatenate(minimizers), np.concatenate(bodies), np.concatenate(([0], np.cumsum(length))), np.concatenate(lows), width)
        # one bit where all strings of a stretch agree
        strings, hits = np.diff(bounds), sums(gone, bounds)
        whole, mixed = hits == strings, (hits > 0) & (hits < strings)
        edges, out = np.cumsum([0, *n]), []
        for i, j in zip(edges[:-1], edges[1:]):
            own = np.flatnonzero(mixed[i:j]) + i
            out.append(b"".join(np.packbits(x).tobytes() for x in (whole[i:j], mixed[i:j], gone[ragged(bounds[:-1][own], strings[own])])))
        del bodies, gone
        trim()
        return pa.table({"part": table.column("part"), "b": table.column("b"), "blob": pa.array(out, pa.binary())})

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return empty
        bits = answers.filter(pa.array(np.asarray(answers.column("kind").to_pylist()) == 1)) if answers.num_rows else answers
        told = answers.filter(pa.array(np.asarray(answers.column("kind").to_pylist()) == 2)) if answers.num_rows else answers
        own = Bucket(table, width, parts)
        run, group, runs, part, lows = own.requests(own.shared(_answers(bits)))
        told, masks = _answers(told), []
        for p, (lo, hi) in _blobs(part, lambda lo, hi: (lo, hi)):
            size, blob = (hi - lo + 7) // 8, np.frombuffer(told[p], np.uint8)
            whole, mixed = (np.unpackbits(blob[k * size : (k + 1) * size], count=hi - lo).astype(bool) for k in (0, 1))
            count = own.count[runs[lo:hi]]
            mask = np.repeat(whole, count)
            mask[np.repeat(mixed, count)] = np.unpackbits(blob[2 * size :], count=int(count[mixed].sum()))
            masks.append(mask)
        mask = np.concatenate(masks) if masks else np.zeros(0, bool)
        bounds, count = np.concatenate(([0], np.cumsum(own.count[runs]))), own.count[run]
        # a copy of the whole stretch in the bucket itself counts as well
        earlier = mask[ragged(bounds[:-1][group], count)] | np.repeat(own.ids[own.text[run]] > lows[group], count)
        at = ragged(own.start[run], count)[earlier]
        begun = np.concatenate((np.zeros(width, np.int64), np.cumsum(np.bincount(at, minlength=len(own.data)))))
        removed = begun[width:] > begun[:-width]
        out = output(own.table, own.data, own.offsets, removed)
        del own, earlier, begun, removed
        trim()
        return out

    empty = _empty(schema, spark)
    asked = texts.groupBy("b").applyInArrow(ask, BLOBS)
    bits = asked.repartition(tasks, "part").groupBy("part").applyInArrow(tell, BLOBS)
    sent = texts.groupBy("b").cogroup(bits.repartition(tasks, "b").groupBy("b")).applyInArrow(send, BLOBS)
    lows = sent.repartition(tasks, "part").groupBy("part").applyInArrow(judge, BLOBS)
    both = bits.withColumn("kind", F.lit(1)).unionByName(lows.withColumn("kind", F.lit(2)))
    return texts.groupBy("b").cogroup(both.repartition(tasks, "b").groupBy("b")).applyInArrow(finish, schema)


def _empty(schema: str, spark) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema).empty_table()


def spans(removed: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes removed, maximal runs removed) of each text."""
    edge = removed.copy()
    first = np.zeros(len(removed) + 1, bool)
    first[offsets] = True
    edge[1:] &= ~removed[:-1] | first[1 : len(removed)]
    return sums(removed, offsets), sums(edge, offsets)


def removal_report(docs: DataFrame, width: int = 50) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""

    def output(table: pa.Table, data: np.ndarray, offsets: np.ndarray, removed: np.ndarray) -> pa.Table:
        n_removed, n_spans = spans(removed, offsets)
        digest = []
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            digest.append(hashlib.sha256(data[a:b][~removed[a:b]] if n_removed[i] else data[a:b]).hexdigest())
        return pa.table({"doc_id": table.column("doc_id"), "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(n_removed), "n_spans": pa.array(n_spans), "kept_sha256": pa.array(digest, pa.string())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return marked(docs.select("doc_id", "text"), output, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string", width)


def without_repeats(docs: DataFrame, width: int = 50) -> DataFrame:
    """``docs`` with repeated stretches cut out of text (whole characters only) and n_chars counted anew, if there.

    A document of which nothing is left goes. Other columns pass through, packed into one so that names can't clash.
    """
    names = docs.columns

    def output(table: pa.Table, data: np.ndarray, offsets: np.ndarray, removed: np.ndarray) -> pa.Table:
        # a character is kept whole if any byte of it is
        head = np.flatnonzero((data & 0xC0) != 0x80)
        if len(head):
            whole = np.logical_and.reduceat(removed, head)
            removed = np.repeat(whole, np.diff(head, append=len(data)))
        gone, _ = spans(removed, offsets)
        kept = [data[a:b][~removed[a:b]].tobytes().decode() if g else None for a, b, g in zip(offsets[:-1].tolist(), offsets[1:].tolist(), gone.tolist())]
        text = table.column("text")
        if gone.any():
            text = pc.if_else(pa.array(gone > 0), pa.array(kept, text.type), text)
        stays = pa.array((gone == 0) | (np.diff(offsets) > gone))
        return pa.table({"row": table.column("row"), "kept": text, "edited": pa.array(gone > 0)}).filter(stays)

    others = [c for c in names if c != "text"]
    packed = docs.select("doc_id", "text", F.struct(*[docs[f"`{c}`"] for c in others]).alias("row"))
    out = marked(packed, output, f"row {packed.schema['row'].dataType.simpleString()}, kept string, edited boolean", width)
    changed = {"text": F.col("kept")} | ({"n_chars": F.when(F.col("edited"), F.length("kept")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in names else {})
    return out.select(*[(changed[c] if c in changed else F.col("row").getField(c)).alias(c) for c in names])
