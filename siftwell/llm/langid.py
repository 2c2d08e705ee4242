"""Language identification by cross-parsing entropy.

A suffix automaton over labelled text of each language yields the longest match from any point of a new text. Cutting
the text greedily into such matches gives a number of phrases; a language's normalised count is that number times
log2 of its text's size, and the language with the smallest wins.

Texts are parsed whole, with no phrase end but those of greedy parsing. The parse is a walk through a table of states;
stretches of ``STRETCH`` bytes are walked in step, each from the root, and then again from the state in which the
stretch before it really ended, for as long as the two walks differ. They meet after a few phrases as a rule; stretches
that still differ after ``ROUNDS`` rounds (text of short period) are walked one after another.

Cases: null text, or text without a letter: ``und`` with score 0. Equal costs: the alphabetically first language.
No labelled rows: every text is ``und``. Rows are never merged, so repeated rows give repeated results. Very long texts
are parsed whole. An empty table gives no rows. Columns of docs come back in one struct, ``row``, so no name can clash.

Training takes whole texts: of each language's ``train_docs`` labelled rows of smallest hash among those of at most
``row_bytes`` bytes, as many as fit into ``train_bytes``. A language that has longer texts only is learnt from its
shortest ones, of which only the first ``train_bytes`` bytes are then read if none is shorter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.buffers import held, portions, sums
from siftwell.session import ship, spread

STRETCH, ROUNDS = 256, 3
FLAG = 1 << 30


def byte_classes() -> np.ndarray:
    """Letters without case, bytes of other characters each by itself, and one class for the rest."""
    c = np.ones(256, np.uint8)
    for b in range(26):
        c[65 + b] = c[97 + b] = 2 + b
    c[128:] = 28 + np.arange(128)
    return c


CLASSES = byte_classes()


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts every substring of ``text``; state 0 is the root."""
    moves, link, length, last = [{}], [-1], [0], 0
    for c in text:
        cur = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = cur
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return moves


class CrossParser:
    def __init__(self, texts: dict[str, bytes]):
        self.langs = sorted(texts)
        seen = sorted({c for t in texts.values() for c in set(CLASSES[np.frombuffer(t, np.uint8)].tolist())})
        self.width = len(seen) + 2  # 0: unused; 1: in no labelled text
        self.code = np.ones(256, np.int32)
        for i, c in enumerate(seen):
            self.code[CLASSES == c] = i + 2
        self.tables, self.weights = [], []
        for lang in self.langs:
            moves = suffix_automaton(bytes(self.code[np.frombuffer(texts[lang], np.uint8)].astype(np.uint8)))
            w = self.width
            # a letter that doesn't go on ends the phrase and begins the next one; one that the text lacks is a phrase by
            # itself, after which the last state begins anew whatever follows
            lone = len(moves)
            anew = np.full(w, FLAG | lone * w, np.int32)
            for c, s in moves[0].items():
                anew[c] = FLAG | s * w
            table = np.tile(anew, (lone + 1, 1))
            table[0] &= FLAG - 1
            table[:, 0] = np.arange(lone + 1) * w
            at = np.repeat(np.arange(len(moves)), [len(m) for m in moves])
            table[at, np.fromiter((c for m in moves for c in m), np.int32)] = np.fromiter((s * w for m in moves for s in m.values()), np.int32)
            self.tables.append(table.ravel())
            self.weights.append(math.log2(max(2, len(texts[lang]))))

    def costs(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of every text (rows) by every language."""
        n = np.diff(offsets)
        parts = (n + STRETCH - 1) // STRETCH
        bounds = np.concatenate(([0], np.cumsum(parts)))
        nth = np.arange(bounds[-1]) - np.repeat(bounds[:-1], parts)
        start = np.repeat(offsets[:-1], parts) + nth * STRETCH
        left = np.minimum(np.repeat(offsets[1:], parts) - start, STRETCH)
        order = np.argsort(-left, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        # the stretch before, the place of each stretch being that in ``order``; -1 for a text's first
        before = np.where(nth[order] > 0, place[np.maximum(order - 1, 0)], -1)
        start, left = start[order], left[order]
        live = np.searchsorted(-left, -np.arange(STRETCH), "left")  # stretches longer than j
        codes = self.code[data]
        steps = [codes[start[: live[j]] + j] for j in range(STRETCH) if live[j]]
        out = np.empty((len(n), len(self.langs)))
        for i, (table, weight) in enumerate(zip(self.tables, self.weights)):
            state = np.zeros(len(start), np.int32)
            count = (before < 0).astype(np.int64)
            walked = []
            for step in steps:
                k = len(step)
                v = table.take(state[:k] + step)
                walked.append(v)
                count[:k] += v >> 30
                state[:k] = v & (FLAG - 1)
            self._corrected(table, steps, live, before, state, count, walked)
            out[:, i] = sums(count[place], bounds) * weight
        return out

    @staticmethod
    def _corrected(table: np.ndarray, steps: list, live: np.ndarray, before: np.ndarray, state: np.ndarray, count: np.ndarray, walked: list) -> None:
        """Walk the stretches again that didn't begin in the state in which the one before them ended."""
        begun = np.zeros(len(state), np.int32)
        inner = np.flatnonzero(before >= 0)
        for _ in range(ROUNDS):
            at = inner[state[before[inner]] != begun[inner]]
            if not len(at):
                return
            begun[at] = s = state[before[at]]
            for j, step in enumerate(steps):
                k = int(np.searchsorted(at, live[j]))
                state[at[k:]] = s[k:]
                at, s = at[:k], s[:k]
                if not len(at):
                    break
                v, old = table.take(s + step[at]), walked[j][at]
                count[at] += (v >> 30) - (old >> 30)
                walked[j][at] = v
                differ = (v ^ old) & (FLAG - 1) != 0
                at, s = at[differ], v[differ] & (FLAG - 1)
            state[at] = s
        after = np.full(len(state), -1)
        after[before[inner]] = inner
        moves, lengths = memoryview(table), np.searchsorted(-live, -np.arange(len(state)), "left")
        for c in inner[state[before[inner]] != begun[inner]].tolist():
            while c >= 0 and int(state[before[c]]) != int(begun[c]):
                s = int(state[before[c]])
                begun[c] = s
                for j in range(int(lengths[c])):
                    v, old = moves[s + int(steps[j][c])], int(walked[j][c])
                    count[c] += (v >> 30) - (old >> 30)
                    walked[j][c] = v
                    s = v & (FLAG - 1)
                    if s == old & (FLAG - 1):
                        break
                else:
                    state[c] = s
                c = int(after[c])


def parser(texts: tuple[tuple[str, bytes], ...]) -> CrossParser:
    return held(("cross-parser", texts), lambda: CrossParser(dict(texts)))


def labelled_text(docs: DataFrame, usable, train_docs: int = 64, train_bytes: int = 48_000, row_bytes: int = 3_000) -> tuple[tuple[str, bytes], ...]:
    """The bounded training text of every language, from ``usable`` rows; which ones, the module's docstring says.

    Rows that repeat doc_id, lang and text count once. At most 1,024 languages are allowed; more is an error, as their
    automata wouldn't fit a worker.
    """
    rows = docs.filter(usable & F.col("text").isNotNull() & F.col("lang").isNotNull())
    size = F.octet_length("text").cast("long")
    keyed = rows.select("lang", F.when(size > row_bytes, size).otherwise(0).alias("over"), F.xxhash64("doc_id", "text").alias("h"), size.alias("n"))
    by = Window.partitionBy("lang").orderBy("over", "h")
    chosen = keyed.withColumn("nth", F.row_number().over(by)).filter(F.col("nth") <= train_docs).drop("nth").collect()
    if len({r.lang for r in chosen}) > 1024:
        raise ValueError("more than 1,024 languages")
    wanted: dict[str, list[int]] = {}
    taken: dict[str, int] = {}
    for r in sorted(set(chosen)):
        n = min(r.n, train_bytes) + 1
        if taken.get(r.lang, 0) + n <= train_bytes + 1:
            wanted.setdefault(r.lang, []).append(r.h)
            taken[r.lang] = taken.get(r.lang, 0) + n
    if not wanted:
        return ()
    hashed = rows.select("lang", F.xxhash64("doc_id", "text").alias("h"), F.left("text", F.lit(train_bytes)).alias("text"))
    got = hashed.filter(F.col("h").isin(sorted({h for hs in wanted.values() for h in hs}))).groupBy("lang", "h").agg(F.min("text").alias("text")).collect()
    text = {(r.lang, r.h): r.text.encode()[:train_bytes] + b"\n" for r in got}
    return tuple((lang, b"".join(text[lang, h] for h in hs)) for lang, hs in sorted(wanted.items()))


def predict(docs: DataFrame, texts: tuple[tuple[str, bytes], ...]) -> DataFrame:
    """(row: the columns of docs, lang_pred, score, bits: per byte, by the language predicted, but for the first phrase)."""
    ship(docs.sparkSession)
    packed = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = spread(docs).select(packed, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("has"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = parser(texts) if texts else None
        for batch, data, offsets in portions(batches, within="row"):
            lang, score, per_byte = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            has = batch.column("has").to_numpy(zero_copy_only=False).astype(bool)
            if model:
                bits = model.costs(data, offsets)
                best = bits.argmin(axis=1)
                lang = np.array(model.langs, object)[best]
                n = np.maximum(1, np.diff(offsets))
                gap = (bits - bits.min(axis=1, keepdims=True)) * (np.minimum(n, 32) / n)[:, None]
                score = 1 / np.exp2(-gap).sum(axis=1)
                per_byte = np.maximum(0, bits[np.arange(len(n)), best] - np.array(model.weights)[best]) / n
            lang[~has], score[~has], per_byte[~has] = "und", 0.0, 0.0
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(lang, pa.string()), pa.array(score), pa.array(per_byte)], ["row", "lang_pred", "score", "bits"])

    kind = rows.select("row").schema.simpleString()[len("struct<row:") : -1]
    return rows.mapInArrow(run, f"row {kind}, lang_pred string, score double, bits double")


def keep_identified(docs: DataFrame, most_bits: float = 8.0) -> DataFrame:
    """``docs`` without the rows that have no letter or that cost every language more than ``most_bits`` bits a byte
    (at 8, phrases are shorter than two bytes on average).

    Texts are learnt from all labelled rows. Without any, nothing is known of any language and all rows with letters stay.
    A tie between languages is no ground to reject a text. lang and the other columns stay as they are.
    """
    texts = labelled_text(docs, F.lit(True))
    out = predict(docs, texts)
    keep = (F.col("lang_pred") != "und") & (F.col("bits") <= most_bits) if texts else F.col("row.text").rlike(r"\p{L}")
    return out.filter(keep).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
