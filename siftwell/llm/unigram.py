"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie of pieces.

Pieces and scores are read from a model file; a model whose scores are merge ranks (a BPE vocabulary) gets log scores by
Zipf's law from them. Text is prefixed with the whitespace marker, spaces become markers, and the best path of pieces
(largest sum of log scores; ties: the path whose last piece is longest, and so on backwards) is found by Viterbi. A
character without a piece of its own may become its UTF-8 bytes, at the least score less 10 per character. Decoding
joins pieces and bytes, turns markers into spaces and drops the first.

As no piece has a marker after another character, paths never cross from a word into the next marker: text is cut there,
and each distinct word is searched once and kept in a table of bounded size. Short words are searched in step, place by
place, by array operations. For longer ones, pieces are looked up at many places at once, and one pass over what was
found leaves the best sums, in time and memory in proportion to the text whatever the length of its words. Inside, the marker is the space byte, which no piece holds otherwise; so a literal U+2581 is encoded as
bytes and comes back as itself.

Cases: null and empty text give no pieces and decode to empty text; texts without spaces are one word, however long;
ids and the round trip hold for any text. Repeated rows give repeated results, an empty table none. Only doc_id and text
are read, so no name can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siftwell.llm.buffers import SliceCache, held, padded, portions, ragged, runs_of, slice_hash, sums, words64
from siftwell.session import ship, spread

UNKNOWN_PENALTY, CHUNK, SLOTS, SHORT, CELLS = 10.0, 2_000_000, 1 << 17, 64, 1_000_000


class DoubleArray:
    """Trie over bytes: the child of state s by byte c is base[s] + c, if check there is s. value: piece that ends in a state."""

    def __init__(self, keys: list[bytes]):
        root: dict = {}
        for i, k in enumerate(keys):
            node = root
            for c in k:
                node = node.setdefault(c, {})
            node[-1] = i
        size = 1 << 16
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used = bytearray(size)
        used[0] = 1
        low, near, todo = 257, 257, [(0, root)]  # the first free place; where several letters were last placed
        while todo:
            state, node = todo.pop()
            value[state] = node.get(-1, -1)
            letters = sorted(c for c in node if c >= 0)
            if not letters:
                continue
            while used[low]:
                low += 1
            b = (low if len(letters) == 1 else max(low, near)) - letters[0]
            while True:
                if b + 256 >= size:
                    grow = size
                    base, check, value = np.pad(base, (0, grow)), np.pad(check, (0, grow), constant_values=-1), np.pad(value, (0, grow), constant_values=-1)
                    used.extend(bytes(grow))
                    size += grow
                if not any(used[b + c] for c in letters):
                    break
                b += 1
            base[state] = b
            if len(letters) > 1:
                near = max(near, b)
            for c in letters:
                used[b + c], check[b + c] = 1, state
                todo.append((b + c, node[c]))
        self.base, self.check, self.value = base, check, value


class Unigram:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes_at = np.zeros(256, np.int32)
        keys, ids, scores = [], [], []
        self.text: list[bytes] = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                b = int(piece[1:-1], 16)
                self.bytes_at[b] = i
                self.text.append(bytes([b]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.text.append(b"")
            else:
                raw = piece.replace("▁", " ").encode()
                if b" " in raw.lstrip(b" "):
                    raise ValueError(f"a piece has a marker inside: {piece!r}")
                keys.append(raw)
                ids.append(i)
                scores.append(sp.get_score(i))
                self.text.append(raw)
        scores = np.array(scores)
        if np.array_equal(scores, np.round(scores)) and len(scores) > 2:  # merge ranks
            rank = scores.max() - scores + 1
            scores = -np.log(rank) - np.log((1 / rank).sum())
        scores = np.round(scores * 2.0**20) / 2.0**20  # sums are exact, so equal ones tie however they are added
        self.scores, self.ids = scores, np.array(ids, np.int32)
        self.unknown = float(scores.min()) - UNKNOWN_PENALTY
        self.trie = DoubleArray(keys)
        self.longest = max(map(len, keys))
        self.n_bytes = np.array([len(t) for t in self.text], np.int64)
        self.starts = np.cumsum(self.n_bytes) - self.n_bytes
        self.joined = np.frombuffer(b"".join(self.text), np.uint8)
        self.cache = SliceCache()
        self.is_byte = np.zeros(n, bool)
        self.is_byte[self.bytes_at] = True

    def viterbi(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces of each word, ids of all words one after another)."""
        counts, parts = np.zeros(len(starts), np.int64), []
        long = np.flatnonzero(lengths > SHORT)
        for i, j in runs_of(np.concatenate(([0], np.cumsum(lengths[long] + 1))), SLOTS):
            n, ids = self._words(data, starts[long[i:j]], lengths[long[i:j]])
            counts[long[i:j]] = n
            parts.append((long[i:j], n, ids))
        order = np.argsort(lengths, kind="stable")[: len(lengths) - len(long)]
        i = 0
        while i < len(order):
            # words of similar length in step, in a table of bounded size
            size = int(lengths[order[min(len(order), i + 4096) - 1]]) + 1
            j = min(len(order), i + max(4096, CELLS // size))
            while j > i + 4096 and (j - i) * (int(lengths[order[j - 1]]) + 1) > CELLS:
                j = i + max(4096, (j - i) // 2)
            n, ids = self._table(data, starts[order[i:j]], lengths[order[i:j]])
            counts[order[i:j]] = n
            parts.append((order[i:j], n, ids))
            i = j
        first = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int32)
        for rows, n, ids in parts:
            out[ragged(first[rows], n)] = ids
        return counts, out

    def _table(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Short words, all of them in step, one place after another."""
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        w, size = len(starts), int(lengths.max(initial=0))
        best = np.full((size + 1, w), -np.inf)
        best[0] = 0
        back = np.zeros((size + 1, w), np.int32)  # bytes of the last piece
        last = np.zeros((size + 1, w), np.int32)  # its number; -1: bytes of a character
        for i in range(size):
            row = np.flatnonzero((lengths > i) & np.isfinite(best[i]))
            if not len(row):
                continue
            lead = data[starts[row] + i]
            char = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
            score, single = best[i, row], np.zeros(len(row), bool)
            live, state = np.arange(len(row)), np.zeros(len(row), np.int64)
            for k in range(self.longest):
                left = lengths[row[live]] > i + k
                live, state = live[left], state[left]
                if not len(live):
                    break
                to = base[state] + data[starts[row[live]] + i + k]
                ok = (check[to] == state) & (base[state] > 0)
                live, state = live[ok], to[ok]
                if not len(live):
                    break
                piece = value[state]
                end = np.flatnonzero(piece >= 0)
                if len(end):
                    r, v = row[live[end]], score[live[end]] + self.scores[piece[end]]
                    single[live[end]] |= char[live[end]] == k + 1
                    up = v > best[i + k + 1, r]
                    r = r[up]
                    best[i + k + 1, r], back[i + k + 1, r], last[i + k + 1, r] = v[up], k + 1, piece[end][up]
            odd = np.flatnonzero(~single)
            if len(odd):
                r, to, v = row[odd], i + char[odd], score[odd] + self.unknown
                up = v > best[to, r]
                best[to[up], r[up]], back[to[up], r[up]], last[to[up], r[up]] = v[up], char[odd][up], -1
        at, live, counts, steps = lengths.copy(), np.arange(w), np.zeros(w, np.int64), []
        while len(live):
            k, piece = back[at[live], live], last[at[live], live]
            begin = starts[live] + at[live] - k
            n = np.where(piece < 0, k, 1)
            steps.append((live, piece, begin, n))
            counts[live] += n
            at[live] -= k
            live = live[at[live] > 0]
        place = np.cumsum(counts)
        out = np.empty(int(counts.sum()), np.int32)
        for live, piece, begin, n in steps:
            place[live] -= n
            whole = piece >= 0
            out[place[live[whole]]] = self.ids[piece[whole]]
            for r, b, m in zip(live[~whole].tolist(), begin[~whole].tolist(), n[~whole].tolist()):
                out[place[r] : place[r] + m] = self.bytes_at[data[b : b + m]]
        return counts, out

    def _matches(self, data: np.ndarray, at: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, ...]:
        """(nth of ``at``, bytes, number, score) of all pieces that start at ``at`` and fit, in this order; number -1: bytes of a character."""
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        lead = data[at]
        char = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
        alone = np.zeros(len(at), bool)
        live, state, found = np.arange(len(at)), np.zeros(len(at), np.int32), []
        for k in range(self.longest):
            to = base[state] + data[at[live] + k]
            ok = (check[to] == state) & (base[state] > 0)
            live, state = live[ok], to[ok]
            piece = value[state]
            end = piece >= 0
            found.append((live[end], np.full(np.count_nonzero(end), k + 1), piece[end]))
            alone[live[end][char[live[end]] == k + 1]] = True
            more = room[live] > k + 1
            live, state = live[more], state[more]
            if not len(live):
                break
        odd = np.flatnonzero(~alone)
        found.append((odd, char[odd], np.full(len(odd), -1)))
        nth, size, piece = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(nth, kind="stable")
        nth, size, piece = nth[order], size[order], piece[order]
        return nth, size, piece, np.where(piece >= 0, self.scores[piece], self.unknown)

    def _words(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of any length.

        Every word has a slot for each place between its bytes. Pieces are looked up for many places at once; one pass over
        them, in order of place, then leaves the best sum and last piece at every slot.
        """
        first = np.cumsum(lengths + 1) - (lengths + 1)
        total, reach = int((lengths + 1).sum()), max(self.longest, 4) + 1
        sizes, pieces = np.zeros(total, np.int32), np.zeros(total, np.int32)  # of the last piece up to a slot
        carried = np.zeros(0)
        for lo in range(0, total, SLOTS):
            hi = min(total, lo + SLOTS)
            slot = np.arange(lo, hi)
            word = np.searchsorted(first, slot, "right") - 1
            inside = slot - first[word]
            sums_here = np.full(hi - lo + reach, -np.inf)
            sums_here[: len(carried)] = carried
            sums_here[np.flatnonzero(inside == 0)] = 0
            room = lengths[word] - inside
            slot, at, room = (x[room > 0] for x in (slot, starts[word] + inside, room))
            begins = (data[at] & 0xC0) != 0x80
            slot, at, room = slot[begins] - lo, at[begins], room[begins]
            nth, size, piece, score = self._matches(data, at, room)
            slot = slot[nth]
            best, won, m = sums_here.tolist(), [-1] * len(sums_here), 0
            for p, e, s in zip(slot.tolist(), (slot + size).tolist(), score.tolist()):
                v = best[p] + s
                if v > best[e]:
                    best[e], won[e] = v, m
                m += 1
            won = np.array(won)
            at = np.flatnonzero(won >= 0)
            sizes[lo + at], pieces[lo + at] = size[won[at]], piece[won[at]]
            carried = np.array(best[hi - lo :])
        return self._paths(data, first, starts, lengths, sizes, pieces)

    def _paths(self, data: np.ndarray, first: np.ndarray, starts: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Follow the last pieces back: all words in step while there are many, the long ones that remain one by one."""
        at, live, n, steps = first + lengths, np.flatnonzero(lengths > 0), np.zeros(len(first), np.int64), []
        while len(live) > 32:
            size, piece = sizes[at[live]], pieces[at[live]]
            steps.append((live, piece, starts[live] + at[live] - first[live] - size, np.where(piece < 0, size, 1)))
            n[live] += steps[-1][3]
            at[live] -= size
            live = live[at[live] > first[live]]
        rest = {}
        own, by_byte = self.ids.tolist(), self.bytes_at.tolist()
        for w in live.tolist():
            e, o, s, path = int(at[w]), int(first[w]), int(starts[w]), []
            back, last = memoryview(sizes), memoryview(pieces)
            while e > o:
                k, number = back[e], last[e]
                if number >= 0:
                    path.append(own[number])
                else:
                    path.extend(by_byte[b] for b in data[s + e - o - k : s + e - o][::-1].tolist())
                e -= k
            rest[w] = path[::-1]
            n[w] += len(path)
        out, place = np.empty(int(n.sum()), np.int32), np.cumsum(n)
        for live, piece, begin, count in steps:
            place[live] -= count
            whole = piece >= 0
            out[place[live[whole]]] = self.ids[piece[whole]]
            for r, b, m in zip(live[~whole].tolist(), begin[~whole].tolist(), count[~whole].tolist()):
                out[place[r] : place[r] + m] = self.bytes_at[data[b : b + m]]
        for w, path in rest.items():
            out[place[w] - len(path) : place[w]] = path
        return n, out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each)."""
        ids, counts = [], []
        for i, j in runs_of(offsets, CHUNK):
            a, b = self._chunk(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            ids.append(a)
            counts.append(b)
        return (np.concatenate(ids), np.concatenate(counts)) if ids else (np.zeros(0, np.int32), np.zeros(0, np.int64))

    def _chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        full = np.diff(offsets) > 0
        if not full.any():
            return np.zeros(0, np.int32), np.zeros(len(full), np.int64)
        data = np.insert(data, offsets[:-1][full], 32)
        offsets = offsets + np.concatenate(([0], np.cumsum(full)))
        space = data == 32
        start = space.copy()
        start[1:] &= ~space[:-1]
        start[offsets[:-1][full]] = True
        starts = np.flatnonzero(start)
        lengths = np.diff(starts, append=len(data))
        h = slice_hash(words64(padded(data)), starts, lengths)
        entry = self.cache.find(h)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            new, at = np.unique(h[missing], return_index=True)
            if not self.cache.room(len(new), int(lengths[missing[at]].sum())):  # a word has no more pieces than bytes
                self.cache.clear()
                missing = np.arange(len(h))
                new, at, nth = np.unique(h, return_index=True, return_inverse=True)
                if not self.cache.room(len(new), int(lengths[at].sum())):
                    # a text of more distinct words than the table holds is encoded without it
                    n, ids = self.viterbi(data, starts[at], lengths[at])
                    return ids[ragged((np.cumsum(n) - n)[nth], n[nth])], sums(n[nth], np.searchsorted(starts, offsets))
            n, ids = self.viterbi(data, starts[missing[at]], lengths[missing[at]])
            self.cache.add(new, n.astype(np.int32), ids)
            entry = self.cache.find(h)
        n, ids = self.cache.values(entry)
        return ids, sums(n, np.searchsorted(starts, offsets))

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts one after another, offsets) of ids[bounds[i]:bounds[i + 1]]."""
        n = self.n_bytes[ids]
        raw = self.joined[ragged(self.starts[ids], n)]
        offsets = np.concatenate(([0], np.cumsum(n)))[bounds]
        firsts = offsets[:-1][np.diff(offsets) > 0]  # each the prefixed marker
        keep = np.ones(len(raw), bool)
        keep[firsts[raw[firsts] == 32]] = False
        return raw[keep], np.concatenate(([0], np.cumsum(keep)))[offsets]

    def log_scores(self) -> np.ndarray:
        out = np.zeros(len(self.text))
        out[self.ids] = self.scores
        return out


def coder(path: str) -> Unigram:
    return held(("unigram", path), lambda: Unigram(path))


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, pieces: ids, n_pieces, n_byte_pieces, round_trip: whether decoding gives the text back)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = coder(model)
        for batch, data, offsets in portions(batches):
            ids, counts = u.encode(data, offsets)
            bounds = np.concatenate(([0], np.cumsum(counts)))
            back, places = u.decode(ids, bounds)
            same = np.diff(places) == np.diff(offsets)
            if len(back) == len(data) and same.all():
                same &= sums(back != data, offsets) == 0
            else:
                same = np.array([back[a:b].tobytes() == data[c:d].tobytes() for a, b, c, d in zip(places[:-1], places[1:], offsets[:-1], offsets[1:])], bool)
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(counts), pa.array(sums(u.is_byte[ids], bounds)), pa.array(same)], ["doc_id", "pieces", "n_pieces", "n_byte_pieces", "round_trip"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return spread(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, pieces array<int>, n_pieces long, n_byte_pieces long, round_trip boolean")


def decoded(rows: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, pieces). Bytes that aren't UTF-8 become U+FFFD."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = coder(model)
        for batch in batches:
            lists = batch.column("pieces").to_pylist()
            bounds = np.cumsum([0, *(len(x or []) for x in lists)])
            raw, offsets = u.decode(np.array([i for x in lists for i in x or []], np.int64), bounds)
            raw = raw.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([raw[a:b].decode(errors="replace") for a, b in zip(offsets[:-1], offsets[1:])], pa.string())], ["doc_id", "text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "pieces").mapInArrow(run, f"doc_id {kind}, text string")
