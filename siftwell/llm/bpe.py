"""Byte-level BPE ids of whole texts, a batch at a time.

Texts are cut into pre-tokens by array operations on their bytes, every distinct pre-token is encoded once and kept
in a table, and ids are gathered from there. A text that holds an apostrophe (contractions) goes to the same
vocabulary's regular-expression encoder, one with characters beyond U+024F or unusual spaces to the tokenizer library,
and so does one that holds the string of an added token: ids are those of ``Tokenizer.from_file(path)`` as it is, for
which that string is one token. With ``plain_specials`` such strings are ordinary text instead.

A batch of more distinct pre-tokens than the table holds is encoded without it.
"""

from __future__ import annotations

import json
from itertools import chain

import numpy as np

from siftwell.llm.buffers import SliceCache, held, padded, ragged, runs_of, slice_hash, sums, words64

LETTER, NUMBER, SPACE, MARK = 1, 2, 3, 5
CHUNK = 2_000_000


def _kinds() -> np.ndarray:
    k = np.full(256, MARK, np.uint8)
    for b in range(128):
        c = chr(b)
        if c.isalpha():
            k[b] = LETTER
        elif c.isdigit():
            k[b] = NUMBER
        elif c in " \t\n\v\f\r":
            k[b] = SPACE
    k[128:] = LETTER
    return k


def _odd() -> np.ndarray:
    """2: only the library; 1: only the regular expression."""
    odd = np.zeros(256, np.uint8)
    odd[0x1C:0x20] = odd[0xC2] = odd[0xCA:] = 2
    odd[ord("'")] = 1
    return odd


KINDS, ODD = _kinds(), _odd()


def byte_of_char() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def pretoken_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions where a pre-token starts, for texts without apostrophes and odd characters."""
    n = len(data)
    kind = KINDS[data]
    blank = kind == SPACE
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    start = np.zeros(n, bool)
    start[1:] = kind[1:] != kind[:-1]  # a new run
    start[1:] &= blank[1:] | (data[:-1] != 32)  # to which one space before it belongs
    # the last space of a longer run stands alone if something follows in the text
    start[1:-1] |= blank[1:-1] & blank[:-2] & ~blank[2:] & ~first[2:n]
    start |= first[:n]
    return np.flatnonzero(start)


def occurrences(data: np.ndarray, token: bytes) -> np.ndarray:
    """Positions at which ``token`` starts."""
    n = len(data) - len(token) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(data[:n] == token[0])
    for k in range(1, len(token)):
        at = at[data[at + k] == token[k]]
        if not len(at):
            break
    return at


class ByteBpe:
    def __init__(self, path: str, plain_specials: bool = False):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        of = byte_of_char()
        self.path, self.plain_specials, self._library = path, plain_specials, None
        self.added = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        self.special = set(self.added)
        model = model["model"]
        ranks = {bytes(of[c] for c in token): i for token, i in model["vocab"].items() if token not in self.special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.plain = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.n_bytes = np.zeros(max([*ranks.values(), *self.added.values()]) + 1, np.int32)
        for token, i in [*ranks.items(), *((t.encode(), i) for t, i in self.added.items())]:
            self.n_bytes[i] = len(token)
        self.sought = [] if plain_specials else [t.encode() for t in self.special]
        self.cache = SliceCache()

    @property
    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            self._library.encode_special_tokens = self.plain_specials
        return self._library

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each)."""
        ids, counts = [], []
        for i, j in runs_of(offsets, CHUNK):
            a, b = self._chunk(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            ids.append(a)
            counts.append(b)
        return (np.concatenate(ids), np.concatenate(counts)) if ids else (np.zeros(0, np.int32), np.zeros(0, np.int64))

    def _chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(offsets) - 1
        odd = ODD[data]
        odd[1:][(data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))] = 2
        at = np.flatnonzero(odd)
        for token in self.sought:
            found = occurrences(data, token)
            if len(found):
                odd[found] = 2
                at = np.flatnonzero(odd)
        if not len(at):
            return self._usual(data, offsets)
        level = np.zeros(n, np.uint8)
        np.maximum.at(level, np.searchsorted(offsets, at, "right") - 1, odd[at])
        # long stretches of usual texts stay together
        ids, counts, i = [], [], 0
        while i < n:
            j = i + 1
            while j < n and level[j] == level[i] == 0:
                j += 1
            if level[i]:
                text = data[offsets[i] : offsets[i + 1]].tobytes().decode()
                got = self.plain.encode_to_numpy(text, disallowed_special=()) if level[i] == 1 else self.library.encode(text, add_special_tokens=False).ids
                ids.append(np.asarray(got, np.int32))
                counts.append(np.array([len(got)]))
            else:
                a, b = self._usual(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ids.append(a)
                counts.append(b)
            i = j
        return np.concatenate(ids), np.concatenate(counts)

    def _usual(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        starts = pretoken_starts(data, offsets)
        lengths = np.diff(starts, append=len(data))
        h = slice_hash(words64(padded(data)), starts, lengths)
        entry = self.cache.find(h)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            new, at = np.unique(h[missing], return_index=True)
            if not self.cache.room(len(new), int(lengths[missing[at]].sum())):  # a pre-token has no more ids than bytes
                self.cache.clear()
                missing = np.arange(len(h))
                new, at, nth = np.unique(h, return_index=True, return_inverse=True)
                if not self.cache.room(len(new), int(lengths[at].sum())):
                    k, ids = self._pieces(data, starts[at], lengths[at])
                    n = k[nth]
                    return ids[ragged((np.cumsum(k) - k)[nth], n)], sums(n, np.searchsorted(starts, offsets))
            k, ids = self._pieces(data, starts[missing[at]], lengths[missing[at]])
            self.cache.add(new, k, ids)
            entry = self.cache.find(h)
        k, ids = self.cache.values(entry)
        return ids, sums(k, np.searchsorted(starts, offsets))


    def _pieces(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each slice, ids of all one after another), each slice being one pre-token."""
        raw, one = data.tobytes(), self.plain._core_bpe.encode_single_piece
        got = [one(raw[s : s + k]) for s, k in zip(starts.tolist(), lengths.tolist())]
        k = np.fromiter(map(len, got), np.int32, len(got))
        return k, np.fromiter(chain.from_iterable(got), np.int32, int(k.sum()))


def encoder(path: str, plain_specials: bool = False) -> ByteBpe:
    return held(("bpe", path, plain_specials), lambda: ByteBpe(path, plain_specials))
