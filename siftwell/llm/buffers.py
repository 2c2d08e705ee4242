"""Texts of an Arrow batch as one byte buffer, and vectorised work on slices of it."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
TRIM_BYTES = 8_000_000
S31, S29, S32 = np.uint64(31), np.uint64(29), np.uint64(32)


_held: dict[tuple, object] = {}


def held(key: tuple, make: Callable[[], object]):
    """The one large model that a worker keeps between tasks; one of another key takes its place."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def trim() -> None:
    """Give freed memory back to the system; Arrow's pool and glibc's heap would keep it for as long as the worker lives."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words (two rounds of multiply and shift)."""
    h = (h ^ (h >> S31)) * M2
    h = (h ^ (h >> S29)) * M3
    return h ^ (h >> S32)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, null as empty; the offsets start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs_of(offsets: np.ndarray, limit: int, texts: int = 1 << 62) -> Iterator[tuple[int, int]]:
    """Consecutive texts, together at most ``limit`` bytes, or one longer text alone; at most ``texts`` of them."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, i + texts)
        yield i, j
        i = j


def portions(batches: Iterator[pa.RecordBatch], limit: int = 2_000_000, texts: int = 1 << 16, within: str | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of stretches of each batch whose texts have at most ``limit`` bytes, or one longer text.

    ``within``: the struct column that holds the texts, so that they needn't be sent twice.
    """
    done = 0
    for batch in batches:
        data, offsets = text_bytes(pc.struct_field(batch.column(within), "text") if within else batch.column("text"))
        for i, j in runs_of(offsets, limit, texts):
            yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        done += len(data)
        if done > TRIM_BYTES:
            trim()
            done = 0
    trim()


def words64(data: np.ndarray) -> np.ndarray:
    """The little-endian 64-bit word at every byte; ``data`` ends in 8 spare bytes."""
    return np.ndarray((len(data) - 7,), "<u8", data.data if data.flags.c_contiguous else np.ascontiguousarray(data).data, strides=(1,))


def padded(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 8, np.uint8)
    out[: len(data)] = data
    return out


def slice_hash(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice, from 8 bytes at a time."""
    last = len(words) - 1
    full = (np.uint64(1) << (np.arange(8, dtype=np.uint64) * np.uint64(8))) - np.uint64(1)
    masks = np.append(full, np.uint64(0xFFFFFFFFFFFFFFFF))
    h = mix(lengths.astype(np.uint64) * M1 ^ (words[np.minimum(starts, last)] & masks[np.minimum(lengths, 8)]))
    step, live = 8, np.flatnonzero(lengths > 8)
    while len(live):
        left = lengths[live] - step
        x = words[np.minimum(starts[live] + step, last)] & masks[np.minimum(left, 8)]
        h[live] = mix((h[live] + M1) ^ x)
        step += 8
        live = live[left > 8]
    return h


class SliceCache:
    """Open-addressing table from slice hashes to ragged int32 values, of at most half as many entries as places.

    Its owner empties it when there is no ``room``. Entries and, at ``pool_limit`` values, the pool are bounded: 12 bytes a
    place, 12 an entry and 4 a value make at most 34 MB for 20 bits.
    """

    pool_limit = 1 << 22

    def __init__(self, bits: int = 20):
        self.bits, self.shift, self.mask = bits, np.uint64(64 - bits), (1 << bits) - 1
        self.clear()

    def clear(self) -> None:
        self.keys, self.slots = np.zeros(self.mask + 1, np.uint64), np.zeros(self.mask + 1, np.int32)
        self.n, self.pool_n = 0, 0
        self.starts, self.lengths, self.pool = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(4096, np.int32)

    def room(self, n: int, values: int = 0) -> bool:
        return self.n + n <= (self.mask + 1) // 2 and self.pool_n + values <= self.pool_limit

    def find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each hash, or -1."""
        h = np.where(h == 0, M1, h)
        slot = ((h * M1) >> self.shift).astype(np.int64)
        key = self.keys[slot]
        out = np.where(key == h, self.slots[slot], -1)
        rest = np.flatnonzero((key != h) & (key != 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & self.mask
            key = self.keys[slot[rest]]
            hit = key == h[rest]
            out[rest[hit]] = self.slots[slot[rest[hit]]]
            rest = rest[~hit & (key != 0)]
        return out

    def add(self, h: np.ndarray, lengths: np.ndarray, values: np.ndarray) -> None:
        """New entries: distinct hashes that aren't in the table."""
        h = np.where(h == 0, M1, h)
        n, m = len(h), len(values)
        while self.n + n > len(self.starts):
            self.starts, self.lengths = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lengths, 2 * len(self.lengths))
        while self.pool_n + m > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.starts[self.n : self.n + n] = self.pool_n + np.cumsum(lengths) - lengths
        self.lengths[self.n : self.n + n] = lengths
        self.pool[self.pool_n : self.pool_n + m] = values
        entry = np.arange(self.n, self.n + n, dtype=np.int32)
        slot = ((h * M1) >> self.shift).astype(np.int64)
        rest = np.arange(n)
        while len(rest):
            free = rest[self.keys[slot[rest]] == 0]
            self.keys[slot[free]] = h[free]
            won = free[self.keys[slot[free]] == h[free]]
            self.slots[slot[won]] = entry[won]
            rest = np.setdiff1d(rest, won, assume_unique=True)
            slot[rest] = (slot[rest] + 1) & self.mask
        self.n += n
        self.pool_n += m

    def values(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, values one after another) of the entries."""
        lengths = self.lengths[entries]
        return lengths, self.pool[ragged(self.starts[entries], lengths)]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every slice, one slice after another."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    out = np.ones(total, np.int64)
    firsts = np.cumsum(lengths) - lengths
    out[0] = starts[0]
    out[firsts[1:]] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(out)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]]; 0 where that is empty."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def minima(values: np.ndarray, bounds: np.ndarray, empty) -> np.ndarray:
    """Minima of values[bounds[i]:bounds[i + 1]]; ``empty`` where that is empty."""
    out = np.full(len(bounds) - 1, empty, values.dtype)
    full = bounds[1:] > bounds[:-1]
    if full.any():
        out[full] = np.minimum.reduceat(values, bounds[:-1][full])
    return out
