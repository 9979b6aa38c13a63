"""Numpy views of UTF-8 text columns.

The operators that run in Arrow batches share these helpers: they look at a batch of documents as one byte array
and find words, lines and segment hashes with array operations instead of a Python loop over words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
#: Bytes of text that one numpy pass takes; a longer document makes a pass of its own.
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


class Docs:
    """The texts of a batch as one byte array; null texts count as empty."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    @classmethod
    def of(cls, column: pa.Array) -> Docs:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if column.null_count:
            column = column.fill_null("")
        wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
        _, at, data = column.buffers()
        if at is None or not len(column):
            return cls(np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64))
        offsets = np.frombuffer(at, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        return cls(data, offsets - offsets[0])

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        """The document that holds each byte position."""
        return np.searchsorted(self.offsets, positions, "right") - 1

    def count(self, mask: np.ndarray) -> np.ndarray:
        """Set bytes of ``mask`` by document."""
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return np.diff(total[self.offsets])

    def edges(self) -> np.ndarray:
        """True at the first byte of each document, and one place behind the last byte."""
        out = np.zeros(len(self.data) + 1, bool)
        out[self.offsets] = True
        return out

    def space(self) -> np.ndarray:
        return _SPACE[self.data]

    def words(self, space: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Byte starts and ends of the maximal runs of ``[^\\x20\\x09-\\x0D]``."""
        space = self.space() if space is None else space
        solid = np.append(~space, False)
        edge = self.edges()
        before = np.append(True, space) | edge
        starts = np.flatnonzero(solid & before)
        after = np.append(space[1:], True) | edge[1:] if len(space) else np.zeros(0, bool)
        return starts, np.flatnonzero(solid[:-1] & after) + 1

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts, ends and documents of the lines between newlines; every document has at least one."""
        breaks = np.flatnonzero(self.data == 0x0A)
        starts = np.concatenate([self.offsets[:-1], breaks + 1])
        docs = np.concatenate([np.arange(len(self)), self.doc_of(breaks)])
        ends = np.concatenate([self.offsets[1:], breaks])
        order, back = np.lexsort((starts, docs)), np.lexsort((ends, np.concatenate([np.arange(len(self)), self.doc_of(breaks)])))
        return starts[order], ends[back], docs[order]

    def folded(self) -> Docs:
        """A-Z lower-cased."""
        return Docs(_FOLD[self.data], self.offsets)

    def joined_words(self) -> tuple[Docs, np.ndarray, np.ndarray]:
        """Words separated by one space each, with their starts and ends."""
        space = self.space()
        starts, ends = self.words(space)
        keep = ~space
        inner = ends[ends < len(self.data)]
        inner = inner[~self.edges()[inner]]
        keep[inner] = True
        place = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(keep, out=place[1:])
        data = self.data[keep]
        data = np.where(_SPACE[data], np.uint8(0x20), data)
        return Docs(data, place[self.offsets]), place[starts], place[ends]


def give_back() -> None:
    """Return freed memory to the system; a worker that is used again would otherwise keep the most it ever took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU library
        pass


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the text of each piece stays near ``limit`` bytes."""
    try:
        for batch in batches:
            docs = Docs.of(batch[column])
            at = 0
            while at < len(batch):
                to = int(np.searchsorted(docs.offsets, docs.offsets[at] + limit, "right")) - 1
                to = min(max(to, at + 1), len(batch))
                yield batch.slice(at, to - at)
                at = to
            give_back()
    finally:
        give_back()


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate([np.ones(1, U64), np.full(n, x, U64)])) for x in (base, inverse))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte segment, from one prefix sum over the whole array."""
    n = max(CHUNK_BYTES, 1 << (len(data) + 1).bit_length())
    power, inverse = _powers(n)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * power[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U64))


def padded(data: np.ndarray) -> np.ndarray:
    return np.concatenate([data, np.zeros(16, np.uint8)])


def words_at(data: np.ndarray, kind: str) -> np.ndarray:
    """Little-endian integers that begin at every byte of ``padded`` data."""
    return np.ndarray((len(data) - 8,), kind, buffer=data, strides=(1,))


_P = [U64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)]


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << U64(by)) | (x >> U64(64 - by))


def _round(x, lane: np.ndarray) -> np.ndarray:
    return _turn(x + lane * _P[1], 31) * _P[0]


def xxh64_segments(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of each byte segment, as the published algorithm defines it."""
    size = ends - starts
    out = np.empty(len(starts), U64)
    long = size > 512
    for i in np.flatnonzero(long):
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), seed)
    rest = np.flatnonzero(~long)
    out[rest] = _xxh64_short(data, starts[rest], size[rest], seed)
    return out


def _xxh64_short(data: np.ndarray, at: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    p1, p2, p3, p4, p5 = _P
    with np.errstate(over="ignore"):
        data = padded(data)
        at = at.astype(np.int64).copy()
        eight, four, s = words_at(data, "<u8"), words_at(data, "<u4"), U64(seed)
        h = np.full(len(at), s + p5, U64)
        act = np.flatnonzero(size >= 32)
        if len(act):
            v = [np.full(len(at), x, U64) for x in (s + p1 + p2, s + p2, s, s - p1)]
            all32, left = act, size.copy()
            while len(act):
                for k in range(4):
                    v[k][act] = _round(v[k][act], eight[at[act] + 8 * k])
                at[act] += 32
                left[act] -= 32
                act = act[left[act] >= 32]
            x = [y[all32] for y in v]
            g = _turn(x[0], 1) + _turn(x[1], 7) + _turn(x[2], 12) + _turn(x[3], 18)
            for y in x:
                g = (g ^ _round(U64(0), y)) * p1 + p4
            h[all32] = g
        h += size.astype(U64)
        left = size % 32
        act = np.flatnonzero(left >= 8)
        while len(act):
            h[act] = _turn(h[act] ^ _round(U64(0), eight[at[act]]), 27) * p1 + p4
            at[act] += 8
            left[act] -= 8
            act = act[left[act] >= 8]
        act = np.flatnonzero(left >= 4)
        h[act] = _turn(h[act] ^ (four[at[act]].astype(U64) * p1), 23) * p2 + p3
        at[act] += 4
        left[act] -= 4
        act = np.flatnonzero(left > 0)
        while len(act):
            h[act] = _turn(h[act] ^ (data[at[act]].astype(U64) * p5), 11) * p1
            at[act] += 1
            left[act] -= 1
            act = act[left[act] > 0]
        h = (h ^ (h >> U64(33))) * p2
        h = (h ^ (h >> U64(29))) * p3
        return h ^ (h >> U64(32))


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenate ``values[starts[i] : starts[i] + sizes[i]]`` for all i."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]
