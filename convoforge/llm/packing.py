"""Sequence packing from the length histogram.

Every text becomes token ids and a closing id; full windows are cut off, which leaves one remainder shorter than a
window per document. Combinations of two and three lengths that fill a window exactly are enumerated, and
non-negative least squares finds how often each must be used to match the histogram of remainders. Rounded counts are
taken as far as remainders reach; what is left is packed greedily, longest first, by counts alone. The histogram has
as many bins as the window is long, so this part of the work is the same at any input size; every piece then finds
its place from its rank among the pieces of its length.

Defined results: null and empty texts consist of the closing id; with ``added_tokens`` the added tokens of the
vocabulary file become their ids wherever a text holds them, as the tokenizers library does by itself, and without they
are ordinary text; a null doc_id is packed like any other; repeated rows are packed each; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import CHUNK, Codec, codec
from .scratch import written
from .textbytes import Docs, chunks

WINDOW = 1024
#: So many (task, length) counts are broadcast at most, 16 bytes each; more are joined.
MOST_COUNTS = 1_000_000


@lru_cache(maxsize=2)
def added(path: str) -> dict[bytes, int]:
    """Bytes and ids of the ``added_tokens`` of a tokenizer's JSON file, longest first."""
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f).get("added_tokens", [])
    for t in tokens:
        if t["single_word"] or t["lstrip"] or t["rstrip"]:
            raise ValueError(f"added token {t['content']!r} asks for its neighbours, which is not supported")
    return {t["content"].encode(): t["id"] for t in sorted(tokens, key=lambda t: -len(t["content"].encode())) if t["content"]}


def _encoded(own: Codec, docs: Docs, tokens: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """As ``own.encode``, but the leftmost added tokens of each text become their ids, and what lies between is encoded apart."""
    raw = docs.data.tobytes()
    if not any(t in raw for t in tokens):
        return own.encode(docs)
    pattern, found, at = re.compile(b"|".join(map(re.escape, tokens))), [], 0
    while m := pattern.search(raw, at):
        inside = np.searchsorted(docs.offsets, m.start(), "right") == np.searchsorted(docs.offsets, m.end() - 1, "right")
        if inside:
            found.append((m.start(), m.end(), tokens[m[0]]))
        at = m.end() if inside else m.start() + 1
    starts, ends, named = np.array(found, np.int64).reshape(-1, 3).T
    keep = np.ones(len(raw), bool)
    for a, b in zip(starts, ends, strict=True):
        keep[a:b] = False
    place = np.concatenate([[0], np.cumsum(keep)])
    every = np.concatenate([docs.offsets, starts])
    order = np.argsort(every, kind="stable")  # an edge of documents comes before a token that begins there
    ids, edges = own.encode(Docs(docs.data[keep], place[every[order]]))
    token = order >= len(docs.offsets)
    ids = np.insert(ids.astype(np.int64), edges[token], named[order[token] - len(docs.offsets)])
    return ids, (edges + np.cumsum(token))[~token]


def _cut(batches: Iterator[pa.RecordBatch], path: str, window: int, close: int, with_ids: bool, added_tokens: bool) -> Iterator[pa.RecordBatch]:
    """Pieces of each document, with their rank among this task's pieces of the same length."""
    own = codec(path, library=True)
    tokens = added(path) if added_tokens else {}
    task = TaskContext.get().partitionId()
    seen = np.zeros(window + 1, np.int64)
    for batch in chunks(batches, "text", CHUNK):
        docs = Docs.of(batch["text"])
        ids, edges = _encoded(own, docs, tokens)
        rows: list[tuple[int, int, int, int, int, int]] = []
        lists: list[np.ndarray] = []
        for i in range(len(docs)):
            whole = np.append(ids[edges[i] : edges[i + 1]], close).astype("<u4")
            for at in range(0, len(whole), window):
                part = whole[at : at + window]
                rows.append((i, at, len(part), zlib.crc32(part.tobytes()), len(whole), int(seen[len(part)])))
                seen[len(part)] += 1
                if with_ids:
                    lists.append(part.astype(np.int32))
        table = np.array(rows, np.int64)
        columns = [batch["doc_id"].take(pa.array(table[:, 0])), *(pa.array(table[:, k]) for k in range(1, 6)), pa.array(np.full(len(table), task), pa.int32())]
        if with_ids:
            columns.append(pa.array(lists, pa.list_(pa.int32())))
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "nth", "task", *(["ids"] if with_ids else [])])


def combinations(window: int) -> list[np.ndarray]:
    """Lengths that add up to the window: all pairs, and all triples."""
    a = np.arange(1, window // 2 + 1)
    pairs = np.stack([window - a, a], 1)
    x, y = np.meshgrid(np.arange(1, window), np.arange(1, window), indexing="ij")
    z = window - x - y
    ordered = (x >= y) & (y >= z) & (z >= 1)
    return [pairs, np.stack([x[ordered], y[ordered], z[ordered]], 1)]


def least_squares(combos: list[np.ndarray], histogram: np.ndarray, rounds: int = 300) -> list[np.ndarray]:
    """Repeat counts x >= 0 that bring sum(x * combination) near the histogram, by multiplicative updates (x never leaves x >= 0)."""
    n = len(histogram)
    goal = [histogram[c].sum(1).astype(float) for c in combos]
    x = [np.where(g > 0, histogram[c].min(1) / 2.0 + 1e-3, 0.0) for g, c in zip(goal, combos, strict=True)]
    for _ in range(rounds):
        made = np.zeros(n)
        for c, v in zip(combos, x, strict=True):
            for k in range(c.shape[1]):
                made += np.bincount(c[:, k], v, n)
        x = [v * g / np.maximum(made[c].sum(1), 1e-9) for v, g, c in zip(x, goal, combos, strict=True)]
    return x


def plan(histogram: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """Which lengths share a sequence, and how many sequences are made of each such list. Uses up the histogram exactly."""
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if left[window]:
        out.append(((window,), int(left[window])))
        left[window] = 0
    if left.sum():
        combos = combinations(window)
        x = least_squares(combos, left)
        ranked = sorted(((int(v), tuple(map(int, c))) for cs, vs in zip(combos, x, strict=True) for c, v in zip(cs[vs >= 0.5], np.rint(vs[vs >= 0.5]), strict=True)), reverse=True)
        for want, lengths in ranked:
            got = min(want, *(int(left[k]) // lengths.count(k) for k in lengths))
            if got > 0:
                out.append((lengths, got))
                for k in lengths:
                    left[k] -= got
    while left.any():
        lengths: list[int] = []
        gap, use = window, left.copy()
        while gap > 0 and (fit := np.flatnonzero(use[: gap + 1])).size:
            k = int(fit[-1])
            lengths.append(k)
            use[k] -= 1
            gap -= k
        got = min(int(left[k]) // lengths.count(k) for k in lengths)
        out.append((tuple(lengths), got))
        for k in lengths:
            left[k] -= got
    return out


def _places(layout: list[tuple[tuple[int, ...], int]], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of ranks per length, sorted: (length and first rank in one number, sequence minus rank, offset)."""
    used = np.zeros(window + 1, np.int64)
    rows, base = [], 0
    for lengths, times in layout:
        at = 0
        for k in lengths:
            rows.append(((k << 48) + int(used[k]), base - int(used[k]), at))
            used[k] += times
            at += k
        base += times
    rows.sort()
    return tuple(np.array(x, np.int64) for x in (zip(*rows, strict=True) if rows else ([], [], [])))


def pack(docs: DataFrame, path: str, window: int = WINDOW, close: int = 0, with_ids: bool = True, added_tokens: bool = False) -> DataFrame:
    """One row per piece with its sequence and offset; with ``with_ids`` also the token ids, ready to be laid into sequences."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, nth long, task int" + ", ids array<int>" * with_ids
    cut = written(docs.select("doc_id", "text").mapInArrow(lambda it: _cut(it, path, window, close, with_ids, added_tokens), schema), "pieces")
    counts = written(cut.groupBy("task", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = np.zeros(window + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most as many rows as the window is long
        histogram[row["length"]] = row["n"]
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(_places(plan(histogram, window), window))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("task", "length", before.alias("before"))
    fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, shift, offset = held.value
        for b in batches:
            length = b["length"].to_numpy()
            if small is not None:
                slots, first = small.value
                earlier = first[np.searchsorted(slots, (b["task"].to_numpy().astype(np.int64) << 20) + length)]
            else:
                earlier = b["before"].to_numpy()
            rank = b["nth"].to_numpy() + earlier
            at = np.searchsorted(keys, (length << 48) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*(b[c] for c in fields), pa.array(shift[at] + rank), pa.array(offset[at])], [*fields, "sequence_id", "offset"])

    small = None
    if counts.count() <= MOST_COUNTS:
        table = offsets.toArrow()
        slots = (table["task"].to_numpy().astype(np.int64) << 20) + table["length"].to_numpy()
        order = np.argsort(slots)
        small = spark.sparkContext.broadcast((slots[order], table["before"].to_numpy()[order]))
    else:
        cut = cut.join(offsets, ["task", "length"])
    out = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, " + "ids array<int>, " * with_ids + "sequence_id long, offset long"
    return cut.mapInArrow(place, out)
