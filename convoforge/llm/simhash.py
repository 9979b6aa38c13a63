"""SimHash near-duplicates: fingerprints, ball hashing, connected components, and verified near-duplicate groups.

A fingerprint bit is the majority bit of the XXH64 values of a text's word shingles. Fingerprints meet in the middle:
the bits are cut into ``blocks`` blocks, of which one holds at most ``radius // blocks`` of up to ``radius`` differing
bits, so for each block (a view) both sides cover half that distance by emitting every variant of the block within
it. Variants are shuffled as plain rows and sorted; those that share one form a run, and the runs are compared as they
stream by. A pair is told in one run of a view only, which both sides know.

``group`` links fingerprints at ``radius`` or fewer differing bits. Runs of up to ``middle`` rows are compared in full, many
of them at once: at 10^10 distinct prints an average run of a half of 32 bits has 77 rows, and few of them are linked. A longer
run, or one with more than two links a row, hands on a spanning forest of its links, which loses no connection, found in
memory of its own length.

``representatives`` keeps one row of each group of texts whose sets of five-word shingles have a similarity of 0.8 or
more. Single edits move five shingles but one word, so a print of the distinct words finds candidates, a second print
of the distinct shingles sifts them, and the sets of whole texts decide. All candidates of a run are verified, unless they
are more than ``partners`` a row. In such a crowded run every row whose block is that of the run is first verified with the
``partners`` nearest by the second print, so most of its groups come together at the cost of few texts. Then the rest
follows: the rows of crowded runs meet again with the group they are in by now, and all candidates of different groups are
verified, but those that cannot be similar by the parities of their shingles (no similar pair is lost to that). Pairs
inside a group change nothing, so the groups are those of ``partners=None``, which verifies every pair of every run.

A block value that over ``dense`` rows share makes the runs of its variants hot. Their rows are dealt over one task for
each ``dense`` rows, to which all others of the run stream by: a task holds ``dense`` rows and their nearest whatever the
size of the run, and finds what one task alone would.

Components come from repeated minimum labels with tables in the shared folder. Nodes with very many links are few by their
count, so their labels are broadcast and no task gets all the links of one.

Defined results: copies share a fingerprint and are joined at no cost; a null or empty text has fingerprint zero and
links like any other (two texts without words are similar); texts with fewer words than a shingle use the whole
sequence; a null doc_id gets a component as its fingerprint has but is never its smallest id; an empty table gives an
empty result; other columns, whatever their names, are carried by ``representatives`` and ignored by ``group``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import drop, written
from .textbytes import U64, Docs, chunks, mix, xxh64_segments


@dataclass(frozen=True)
class Params:

    shingle: int = 3
    radius: int = 3
    blocks: int = 2
    seed: int = 42
    small: int = 16
    middle: int = 1024
    dense: int = 20_000


@dataclass(frozen=True)
class Near:
    """Near-duplicate groups: ``similarity`` of sets of ``shingle`` words. ``ball``: how prints of distinct words meet; up
    to ``limit`` differing bits of them and ``sift`` of the second print count as candidates. In crowded runs the ``partners``
    nearest candidates of a row are verified first, in the runs of its own three blocks, then all that lie in other groups;
    None: all candidates at once. Both give the same groups."""

    shingle: int = 5
    similarity: float = 0.8
    ball: Params = Params(shingle=1, radius=8, blocks=3)
    limit: int = 12
    sift: int = 22
    partners: int | None = 8
    salt_rows: int = 64


#: Runs of up to so many times ``small`` rows are compared in full before they count as crowded; places of a sketch of shingles.
FULL_RUNS, SKETCH_BITS = 16, 512
_MORE = ["root", "size", *(f"s{i}" for i in range(SKETCH_BITS // 64))]
_SPREAD = (((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.uint8)).view("<u8").ravel()


def majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The bits set in over half of the hashes of each document; document i has ``hashes[first[i]:first[i + 1]]``."""
    size = np.diff(first)
    out = np.zeros(len(size), U64)
    full = np.flatnonzero(size)
    if not len(full):
        return out
    blocks = (size[full] + 254) // 255  # byte counters hold 255
    at = np.repeat(first[full], blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    begin = np.cumsum(blocks) - blocks
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    for k in range(8):
        counts = np.add.reduceat(_SPREAD[octets[:, k]], at).view(np.uint8).reshape(-1, 8)
        votes = np.add.reduceat(counts.astype(np.int64), begin, axis=0)
        bits = (2 * votes > size[full][:, None]).astype(U64)
        out[full] |= (bits << np.arange(8, dtype=U64)).sum(1, dtype=U64) << U64(8 * k)
    return out


def _shingles(joined: tuple[Docs, np.ndarray, np.ndarray], words: int, seed: int, distinct: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of folded, joined documents; document i has ``hashes[first[i]:first[i + 1]]``."""
    docs, starts, ends = joined
    at = np.searchsorted(starts, docs.offsets)
    count = np.diff(at)
    shingles = np.where(count > 0, np.maximum(count - words + 1, 1), 0)
    first = np.concatenate([[0], np.cumsum(shingles)])
    begin = np.repeat(at[:-1] - first[:-1], shingles) + np.arange(first[-1])
    last = np.minimum(begin + words, np.repeat(at[1:], shingles)) - 1
    hashes = xxh64_segments(docs.data, starts[begin], ends[last], seed)
    if not distinct:
        return hashes, first
    doc = np.repeat(np.arange(len(shingles), dtype=U64), shingles)
    keep = np.sort(np.unique(hashes ^ mix(doc), return_index=True)[1])
    return hashes[keep], np.searchsorted(doc[keep], np.arange(len(shingles) + 1))


def _fingerprints(batches: Iterator[pa.RecordBatch], kinds: list[tuple[int, bool]], seed: int, carry: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text"):
        docs = Docs.of(batch["text"]).folded().joined_words()
        prints = [pa.array(majority(*_shingles(docs, n, seed, distinct)).view(np.int64)) for n, distinct in kinds]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in carry), *prints], [*carry, *(f"print{i or ''}" for i in range(len(kinds)))])


def fingerprints(docs: DataFrame, kinds: list[tuple[int, bool]], seed: int, carry: list[str]) -> DataFrame:
    """The columns of ``carry`` and a 64-bit print (``print``, ``print1``, ...) for each (words of a shingle, distinct ones alone)."""
    kept = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry]
    names = [f"print{i or ''} long" for i in range(len(kinds))]
    return docs.select(*dict.fromkeys([*carry, "text"])).mapInArrow(lambda it: _fingerprints(it, kinds, seed, carry), ", ".join([*kept, *names]))


def _views(p: Params) -> list[tuple[int, int, np.ndarray]]:
    """For each block: its lowest bit, its mask there, and every mask of up to half the differing bits it may hold."""
    edges = [64 * i // p.blocks for i in range(p.blocks + 1)]
    half = -(-(p.radius // p.blocks) // 2)
    out = []
    for lo, hi in zip(edges, edges[1:], strict=False):
        ball = [sum(1 << b for b in some) for n in range(half + 1) for some in combinations(range(hi - lo), n)]
        out.append((lo, (1 << (hi - lo)) - 1, np.array(ball, U64)))
    return out


def _variants(batches: Iterator[pa.RecordBatch], p: Params, carry: list[str]) -> Iterator[pa.RecordBatch]:
    views = _views(p)
    for batch in batches:
        for at in range(0, len(batch), 2000):
            part = batch.slice(at, 2000)
            prints = part["print"].to_numpy().view(U64)
            for k, (lo, mask, ball) in enumerate(views):
                runs = ((((prints >> U64(lo)) & U64(mask))[:, None] ^ ball) * U64(p.blocks) + U64(k)).ravel()
                again = np.repeat(np.arange(len(part)), len(ball))
                rows = [part[c].take(pa.array(again)) for c in carry]
                yield pa.RecordBatch.from_arrays([pa.array(runs.view(np.int64)), *rows], ["run", *carry])


def _all_variants(rows: DataFrame, p: Params, carry: list[str]) -> DataFrame:
    """Variants of all rows. Few bytes come in and many go out, so rows are dealt anew (by a hash, which the grouping before
    has not dealt by)."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in carry)
    dealt = rows.select(*carry).repartition(tasks, F.xxhash64("print", F.lit(1)))
    return dealt.mapInArrow(lambda it: _variants(it, p, carry), f"run long, {kinds}")


def _meeting(variants: DataFrame, carry: list[str], pairs: Callable, schema: str) -> DataFrame:
    """Variants brought together by run; ``pairs`` compares the runs as they stream by."""
    return variants.repartition("run").sortWithinPartitions("run").mapInArrow(lambda it: pairs(_runs(it, carry)), schema)


def _runs(batches: Iterator[pa.RecordBatch], carry: list[str]) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns of sorted rows, cut between runs; a run that goes on over batches is held until it ends."""
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        if not len(batch):
            continue
        columns = tuple(batch[c].to_numpy() for c in ("run", *carry))
        cut = int(np.searchsorted(columns[0], columns[0][-1]))
        if held and cut == 0 and held[-1][0][-1] == columns[0][-1]:
            held.append(columns)
            continue
        yield tuple(np.concatenate(x) for x in zip(*held, tuple(c[:cut] for c in columns), strict=True))
        held = [tuple(c[cut:] for c in columns)]
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _told(run: np.ndarray, x: np.ndarray, y: np.ndarray, p: Params) -> np.ndarray:
    """Whether this run is the one of its view in which the pair of prints x, y is told."""
    run = run.view(U64)
    lows, masks = np.array([v[0] for v in _views(p)], U64), np.array([v[1] for v in _views(p)], U64)
    view = (run % U64(p.blocks)).astype(np.int64)
    x, y = (x >> lows[view]) & masks[view], (y >> lows[view]) & masks[view]
    apart = x ^ y
    lowest = apart & (~apart + U64(1))
    bits = np.bitwise_count(apart)
    if p.radius // p.blocks not in (1, 2):  # variants of one bit alone are told apart so
        return np.ones(len(run), bool)
    own = np.where(bits == 0, x ^ U64(1), np.where(bits == 1, np.minimum(x, y), np.minimum(x ^ lowest, y ^ lowest)))
    return own == run // U64(p.blocks)


def _close(run: np.ndarray, most: int, near: Callable) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Index pairs of all near rows in runs of up to ``most`` rows, and where the longer runs begin and end."""
    begin = np.flatnonzero(np.append(True, run[1:] != run[:-1])) if len(run) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(run)))
    longer = [(int(b), int(b + n)) for b, n in zip(begin[size > most], size[size > most], strict=True)]
    left = np.repeat(np.where(size > most, 0, begin + size), size)  # where the run of each row ends
    i, step, some = np.arange(len(run)), 1, []
    while len(i := i[i + step < left[i]]):
        ok = i[near(i, i + step)]
        some.append((ok, ok + step))
        step += 1
    return *_joined(some), longer


def _parts(prints: np.ndarray, blocks: int) -> Iterator[np.ndarray]:
    """Indices of the prints that share a block of bits, for each of ``blocks`` blocks."""
    width = 64 // blocks
    for lo in range(0, width * blocks, width):
        block = (prints >> U64(lo)) & U64((1 << width) - 1)
        order = np.argsort(block, kind="stable")
        yield from (part for part in np.split(order, np.flatnonzero(np.diff(block[order])) + 1) if len(part) > 1)


def _joined(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    none = np.zeros(0, np.int64)
    first, second = zip((none, none), *pairs, strict=True)
    return np.concatenate(first), np.concatenate(second)


def _forest(prints: np.ndarray, radius: int, dense: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that connect all prints linked at ``radius``. Very many are first parted by a block that links leave equal."""
    if len(prints) > dense:
        forests = ((part, _forest(prints[part], radius, len(part))) for part in _parts(prints, radius + 1))
        return _joined([(part[a], part[b]) for part, (a, b) in forests])
    left, a, b, reached = np.arange(len(prints)), [], [], []
    while len(left):
        at = reached.pop() if reached else left[0]
        if left[0] == at:
            left = left[1:]
        near = np.bitwise_count(prints[left] ^ prints[at]) <= radius
        found = left[near]
        a += [at] * len(found)
        b += found.tolist()
        reached += found.tolist()
        left = left[~near]
    return np.array(a, np.int64), np.array(b, np.int64)


def _links(runs: Iterator[tuple[np.ndarray, ...]], p: Params) -> Iterator[pa.RecordBatch]:
    for run, prints in runs:
        prints = prints.view(U64)
        first, second, longer = _close(run, p.middle, lambda i, j, x=prints: np.bitwise_count(x[i] ^ x[j]) <= p.radius)
        begin = np.flatnonzero(np.append(True, run[1:] != run[:-1])) if len(run) else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, len(run)))
        of = np.searchsorted(begin, first, side="right") - 1
        crowded = (size > p.small) & (np.bincount(of, minlength=len(size)) > 2 * size)
        longer += [(int(begin[i]), int(begin[i] + size[i])) for i in np.flatnonzero(crowded)]
        first, second = first[~crowded[of]], second[~crowded[of]]
        told = _told(run[first], prints[first], prints[second], p)
        pairs = [(first[told], second[told])]
        for at, to in longer:
            a, b = _forest(prints[at:to], p.radius, p.dense)
            pairs.append((a + at, b + at))
        x, y = (prints[i].view(np.int64) for i in _joined(pairs))
        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], ["a", "b"])


def links(prints: DataFrame, p: Params = Params()) -> DataFrame:
    """Linked pairs (a, b) of the distinct fingerprints in column ``print``: enough of them to connect all that are linked."""
    return _meeting(_all_variants(prints, p, ["print"]), ["print"], lambda runs: _links(runs, p), "a long, b long").distinct()


def _with_least(pairs: DataFrame, least: DataFrame, rows: int, hot: int) -> DataFrame:
    """Adds ``m`` of (a, m, n) to the pairs by ``a``. Nodes with over ``hot`` of all ``rows`` pairs, or a millionth of them if
    that is more, are a million at most: they are broadcast, and their pairs stay where they are."""
    most = max(hot, rows // 1_000_000)
    if rows <= most:
        return pairs.join(least.select("a", "m"), "a")
    many = written(least.where(F.col("n") > most).select("a", "m"), "hot-nodes")
    if many.isEmpty():
        return pairs.join(least.select("a", "m"), "a")
    few = pairs.join(F.broadcast(many), "a", "left_anti").join(least.select("a", "m"), "a")
    return few.unionByName(pairs.join(F.broadcast(many), "a"))


def components(edges: DataFrame, hot: int = 100_000) -> DataFrame:
    """(node, root) of every node of the undirected edges (a, b); the root is the smallest node of its component.

    Alternates two steps until nothing changes: every node links its larger neighbours, then its smaller ones, to the
    smallest node it knows. Each round is a table in the shared folder. ``hot``: see ``_with_least``.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not seen[0] or seen == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = seen
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = _with_least(both.where("b > a"), least, 2 * seen[0], hot)
        large = large.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = _with_least(large, least, seen[0], hot)
        then = written(small.select("b", "m").where("b <> m").union(least.select("a", "m")).toDF("a", "b").distinct(), "links")
        drop(now)
        now = then


def group(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, ``print`` and ``component_id`` (the smallest doc_id reachable over links) of every row."""
    prints = written(fingerprints(docs, [(p.shingle, False)], p.seed, ["doc_id"]), "prints")
    nodes = written(prints.groupBy("print").agg(F.min("doc_id").alias("first")), "nodes")
    roots = components(links(nodes, p)).withColumnRenamed("node", "print")
    nodes = nodes.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print"))
    named = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(nodes.join(named, "root").select("print", "component_id"), "print").select("doc_id", "print", "component_id")


def _may_be_similar(x: tuple[np.ndarray, ...], i: np.ndarray, y: tuple[np.ndarray, ...], j: np.ndarray, near: Near) -> np.ndarray:
    """Whether rows i of x and j of y, as (group, size, words of the sketch), are of two groups and not ruled out as similar.

    Bits in which two sketches differ are no more than the shingles that one text alone holds, and similar sets differ in at
    most (1 - s) / (1 + s) of both sizes together.
    """
    some = np.flatnonzero(x[0][i] != y[0][j])
    a, b = x[1][i[some]], y[1][j[some]]
    some = some[np.minimum(a, b) >= near.similarity * np.maximum(a, b) - 1e-6]
    i_, j_ = i[some], j[some]
    apart = sum(np.bitwise_count(s[i_].view(U64) ^ t[j_].view(U64)).astype(np.int64) for s, t in zip(x[2:], y[2:], strict=True))
    out = np.zeros(len(i), bool)
    out[some] = apart * (1 + near.similarity) <= (1 - near.similarity) * (x[1][i[some]] + y[1][j[some]]) + 1e-6
    return out


class _Nearest:
    """Of rows that stream by, the candidates nearest to each row of ``own`` by the second print, the first seen of equal ones.

    Without ``partners`` all candidates come out as they are seen; with a ``run``, those alone that are told in it. Rows may
    have groups, sizes and sketches behind their nodes: then pairs come out once, if ``_may_be_similar`` leaves them.
    """

    def __init__(self, own: tuple[np.ndarray, ...], near: Near, run: int | None = None) -> None:
        self.words, self.fine, self.nodes, *self.more = own
        self.near, self.run = near, run
        self.bound = np.full(len(self.nodes), near.sift + 1, np.uint8)  # a candidate has fewer differing bits
        self.row, self.apart, self.to = np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(0, np.int64)
        self.step = 64

    def _met(self, words: np.ndarray, fine: np.ndarray, nodes: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of ``own``, differing bits and nodes of the candidates within the bounds, some rows at a time."""
        some, height = [(self.row[:0], self.apart[:0], self.to[:0])], max(1, (1 << 18) // len(nodes))
        for lo in range(0, len(self.nodes), height):
            apart = np.bitwise_count(self.fine[lo : lo + height, None] ^ fine)
            row, at = np.nonzero(apart < self.bound[lo : lo + height, None])
            x, y = self.words[lo + row], words[at]
            good = (np.bitwise_count(x ^ y) <= self.near.limit) & (self.nodes[lo + row] != nodes[at])
            if self.near.partners is None and self.run is not None:
                good &= _told(np.full(len(x), self.run), x, y, self.near.ball)
            row, at = row[good], at[good]
            if more:
                good = self.nodes[lo + row] < nodes[at]
                row, at = row[good], at[good]
                good = _may_be_similar(self.more, lo + row, more, at, self.near)
                row, at = row[good], at[good]
            some.append((lo + row, apart[row, at], nodes[at]))
        return tuple(np.concatenate(x) for x in zip(*some, strict=True))

    def see(self, words: np.ndarray, fine: np.ndarray, nodes: np.ndarray, *more: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        at, most = 0, self.near.partners
        while at < len(nodes):
            to = at + self.step
            row, apart, node = self._met(words[at:to], fine[at:to], nodes[at:to], *(c[at:to] for c in more))
            at = to
            if most is None:
                yield self.nodes[row], node
                continue
            self.step = max(self.step, min(4 * self.step, 1 << 14))  # bounds are tight soon, and few rows come within them
            if not len(row):
                continue
            if not len(self.row) and np.bincount(row).max() < most:
                self.row, self.apart, self.to = row, apart, node
                continue
            row, apart, node = np.append(self.row, row), np.append(self.apart, apart), np.append(self.to, node)
            order = np.argsort(row * 256 + apart, kind="stable")
            row = row[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            kept = order[rank < most]
            self.row, self.apart, self.to = row[rank < most], apart[kept], node[kept]
            full = row[rank == most - 1]
            self.bound[full] = apart[order[rank == most - 1]]

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        return self.nodes[self.row], self.to


def _partners(own: tuple[np.ndarray, ...], rows: tuple[np.ndarray, ...], near: Near, run: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes: each row of ``own`` with its nearest candidates of ``rows``, or with all; both are words, fine, nodes."""
    nearest = _Nearest(own, near, run)
    if len(own[0]) * len(rows[0]) <= 1 << 16:
        nearest.step = 1 << 16  # at once
    return _joined([*nearest.see(*rows), nearest.found()])


def _pairs(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], ["a", "b"])


def _with_run(batch: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(len(batch), pa.int64())], ["a", "b", "run"])


def _candidates(runs: Iterator[tuple[np.ndarray, ...]], near: Near) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b), and rows (a, run) of crowded runs, one run of each row and batch."""
    p = near.ball
    full = p.small if near.partners is None else FULL_RUNS * p.small
    lows, masks = np.array([v[0] for v in _views(p)], U64), np.array([v[1] for v in _views(p)], U64)
    for run, words, fine, nodes, *more in runs:
        words, fine = words.view(U64), fine.view(U64)
        left: list[np.ndarray] = []

        def alike(i: np.ndarray, j: np.ndarray, x: np.ndarray = words, y: np.ndarray = fine, z: list[np.ndarray] = more) -> np.ndarray:
            ok = (np.bitwise_count(x[i] ^ x[j]) <= near.limit) & (np.bitwise_count(y[i] ^ y[j]) <= near.sift)
            if z:
                ok[ok] = _may_be_similar(z, i[ok], z, j[ok], near)
            return ok

        first, second, longer = _close(run, full, alike)
        if near.partners is not None:
            begin = np.flatnonzero(np.append(True, run[1:] != run[:-1])) if len(run) else np.zeros(0, np.int64)
            size = np.diff(np.append(begin, len(run)))
            of = np.searchsorted(begin, first, side="right") - 1
            crowded = (size > p.small) & (np.bincount(of, minlength=len(size)) > near.partners * size)
            longer += [(int(begin[i]), int(begin[i] + size[i])) for i in np.flatnonzero(crowded)]
            first, second = first[~crowded[of]], second[~crowded[of]]
        told = _told(run[first], words[first], words[second], p)
        yield _with_run(_pairs(nodes[first[told]], nodes[second[told]]))
        for at, to in longer:
            value, view = int(run[at]) // p.blocks, int(run[at]) % p.blocks
            rows = words[at:to], fine[at:to], nodes[at:to], *(c[at:to] for c in more)
            own = ((rows[0] >> lows[view]) & masks[view]) == U64(value) if near.partners is not None else slice(None)
            yield _with_run(_pairs(*_partners(tuple(x[own] for x in rows), rows, near, int(run[at]))))
            left.append(np.arange(at, to))
        if left and near.partners is not None:
            rows = np.concatenate(left)
            rows = rows[np.unique(nodes[rows], return_index=True)[1]]
            yield pa.RecordBatch.from_arrays([pa.array(nodes[rows]), pa.nulls(len(rows), pa.int64()), pa.array(run[rows])], ["a", "b", "run"])


def _hot_candidates(batches: Iterator[pa.RecordBatch], near: Near) -> Iterator[pa.RecordBatch]:
    """Candidates of rows sorted by run and salt, of which those to be held (``mine``) come first and the others stream by."""
    key: tuple[int, int] | None = None
    own: list[tuple[np.ndarray, ...]] = []
    nearest: _Nearest | None = None

    def begun() -> Iterator[pa.RecordBatch]:
        nonlocal nearest, own
        if own and nearest is None:
            rows, own = tuple(np.concatenate(x) for x in zip(*own, strict=True)), []
            nearest = _Nearest(rows, near, key[0])
            yield from (_pairs(*x) for x in nearest.see(*rows))

    def ended() -> Iterator[pa.RecordBatch]:
        yield from begun()
        if nearest:
            yield _pairs(*nearest.found())

    for batch in batches:
        run, salt = (batch[c].to_numpy() for c in ("run", "salt"))
        mine = batch["mine"].to_numpy(zero_copy_only=False)
        columns = batch["print"].to_numpy().view(U64), batch["print1"].to_numpy().view(U64), batch["node"].to_numpy()
        columns = *columns, *(batch[c].to_numpy() for c in _MORE if c in batch.schema.names)
        edges = np.flatnonzero((run[1:] != run[:-1]) | (salt[1:] != salt[:-1])) + 1
        for at, to in zip([0, *edges.tolist()], [*edges.tolist(), len(run)], strict=True):
            if at < to and key != (run[at], salt[at]):
                yield from ended()
                key, own, nearest = (int(run[at]), int(salt[at])), [], None
            held = at + int(mine[at:to].sum())
            if at < held:
                own.append(tuple(c[at:held] for c in columns))
            if held < to:
                yield from begun()
                if nearest:
                    yield from (_pairs(*x) for x in nearest.see(*(c[held:to] for c in columns)))
    yield from ended()


def _hot_runs(rows: DataFrame, near: Near) -> DataFrame:
    """Runs that some block value of over ``dense`` rows sends variants to, and over how many tasks (``salts``) each is dealt."""
    p, views = near.ball, _views(near.ball)
    runs = [(F.shiftrightunsigned("print", lo).bitwiseAND(F.lit(mask))) * p.blocks + k for k, (lo, mask, _) in enumerate(views)]
    values = rows.select(F.explode(F.array(*runs)).alias("own")).groupBy("own").agg(F.count("*").alias("n")).where(F.col("n") > p.dense)
    balls = F.array(*(F.array(*(F.lit(int(m)) for m in ball)) for *_, ball in views))
    ball = values.select("own", "n", F.explode(F.element_at(balls, (F.col("own") % p.blocks).cast("int") + 1)).alias("mask"))
    run = (F.floor(F.col("own") / p.blocks).bitwiseXOR(F.col("mask")) * p.blocks + F.col("own") % p.blocks).alias("run")
    rows_held = F.max(F.when(F.col("mask") == 0, F.col("n"))) if near.partners is not None else F.sum("n")
    return ball.select(run, "n", "mask").groupBy("run").agg(F.ceil(F.coalesce(rows_held, F.lit(1)) / p.dense).cast("int").alias("salts"))


def _dealt_candidates(dealt: DataFrame, columns: list[str], near: Near) -> DataFrame:
    """Pairs (a, b) of rows with their ``run``, ``salt`` and whether they are held (``mine``)."""
    dealt = dealt.select("run", "salt", "mine", *columns).repartition("run", "salt").sortWithinPartitions("run", "salt", F.desc("mine"))
    return dealt.mapInArrow(lambda it: _hot_candidates(it, near), "a long, b long")


def _met_and_left(nodes: DataFrame, near: Near) -> DataFrame:
    """Candidate pairs (a, b) of nodes: those of most runs, each compared in one task, and those of hot runs, dealt over many.

    Rows (a, run), with a null b, are those of runs of which not all candidates came out, each once at least. Nodes may have
    the columns of ``_MORE``: see ``_Nearest``.
    """
    p, carry, schema = near.ball, ["print", "print1", "node", *(c for c in _MORE if c in nodes.columns)], "a long, b long, run long"
    variants = _all_variants(nodes, p, carry)
    hot = written(_hot_runs(nodes, near), "hot-runs")
    if hot.isEmpty():
        return _meeting(variants, carry, lambda runs: _candidates(runs, near), schema)
    cool = _meeting(variants.join(hot, "run", "left_anti"), carry, lambda runs: _candidates(runs, near), schema)
    own = F.lit(near.partners is None)
    for k, (lo, mask, _) in enumerate(_views(p)):
        own = own | (F.shiftrightunsigned("print", lo).bitwiseAND(F.lit(mask)) * p.blocks + k == F.col("run"))
    dealt = variants.join(hot, "run").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    dealt = dealt.withColumn("mine", own & (F.pmod(F.xxhash64("node"), "salts") == F.col("salt")))
    none = F.lit(None).cast("long")
    found = cool.union(_dealt_candidates(dealt, carry, near).select("a", "b", none.alias("run")))
    if near.partners is None:
        return found
    return found.union(variants.join(hot, "run").select(F.col("node").alias("a"), none.alias("b"), "run"))


def _met(nodes: DataFrame, near: Near) -> DataFrame:
    """The candidate pairs of ``_met_and_left`` alone."""
    return _met_and_left(nodes, near).where("run is null").select("a", "b")


def _sketches(batches: Iterator[pa.RecordBatch], near: Near) -> Iterator[pa.RecordBatch]:
    """How many distinct shingles each text has, and for each of ``SKETCH_BITS`` places whether an odd number of them falls there."""
    for batch in chunks(batches, "text"):
        hashes, first = _shingles(Docs.of(batch["text"]).folded().joined_words(), near.shingle, near.ball.seed, True)
        place = np.repeat(np.arange(len(batch)) * SKETCH_BITS, np.diff(first)) + (hashes & U64(SKETCH_BITS - 1)).astype(np.int64)
        odd = np.bincount(place, minlength=len(batch) * SKETCH_BITS) % 2 == 1
        rows = np.packbits(odd.reshape(len(batch), SKETCH_BITS), axis=1).view(np.int64)
        columns = [batch["node"], pa.array(np.diff(first).astype(np.int64)), *(pa.array(np.ascontiguousarray(c)) for c in rows.T)]
        yield pa.RecordBatch.from_arrays(columns, ["node", *_MORE[1:]])


def _left_candidates(left: DataFrame, roots: DataFrame, nodes: DataFrame, texts: DataFrame, near: Near) -> DataFrame:
    """All candidate pairs (a, b) of the rows ``left`` (node) that are of different groups and may be similar."""
    texts = texts.join(left, "node", "left_semi").repartition("node")
    known = texts.mapInArrow(lambda it: _sketches(it, near), ", ".join(f"{c} long" for c in ["node", *_MORE[1:]]))
    known = nodes.select("node", "print", "print1").join(known, "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return _met(written(known, "left-nodes"), replace(near, partners=None))


def _similar(batches: Iterator[pa.RecordBatch], near: Near) -> Iterator[pa.RecordBatch]:
    """Pairs whose texts have sets of shingles that are similar enough."""
    for batch in chunks(chunks(batches, "text_a"), "text_b"):
        keys, pair, sizes = [], [], []
        for side in ("text_a", "text_b"):
            hashes, first = _shingles(Docs.of(batch[side]).folded().joined_words(), near.shingle, near.ball.seed, True)
            sizes.append(np.diff(first))
            pair.append(np.repeat(np.arange(len(batch)), sizes[-1]))
            keys.append(hashes ^ mix(pair[-1].astype(U64)))
        keys, pair = np.concatenate(keys), np.concatenate(pair)
        order = np.argsort(keys, kind="stable")
        shared = np.bincount(pair[order[1:]][keys[order[1:]] == keys[order[:-1]]], minlength=len(batch))
        either = sizes[0] + sizes[1] - shared
        yield batch.select(["a", "b"]).filter(pa.array(shared >= near.similarity * either - 1e-9))


def _told_texts(pairs: DataFrame, side: str, other: str, texts: DataFrame, near: Near) -> DataFrame:
    """Adds the text of one side. Texts with many pairs are copied, one for each ``salt_rows`` pairs, so no task gets them all."""
    salts = pairs.groupBy(side).agg(F.ceil(F.count("*") / near.salt_rows).cast("int").alias("salts"))
    copies = texts.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}")).join(salts, side)
    copies = copies.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    salted = pairs.join(salts, side).withColumn("salt", F.pmod(F.xxhash64(other), "salts").cast("int")).drop("salts")
    return salted.join(copies, [side, "salt"]).drop("salt")


def _verified(pairs: DataFrame, texts: DataFrame, near: Near) -> DataFrame:
    """The pairs whose texts are similar."""
    both = _told_texts(_told_texts(pairs, "a", "b", texts, near), "b", "a", texts, near)
    return both.select("a", "b", "text_a", "text_b").mapInArrow(lambda it: _similar(it, near), "a long, b long")


def representatives(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """One row of each group of similar texts: that of the smallest doc_id (null comes last), then of the smallest text hash.

    Chosen by row: rows that repeat a doc_id count apart, and a group whose ids are all null keeps a row too. Of rows
    equal in doc_id and text one stays, that of the smallest hash over all columns. Rows are named by 64-bit hashes of
    both columns together.
    """
    columns = [f"c{i}" for i in range(len(docs.columns))]  # other columns may have any name
    plain = docs.toDF(*columns)
    doc_id, text = (F.col(columns[docs.columns.index(c)]) for c in ("doc_id", "text"))
    keyed = plain.withColumns({"doc_id": doc_id, "text": text, "id_hash": F.xxhash64(doc_id), "text_hash": F.xxhash64(text)})
    kinds = [(near.ball.shingle, True), (near.shingle, True)]
    prints = written(fingerprints(keyed, kinds, near.ball.seed, ["doc_id", "id_hash", "text_hash"]), "prints")
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash", "id_hash")
    nodes = prints.groupBy("text_hash", "print", "print1").agg(F.min(first).alias("first"))
    nodes = written(nodes.drop("text_hash").withColumn("node", F.monotonically_increasing_id()), "nodes")
    drop(prints)
    found = written(_met_and_left(nodes, near).groupBy("a", "b").agg(F.min("run").alias("run")), "pairs")
    pairs, left = found.where("run is null").select("a", "b"), found.where("run is not null").select(F.col("a").alias("node")).distinct()
    paired = found.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "node")
    wanted = nodes.join(paired, "node", "left_semi").select("node", "first.id_hash", "first.text_hash")
    texts = keyed.select("id_hash", "text_hash", "text").join(wanted, ["id_hash", "text_hash"]).select("node", "text")
    texts = written(texts.dropDuplicates(["node"]), "texts")
    roots = components(_verified(pairs, texts, near))
    if not left.isEmpty():
        more = written(_left_candidates(left, roots, nodes, texts, near).distinct(), "left-pairs")
        if not more.isEmpty():
            roots = components(roots.toDF("a", "b").union(_verified(more, texts, near)))
        drop(more)
    drop(found)
    drop(texts)
    named = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    kept = keyed.join(named.select("first.id_hash", "first.text_hash"), ["id_hash", "text_hash"], "left_semi")
    nth = F.row_number().over(Window.partitionBy("id_hash", "text_hash").orderBy(F.xxhash64(*columns)))
    return kept.withColumn("nth", nth).where("nth = 1").select(*columns).toDF(*docs.columns)
