"""Hard negatives from a vector-approximation file.

Rows become integer vectors; rows of one vector and label become one node, whose smallest ids stand for all. The nodes are
stored in blocks, each dimension quantised into cells. For an anchor, a table of its products with each cell's edges gives
a lower and an upper bound of every row's score; only rows whose bounds allow them a place are scored exactly, from
the vectors that lie beside the cells. A first pass finds every anchor's positives, a second fills the windows below them.
Anchors go around in waves of bounded size, every wave against all rows; tasks keep the few best of each anchor or window.

Cell edges come from quantiles of at most ``Params.sample`` nodes; they decide how tight bounds are, never what is found.
The outermost cells of a block end at the block's own extremes.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part, nor do rows whose
length is not the commonest one or with a component beyond ``LIMIT`` after scaling, whose products a long can't hold; a null
id takes no part; rows that share an id are rows of their own; an anchor without positives, or a positive without negatives
in its window, gives no row, and no window lies below a positive of a negative score; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import drop, written

#: Largest component after scaling.
LIMIT = 1 << 28
_NONE = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Params:
    """``wave``: anchors sent to the tasks at once, ``wave_bytes`` their most; ``block``: nodes of a block."""

    top: int = 5
    lower_percent: int = 80
    upper_percent: int = 100
    scale: int = 256
    cells: int = 64
    sample: int = 10_000
    block: int = 1024
    wave: int = 1 << 16
    wave_bytes: int = 32 << 20


def usable(vectors: DataFrame, scale: int, id_col: str, vec_col: str, label: Column) -> tuple[DataFrame, int]:
    """(id, label, vec as array<int>) of the rows that take part, and their length."""
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")) & (F.abs(x) * scale <= float(LIMIT - 1)))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.where("id is not null and label is not null and vec is not null").where(fine)
    sizes = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    width = sizes[0]["n"] if sizes else 1
    return rows.where((F.size("vec") == width) & (F.size("vec") > 0)).select("id", "label", F.transform("vec", lambda x: F.floor(x * F.lit(float(scale))).cast("int")).alias("vec")), width


def nodes_of(rows: DataFrame, p: Params) -> DataFrame:
    """Distinct (label, vec) with a name and the smallest ids, one more than any answer needs."""
    nth = F.row_number().over(Window.partitionBy("vec", "label").orderBy("id"))
    few = rows.withColumn("nth", nth).where(F.col("nth") <= p.top + 1)
    return few.groupBy("vec", "label").agg(F.sort_array(F.collect_list("id")).alias("members")).withColumn("node", F.monotonically_increasing_id())


def edges_of(nodes: DataFrame, width: int, p: Params) -> np.ndarray:
    """For each dimension the inner cell edges: row d holds the least value of cells 1, 2, ..."""
    sample = nodes.select("vec").orderBy(F.xxhash64("vec")).limit(p.sample).toArrow()
    x = sample["vec"].combine_chunks().flatten().to_numpy().reshape(sample.num_rows, width) if sample.num_rows else np.zeros((1, width))
    return np.ceil(np.quantile(x, np.arange(1, p.cells) / p.cells, axis=0)).T.astype(np.int64)


def cells_of(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(e, own, "right") for e, own in zip(edges, x.T, strict=True)], 1).astype(np.uint8) if x.shape[1] else np.zeros(x.shape, np.uint8)


def _blocks(batches: Iterator[pa.RecordBatch], width: int, edges: np.ndarray, p: Params) -> Iterator[pa.RecordBatch]:
    """Nodes as blocks, by label: cells and vectors as matrices, and the extremes of each dimension."""
    held: list[pa.RecordBatch] = []

    def made(least: int) -> Iterator[pa.RecordBatch]:
        nonlocal held
        table = pa.Table.from_batches(held).combine_chunks()
        while table.num_rows >= least:
            b = table.slice(0, p.block).to_batches()[0]
            table = table.slice(len(b))
            x = b["vec"].flatten().to_numpy().reshape(len(b), width)
            ends = np.stack([x.min(0), x.max(0)]).astype(np.int32)
            one = [[b["node"].to_pylist()], [b["label"].to_pylist()], [b["members"].to_pylist()], [cells_of(x, edges).tobytes()], [x.astype(np.int32).tobytes()], [ends.tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(one, _KINDS, strict=True)], ["node", "label", "members", "cells", "vecs", "ends"])
        held = table.to_batches()

    for b in batches:
        held.append(b)
        if sum(map(len, held)) >= p.block:
            yield from made(p.block)
    if sum(map(len, held)):
        yield from made(1)


_KINDS = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64())), pa.binary(), pa.binary(), pa.binary()]


@dataclass
class Block:
    node: np.ndarray
    label: np.ndarray
    members: pa.ListArray
    x: np.ndarray
    middle: np.ndarray
    half: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch, i: int, width: int, edges: np.ndarray) -> Block:
        node, label, members = (batch[c][i].values for c in ("node", "label", "members"))
        n = len(node)
        cells = np.frombuffer(batch["cells"][i].as_py(), np.uint8).reshape(n, width)
        x = np.frombuffer(batch["vecs"][i].as_py(), np.int32).reshape(n, width).astype(np.int64)
        least, most = np.frombuffer(batch["ends"][i].as_py(), np.int32).reshape(2, width, 1).astype(np.int64)
        low = np.clip(np.concatenate([least, edges], 1), least, most)
        high = np.clip(np.concatenate([edges - 1, most], 1), least, most)
        at = np.arange(width)
        low, high = low[at, cells].astype(np.float64), high[at, cells].astype(np.float64)
        return cls(node.to_numpy(), label.to_numpy(), members, x, (low + high) / 2, (high - low) / 2)

    def bounds(self, q: np.ndarray, rows: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores of ``rows`` with the vectors ``q``; a little wider than rounding can be."""
        q = q.astype(np.float64)
        middle, half = q @ self.middle[rows].T, np.abs(q) @ self.half[rows].T
        slack = np.abs(q).sum(1, keepdims=True) * (np.abs(self.middle[rows]).max(initial=0) + 1) * 2.0**-44 + 0.25
        return middle - half - slack, middle + half + slack

    def scores(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", q, self.x[rows])

    def ids(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each row's members, and how many each has."""
        size = np.diff(self.members.offsets.to_numpy())[rows]
        start = self.members.offsets.to_numpy()[:-1][rows]
        at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return self.members.values.to_numpy()[at], size


class Best:
    """The first ``top`` rows of each of ``n`` lists, by score downwards and id upwards."""

    def __init__(self, n: int, top: int):
        self.n, self.top = n, top
        self.of, self.score, self.id, self.node = (np.zeros(0, np.int64) for _ in range(4))
        self.least = np.full(n, _NONE)

    def add(self, of: np.ndarray, score: np.ndarray, id_: np.ndarray, node: np.ndarray) -> None:
        of, score, id_, node = (np.concatenate(pair) for pair in ((self.of, of), (self.score, score), (self.id, id_), (self.node, node)))
        order = np.lexsort((id_, -score, of))
        of, score, id_, node = of[order], score[order], id_[order], node[order]
        nth = np.arange(len(of)) - np.searchsorted(of, of)
        few = nth < self.top
        self.of, self.score, self.id, self.node, nth = of[few], score[few], id_[few], node[few], nth[few]
        full = nth == self.top - 1
        self.least[self.of[full]] = self.score[full]


@dataclass
class Wave:
    """Anchor nodes by label, and (second pass) their windows: below ``positive[i]`` of anchor ``of[i]`` from ``low[i]`` to ``high[i]``."""

    node: np.ndarray
    label: np.ndarray
    q: np.ndarray
    of: np.ndarray | None = None
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    positive: np.ndarray | None = None

    def windows(self, q: np.ndarray, score: np.ndarray, p: Params) -> None:
        """One for each anchor and score of a positive, anchors in their order."""
        at = np.argsort(self.node)
        of = at[np.searchsorted(self.node, q, sorter=at)]
        low, high = -(-p.lower_percent * score // 100), p.upper_percent * score // 100
        order = np.lexsort((-score, of))
        order = order[low[order] <= high[order]]
        self.of, self.low, self.high, self.positive = of[order], low[order], high[order], score[order]


#: Anchors that are bounded against a block at a time.
STRIP = 256


def _positives(batches: Iterator[pa.RecordBatch], wave: Wave, width: int, edges: np.ndarray, p: Params) -> Iterator[pa.RecordBatch]:
    best, top = Best(len(wave.node), p.top + 1), p.top + 1
    for batch in batches:
        for i in range(len(batch)):
            block = Block.of(batch, i, width, edges)
            for label in np.unique(block.label):
                rows = np.flatnonzero(block.label == label)
                first, last = np.searchsorted(wave.label, [label, label + 1])
                for at in range(first, last, STRIP):
                    own = np.arange(at, min(at + STRIP, last))
                    lower, upper = block.bounds(wave.q[own], rows)
                    least = best.least[own].astype(np.float64)
                    if len(rows) >= top:
                        least = np.maximum(least, np.partition(lower, len(rows) - top, 1)[:, len(rows) - top])
                    a, r = np.nonzero(upper >= least[:, None])
                    a, r = own[a], rows[r]
                    score = block.scores(wave.q[a], r)
                    good = score >= best.least[a]
                    ids, size = block.ids(r[good])
                    best.add(*(np.repeat(v[good], size) for v in (a, score)), ids, np.repeat(block.node[r[good]], size))
    yield pa.RecordBatch.from_arrays([pa.array(wave.node[best.of]), pa.array(best.node), pa.array(best.id), pa.array(best.score)], ["q", "node", "id", "score"])


def _negatives(batches: Iterator[pa.RecordBatch], wave: Wave, width: int, edges: np.ndarray, p: Params) -> Iterator[pa.RecordBatch]:
    best = Best(len(wave.of), p.top)
    start = np.searchsorted(wave.of, np.arange(len(wave.node) + 1))
    asked = np.flatnonzero(np.diff(start))
    for batch in batches:
        for i in range(len(batch)):
            block = Block.of(batch, i, width, edges)
            for at in range(0, len(asked), STRIP):
                own = asked[at : at + STRIP]
                lower, upper = block.bounds(wave.q[own])
                least = np.maximum(wave.low, best.least)
                floor = np.minimum.reduceat(least[: start[own[-1] + 1]], start[own]).astype(np.float64)  # windows of one anchor are consecutive
                a, r = np.nonzero((upper >= floor[:, None]) & (wave.label[own][:, None] != block.label))
                size = (start[own + 1] - start[own])[a]
                w = np.repeat(start[own][a] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                pair = np.repeat(np.arange(len(a)), size)
                may = (upper[a, r][pair] >= least[w]) & (lower[a, r][pair] <= wave.high[w])
                w, pair = w[may], pair[may]
                used, pair = np.unique(pair, return_inverse=True)
                score = block.scores(wave.q[own[a[used]]], r[used])[pair]
                good = (score >= least[w]) & (score <= wave.high[w])
                rows = r[used][pair[good]]
                ids, size = block.ids(rows)
                best.add(*(np.repeat(v[good], size) for v in (w, score)), ids, np.repeat(block.node[rows], size))
    yield pa.RecordBatch.from_arrays([pa.array(wave.node[wave.of[best.of]]), pa.array(wave.positive[best.of]), pa.array(best.id), pa.array(best.score)], ["q", "positive", "id", "score"])


def _pass(blocks: DataFrame, wave: Wave, work: Callable, width: int, edges: np.ndarray, p: Params, schema: str) -> DataFrame:
    held = blocks.sparkSession.sparkContext.broadcast((wave, edges))
    return blocks.mapInArrow(lambda it: work(it, held.value[0], width, held.value[1], p), schema)


def _first(rows: DataFrame, by: list[str], top: int, name: str) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
    return rows.withColumn(name, nth).where(F.col(name) <= top)


def mine(vectors: DataFrame, is_anchor: Column, p: Params = Params(), id_col: str = "vec_id", vec_col: str = "embedding", label: Column | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for every row where ``is_anchor`` (of ``id``) holds."""
    rows, width = usable(vectors, p.scale, id_col, vec_col, F.col("label") if label is None else label)
    rows = written(rows, "negatives-rows")
    nodes = written(nodes_of(rows, p), "negatives-nodes")
    edges = edges_of(nodes, width, p)
    dealt = nodes.repartition("node").sortWithinPartitions("label", "node")
    blocks = dealt.mapInArrow(lambda it: _blocks(it, width, edges, p), "node array<long>, label array<long>, members array<array<bigint>>, cells binary, vecs binary, ends binary")
    blocks = written(blocks, "negatives-blocks")
    asked = rows.where(is_anchor).join(nodes.select("node", "vec", "label"), ["vec", "label"])
    asked = written(asked.select(F.col("id").alias("anchor_id"), F.col("node").alias("q"), "label", "vec"), "negatives-anchors")
    anchors = asked.groupBy("q").agg(F.first("label").alias("label"), F.first("vec").alias("vec"))
    in_wave = max(1, min(p.wave, p.wave_bytes // (8 * width + 400)))
    waves = -(-anchors.count() // in_wave)
    anchors = written(anchors.withColumn("wave", F.pmod(F.xxhash64("q", F.lit(1)), F.lit(max(waves, 1)))), "negatives-queries", by="wave")
    positives, negatives = [], []
    for turn in range(waves):
        own = anchors.where(F.col("wave") == turn).toArrow().sort_by([("label", "ascending"), ("q", "ascending")])
        wave = Wave(own["q"].to_numpy(), own["label"].to_numpy(), own["vec"].combine_chunks().flatten().to_numpy().reshape(own.num_rows, width).astype(np.int64))
        near = _first(_pass(blocks, wave, _positives, width, edges, p, "q long, node long, id long, score long"), ["q"], p.top + 1, "nth")
        near = written(near, "positives")
        positives.append(near)
        scores = near.select("q", "score").distinct().toArrow()
        wave.windows(scores["q"].to_numpy(), scores["score"].to_numpy(), p)
        found = _pass(blocks, wave, _negatives, width, edges, p, "q long, positive long, id long, score long")
        found = _first(found, ["q", "positive"], p.top, "rank")
        negatives.append(written(found, "negatives"))
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not waves:
        return vectors.sparkSession.createDataFrame([], schema)
    for table in (blocks, nodes, rows, anchors):
        drop(table)
    return _joined(asked, _all(positives), _all(negatives), p)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _joined(asked: DataFrame, positives: DataFrame, negatives: DataFrame, p: Params) -> DataFrame:
    """Each anchor's first positives but itself (one row, where others share its id), with what lies in their windows."""
    below = negatives.groupBy("q", F.col("positive").alias("score")).agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("below"))
    copy = F.row_number().over(Window.partitionBy("q", "node", "id").orderBy("nth"))
    near = positives.withColumn("copy", copy).join(below, ["q", "score"], "left")
    near = near.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("nth", "node", "id", "score", "copy", "below"))).alias("near"))
    itself = lambda n: (n["node"] == F.col("q")) & (n["id"] == F.col("anchor_id")) & (n["copy"] == 1)
    each = asked.select("anchor_id", "q").join(near, "q").select("anchor_id", F.explode(F.slice(F.filter("near", lambda n: ~itself(n)), 1, p.top)).alias("n"))
    each = each.select("anchor_id", F.col("n.id").alias("positive_id"), F.col("n.score").alias("positive_score"), F.explode("n.below").alias("b"))
    return each.select("anchor_id", "positive_id", F.col("b.rank").cast("int").alias("rank"), F.col("b.id").alias("negative_id"), "positive_score", F.col("b.score").alias("negative_score"))
