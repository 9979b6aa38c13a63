"""Approximate nearest neighbours by NN-descent.

Equal vectors become one node (with its smallest ids), so copies cost nothing and ties come out exactly. A first
neighbour graph comes from random projections: nodes sorted along them are compared in blocks of fixed size. Each
NN-descent round then joins neighbours of neighbours: every node introduces the members of its list (its neighbours
and a sample of the nodes that have it as theirs, new links first) to each other, and nodes keep the nearest ``k`` they
have met, until hardly a link is new. Queries walk the graph greedily: the best unvisited nodes of a beam are expanded until
nothing better turns up (or ``rounds`` are over); the best of the beam, and all whose float16 scores may hide one of the
best, are rescored in double precision on the original vectors.

Lists and beams are bounded per node by the method; list members are limited before the shuffle, and a task tells a node
no more than its ``k`` nearest, so a node that very many others point to gets no more than that from each task. Vectors travel as float16 in the graph's work.

Defined results: vectors that are null, zero or hold a null or non-finite component take no part, nor do those whose
length is not the commonest one; a null id takes no part; rows that share an id are one vector, the smallest; with fewer
candidates than asked all are returned; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import drop, written

#: So many met pairs are held by a task, 20 bytes each, before they are cut to the nearest of each node.
HELD = 1 << 20


@dataclass(frozen=True)
class Params:
    """Descents end when under ``settled`` of all links are new; ``rounding``: how far float16 may put a score wrong."""

    top: int = 5
    k: int = 32
    list_size: int = 60
    projections: int = 4
    block: int = 800
    descents: int = 6
    settled: float = 0.05
    beam: int = 160
    step: int = 40
    rounds: int = 16
    rescored: int = 24
    rounding: float = 0.004
    seed: int = 0
    broadcast_bytes: int = 32 << 20


def _matrix(column: pa.Array, width: int, kind=np.float16) -> np.ndarray:
    """Binary vectors as the rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, width), np.float32)
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width).astype(np.float32)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(id, vec as array<double>) of the rows that take part, and their length."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & fine)
    sizes = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    width = sizes[0]["n"] if sizes else 1
    return rows.where(F.size("vec") == width).groupBy("id").agg(F.min("vec").alias("vec")), width


def nodes_of(rows: DataFrame, p: Params) -> DataFrame:
    """Distinct vectors: node (their smallest id), vec, and members, their smallest ids: one more than any answer needs."""
    nth = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    few = rows.withColumn("nth", nth).where(F.col("nth") <= p.top + 1)
    return few.groupBy("vec").agg(F.min("id").alias("node"), F.sort_array(F.collect_list("id")).alias("members"))


def _small(batches: Iterator[pa.RecordBatch], width: int, p: Params) -> Iterator[pa.RecordBatch]:
    """Unit vectors as float16, and each node's place along every projection: side of some planes, then distance from one."""
    rng = np.random.default_rng(p.seed)
    planes = rng.normal(size=(p.projections, 7, width)).astype(np.float32)
    for b in batches:
        x = np.array(b["vec"].values.to_numpy(zero_copy_only=False)).reshape(len(b), width) if len(b) else np.zeros((0, width))
        x = x / np.abs(x).max(1, keepdims=True)
        x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
        places = []
        for own in planes:
            y = x @ own.T
            side = ((y[:, :6] > 0) << np.arange(6)).sum(1)
            places.append(np.stack([side.astype(np.float64) * 1000, y[:, 6]], 1).sum(1))
        places = np.stack(places, 1)
        small = pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())
        yield pa.RecordBatch.from_arrays([b["node"], small, *(pa.array(places[:, r]) for r in range(p.projections))], ["node", "v", *(f"place{r}" for r in range(p.projections))])


def _compared(batches: Iterator[pa.RecordBatch], width: int, p: Params) -> Iterator[pa.RecordBatch]:
    """Nearest nodes inside blocks of consecutive rows."""

    def block(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        s = x @ x.T
        np.fill_diagonal(s, -2)
        k = min(p.k, len(ids) - 1)
        near = np.argpartition(-s, k - 1, 1)[:, :k] if k > 0 else np.zeros((len(ids), 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, max(k, 0))), pa.array(ids[near].ravel()), pa.array(np.take_along_axis(s, near, 1).ravel())], ["a", "b", "s"])

    ids, x = np.zeros(0, np.int64), np.zeros((0, width), np.float32)
    for b in batches:
        ids, x = np.concatenate([ids, b["node"].to_numpy()]), np.concatenate([x, _matrix(b["v"], width)])
        while len(ids) >= 2 * p.block:
            yield block(ids[: p.block], x[: p.block])
            ids, x = ids[p.block :], x[p.block :]
    if len(ids):
        yield block(ids, x)


def _best(pairs: DataFrame, p: Params) -> DataFrame:
    """The k nearest of each node: (node, near array of (s, b, fresh)). Old links win over their repeats.

    Repeats of a pair become one before lists are cut to ``k``. Tasks send each pair once and at most ``k`` of a node.
    """
    each = pairs.repartition("a").groupBy("a", "b").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh"))
    nth = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), "b"))
    few = each.withColumn("nth", nth).where(F.col("nth") <= p.k)
    near = F.sort_array(F.collect_list(F.struct("s", "b", "fresh")), asc=False)
    return few.groupBy("a").agg(near.alias("near")).withColumnRenamed("a", "node")


def _nearest(a: np.ndarray, b: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair (a, b) once, with its best score, and of each ``a`` the ``k`` best."""
    order = np.lexsort((-s, b, a))
    a, b, s = a[order], b[order], s[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b, s = a[first], b[first], s[first]
    order = np.lexsort((b, -s, a))
    a, b, s = a[order], b[order], s[order]
    few = np.arange(len(a)) - np.searchsorted(a, a) < k
    return a[few], b[few], s[few]


def _introduced(batches: Iterator[pa.RecordBatch], width: int, p: Params) -> Iterator[pa.RecordBatch]:
    """Members of each list compared with each other; a pair is told to the side it could improve."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    n = 0
    for batch in batches:
        for at in range(0, len(batch), 200):
            lists = batch["list"].slice(at, 200)
            edges = lists.offsets.to_numpy()
            flat = lists.values.slice(edges[0], edges[-1] - edges[0])
            ids, fresh, least = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("b", "fresh", "least"))
            x = _matrix(flat.field("v"), width)
            for i, j in zip(edges[:-1] - edges[0], edges[1:] - edges[0], strict=True):
                s = x[i:j] @ x[i:j].T
                own, new = ids[i:j], fresh[i:j]
                good = (s > least[i:j, None]) & (new[:, None] | new) & (own[:, None] != own)
                u, w = np.nonzero(good)
                held.append((own[u], own[w], s[u, w].astype(np.float32)))
                n += len(u)
            if n > HELD:
                held = [_nearest(*map(np.concatenate, zip(*held, strict=True)), p.k)]
                n = len(held[0][0])
                if n > HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], ["a", "b", "s"])
                    held, n = [], 0
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in _nearest(*map(np.concatenate, zip(*held, strict=True)), p.k)], ["a", "b", "s"])


def graph(nodes: DataFrame, width: int, p: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """(node, near) neighbour lists, and (node, v) small vectors, both as tables in the shared folder."""
    places = ", ".join(f"place{r} double" for r in range(p.projections))
    small = written(nodes.select("node", "vec").mapInArrow(lambda it: _small(it, width, p), f"node long, v binary, {places}"), "ann-vectors")
    pairs = None
    for r in range(p.projections):
        dealt = small.select("node", "v", f"place{r}").repartitionByRange(F.col(f"place{r}"), F.col("node")).sortWithinPartitions(f"place{r}", "node")
        part = dealt.select("node", "v").mapInArrow(lambda it: _compared(it, width, p), "a long, b long, s float")
        pairs = part if pairs is None else pairs.union(part)
    links = written(_best(pairs.withColumn("fresh", F.lit(True)), p), "ann-graph")
    for turn in range(p.descents):
        each = links.select("node", F.explode("near").alias("n")).select(F.col("node").alias("a"), "n.b", "n.fresh")
        each = each.union(each.select("b", "a", "fresh"))
        nth = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("fresh"), F.xxhash64("a", "b", F.lit(turn))))
        lists = each.withColumn("nth", nth).where(F.col("nth") <= p.list_size).select("a", "b", "fresh")
        least = links.select("node", F.when(F.size("near") >= p.k, F.element_at("near", -1)["s"]).otherwise(F.lit(-2.0).cast("float")).alias("least"))
        known = small.select("node", "v").join(least, "node", "left").fillna(-2.0, ["least"]).withColumnRenamed("node", "b")
        lists = lists.join(known, "b").groupBy("a").agg(F.collect_list(F.struct("b", "fresh", "least", "v")).alias("list"))
        met = lists.select("list").mapInArrow(lambda it: _introduced(it, width, p), "a long, b long, s float").withColumn("fresh", F.lit(True))
        old = links.select(F.col("node").alias("a"), F.explode("near").alias("n")).select("a", "n.b", "n.s", F.lit(False).alias("fresh"))
        then = written(_best(old.union(met), p), "ann-graph")
        drop(links)
        links = then
        new = F.aggregate("near", F.lit(0), lambda n, x: n + F.when(x["fresh"], 1).otherwise(0))
        share = links.agg((F.sum(new) / F.sum(F.size("near"))).alias("share")).first()["share"]
        if not share or share < p.settled:
            break
    return links, small.select("node", "v")


def _scored(pairs: DataFrame, small: DataFrame, queries: DataFrame, width: int, p: Params) -> DataFrame:
    """Adds the cosine ``s`` to (q, node) rows. Query vectors are broadcast if their checked size allows it, else joined."""
    rows = pairs.join(small, "node")
    if queries.count() * (2 * width + 8) <= p.broadcast_bytes:
        table = queries.select("node", "v").toArrow()
        ids = table["node"].to_numpy()
        order = np.argsort(ids)
        held = pairs.sparkSession.sparkContext.broadcast((ids[order], _matrix(table["v"], width)[order]))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, vectors = held.value
            for b in batches:
                own = vectors[np.searchsorted(names, b["q"].to_numpy())]
                yield pa.RecordBatch.from_arrays([b["q"], b["node"], pa.array(np.einsum("ij,ij->i", own, _matrix(b["v"], width)))], ["q", "node", "s"])

        return rows.mapInArrow(score, "q long, node long, s float")

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["q"], b["node"], pa.array(np.einsum("ij,ij->i", _matrix(b["w"], width), _matrix(b["v"], width)))], ["q", "node", "s"])

    return rows.join(queries.select(F.col("node").alias("q"), F.col("v").alias("w")), "q").mapInArrow(both, "q long, node long, s float")


def walk(links: DataFrame, small: DataFrame, queries: DataFrame, width: int, p: Params = Params()) -> DataFrame:
    """(q, node, s): the beam of each query node after the greedy search. A query starts at its own place in the graph."""
    queries = queries.select("node", "v")
    near = links.select("node", F.transform("near", lambda n: n["b"]).alias("near"))
    beam = written(queries.select(F.col("node").alias("q"), "node", F.lit(1.0).cast("float").alias("s"), F.lit(False).alias("done")), "ann-beam")
    by = Window.partitionBy("q").orderBy(F.desc("s"), "node")
    for _ in range(p.rounds):
        turn = F.row_number().over(Window.partitionBy("q", "done").orderBy(F.desc("s"), "node"))
        beam_now = beam.withColumn("now", ~F.col("done") & (turn <= p.step))
        new = beam_now.where("now").select("q", "node").join(near, "node").select("q", F.explode("near").alias("node")).distinct()
        scored = _scored(new, small, queries, width, p).withColumn("done", F.lit(False))
        held = beam_now.select("q", "node", "s", (F.col("done") | F.col("now")).alias("done"))
        every = held.union(scored).groupBy("q", "node").agg(F.max("s").alias("s"), F.max("done").alias("done"))
        then = written(every.withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= p.beam).drop("nth"), "ann-beam")
        drop(beam)
        beam = then
        if not beam.where("not done").limit(1).count():
            break
    return beam


def search(vectors: DataFrame, is_query, p: Params = Params(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the ``p.top`` nearest found of every row for which the column ``is_query`` (of ``id``) holds."""
    rows, width = usable(vectors, id_col, vec_col)
    nodes = written(nodes_of(rows, p), "ann-nodes")
    links, small = graph(nodes, width, p)
    asked = rows.where(is_query).join(nodes, "vec").select(F.col("id").alias("query_id"), F.col("node").alias("q"))
    asked = written(asked, "ann-queries")
    beam = walk(links, small, small.join(asked.select(F.col("q").alias("node")).distinct(), "node", "left_semi"), width, p)
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "node"))
    last = F.min(F.when(F.col("nth") == p.top + 1, F.col("s"))).over(Window.partitionBy("q"))
    best = beam.withColumn("nth", nth).withColumn("last", last)
    best = best.where((F.col("nth") <= p.rescored) | (F.col("s") >= F.col("last") - p.rounding)).select("q", "node")
    own = nodes.select(F.col("node").alias("q"), F.col("vec").alias("query_vec"))
    best = best.join(nodes, "node").join(own, "q")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    score = dot("vec", "query_vec") / (F.sqrt(dot("vec", "vec")) * F.sqrt(dot("query_vec", "query_vec")))
    best = best.select("q", F.explode("members").alias("vec_id"), score.alias("score"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    best = best.withColumn("nth", rank).where(F.col("nth") <= p.top + 1)
    found = asked.join(best, "q").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= p.top).select("query_id", "rank", "vec_id", "score")
