"""Centroid clustering: Lloyd's rounds with exponion search, in exact integers.

Vectors become integers and are stored once, in blocks, as a table bucketed by block. What a round remembers of a vector
(its cluster, an upper bound of the distance to that centroid, a lower bound of the distance to any other) lies in a small
table of the same buckets, so each round joins the two without a shuffle and writes the small one anew. A vector whose
bounds prove its centroid the nearest is left alone; any other scans the centroids inside a ball around its current one,
found in that centroid's sorted list of distances to the others. The radius is inclusive and bounds are rounded outwards,
so ties are always seen and go to the smaller number. Only vectors that change their cluster add to a round's sums.

Defined results: vectors of another length, null ones and those with a null or non-finite component take no part, nor do
those with a component beyond ``LIMIT`` after scaling, whose distances a long can't hold; a null id is clustered, but
begins no centroid before others do; repeated rows are vectors of their own; with fewer vectors than centroids there are
as many centroids as vectors; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, folder, written

#: Largest component after scaling.
LIMIT = 1 << 27
#: Stands for a squared distance that nothing has.
_FAR = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Params:
    """``k`` centroids stay on the driver and in every task, so k * width must be small; ``seed`` picks the first ones."""

    k: int = 8
    rounds: int = 10
    width: int = 64
    scale: int = 1024
    seed: int = 3
    block: int = 256


def usable(vectors: DataFrame, p: Params, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec as array<int>) of the rows that take part."""
    scaled = lambda x: F.floor(x * F.lit(float(p.scale)))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")) & (F.abs(x) * p.scale <= float(LIMIT - 1)))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return rows.where((F.size("vec") == p.width) & fine).select("id", F.transform("vec", lambda x: scaled(x).cast("int")).alias("vec"))


def first_centroids(rows: DataFrame, p: Params) -> np.ndarray:
    """The vectors whose hashed ids come first; equal hashes by the vector itself."""
    hashed = F.sha2(F.concat(F.lit(f"{p.seed}:"), F.col("id").cast("string")), 256)
    first = rows.orderBy(hashed.asc_nulls_last(), "vec").limit(p.k).select("vec").collect()
    return np.array([r["vec"] for r in first], np.int64).reshape(len(first), p.width)


def _blocks(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """Rows gathered into blocks: an identifier, ids, and the vectors as one matrix of the smallest integers that hold them."""
    number = TaskContext.get().partitionId() << 32
    held: list[pa.RecordBatch] = []

    def made(size: int) -> Iterator[pa.RecordBatch]:
        nonlocal number, held
        table = pa.Table.from_batches(held).combine_chunks()
        while table.num_rows >= size and table.num_rows:
            part = table.slice(0, p.block).to_batches()[0]
            x = part["vec"].flatten().to_numpy(zero_copy_only=False)
            kind = np.int16 if not len(x) or np.abs(x).max() < 1 << 15 else np.int32
            ids = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part["id"])
            yield pa.RecordBatch.from_arrays([pa.array([number]), ids, pa.array([x.astype(kind).tobytes()], pa.binary())], ["block", "ids", "vecs"])
            number += 1
            table = table.slice(len(part))
        held = table.to_batches() if table.num_rows else []

    for b in batches:
        held.append(b)
        if sum(map(len, held)) >= p.block:
            yield from made(p.block)
    if held:
        yield from made(1)


def _vectors(data: bytes, n: int, width: int) -> np.ndarray:
    return np.frombuffer(data, np.int16 if len(data) == 2 * n * width else np.int32).reshape(n, width).astype(np.int64)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def _up(x: np.ndarray) -> np.ndarray:
    """The float32 above, for upper bounds."""
    return np.nextafter(np.nextafter(np.asarray(x, np.float64), np.inf).astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.nextafter(np.asarray(x, np.float64), -np.inf).astype(np.float32), np.float32(-np.inf))


class Geometry:
    """Centroids with, for each, the others by distance."""

    def __init__(self, c: np.ndarray):
        self.c, k = c, len(c)
        square = np.stack([_squares(c, one) for one in c]) if k else np.zeros((0, 0), np.int64)
        dist = np.sqrt(square.astype(np.float64))
        self.order = [sorted((j for j in range(k) if j != i), key=lambda j: (square[i, j], j)) for i in range(k)]
        self.near = [_down(dist[i][self.order[i]]) for i in range(k)]
        self.gap = np.array([n[0] if len(n) else np.inf for n in self.near], np.float32)
        self.gap_above = np.array([_up(dist[i][o[0]]) if o else np.float32(np.inf) for i, o in enumerate(self.order)], np.float32)


def exponion(x: np.ndarray, a: np.ndarray, u: np.ndarray, low: np.ndarray, g: Geometry) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """New cluster, upper and lower bound of each row of ``x``, and how many distances to other centroids were taken."""
    a, u, low, scans = a.copy(), u.copy(), low.copy(), 0
    for c in np.unique(a):
        rows = np.flatnonzero((a == c) & ~(u < np.maximum(low, g.gap[a] / 2)))
        own = _squares(x[rows], g.c[c])
        u[rows] = _up(np.sqrt(own))
        open_ = ~(u[rows] < np.maximum(low[rows], g.gap[c] / 2))
        rows, best = rows[open_], own[open_]
        name, second = np.full(len(rows), c), np.full(len(rows), _FAR)
        reach = np.searchsorted(g.near[c], _up(2 * u[rows].astype(np.float64) + g.gap_above[c]), "right")
        for t in range(int(reach.max()) if len(rows) else 0):
            at = np.flatnonzero(reach > t)
            j = g.order[c][t]
            d = _squares(x[rows[at]], g.c[j])
            scans += len(at)
            won = (d < best[at]) | ((d == best[at]) & (j < name[at]))
            second[at] = np.minimum(second[at], np.where(won, best[at], d))
            best[at], name[at] = np.where(won, d, best[at]), np.where(won, j, name[at])
        a[rows], u[rows] = name, _up(np.sqrt(best))
        low[rows] = np.where(second == _FAR, np.float32(np.inf), _down(np.sqrt(second.astype(np.float64))))
    return a, u, low, scans


def _round(batches: Iterator[pa.RecordBatch], g: Geometry, moved: np.ndarray, p: Params) -> Iterator[pa.RecordBatch]:
    """One round over blocks joined with what is remembered of them (null at first). ``moved``: how far each centroid went."""
    k = len(g.c)
    others = np.array([max([0.0, *np.delete(moved, i)]) for i in range(k)])
    for batch in batches:
        out = []
        for block, ids, vecs, was, above, below in zip(*(batch[c] for c in ("block", "ids", "vecs", "cluster", "above", "below")), strict=True):
            n = len(ids)
            x = _vectors(vecs.as_py(), n, p.width)
            if was.is_valid:
                old, u, low = (np.frombuffer(y.as_py(), kind) for y, kind in ((was, np.int32), (above, np.float32), (below, np.float32)))
                u, low = _up(u.astype(np.float64) + moved[old]), _down(low.astype(np.float64) - others[old])
                start = old
            else:
                old, start = np.full(n, -1, np.int32), np.zeros(n, np.int32)
                u, low = np.full(n, np.inf, np.float32), np.zeros(n, np.float32)
            a, u, low, _ = exponion(x, start, u, low, g)
            change = np.flatnonzero(a != old)
            delta = None
            if len(change):
                sign = np.zeros((k, len(change)))
                sign[a[change], np.arange(len(change))] = 1
                gone = np.flatnonzero(old[change] >= 0)
                sign[old[change][gone], gone] -= 1
                delta = np.concatenate([sign @ x[change], sign.sum(1, keepdims=True)], 1).astype(np.int64).ravel()
            out.append((block, a.astype(np.int32).tobytes(), u.tobytes(), low.tobytes(), delta))
        names = ["block", "cluster", "above", "below", "delta"]
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i].as_py() if i == 0 else r[i] for r in out], kind) for i, kind in enumerate(kinds)], names)


def _last(batches: Iterator[pa.RecordBatch], c: np.ndarray, p: Params) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, vecs, cluster in zip(batch["ids"], batch["vecs"], batch["cluster"], strict=True):
            a = np.frombuffer(cluster.as_py(), np.int32)
            d = _squares(_vectors(vecs.as_py(), len(ids), p.width), c[a])
            yield pa.RecordBatch.from_arrays([ids.values, pa.array(a), pa.array(d)], ["vec_id", "cluster", "distance"])


def _bucketed(df: DataFrame, name: str, buckets: int) -> tuple[DataFrame, str]:
    """A table in the shared folder, dealt by block into files that joins on the block read side by side."""
    name = f"convoforge_{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(buckets, "block").option("path", f"{folder(df.sparkSession)}/{name}").saveAsTable(name)
    return df.sparkSession.table(name), name


def _gone(table: DataFrame, name: str) -> None:
    drop(table)
    table.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


def cluster(vectors: DataFrame, p: Params = Params(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that takes part."""
    spark = vectors.sparkSession
    rows = usable(vectors, p, id_col, vec_col)
    kind = rows.schema["id"].dataType.simpleString()
    c = first_centroids(rows, p)
    k = len(c)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = rows.mapInArrow(lambda it: _blocks(it, p), f"block long, ids array<{kind}>, vecs binary")
    blocks, blocks_name = _bucketed(blocks.repartition(buckets, "block"), "blocks", buckets)
    state, state_name = None, ""
    sums, counts, moved = np.zeros((k, p.width), object), np.zeros(k, object), np.zeros(k)
    schema = "block long, cluster binary, above binary, below binary, delta array<bigint>"
    for turn in range(p.rounds + 1 if k else 0):
        known = blocks.withColumns({n: F.lit(None).cast("binary") for n in ("cluster", "above", "below")}) if state is None else blocks.join(state.drop("delta").hint("shuffle_hash"), "block")
        now = known.mapInArrow(lambda it, g=Geometry(c), m=moved: _round(it, g, m, p), schema)
        then, then_name = _bucketed(now, "state", buckets)
        if state is not None:
            _gone(state, state_name)
        state, state_name = then, then_name
        deltas = state.where("delta is not null").select(F.posexplode("delta")).groupBy("pos").agg(F.sum("col").alias("sum")).collect()
        if not deltas or turn == p.rounds:  # nothing changed, so nothing will in the rounds to come
            break
        total = np.zeros(k * (p.width + 1), object)
        for r in deltas:
            total[r["pos"]] = int(r["sum"])
        total = total.reshape(k, p.width + 1)
        sums, counts = sums + total[:, :-1], counts + total[:, -1]
        new = np.array([[s // n for s in own] if n else list(old) for own, n, old in zip(sums, counts, c, strict=True)], np.int64)
        moved = _up(np.sqrt(_squares(new, c).astype(np.float64))).astype(np.float64)
        c = new
    out = f"vec_id {kind}, cluster int, distance long"
    if not k:
        return spark.createDataFrame([], f"{out}, cluster_inertia long, inertia long, centroid_sha256 string")
    rated = blocks.join(state.select("block", "cluster").hint("shuffle_hash"), "block").mapInArrow(lambda it: _last(it, c, p), out)
    rated = written(rated, "clustered")
    _gone(state, state_name)
    _gone(blocks, blocks_name)
    each = {r["cluster"]: int(r["sum"]) for r in rated.groupBy("cluster").agg(F.sum("distance").alias("sum")).collect()}
    text = [hashlib.sha256(",".join(map(str, one)).encode()).hexdigest() for one in c.tolist()]
    about = spark.createDataFrame([(j, s, sum(each.values()), text[j]) for j, s in each.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rated.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
