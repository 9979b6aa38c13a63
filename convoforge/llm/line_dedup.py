"""Reversible line deduplication: exact reference counts behind sharded cuckoo filters.

A line's key is the line without surrounding ``[\\x20\\x09-\\x0D]``, A-Z lower-cased; keys of ``min_chars`` code points
found in ``min_docs`` documents are droppable: only the largest doc_id that holds such a key keeps its lines.

``LineIndex`` holds two exact tables, references (key, doc_id, lines) and droppable keys (key, documents, keeper), and
one cuckoo filter per shard of the droppable keys. ``insert`` and ``delete`` add or take back documents: reference
counts change, keys that cross the limit enter or leave their shard's filter, and the state is the same as if only the
remaining documents had ever been seen. Both tables lie in one folder for each leaf (a range of key hashes): an update
reads and writes the leaves of the keys it changes, as a layer over the others, and after ``layers`` updates the layers
become one table. ``apply`` probes the filters, so that only likely droppable lines are joined
with the exact table, which has the last word. Filters are broadcast while their checked size allows it and
otherwise meet the lines shard by shard, in salted groups.

Defined results: a null or empty text is one empty line; rows that share a doc_id are one document, and its drops
hold for each of them; rows with a null doc_id neither count nor lose lines; an empty table gives an empty result;
further columns of ``docs`` are carried along, but those named like the results are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import drop, written
from .textbytes import U64, chunks, mix

BLANK = b" \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Params:
    min_chars: int = 40
    min_docs: int = 5
    shard_keys: int = 100_000
    broadcast_bytes: int = 64 << 20
    salts: int = 16
    leaf_rows: int = 2_000_000
    least_leaves: int = 64
    layers: int = 8


class CuckooFilter:
    """Partial-key cuckoo filter: 16-bit prints in buckets of four; supports deletion. Works on arrays of 64-bit hashes."""

    SLOTS, KICKS = 4, 500

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def for_keys(cls, n: int) -> CuckooFilter:
        buckets = 1 << max(4, int(np.ceil(np.log2(max(n, 1) / (cls.SLOTS * 0.8)))))
        return cls(np.zeros((buckets, cls.SLOTS), np.uint16))

    @classmethod
    def load(cls, raw: bytes) -> CuckooFilter:
        return cls(np.frombuffer(raw, np.uint16).reshape(-1, cls.SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hashes = mix(hashes.astype(np.int64).view(U64))
        prints = np.maximum((hashes >> U64(48)).astype(np.uint16), 1)
        first = (hashes & U64(len(self.table) - 1)).astype(np.int64)
        return prints, first, self._other(first, prints)

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(prints.astype(U64)) & U64(len(self.table) - 1)).astype(np.int64)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        prints, first, second = self._places(hashes)
        return ((self.table[first] == prints[:, None]) | (self.table[second] == prints[:, None])).any(1)

    def insert(self, hashes: np.ndarray) -> bool:
        """False if the filter is too full; it must then be built anew, larger, from the exact table."""
        prints, first, second = self._places(hashes)
        waiting = np.arange(len(prints))
        for bucket in (first, second):
            while len(waiting):  # one key per bucket and round
                _, pick = np.unique(bucket[waiting], return_index=True)
                at = waiting[pick]
                free = self.table[bucket[at]] == 0
                open_ = free.any(1)
                self.table[bucket[at[open_]], free[open_].argmax(1)] = prints[at[open_]]
                placed = np.zeros(len(prints), bool)
                placed[at[open_]] = True
                closed = np.isin(bucket[waiting], bucket[at[~open_]])
                rest = waiting[~placed[waiting]]
                if closed.all() or not open_.any():
                    waiting = rest
                    break
                waiting = rest
        rng = np.random.default_rng(len(prints))
        for i in waiting:
            print_, bucket = prints[i], second[i]
            for _ in range(self.KICKS):
                free = np.flatnonzero(self.table[bucket] == 0)
                if len(free):
                    self.table[bucket, free[0]] = print_
                    break
                slot = rng.integers(self.SLOTS)
                print_, self.table[bucket, slot] = self.table[bucket, slot], print_
                bucket = int(self._other(np.array([bucket]), np.array([print_]))[0])
            else:
                return False
        return True

    def delete(self, hashes: np.ndarray) -> None:
        """Take back keys that were inserted."""
        for print_, *buckets in zip(*(x.tolist() for x in self._places(hashes)), strict=True):
            for bucket in buckets:
                found = np.flatnonzero(self.table[bucket] == print_)
                if len(found):
                    self.table[bucket, found[0]] = 0
                    break


def _key(line: bytes, least: int) -> bytes | None:
    """Digest of a line's key, or None if the key is too short."""
    if len(line) < least:
        return None
    key = line.strip(BLANK).lower()
    if len(key) < least or (not key.isascii() and len(key.decode("utf-8")) < least):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def _keys(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text", 4 << 20):
        for at in range(0, len(batch), 500):
            part = batch.slice(at, 500)
            keys, ids, counts = [], [], []
            for doc, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                if doc is None or not text:
                    continue
                own: dict[bytes, int] = {}
                for line in text.encode().split(b"\n"):
                    if (key := _key(line, p.min_chars)) is not None:
                        own[key] = own.get(key, 0) + 1
                keys += own
                counts += own.values()
                ids += [doc] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, part["doc_id"].type), pa.array(counts, pa.int64())], ["key", "doc_id", "n"])


def references(docs: DataFrame, p: Params) -> DataFrame:
    """(key, doc_id, n): how many lines of each document have each key."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(lambda it: _keys(it, p), f"key binary, doc_id {kind}, n long")
    return found.groupBy("key", "doc_id").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class LineIndex:
    """``depth``: layers over the first table; ``touched``: leaves that the last update wrote (all, if none are named)."""

    params: Params
    shards: int
    leaves: int
    references: DataFrame
    droppable: DataFrame
    filters: DataFrame
    depth: int = 0
    touched: tuple[int, ...] = ()


def _leaf(leaves: int):
    return F.pmod(F.xxhash64("key", F.lit(1)), F.lit(leaves)).cast("int").alias("leaf")


def _stored(rows: DataFrame, name: str) -> DataFrame:
    """A table with one folder a leaf; a leaf may hold a key of very many documents, so several tasks write it."""
    return written(rows.repartition("leaf", F.pmod(F.xxhash64(*[c for c in ("key", "doc_id") if c in rows.columns]), F.lit(4))), name, "leaf")


def _droppable(references: DataFrame, p: Params) -> DataFrame:
    own = [c for c in ("leaf",) if c in references.columns]
    found = references.groupBy("key", *own).agg(F.count("doc_id").alias("docs"), F.max("doc_id").alias("keeper"))
    return found.where(F.col("docs") >= p.min_docs).withColumn("hash", F.xxhash64("key"))


def _shard(shards: int):
    return F.pmod("hash", F.lit(shards)).cast("int")


FILTER = "shard int, keys long, full boolean, cuckoo binary"


def _filled(shard: int, hashes: np.ndarray) -> pd.DataFrame:
    size = len(hashes)
    while True:
        own = CuckooFilter.for_keys(size)
        if own.insert(hashes):
            return pd.DataFrame({"shard": [shard], "keys": [len(hashes)], "full": [False], "cuckoo": [own.dump()]})
        size *= 2


def _build_filters(droppable: DataFrame, shards: int) -> DataFrame:
    rows = droppable.select(_shard(shards).alias("shard"), "hash")
    return written(rows.groupBy("shard").applyInPandas(lambda key, rows: _filled(key[0], rows["hash"].to_numpy()), FILTER), "cuckoo")


def build(docs: DataFrame, p: Params = Params()) -> LineIndex:
    """An index that can be updated."""
    flat = written(references(docs, p), "line-references")
    leaves = max(p.least_leaves, -(-flat.count() // p.leaf_rows))
    refs = _stored(flat.withColumn("leaf", _leaf(leaves)), "line-references")
    drop(flat)
    droppable = _stored(_droppable(refs, p), "line-keys")
    shards = max(16, -(-droppable.count() // p.shard_keys))
    return LineIndex(p, shards, leaves, refs, droppable, _build_filters(droppable, shards))


def _turn(key, old: pd.DataFrame, steps: pd.DataFrame) -> pd.DataFrame:
    """The filter of one shard after keys came (step 1) and went (-1)."""
    new, gone = (steps["hash"][steps["step"] == s].to_numpy() for s in (1, -1))
    if not len(old):
        return _filled(key[0], new)
    own = CuckooFilter.load(old["cuckoo"][0])
    own.delete(gone)
    full = not own.insert(new)
    return pd.DataFrame({"shard": [key[0]], "keys": [int(old["keys"][0]) + len(new) - len(gone)], "full": [full], "cuckoo": [own.dump()]})


def _changed(index: LineIndex, docs: DataFrame, sign: int) -> LineIndex:
    p = index.params
    change = references(docs, p).withColumn("n", sign * F.col("n")).withColumn("leaf", _leaf(index.leaves))
    change = written(change, "line-changes")
    touched = sorted(r["leaf"] for r in change.select("leaf").distinct().collect())  # at most ``leaves``
    if not touched:
        return replace(index, touched=())
    here = F.col("leaf").isin(touched)
    refs = index.references.where(here).unionByName(change).groupBy("key", "doc_id", "leaf").agg(F.sum("n").alias("n")).where("n > 0")
    refs = _stored(refs, "line-references")
    droppable = _stored(_droppable(refs, p), "line-keys")
    before = index.droppable.where(here)
    come = droppable.join(before, "key", "left_anti").select("hash", F.lit(1).alias("step"))
    go = before.join(droppable, "key", "left_anti").select("hash", F.lit(-1).alias("step"))
    steps = written(come.union(go).withColumn("shard", _shard(index.shards)), "line-steps")
    drop(change)
    turned = sorted(r["shard"] for r in steps.select("shard").distinct().collect())  # at most ``shards``
    filters = index.filters
    if turned:
        there = F.col("shard").isin(turned)
        new = filters.where(there).groupBy("shard").cogroup(steps.groupBy("shard")).applyInPandas(_turn, FILTER)
        filters = filters.where(~there).unionByName(written(new, "cuckoo"))
    changed = replace(
        index, references=index.references.where(~here).unionByName(refs), droppable=index.droppable.where(~here).unionByName(droppable), filters=filters,
        depth=index.depth + 1, touched=tuple(touched),
    )
    if changed.depth > p.layers:
        refs, droppable = _stored(changed.references, "line-references"), _stored(changed.droppable, "line-keys")
        changed = replace(changed, references=refs, droppable=droppable, filters=written(changed.filters, "cuckoo"), depth=0)
    if changed.filters.where("full").limit(1).count():
        shards = max(index.shards, -(-changed.droppable.count() // p.shard_keys))
        changed = replace(changed, shards=shards, filters=_build_filters(changed.droppable, shards))
    return changed


def insert(index: LineIndex, docs: DataFrame) -> LineIndex:
    """The index with these documents added."""
    return _changed(index, docs, 1)


def delete(index: LineIndex, docs: DataFrame) -> LineIndex:
    """The index with these documents taken back; their texts must be those that were inserted."""
    return _changed(index, docs, -1)


def _probe(index: LineIndex, refs: DataFrame) -> DataFrame:
    """References whose key is in its shard's filter: all droppable ones, and a few others."""
    spark: SparkSession = refs.sparkSession
    p, shards = index.params, index.shards
    rows = refs.select("key", "doc_id", F.xxhash64("key").alias("hash")).withColumn("shard", _shard(shards))
    schema = refs.select("key", "doc_id").schema
    total = index.filters.agg(F.sum(F.length("cuckoo"))).first()[0] or 0
    if total <= p.broadcast_bytes:
        held = spark.sparkContext.broadcast({r["shard"]: bytes(r["cuckoo"]) for r in index.filters.collect()})

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = {k: CuckooFilter.load(v) for k, v in held.value.items()}
            for b in batches:
                hashes, shard = b["hash"].to_numpy(), b["shard"].to_numpy()
                keep = np.zeros(len(b), bool)
                order = np.argsort(shard, kind="stable")
                cuts = np.flatnonzero(np.diff(shard[order])) + 1
                for at in np.split(order, cuts):
                    if len(at) and int(shard[at[0]]) in own:
                        keep[at] = own[int(shard[at[0]])].contains(hashes[at])
                yield b.select(["key", "doc_id"]).filter(pa.array(keep))

        return rows.mapInArrow(probe, schema)
    n = max(p.salts, -(-refs.count() // (shards * p.leaf_rows)))
    salts = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("salt")
    filters = index.filters.select("shard", "cuckoo", salts)
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "key"), F.lit(n)).cast("int"))

    def meet(rows: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        if not len(filters):
            return rows.loc[[], ["key", "doc_id"]]
        return rows.loc[CuckooFilter.load(filters["cuckoo"][0]).contains(rows["hash"].to_numpy()), ["key", "doc_id"]]

    return rows.groupBy("shard", "salt").cogroup(filters.groupBy("shard", "salt")).applyInPandas(meet, schema)


def _strip(batches: Iterator[pa.RecordBatch], p: Params, carry: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text", 4 << 20):
        for at in range(0, len(batch), 500):
            part = batch.slice(at, 500)
            n_lines, n_dropped, digests, kept = [], [], [], []
            for text, drops in zip(part["text"].to_pylist(), part["drops"].to_pylist(), strict=True):
                lines = (text or "").encode().split(b"\n")
                n_lines.append(len(lines))
                if drops:
                    drops = set(drops)
                    lines = [x for x in lines if _key(x, p.min_chars) not in drops]
                n_dropped.append(n_lines[-1] - len(lines))
                whole = b"\n".join(lines)
                digests.append(hashlib.sha256(whole).hexdigest())
                kept.append(whole if n_dropped[-1] or text is not None else None)
            made = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())]
            names = ["n_lines", "n_dropped", "kept_sha256", "text"]
            keep = range(4 if "text" in carry else 3)
            others = [c for c in carry if c != "text"]
            yield pa.RecordBatch.from_arrays([*(part[c] for c in others), *(made[i] for i in keep)], [*others, *(names[i] for i in keep)])


def apply(index: LineIndex, docs: DataFrame, refs: DataFrame | None = None, carry: list[str] | None = None) -> DataFrame:
    """``docs`` without the droppable lines that another document keeps, with line counts and the digest of what stays.

    ``refs``: the references of exactly these documents, if they are at hand; they are counted otherwise.
    """
    p = index.params
    made = {"n_lines", "n_dropped", "kept_sha256", "drops"}
    carry = [c for c in docs.columns if c not in made] if carry is None else carry
    likely = _probe(index, references(docs, p) if refs is None else refs)
    known = index.droppable.select("key", "keeper")
    if known.count() * 64 <= p.broadcast_bytes:
        drops = likely.join(F.broadcast(known), "key")
    else:  # a line of very many documents meets its key in several tasks
        likely = likely.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(p.salts)).cast("int"))
        known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(p.salts - 1))))
        drops = likely.join(known, ["key", "salt"]).drop("salt")
    drops = drops.where("doc_id <> keeper")
    drops = drops.groupBy("doc_id").agg(F.collect_set("key").alias("drops"))
    rows = docs.select(*dict.fromkeys([*carry, "doc_id", "text"])).join(drops, "doc_id", "left")
    kept = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry if c != "text"]
    schema = ", ".join([*kept, "n_lines long, n_dropped long, kept_sha256 string", *(["text string"] if "text" in carry else [])])
    return rows.mapInArrow(lambda it: _strip(it, p, carry), schema)


def dedup(docs: DataFrame, p: Params = Params(), carry: list[str] | None = None) -> DataFrame:
    """Index ``docs``, for this once, and apply the index to them."""
    refs = written(references(docs, p), "line-references")
    droppable = written(_droppable(refs, p), "line-keys")
    shards = max(16, -(-droppable.count() // p.shard_keys))
    return apply(LineIndex(p, shards, 0, refs, droppable, _build_filters(droppable, shards)), docs, refs, carry)
