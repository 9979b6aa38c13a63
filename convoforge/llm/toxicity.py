"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

Words are runs of letters and digits, A-Z lower-cased. A text's features are its distinct words, their beginnings (which
inflected forms share), pairs of neighbours, and pairs with one or two words left out between them, hashed into one table of coordinates. Training goes over the labelled
rows one at a time; each coordinate has a learning rate of its own, and the L1 term keeps all coordinates at zero whose
gradients don't add up, so few weights are left: these are broadcast, and every row is scored in Arrow batches.

The fit is on a sample bounded twice: the ``max_train_rows`` labelled rows whose hashed ids come first, and of these as
many as have ``max_train_features`` features in total.

Defined results: a null or empty text, or one without words, gets the score of the bias alone; a null doc_id or label
takes no part in training; a doc_id with several labels has the largest; repeated rows are scored alike; where the labelled
rows are all of one class, or none, no weight is learnt and every score is the share of ones (0 without rows); an empty
table gives an empty result; columns of the caller named like the result's are left out unless ``carry`` renames them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, written
from .textbytes import U64, Docs, chunks, mix, segment_hashes

#: ASCII bytes that part words; bytes of other characters belong to them.
_BREAK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


@dataclass(frozen=True)
class Params:
    """``stems``: lengths of beginnings in code points. ``rate`` and ``smooth`` shape the learning rate of a coordinate, ``l1`` and ``l2`` hold weights back."""

    bits: int = 20
    gaps: tuple[int, ...] = (1, 2, 3)
    stems: tuple[int, ...] = (4, 6)
    max_train_rows: int = 12_000
    max_train_features: int = 24_000_000
    epochs: int = 4
    rate: float = 1.0
    smooth: float = 1.0
    l1: float = 4.0
    l2: float = 1.0
    threshold: float = 0.5


@dataclass(frozen=True)
class Model:
    """The coordinates with a weight, in order."""

    at: np.ndarray
    weight: np.ndarray
    bias: float


def _grams(docs: Docs, p: Params) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each family of features: coordinates and the document of each."""
    starts, ends = docs.words(_BREAK[docs.data])
    of, hashes = docs.doc_of(starts), segment_hashes(docs.data, starts, ends)
    shift = U64(64 - p.bits)
    yield (mix(hashes) >> shift).astype(np.int32), of
    lead = np.append(np.flatnonzero((docs.data & 0xC0) != 0x80), len(docs.data))
    for size in p.stems:
        to = lead[np.minimum(np.searchsorted(lead, starts) + size, len(lead) - 1)]
        longer = to < ends
        stem = segment_hashes(docs.data, starts[longer], to[longer])
        yield (mix(stem + U64(size << 32)) >> shift).astype(np.int32), of[longer]
    for gap in p.gaps:
        inside = of[:-gap] == of[gap:] if len(of) > gap else np.zeros(0, bool)
        pair = mix(hashes[: len(inside)][inside] * U64(0xA0761D6478BD642F) + hashes[gap:][inside] + U64(gap))
        yield (pair >> shift).astype(np.int32), of[: len(inside)][inside]


def _features(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text"):
        docs = Docs.of(batch["text"]).folded()
        at, of = (np.concatenate(x) for x in zip(*_grams(docs, p), strict=True))
        key = np.unique((of.astype(np.int64) << p.bits) | at)
        edges = np.searchsorted(key, np.arange(len(docs) + 1) << p.bits)
        ids = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array((key & ((1 << p.bits) - 1)).astype(np.int32)))
        yield pa.RecordBatch.from_arrays([batch["place"], batch["label"], pa.array(np.diff(edges)), ids], ["place", "label", "n", "ids"])


def ftrl(rows: Iterator[tuple[np.ndarray, int]], p: Params, bias: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and bias after one pass over (coordinates, label) rows for each of ``p.epochs`` calls of ``rows``."""
    size = (1 << p.bits) + 1  # the last coordinate is the bias, without L1
    z, n = np.zeros(size), np.zeros(size)
    z[-1], n[-1] = -bias * (p.smooth / p.rate + p.l2), 0.0

    def weights(at: np.ndarray | slice) -> np.ndarray:
        shrunk = np.maximum(np.abs(z[at]) - p.l1, 0)
        return -np.sign(z[at]) * shrunk / ((p.smooth + np.sqrt(n[at])) / p.rate + p.l2)

    def own_bias() -> float:
        return -z[-1] / ((p.smooth + np.sqrt(n[-1])) / p.rate + p.l2)

    for at, y in rows:
        w, b = weights(at), own_bias()
        g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - y
        square = np.sqrt(n[at] + g * g)
        z[at] += g - (square - np.sqrt(n[at])) / p.rate * w
        n[at] += g * g
        z[-1] += g - (np.sqrt(n[-1] + g * g) - np.sqrt(n[-1])) / p.rate * b
        n[-1] += g * g
    return weights(slice(0, size - 1)), float(own_bias())


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params(), id_col: str = "doc_id", label_col: str = "toxic") -> Model:
    """Train on the labelled rows of ``docs``; the sample's bounds keep the driver's share constant at any input size."""
    place = F.xxhash64(F.col(id_col).cast("string"))
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    texts = docs.select(F.col(id_col).alias("id"), "text")
    first = marked.join(texts.select("id").distinct(), "id", "left_semi").orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(p.max_train_rows)
    rows = texts.join(F.broadcast(first), "id").select(F.xxhash64(F.col("id").cast("string")).alias("place"), "label", "text")
    held = written(rows.mapInArrow(lambda it: _features(it, p), "place long, label int, n long, ids array<int>"), "toxicity-features")
    table = _bounded(held, p)
    drop(held)
    label, ids = table["label"].to_numpy(), table["ids"].combine_chunks()
    ones = float(label.mean()) if len(label) else 0.0
    if ones in (0.0, 1.0):
        return Model(np.zeros(0, np.int32), np.zeros(0, np.float32), 40.0 if ones else -40.0)
    edges, values = ids.offsets.to_numpy(), ids.values.to_numpy()
    rows = ((values[edges[i] : edges[i + 1]], label[i]) for _ in range(p.epochs) for i in range(len(label)))
    weights, bias = ftrl(rows, p, float(np.log(ones / (1 - ones))))
    at = np.flatnonzero(weights)
    return Model(at.astype(np.int32), weights[at].astype(np.float32), bias)


def _bounded(held: DataFrame, p: Params) -> pa.Table:
    """The first rows by place that keep both bounds."""
    sizes = held.select("place", "n").orderBy("place", "n").limit(p.max_train_rows).toArrow()
    fits = np.cumsum(sizes["n"].to_numpy()) <= p.max_train_features
    last = sizes["place"].to_numpy()[fits].max(initial=np.iinfo(np.int64).min)
    return held.where(F.col("place") <= int(last)).orderBy("place", "n", "label", "ids").limit(int(fits.sum())).toArrow()


def _scores(batches: Iterator[pa.RecordBatch], model: Model, p: Params, carry: list[str]) -> Iterator[pa.RecordBatch]:
    weight = np.zeros(1 << p.bits, np.float32)
    weight[model.at] = model.weight
    for batch in chunks(batches, "text"):
        docs = Docs.of(batch["text"]).folded()
        keys = []
        for at, of in _grams(docs, p):
            told = np.flatnonzero(weight[at])
            keys.append((of[told].astype(np.int64) << p.bits) | at[told])
        key = np.unique(np.concatenate(keys))
        z = model.bias + np.bincount(key >> p.bits, weight[key & ((1 << p.bits) - 1)].astype(np.float64), len(docs))
        score = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in carry), pa.array(score), pa.array((score >= p.threshold).astype(np.int32))], [*carry, "score", "predicted"])


def score(docs: DataFrame, model: Model, p: Params = Params(), carry: list[str] | None = None) -> DataFrame:
    """``score`` and ``predicted`` of every row, beside the columns in ``carry`` (default: all that aren't named like these)."""
    carry = [c for c in docs.columns if c not in ("score", "predicted")] if carry is None else carry
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry), "score double", "predicted int"])
    return docs.select(*dict.fromkeys([*carry, "text"])).mapInArrow(lambda it: _scores(it, held.value, p, carry), schema)
