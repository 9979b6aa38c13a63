"""Quality rules: counted text measures with fixed limits, then a calibrated n-gram classifier.

``base_measures`` counts words, characters, symbols, repeated lines and repeated word windows of every whole text.
``fit`` trains a logistic regression on hashed word and character n-grams of labelled rows and calibrates its output
(Platt scaling on rows that took no part in training). ``score`` rates every row in Arrow batches; a row is kept if
no rule rejects it and its calibrated probability reaches the fixed threshold.

Defined results: a null or empty text has no words and is rejected by the word-count rule; a null doc_id or label
takes no part in training; repeated rows are each rated alike; with no labelled rows of both classes the classifier
keeps all that the rules keep; an empty table gives an empty result; extra columns are carried along by ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import U64, Docs, chunks, give_back, mix, padded, segment_hashes, words_at

WINDOW = 8
#: Rows that the fit takes at a time; what it needs beside the features is for these alone.
FIT_ROWS = 200
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Params:
    """``max_train_rows`` bounds the labelled sample (lowest hashes of doc_id); a quarter of it calibrates."""

    min_words: int = 20
    max_repeat_percent: int = 30
    threshold: float = 0.5
    bits: int = 16
    char_sizes: tuple[int, ...] = (3, 5)
    max_train_rows: int = 3000
    epochs: int = 60
    rate: float = 2.0
    l2: float = 1e-5


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float


def _base(docs: Docs, space: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> dict[str, np.ndarray]:
    n = len(docs)
    of = docs.doc_of(starts)
    n_words = np.bincount(of, minlength=n)
    chars = docs.count(~space & ((docs.data & 0xC0) != 0x80))
    out = {"n_words": n_words, "word_chars": chars, "n_symbols": docs.count(_SYMBOL[docs.data])}

    ls, le, ld = docs.lines()
    full = np.searchsorted(starts, le, "left") > np.searchsorted(starts, ls, "left")
    ls, le, ld = ls[full], le[full], ld[full]
    key = mix(segment_hashes(docs.data, ls, le) + mix(ld.astype(U64) + U64(1)))
    _, first = np.unique(key, return_index=True)
    out["n_dup_lines"] = np.bincount(ld, minlength=n) - np.bincount(ld[first], minlength=n)

    covered = np.zeros(len(of) + 1, np.int64)
    if len(of) >= WINDOW:
        at = np.flatnonzero(of[WINDOW - 1 :] == of[: len(of) - WINDOW + 1])
        key = np.zeros(len(at), U64)
        for j in range(WINDOW):
            key = key * U64(0x9E3779B97F4A7C15) + hashes[at + j]
        key = mix(key + mix(of[at].astype(U64) + U64(1)))
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(covered, at[twice], 1)
        np.add.at(covered, at[twice] + WINDOW, -1)
    out["n_repeat_words"] = np.bincount(of[np.cumsum(covered)[:-1] > 0], minlength=n)
    return out


def _grams(docs: Docs, starts: np.ndarray, hashes: np.ndarray, p: Params) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each family of n-grams: hashed buckets in text order, and where each document's begin."""
    size = 1 << p.bits
    shift = U64(64 - p.bits)
    edges = docs.offsets
    yield ((hashes * U64(0xD6E8FEB86659FD93)) >> shift).astype(np.int32), np.searchsorted(starts, edges)
    pair = hashes[:-1] * U64(0xA0761D6478BD642F) + hashes[1:] if len(hashes) > 1 else np.zeros(0, U64)
    first = np.searchsorted(starts, edges)
    inside = np.ones(len(pair), bool)
    cut = first[1:-1] - 1
    inside[cut[(cut >= 0) & (cut < len(pair))]] = False
    count = np.concatenate([[0], np.cumsum(inside)])
    yield (size + (mix(pair[inside]) >> shift)).astype(np.int32), count[np.minimum(first, len(pair))]
    whole = words_at(padded(docs.data), "<u8")[: len(docs.data)]
    for k, n in enumerate(p.char_sizes):
        gram = (whole & U64((1 << 8 * n) - 1)) * U64(0x9E3779B97F4A7C15) >> shift
        last = np.maximum(edges[1:] - n + 1, edges[:-1])  # n-grams stay inside their document
        keep = np.zeros(len(gram) + 1, np.int64)
        np.add.at(keep, edges[:-1], 1)
        np.add.at(keep, last, -1)
        keep = np.cumsum(keep)[:-1] > 0
        count = np.concatenate([[0], np.cumsum(keep)])
        yield ((2 + k) * size + gram[keep].astype(np.int64)).astype(np.int32), count[edges]


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[edges[1:]] - total[edges[:-1]]


def _logits(docs: Docs, starts: np.ndarray, hashes: np.ndarray, model: Model, p: Params) -> np.ndarray:
    out = np.full(len(docs), model.bias)
    for buckets, edges in _grams(docs, starts, hashes, p):
        out += _sums(model.weights[buckets], edges) / np.maximum(np.diff(edges), 1)
    return out


def _features(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text"):
        docs = Docs.of(batch["text"]).folded()
        starts, ends = docs.words()
        hashes = segment_hashes(docs.data, starts, ends)
        families = list(_grams(docs, starts, hashes, p))
        ids, values = [], []
        for i in range(len(docs)):
            parts = [np.unique(b[e[i] : e[i + 1]], return_counts=True) for b, e in families]
            ids.append(np.concatenate([b for b, _ in parts]))
            values.append(np.concatenate([c / max(c.sum(), 1) for _, c in parts]).astype(np.float32))
        yield pa.RecordBatch.from_arrays(
            [batch["part"], batch["quality"], pa.array(ids, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))],
            ["part", "quality", "ids", "vals"],
        )


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Model:
    """Train on at most ``p.max_train_rows`` labelled documents; the bound keeps the driver's share constant at any input size."""
    rank = F.xxhash64("doc_id")
    sample = (
        labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
        .orderBy(rank, "doc_id").limit(p.max_train_rows).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)).cast("int"))
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("part", "quality", "text")
    features = rows.mapInArrow(lambda it: _features(it, p), "part int, quality int, ids array<int>, vals array<float>")
    table = features.toArrow()
    part, y = table["part"].to_numpy(), table["quality"].to_numpy().astype(float)
    size = (2 + len(p.char_sizes)) << p.bits
    weights, bias = np.zeros(size), 0.0
    if len(set(y[part > 0])) < 2:
        return Model(weights.astype(np.float32), 0.0, 0.0, 40.0)
    blocks = [b for batch in table.select(["ids", "vals"]).to_batches(max_chunksize=FIT_ROWS) for b in [_block(batch)]]
    del table
    cost = np.where(part > 0, np.where(y > 0, 0.5 / (y[part > 0] > 0).sum(), 0.5 / (y[part > 0] == 0).sum()), 0)
    square, bias_square = np.full(size, 1e-8), 1e-8

    def logits() -> np.ndarray:
        return bias + np.concatenate([np.bincount(_rows(edges), weights[ids] * vals, len(edges) - 1) for ids, vals, edges in blocks])

    for _ in range(p.epochs):
        wrong = cost * (1 / (1 + np.exp(-np.clip(logits(), -30, 30))) - y)
        step, at = p.l2 * weights, 0
        for ids, vals, edges in blocks:
            here = wrong[at : at + len(edges) - 1]
            step += np.bincount(ids, here[_rows(edges)] * vals, size)
            at += len(here)
        square += step * step
        weights -= p.rate * step / np.sqrt(square)
        bias_square += wrong.sum() ** 2
        bias -= 0.1 * wrong.sum() / np.sqrt(bias_square)
    z = logits()
    del blocks
    give_back()
    slope, shift = _platt(z[part == 0], y[part == 0])
    return Model(weights.astype(np.float32), float(bias), slope, shift)


def _block(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, values and row edges of a few rows, as views of the batch."""
    ids, vals = batch["ids"], batch["vals"]
    edges = ids.offsets.to_numpy()
    return ids.values.to_numpy()[edges[0] : edges[-1]], vals.values.to_numpy()[edges[0] : edges[-1]], edges - edges[0]


def _rows(edges: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(edges) - 1), np.diff(edges))


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve that fits held-back labels, with smoothed targets, by Newton's method."""
    good, bad = (y > 0).sum(), (y == 0).sum()
    t = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    spread = max(float(np.std(z)), 1e-6) if len(z) else 1.0
    x = np.stack([z / spread, np.ones_like(z)], 1)
    b = np.zeros(2)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (q - t) + 1e-3 * b)
        b -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0] / spread), float(b[1])


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"


def _rate(batches: Iterator[pa.RecordBatch], model: Model, p: Params, carry: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text"):
        docs = Docs.of(batch["text"])
        space = docs.space()
        starts, ends = docs.words(space)
        out = _base(docs, space, starts, ends, segment_hashes(docs.data, starts, ends))
        failed = (out["n_words"] < p.min_words) | (100 * out["n_repeat_words"] > p.max_repeat_percent * out["n_words"])
        fold = docs.folded()
        z = _logits(fold, starts, segment_hashes(fold.data, starts, ends), model, p)
        prob = 1 / (1 + np.exp(-np.clip(model.slope * z + model.shift, -40, 40)))
        columns = [batch[c] for c in carry] + [pa.array(out[c], pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        columns += [pa.array(failed), pa.array(prob), pa.array(~failed & (prob >= p.threshold))]
        yield pa.RecordBatch.from_arrays(columns, [*carry, *(x.split()[0] for x in MEASURES.split(", "))])


def score(docs: DataFrame, model: Model, p: Params = Params(), carry: list[str] | None = None) -> DataFrame:
    """Measures, probability and verdict of every row, beside the columns in ``carry`` (default: all but clashing ones)."""
    taken = {x.split()[0] for x in MEASURES.split(", ")}
    carry = [c for c in docs.columns if c not in taken] if carry is None else carry
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry), MEASURES])
    return docs.select(*dict.fromkeys([*carry, "text"])).mapInArrow(lambda it: _rate(it, held.value, p, carry), schema)
