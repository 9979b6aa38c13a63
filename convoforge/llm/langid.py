"""Language identification by a bit-sliced Bloom filter over n-grams.

Learning counts byte n-grams per language over all training rows, keeps for each language the n-grams that are about
as frequent there as in the language that uses them most, and sets the language's bit in every slot that the n-gram
hashes to. A lookup ANDs an n-gram's slots and so returns all languages that hold it at once. For a text the set bits
are counted per language; the expected false positives (fill of the language's slice, to the power of the number of
hashes) are taken off; the largest share wins.

Defined results: null texts and texts without a letter are ``und`` with score 0; ties go to the language that sorts
first; with nothing learned every text is ``und``; rows with a null lang or doc_id are never learned from; repeated
rows are rated alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import drop, written
from .textbytes import U64, Docs, chunks, mix, padded, words_at

UNKNOWN = "und"


@dataclass(frozen=True)
class Params:
    """``bits`` fixes the size of the filter: 2**bits slots of one mask word for each 64 languages (16 MB), whatever the number
    of documents: that is the bound of what is broadcast."""

    sizes: tuple[int, ...] = (3, 4)
    bits: int = 21
    hashes: int = 2
    min_count: int = 3
    ratio: float = 0.2


@dataclass(frozen=True)
class Model:
    """``slots[word]``: masks of languages 64 * word to 64 * word + 63."""

    languages: tuple[str, ...]
    slots: np.ndarray
    fill: np.ndarray


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def _letters(docs: Docs) -> Docs:
    """Lower-cased letters (A-Z and the accented Latin-1 capitals); every other ASCII byte becomes a space."""
    data = docs.folded().data
    accented = np.zeros(len(data), bool)
    if len(data) > 1:
        accented[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    data = np.where(accented, data | 0x20, data)
    return Docs(np.where(_LETTER[data], data, np.uint8(0x20)), docs.offsets)


def _codes(docs: Docs, sizes: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: n-gram codes in text order, and where each document's begin. N-grams with two spaces in a row are left out."""
    if not len(docs.data):
        return
    edges = docs.offsets
    whole = words_at(padded(docs.data), "<u8")[: len(docs.data)]
    blank = docs.data == 0x20
    gap = np.append(blank[:-1] & blank[1:], False)
    for n in sizes:
        last = np.maximum(edges[1:] - n + 1, edges[:-1])
        mark = np.zeros(len(whole) + 1, np.int64)
        np.add.at(mark, edges[:-1], 1)
        np.add.at(mark, last, -1)
        keep = np.cumsum(mark)[:-1] > 0
        for j in range(n - 1):
            keep[: len(gap) - j] &= ~gap[j:]
        count = np.concatenate([[0], np.cumsum(keep)])
        yield (whole[keep] & U64((1 << 8 * n) - 1)) | U64(n << 56), count[edges]


def _count(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """n-gram counts of a partition by language, merged as they grow and handed on in pieces of bounded size."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    waiting = 0

    def merged(parts):
        codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        return codes, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)

    def flush():
        for lang, parts in held.items():
            codes, counts = merged(parts)
            for i in range(0, len(codes), 50_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(codes[i : i + 50_000])), pa.array(codes[i : i + 50_000].astype(np.int64)), pa.array(counts[i : i + 50_000])], ["lang", "code", "n"]
                )
        held.clear()

    for batch in chunks(batches, "text"):
        docs = _letters(Docs.of(batch["text"]))
        names = np.array(batch["lang"].to_pylist(), dtype=object)
        for codes, edges in _codes(docs, p.sizes):
            of = np.repeat(np.arange(len(docs)), np.diff(edges))
            for lang in sorted(set(names)):
                got = np.unique(codes[(names == lang)[of]], return_counts=True)
                held.setdefault(lang, []).append(got)
                waiting += len(got[0])
        if waiting > 2_000_000:
            for lang in held:
                held[lang] = [merged(held[lang])]
            waiting = sum(len(x[0][0]) for x in held.values())
            if waiting > 1_000_000:
                yield from flush()
                waiting = 0
    yield from flush()


def _places(codes: np.ndarray, p: Params) -> Iterator[np.ndarray]:
    h = mix(codes)
    for k in range(p.hashes):
        yield ((h >> U64(k * p.bits)) & U64((1 << p.bits) - 1)).astype(np.int64)


def learn(docs: DataFrame, p: Params = Params()) -> Model:
    """Fit on all rows of ``docs`` that have text and lang. What reaches the driver is the filter, of fixed size."""
    rows = docs.where("text is not null and lang is not null").select("text", "lang")
    counts = rows.mapInArrow(lambda it: _count(it, p), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    counts = written(counts, "ngrams")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # one row a language
    languages = tuple(sorted(totals))
    words = -(-len(languages) // 64)
    slots = np.zeros((words, 1 << p.bits), U64)
    if languages:
        spark = docs.sparkSession
        known = F.broadcast(spark.createDataFrame([(x, i // 64, i % 64, float(totals[x])) for i, x in enumerate(languages)], "lang string, word int, bit int, total double"))
        share = counts.where(F.col("n") >= p.min_count).join(known, "lang").withColumn("share", F.col("n") / F.col("total"))
        share = share.withColumn("most", F.max("share").over(Window.partitionBy("code")))
        masks = share.where(F.col("share") >= p.ratio * F.col("most")).groupBy("code", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))

        def place(batches):
            for b in batches:
                for at in _places(b["code"].to_numpy().astype(U64), p):
                    yield pa.RecordBatch.from_arrays([b["word"], pa.array(at), b["mask"]], ["word", "slot", "mask"])

        filled = written(masks.mapInArrow(place, "word int, slot long, mask long").groupBy("word", "slot").agg(F.bit_or("mask").alias("mask")), "slots")
        for word in range(words):  # 2**bits rows at most
            own = filled.where(F.col("word") == word).select("slot", "mask").toArrow()
            slots[word, own["slot"].to_numpy()] = own["mask"].to_numpy().astype(U64)
        drop(filled)
    drop(counts)
    fill = np.array([float(((slots[i // 64] >> U64(i % 64)) & U64(1)).mean()) for i in range(len(languages))])
    return Model(languages, slots, fill)


def _has_letter(docs: Docs) -> np.ndarray:
    ascii_letters = docs.count(_LETTER[docs.data] & (docs.data < 128)) > 0
    for i in np.flatnonzero(~ascii_letters & (np.diff(docs.offsets) > 0)):
        ascii_letters[i] = any(map(str.isalpha, docs.data[docs.offsets[i] : docs.offsets[i + 1]].tobytes().decode("utf-8", "replace")))
    return ascii_letters


def _predict(batches: Iterator[pa.RecordBatch], model: Model, p: Params, carry: list[str]) -> Iterator[pa.RecordBatch]:
    names = np.array([*model.languages, UNKNOWN], dtype=object)
    n_lang = len(model.languages)
    false = model.fill**p.hashes
    for batch in chunks(batches, "text"):
        docs = Docs.of(batch["text"])
        votes, grams = np.zeros((len(docs), n_lang)), np.zeros(len(docs))
        for codes, edges in _codes(_letters(docs), p.sizes):
            grams += np.diff(edges)
            places = list(_places(codes, p))
            for word, slots in enumerate(model.slots):
                mask = np.bitwise_and.reduce([slots[at] for at in places])
                for i in range(64 * word, min(64 * word + 64, n_lang)):
                    total = np.concatenate([[0], np.cumsum(((mask >> U64(i % 64)) & U64(1)).astype(np.int64))])
                    votes[:, i] += total[edges[1:]] - total[edges[:-1]]
        votes = np.maximum(votes - grams[:, None] * false, 0) / np.maximum(1 - false, 1e-9)
        known = _has_letter(docs) & (n_lang > 0)
        best = votes.argmax(1) if n_lang else np.zeros(len(docs), np.int64)
        total = votes.sum(1)
        top = votes.max(1) if n_lang else total
        score = np.where(total > 0, top / np.maximum(total, 1e-9), 1 / max(n_lang, 1))
        columns = [batch[c] for c in carry] + [pa.array(list(names[np.where(known, best, n_lang)]), pa.string()), pa.array(np.where(known, np.minimum(score, 1.0), 0.0))]
        yield pa.RecordBatch.from_arrays(columns, [*carry, "lang_pred", "score"])


def predict(docs: DataFrame, model: Model, p: Params = Params(), carry: list[str] | None = None) -> DataFrame:
    """``lang_pred`` and ``score`` of every row, from its text alone."""
    carry = [c for c in docs.columns if c not in ("lang_pred", "score")] if carry is None else carry
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry), "lang_pred string, score double"])
    return docs.select(*dict.fromkeys([*carry, "text"])).mapInArrow(lambda it: _predict(it, held.value, p, carry), schema)
