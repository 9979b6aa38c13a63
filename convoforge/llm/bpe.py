"""Byte-level BPE by prefix dynamic programming, on batches of whole texts.

``PrefixTable`` holds, for every prefix of a byte string, the one token that can end a valid encoding of that prefix.
A token may follow another iff encoding the two together gives the two back; so the last token of a prefix depends
only on the last tokens of shorter prefixes. Appending extends the table, and an edit recomputes it only from the
edit on. ``Codec`` splits texts into the pieces that BPE treats separately (letters, numbers, other signs, white
space) with array operations, encodes each distinct piece of a batch once, and decodes ids back to bytes.

Defined results: null texts are empty and have no ids; text that looks like a special token is ordinary text;
repeated rows are encoded alike; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import json
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textbytes import Docs, chunks, gather, segment_hashes

CHUNK = 2 << 20
#: Distinct pieces that a worker remembers; twice as many at most.
REMEMBERED = 50_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks, from a ``.tiktoken`` list or the vocabulary in a tokenizer's JSON file."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        return {bytes(back[c] for c in token): rank for token, rank in vocab.items() if all(c in back for c in token) and not token.startswith("<|")}
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Vocabulary:
    """Tokens by rank, and which token may follow which."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        size = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self._fits: dict[int, bool] = {}
        self._halves: dict[int, tuple[int, int]] = {}
        #: Finds every token that ends at each byte, longest first.
        self.ending = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.ending.add_word(token.decode("latin-1"), (rank, len(token)))
        self.ending.make_automaton()

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one; None for a single byte."""
        got = self._halves.get(token)
        if got is None and len(self.tokens[token]) > 1:
            text = self.tokens[token]
            parts = [text[i : i + 1] for i in range(len(text))]
            while len(parts) > 2:
                _, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            got = self._halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]])
        return got

    def fits(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left``: their bytes together encode to just these two.

        Takes merges back, latest first. Whenever the tokens then at the border could have merged with each other
        before the merge just taken back, the border would not have lasted; equal ranks merge from the left.
        """
        key = left << 32 | right
        got = self._fits.get(key)
        if got is not None:
            return got
        ranks, tokens, before = self.ranks, self.tokens, 1 << 60
        while True:
            if ranks.get(tokens[left] + tokens[right], 1 << 60) < before:
                got = False
                break
            of_left, of_right = self.halves(left), self.halves(right)
            if of_left and (not of_right or left > right):
                before, left = left, of_left[1]
            elif of_right:
                before, right = right + 1, of_right[0]
            else:
                got = True
                break
        if len(self._fits) > 500_000:
            self._fits.clear()
        self._fits[key] = got
        return got


class PrefixTable:
    """The last token of every prefix of a byte string."""

    def __init__(self, vocabulary: Vocabulary, text: bytes = b""):
        self.vocabulary, self.text = vocabulary, b""
        self.last: list[int] = [-1]
        self.append(text)

    def append(self, more: bytes) -> None:
        """Extend the string; what the table holds already stays valid."""
        v, last = self.vocabulary, self.last
        at = len(self.text)
        self.text = text = self.text + more
        base = max(0, at - v.longest + 1)
        known, fits = v._fits, v.fits
        last += [-1] * len(more)
        for end, (token, size) in v.ending.iter(text[base:].decode("latin-1")):
            end += base + 1
            if end > at and last[end] < 0:
                left = last[end - size]
                if end != size:
                    if left < 0:
                        continue
                    may = known.get(left << 32 | token)
                    if not (fits(left, token) if may is None else may):
                        continue
                last[end] = token
        if more and last[-1] < 0:
            raise ValueError("a byte is not in the vocabulary")

    def edit(self, start: int, end: int, new: bytes) -> None:
        """Replace ``text[start:end]``; prefixes before the edit keep their tokens."""
        tail = self.text[end:]
        self.text = self.text[:start]
        del self.last[start + 1 :]
        self.append(new + tail)

    def ids(self) -> list[int]:
        out, at = [], len(self.text)
        while at:
            out.append(self.last[at])
            at -= len(self.vocabulary.tokens[out[-1]])
        return out[::-1]


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """By code point: 0 white space, 1 letter, 2 number, 3 other."""
    kinds = {"L": 1, "N": 2}
    out = np.array([kinds.get(unicodedata.category(chr(c))[0], 3) for c in range(0x110000)], np.uint8)
    out[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 0
    return out


def pieces(docs: Docs) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the pieces that the pattern of the tokenizer matches, in order; together they cover every text.

    The pattern: a contraction ('s 't 're 've 'm 'll 'd); letters, numbers or other signs, with one space before them;
    white space up to the last character before something else; white space.
    """
    points = np.frombuffer(docs.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    byte_at = np.append(np.flatnonzero((docs.data & 0xC0) != 0x80), len(docs.data))
    edge = docs.edges()[byte_at]
    kind = _classes()[points]
    white = kind == 0
    head = edge[:-1].copy()
    head[1:] |= kind[1:] != kind[:-1]
    start = head.copy()
    # The last white space before something else stands alone, or leads what follows if it is a space.
    last = np.flatnonzero(head[1:] & ~edge[1:-1] & white[:-1])
    start[last] = True
    start[last[points[last] == 0x20] + 1] = False
    quote = np.flatnonzero(start & (points == 0x27))
    inside = lambda i: (i < n) & ~edge[np.minimum(i, n)]
    at = lambda i: points[np.minimum(i, n - 1)]
    if len(quote):
        same1 = inside(quote + 1)
        one = same1 & np.isin(at(quote + 1), [ord(c) for c in "stmd"])
        same2 = same1 & inside(quote + 2)
        two = same2 & np.logical_or.reduce([(at(quote + 1) == ord(a)) & (at(quote + 2) == ord(b)) for a, b in ("re", "ve", "ll")])
        for some, size in ((quote[one], 2), (quote[two & ~one], 3)):
            start[some + 1] = False
            rest = some + size
            rest = rest[inside(rest)]
            start[rest[kind[rest] == 1]] = True
    begin = byte_at[:-1][start]
    return begin, np.append(begin[1:], len(docs.data))


class Codec:
    """Encodes with ``PrefixTable``, or hands single pieces to ``encode_piece``; either way each distinct piece of a chunk once."""

    def __init__(self, path: str, encode_piece: Callable[[bytes], list[int]] | None = None):
        self.vocabulary = Vocabulary(load_ranks(path))
        self._ids_of = encode_piece or (lambda piece: PrefixTable(self.vocabulary, piece).ids())
        self._young: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}

    def _encode_piece(self, piece: bytes) -> bytes:
        """Ids of a piece as native 32-bit integers."""
        got = self._young.get(piece)
        if got is None:
            got = self._old.get(piece)
            if got is None:
                whole = self.vocabulary.ranks.get(piece)
                got = array("I", [whole] if whole is not None else self._ids_of(piece)).tobytes()
            if len(piece) <= 256:
                if len(self._young) >= REMEMBERED:
                    self._old, self._young = self._young, {}
                self._young[piece] = got
        return got

    def encode(self, docs: Docs) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each document's begin."""
        starts, ends = pieces(docs)
        keys = segment_hashes(docs.data, starts, ends)
        _, first, back = np.unique(keys, return_index=True, return_inverse=True)
        raw = docs.data.tobytes()
        found = [self._encode_piece(raw[a:b]) for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        sizes = np.array([len(x) // 4 for x in found], np.int64)
        flat = np.frombuffer(b"".join(found), np.uint32)
        at = np.cumsum(sizes) - sizes
        ids = gather(flat, at[back], sizes[back])
        total = np.concatenate([[0], np.cumsum(sizes[back])])
        return ids, total[np.searchsorted(starts, docs.offsets)]

    def decode(self, ids: np.ndarray, edges: np.ndarray) -> Docs:
        v = self.vocabulary
        sizes = v.sizes[ids]
        total = np.concatenate([[0], np.cumsum(sizes)])
        return Docs(gather(v.bytes, v.starts[ids], sizes), total[edges])


@lru_cache(maxsize=2)
def codec(path: str, library: bool = False) -> Codec:
    """One per worker process and vocabulary file; every executor has the file at the same place.

    ``library``: single pieces go to the tiktoken library instead of the prefix table; the ids are the same.
    """
    if not library:
        return Codec(path)
    import tiktoken

    encoding = tiktoken.Encoding("pieces", pat_str=r"(?s).+", mergeable_ranks=load_ranks(path), special_tokens={})
    return Codec(path, lambda piece: encoding.encode_ordinary(piece.decode()))


def _digests(batches: Iterator[pa.RecordBatch], path: str, carry: list[str], with_ids: bool) -> Iterator[pa.RecordBatch]:
    own = codec(path)
    for batch in chunks(batches, "text", CHUNK):
        docs = Docs.of(batch["text"])
        ids, edges = own.encode(docs)
        back = own.decode(ids, edges)
        cut = lambda x, e, i: x[e[i] : e[i + 1]].tobytes()
        raw = ids.astype("<u4")
        columns = [batch[c] for c in carry] + [
            pa.array(np.diff(edges), pa.int64()),
            pa.array([hashlib.sha256(cut(raw, edges, i)).hexdigest() for i in range(len(docs))], pa.string()),
            pa.array([hashlib.sha256(cut(back.data, back.offsets, i)).hexdigest() for i in range(len(docs))], pa.string()),
        ]
        if with_ids:
            columns.append(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids.astype(np.int32))))
        yield pa.RecordBatch.from_arrays(columns, [*carry, "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])])


def encode(docs: DataFrame, path: str, carry: list[str] | None = None, with_ids: bool = True) -> DataFrame:
    """Encode every whole text and decode it again: token count, ids and the digests of ids and decoded bytes."""
    made = ["n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    carry = [c for c in docs.columns if c not in made] if carry is None else carry
    kept = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry]
    schema = ", ".join([*kept, "n_tokens long, ids_sha256 string, decoded_sha256 string", *(["ids array<int>"] if with_ids else [])])
    return docs.select(*dict.fromkeys([*carry, "text"])).mapInArrow(lambda it: _digests(it, path, carry, with_ids), schema)
