"""Personal data by weak supervision.

Formats that are plain (email, ip, card, phone) give the base spans. Less certain candidates are account numbers, social
security numbers, local phone numbers, masked addresses, names after a form of address, and near misses of the base
formats (a card number that fails its check digit, an address without a domain ending). Labelers vote yes, no or
nothing on base spans and candidates alike: a strict format check, a gazetteer, the words before, the shape of the
digits, and the characters around. Expectation-maximisation over the counts of all vote patterns estimates, family by
family (a format with its near misses), each labeler's reliability without labelled data; only how often a check digit
or a number's range errs is known beforehand (``KNOWN``), since by it alone near misses differ from base spans. Its posteriors
train a logistic span classifier, which sees the votes and what no labeler reads: words beside the span, its outline and its
ends, hashed. The classifier decides the candidates; of accepted ones that overlap, the likelier stays. Base spans stay
whatever it says.

Counts of vote patterns cover all documents (a table of bounded size). The classifier is trained on at most
``train_spans`` spans of all those, those of the smallest hashes.

Defined results: null and empty texts have no spans; repeated rows are each reported; a null doc_id is kept; an empty
table gives an empty result; columns named like the results are replaced, others are carried, whatever their names;
offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written
from .textbytes import Docs, chunks

BASE = ("email", "ip", "card", "phone")
MORE = ("iban", "ssn", "local_phone", "masked_email", "name")
LIKE = ("email_like", "ip_like", "card_like", "phone_like")
KINDS = BASE + MORE + LIKE
#: Formats whose labelers are judged together.
FAMILIES = ("email", "ip", "card", "phone", "iban", "ssn", "name")
FAMILY = tuple(FAMILIES.index({"local_phone": "phone", "masked_email": "email"}.get(k, k.removesuffix("_like"))) for k in KINDS)
LABELERS = ("strict", "gazetteer", "context", "shape", "border")
#: The strict check by family: how often it says yes of a true span, and of a false one. A random number passes a check digit
#: one time in ten, a remainder of 97 one time in a hundred, the lengths of phone numbers and the ranges of social security
#: numbers more often; true spans that fail are mistyped, which is rare. Names have no such check.
KNOWN = {"email": (0.95, 0.1), "ip": (0.95, 0.1), "card": (0.95, 0.1), "phone": (0.95, 0.5), "iban": (0.95, 0.01), "ssn": (0.99, 0.8)}
BUCKETS = 256
YES, NO, NONE = 1, 0, 2

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_HOST = re.compile(r"@[A-Za-z0-9-]+")
_NAME_CHAR = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "Señor", "Señora", "name is", "heiße", "appelle", "llamo")
# Common given names of the four languages, public domain endings, and national account number lengths.
_FIRST_NAMES = frozenset(
    """james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah
    christopher karen charles lisa daniel nancy matthew betty anthony sandra mark ashley steven emily andrew donna joshua michelle george emma
    peter maria andreas petra stefan sabine hans ursula klaus monika jürgen karin wolfgang helga frank brigitte uwe ingrid dieter renate
    jean marie pierre nathalie michel isabelle philippe sylvie alain catherine nicolas martine claire christine françois sophie julien camille
    antonio carmen josé ana manuel isabel francisco dolores juan pilar javier teresa carlos laura jesús cristina luis marta miguel elena pablo lucía paul anna""".split()
)
_DOMAINS = frozenset("com org net edu gov mil int info biz io dev app eu".split())
_IBAN_SIZE = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28,
    "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24,
}
_ASKED = re.compile(r"(?i)\b(call|phone|tel|mobile|fax|mail|e-mail|contact|ssn|social security|iban|account|konto|compte|cuenta|name|reach|write to|card|credit|visa|ip address|host|address|karte|telefon|adresse|carte|téléphone|tarjeta|teléfono|correo)\b")
_OTHER = re.compile(r"(?i)\b(version|isbn|order|serial|page|chapter|build|figure|table|section|item|release|invoice|sku|model|part|ref|rechnung|seite|commande|factura|página)\b")
_CANDIDATES: dict[str, re.Pattern[str]] = {
    "iban": re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "local_phone": re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9])"),
    "masked_email": re.compile(r"\b[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{1,63})+"),
    "name": re.compile(r"\b(?:" + "|".join(_TITLES) + r")\.? (?P<name>[A-ZÀ-Ý][a-zà-ÿ]{1,30}(?: [A-ZÀ-Ý][a-zà-ÿ]{1,30}){0,2})"),
}


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str, digits: bool = True) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, rank of the kind, end) of the plain formats, leftmost matches that do not overlap others of their kind; and
    of the matches that fail."""
    found, failed = [], []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _NAME_CHAR:
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            done = match.end()
            found.append((start, 0, done))
        elif start < at and (match := _HOST.match(text, at)):
            failed.append((start, KINDS.index("email_like"), match.end()))
        at = text.find("@", max(at + 1, done))
    if digits:
        for m in _IP.finditer(text):
            good = all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in m[0].split("."))
            (found if good else failed).append((m.start(), 1 if good else KINDS.index("ip_like"), m.end()))
        for m in _CARD.finditer(text):
            number = _digits(m[0])
            if 14 <= len(number) <= 19 and _luhn(number):
                found.append((m.start(), 2, m.end()))
            elif 12 <= len(number) <= 20:
                failed.append((m.start(), KINDS.index("card_like"), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                good = 10 <= len(_digits(m[0])) <= 15
                if good or len(_digits(m[0])) >= 6:
                    (found if good else failed).append((m.start(), 3 if good else KINDS.index("phone_like"), m.end()))
    return sorted(found), failed


def _strict(kind: str, text: str) -> int:
    if kind in BASE or kind in LIKE:
        return YES if kind in BASE else NO
    if kind == "iban":
        plain = text.replace(" ", "")
        moved = plain[4:] + plain[:4]
        return YES if 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1 else NO
    if kind == "ssn":
        return NO if text[:3] in ("000", "666") or text[0] == "9" or text[4:6] == "00" or text[7:] == "0000" else YES
    if kind == "local_phone":
        return YES if _digits(text)[0] not in "01" else NO
    return YES if kind == "name" and " " in text else NONE


def _gazetteer(kind: str, text: str) -> int:
    if kind == "name":
        return YES if text.split(" ")[0].lower() in _FIRST_NAMES else NONE
    if kind in ("email", "masked_email", "email_like"):
        ending = re.split(r"[^A-Za-z]+", text)[-1].lower()
        return YES if ending in _DOMAINS or (len(ending) == 2 and kind != "email_like") else NO
    if kind == "iban":
        return YES if _IBAN_SIZE.get(text[:2]) == len(text.replace(" ", "")) else NO
    if kind in ("card", "card_like"):
        return YES if text[0] in "3456" else NO
    if kind in ("ip", "ip_like"):
        return NO if text[0] == "0" or text.count("0") + text.count(".") == len(text) else NONE
    return NONE


def _context(before: str) -> int:
    return YES if _ASKED.search(before) else NO if _OTHER.search(before) else NONE


def _shape(kind: str, text: str) -> int:
    number = _digits(text)
    if kind in ("ip", "ip_like"):
        return NO if len(number) <= 5 else YES  # a version has short parts
    if len(number) < 6 or kind in ("email", "email_like", "masked_email"):
        return NONE
    steps = {(ord(b) - ord(a)) % 10 for a, b in zip(number, number[1:], strict=False)}
    return NO if len(set(number)) <= 2 or len(steps) == 1 else YES


def _border(before: str, after: str) -> int:
    return NO if before[-1:].isalnum() or after[:1].isalnum() or before[-1:] in ("/", "=", "#") else YES


_OUTLINE = str.maketrans({**{c: "9" for c in "0123456789"}, **{c: "a" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}})
_REPEAT = re.compile(r"(.)\1+")


def _features(kind: int, got: str, before: str, after: str) -> list[int]:
    """Buckets of what no labeler reads: neighbouring words, outline with and without lengths, both ends, grouping of digits."""
    words = before.lower().split()
    outline = got[:64].translate(_OUTLINE)
    said = [f"w{x}" for x in words[-2:]] + [f"n{x}" for x in after.lower().split()[:1]]
    said += [f"o{outline}", "r" + _REPEAT.sub(r"\1", outline), f"s{got[:2]}", f"e{got[-2:]}", "g" + ",".join(str(len(x)) for x in re.findall("9+", outline))]
    return [zlib.crc32(f"{FAMILY[kind]} {x}".encode()) % BUCKETS for x in said]


def candidates(text: str, digits: bool, base: list[tuple[int, int, int]], failed: list[tuple[int, int, int]]) -> list[tuple]:
    """(start, rank of the kind, end, votes, length class, features) of base spans, and of the less certain spans that touch none."""
    spans = list(failed)
    for kind in MORE:
        if kind in ("iban", "ssn", "local_phone"):
            if not digits:
                continue
        elif not any(x in text for x in (("(at)", "[at]") if kind == "masked_email" else _TITLES)):
            continue
        spans += [(*m.span("name" if kind == "name" else 0), kind) for m in _CANDIDATES[kind].finditer(text)]
    spans = [(x[0], KINDS.index(x[2]), x[1]) if isinstance(x[2], str) else x for x in spans]
    spans = base + [x for x in spans if not any(a < x[2] and x[0] < b for a, _, b in base)]
    found = []
    for start, rank, end in spans:
        kind, got, before, after = KINDS[rank], text[start:end], text[max(0, start - 40) : start], text[end : end + 24]
        votes = (_strict(kind, got), _gazetteer(kind, got), _context(before), _shape(kind, got), _border(before, after))
        code = sum(v * 3**i for i, v in enumerate(votes))
        found.append((start, rank, end, code, min(len(got).bit_length(), 7), _features(rank, got, before, after)))
    return sorted(found)


SPAN = "array<struct<start:int,kind:int,end:int>>"
CANDIDATE = "array<struct<start:int,kind:int,end:int,votes:int,size:int,told:array<int>>>"


def _scan(batches: Iterator[pa.RecordBatch], carry: list[str], types: tuple[pa.DataType, pa.DataType]) -> Iterator[pa.RecordBatch]:
    digit = np.zeros(256, bool)
    digit[48:58] = True
    for batch in chunks(batches, "text", 4 << 20):
        docs = Docs.of(batch["text"])
        has = docs.count(digit[docs.data]) > 5
        some = docs.count(digit[docs.data]) > 3
        base, more = [], []
        for text, many, few in zip(batch["text"].to_pylist(), has.tolist(), some.tolist(), strict=True):
            own, failed = base_spans(text or "", few)
            base.append([dict(zip(("start", "kind", "end"), x, strict=True)) for x in own])
            more.append([dict(zip(("start", "kind", "end", "votes", "size", "told"), x, strict=True)) for x in candidates(text or "", many, own, failed)])
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in carry), pa.array(base, types[0]), pa.array(more, types[1])], [*carry, "base", "more"])


def scan(docs: DataFrame, carry: list[str]) -> DataFrame:
    """Base spans and candidates with their votes, beside the columns in ``carry``."""
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    span = [("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]
    types = pa.list_(pa.struct(span)), pa.list_(pa.struct([*span, ("votes", pa.int32()), ("size", pa.int32()), ("told", pa.list_(pa.int32()))]))
    rows = docs.select(*dict.fromkeys([*carry, "text"]))
    return rows.mapInArrow(lambda it: _scan(it, carry, types), ", ".join(filter(None, [kept, f"base {SPAN}", f"more {CANDIDATE}"])))


@dataclass(frozen=True)
class Model:
    """By family: the share of true spans, and ``vote[family, labeler, truth, vote]``; the classifier's weights and bias."""

    prior: np.ndarray
    vote: np.ndarray
    weights: np.ndarray
    bias: float


def _votes(code: np.ndarray) -> np.ndarray:
    return np.stack([code // 3**i % 3 for i in range(len(LABELERS))], 1).astype(int)


def _design(kind: np.ndarray, code: np.ndarray, size: np.ndarray, told: list[list[int]]) -> np.ndarray:
    votes = _votes(code)
    parts = [(votes == v).astype(np.float32) for v in (YES, NO)]
    hashed = np.zeros((len(kind), BUCKETS), np.float32)
    for row, buckets in zip(hashed, told, strict=True):
        row[buckets] = 1
    return np.concatenate([*parts, np.eye(len(FAMILIES), dtype=np.float32)[np.array(FAMILY)[kind]], np.eye(8, dtype=np.float32)[size], hashed], 1)


def estimate(code: np.ndarray, n: np.ndarray, known: tuple[float, float] | None = None, rounds: int = 100) -> tuple[float, np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns of one family: share of true spans, the labelers' votes by truth, posterior by pattern.

    Reliabilities start at, and are pulled towards, labelers that are somewhat better than chance; abstaining tells nothing.
    Those of the first labeler, the strict check, stay as ``known`` where that is given.
    """
    votes = _votes(code)
    start = np.full((len(LABELERS), 2, 2), 0.3)
    start[:, 0, NO] = start[:, 1, YES] = 0.7
    if known:
        start[0] = [[1 - known[1], known[1]], [1 - known[0], known[0]]]
    vote, prior = start.copy(), 0.5
    post = np.full(len(code), 0.5)
    for _ in range(rounds):
        logs = np.stack([np.full(len(code), np.log(1 - prior)), np.full(len(code), np.log(prior))], 1)
        for i in range(len(LABELERS)):
            told = votes[:, i] != NONE
            logs[told] += np.log(vote[i][:, votes[told, i]]).T
        post = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))
        prior = float((post @ n + 1) / (n.sum() + 2))
        for i in range(1 if known else 0, len(LABELERS)):
            for truth, w in ((1, post * n), (0, (1 - post) * n)):
                counts = np.array([w[votes[:, i] == v].sum() for v in (NO, YES)])
                vote[i, truth] = (counts + 10 * start[i, truth]) / (counts.sum() + 10)
    return prior, vote, post


def fit(scanned: DataFrame, train_spans: int = 10_000) -> Model:
    """Reliabilities from all spans of ``scan`` (at most 7 families x 3**5 counts come to the driver), then the classifier
    from at most ``train_spans`` of them."""
    spans = scanned.select(F.explode("more").alias("m")).select("m.*")
    family = F.element_at(F.array(*map(F.lit, FAMILY)), F.col("kind") + 1)
    rows = spans.groupBy(family.alias("family"), "votes").agg(F.count("*").alias("n")).orderBy("family", "votes").collect()
    prior, vote = np.full(len(FAMILIES), 0.5), np.full((len(FAMILIES), len(LABELERS), 2, 2), 0.5)
    width = 2 * len(LABELERS) + len(FAMILIES) + 8 + BUCKETS
    if not rows:
        return Model(prior, vote, np.zeros(width, np.float32), -1.0)
    post: dict[tuple[int, int], float] = {}
    for k in {r["family"] for r in rows}:
        own = [r for r in rows if r["family"] == k]
        prior[k], vote[k], known = estimate(np.array([r["votes"] for r in own]), np.array([float(r["n"]) for r in own]), KNOWN.get(FAMILIES[k]))
        post |= {(k, r["votes"]): float(x) for r, x in zip(own, known, strict=True)}
    sample = spans.orderBy(F.xxhash64("kind", "votes", "told", "start"), "start", "end").limit(train_spans).select("kind", "votes", "size", "told").toArrow()
    kind, code, size = (sample[c].to_numpy() for c in ("kind", "votes", "size"))
    x = _design(kind, code, size, sample["told"].to_pylist())
    goal = np.array([post[FAMILY[k], v] for k, v in zip(kind, code.tolist(), strict=True)], np.float32)
    weights, bias, fast, pull = np.zeros(width, np.float32), 0.0, np.zeros(width, np.float32), 0.0
    for _ in range(400):
        wrong = (1 / (1 + np.exp(-(x @ weights + bias))) - goal) / len(goal)
        fast = 0.9 * fast - 0.3 * (x.T @ wrong + 1e-4 * weights)
        pull = 0.9 * pull - 0.3 * float(wrong.sum())
        weights, bias = weights + fast, bias + pull
    return Model(prior, vote, weights, float(bias))


def _chosen(more: list[dict], model: Model, threshold: float) -> list[tuple[int, int, int]]:
    """Candidates that the classifier accepts; of those that overlap the likelier."""
    more = [m for m in more if m["kind"] >= len(BASE)]
    if not more:
        return []
    x = _design(*(np.array([m[c] for m in more]) for c in ("kind", "votes", "size")), [m["told"] for m in more])
    good = 1 / (1 + np.exp(-(x @ model.weights + model.bias)))
    taken: list[tuple[int, int, int]] = []
    for i in sorted(range(len(more)), key=lambda i: (-good[i], more[i]["start"], more[i]["kind"])):
        start, end = more[i]["start"], more[i]["end"]
        if good[i] >= threshold and not any(a < end and start < b for a, _, b in taken):
            taken.append((start, more[i]["kind"], end))
    return taken


def decide(scanned: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Adds ``spans``: base spans and accepted candidates as (start, kind, end), in order."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = []
            for base, more in zip(b["base"].to_pylist(), b["more"].to_pylist(), strict=True):
                own = sorted([(s["start"], s["kind"], s["end"]) for s in base] + _chosen(more or [], model, threshold))
                spans.append([dict(zip(("start", "kind", "end"), s, strict=True)) for s in own])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(spans, b.schema.field("base").type)], [*b.schema.names, "spans"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scanned.schema)
    return scanned.mapInArrow(judge, f"{kept}, spans {SPAN}")


def find(docs: DataFrame, carry: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """Scan, fit and decide; ``spans`` of every row beside the columns in ``carry`` (default: all but text)."""
    made = ("base", "more", "spans")
    carry = [c for c in docs.columns if c not in (*made, "text")] if carry is None else carry
    scanned = written(scan(docs, carry), "personal-data")
    return decide(scanned, fit(scanned), threshold)


def report(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans written out."""
    rows = find(docs, ["doc_id"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said: Callable[[list], str] = lambda spans: ",".join(f"{KINDS[s['kind']]}:{s['start']}:{s['end']}" for s in spans)
        for b in batches:
            base, spans = b["base"].to_pylist(), b["spans"].to_pylist()
            counts = [pa.array([sum(s["kind"] == k for s in x) for x in base], pa.int64()) for k in range(len(BASE))]
            digests = pa.array([hashlib.sha256(said(x).encode()).hexdigest() for x in base], pa.string())
            yield pa.RecordBatch.from_arrays([b["doc_id"], *counts, digests, pa.array([said(x) for x in spans], pa.string())], names)

    names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(write, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
