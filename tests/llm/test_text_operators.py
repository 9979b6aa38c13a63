"""The Arrow operators against plain Python on the smallest tables, and on rows made to be awkward."""

import base64
import hashlib
import random
import re
import string
import struct
import zlib
from collections import Counter

import public_tokenizers
import pytest
import xxhash

from convoforge.llm import bpe, langid, packing, quality, queries, simhash

SF = "/root/testdata/sf0.01"
ODD = [
    (1, ""), (2, None), (3, " \n\t "), (4, "Ünïcode straße ß 漢字 'S it's we'll\n\n  x"), (5, "one"), (6, "one two"),
    (7, "word " * 30), (8, "a b c d e f g h i j\n" * 4), (9, "same line\nsame line\n\nsame line"), (9, "same line\nsame line\n\nsame line"),
    (None, "null id text that is here for nothing but to be here"), (11, "x" * 5000 + " " + "y " * 3000), (12, "<|endoftext|> 12,345!! ##"),
]


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300").select("doc_id", "text", "lang").withColumn("view", __import__("pyspark").sql.functions.lit(0))
    return real, spark.createDataFrame(ODD, "doc_id long, text string")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def fingerprint(text):
    w = words(fold(text))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_matches_brute_force(docs):
    for frame in docs:
        rows = [(r["doc_id"], fingerprint(r["text"])) for r in frame.collect()]
        prints = sorted({p for _, p in rows})
        top = {p: p for p in prints}

        def root(p):
            while top[p] != p:
                p = top[p]
            return p

        for i, a in enumerate(prints):
            for b in prints[i + 1 :]:
                if (a ^ b).bit_count() <= 3 and root(a) != root(b):
                    top[root(b)] = root(a)
        least = {}
        for d, p in rows:
            if d is not None:
                least[root(p)] = min(d, least.get(root(p), d))
        want = sorted((str(d), p, least.get(root(p))) for d, p in rows)
        got = sorted((str(r["doc_id"]), r["print"] % (1 << 64), r["component_id"]) for r in simhash.group(frame).collect())
        assert got == want


@pytest.mark.parametrize(
    "blocks, small, middle, dense, hot", [(2, 16, 1024, 20_000, 100_000), (2, 2, 2, 50, 5), (2, 2, 50, 20_000, 50), (1, 16, 1024, 20_000, 5), (3, 16, 1024, 20_000, 20), (4, 4, 100, 50, 100_000)]
)
def test_ball_hashing_finds_every_link(spark, blocks, small, middle, dense, hot):
    import random

    random.seed(5)
    prints = [random.getrandbits(64) for _ in range(60)]
    prints += [p ^ sum(1 << b for b in random.sample(range(64), random.randint(1, 4))) for p in prints]
    prints += [prints[0] ^ (x << 16) for x in range(0, 2000, 3)]  # a bucket that fills one block
    prints = sorted(set(prints))
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    edges = simhash.links(spark.createDataFrame(signed, "print long"), simhash.Params(blocks=blocks, small=small, middle=middle, dense=dense))
    got = {r["node"] % (1 << 64): r["root"] for r in simhash.components(edges, hot).collect()}
    top = {p: p for p in prints}

    def root(p):
        while top[p] != p:
            p = top[p]
        return p

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= 3 and root(a) != root(b):
                top[root(b)] = root(a)
    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            assert (root(a) == root(b)) == (got.get(a, a - (a >> 63 << 64)) == got.get(b, b - (b >> 63 << 64)))


def measures(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    where = {}
    for i in range(len(w) - 7):
        where.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {j for at in where.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_measures_and_verdicts(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    for frame in docs:
        texts = sorted(map(str, (measures(r["text"]) for r in frame.collect())))
        rows = quality.score(frame, model).collect()
        assert sorted(str((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])) for r in rows) == texts
        for r in rows:
            assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
            assert not (r["base_failed"] and r["kept"])
    rated = queries.op5_quality(spark, SF).join(labels, "doc_id")
    good, bad = rated.where("quality = 1"), rated.where("quality = 0")
    assert good.where("kept").count() >= 0.97 * good.count()
    assert bad.where("not kept").count() >= 0.9 * bad.count()


def test_quality_without_labels(spark, docs):
    model = quality.fit(docs[0], spark.createDataFrame([], "doc_id long, quality int"))
    assert all(r["kept"] != r["base_failed"] for r in quality.score(docs[0], model).collect())
    assert quality.score(docs[0].limit(0), model).count() == 0


def test_language_held_out_accuracy(spark, docs):
    rows = queries.op6_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    model = langid.learn(docs[0])
    odd = {r["doc_id"]: r for r in langid.predict(docs[1], model).collect()}
    assert [odd[k]["lang_pred"] for k in (1, 2, 3)] == ["und"] * 3
    assert all(0 <= r["score"] <= 1 for r in odd.values())
    assert {r["lang_pred"] for r in langid.predict(docs[1], langid.learn(docs[0].limit(0))).collect()} == {"und"}


def grams(text):
    """Byte 3- and 4-grams of lower-cased letters, other ASCII characters as spaces, none with two spaces in a row."""
    low = "".join(c.lower() if c in string.ascii_uppercase or "À" <= c <= "Þ" and c != "×" else c for c in text)
    data = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in low.encode())
    return [data[i : i + n] for n in (3, 4) for i in range(len(data) - n + 1) if b"  " not in data[i : i + n]]


def test_language_votes_match_exact_sets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null and lang is not null")
    rows, counts = docs.collect(), {}
    for r in rows:
        counts.setdefault(r["lang"], Counter()).update(grams(r["text"]))
    names, share = sorted(counts), {}
    for name in names:
        total = sum(counts[name].values())
        for g, n in counts[name].items():
            if n >= 3:
                share.setdefault(g, {})[name] = n / total
    holds = {g: {k for k, v in by.items() if v >= 0.2 * max(by.values())} for g, by in share.items()}
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, langid.learn(docs)).collect()}
    same = 0
    for r in rows:
        votes = Counter(k for g in grams(r["text"]) for k in holds.get(g, ()))
        best = max(names, key=lambda k: (votes[k], [-ord(c) for c in k]))
        same += got[r["doc_id"]] == best
    assert same >= 0.99 * len(rows)


def test_more_than_64_languages(spark):
    rng = random.Random(3)
    said = {f"l{i:03d}": ["".join(rng.choice(string.ascii_lowercase) for _ in range(7)) for _ in range(12)] for i in range(90)}
    data = [(i * 10 + j, " ".join(rng.choice(words) for _ in range(40)), lang) for i, (lang, words) in enumerate(said.items()) for j in range(5)]
    frame = spark.createDataFrame(data, "doc_id long, text string, lang string").selectExpr("*", "lang as code", "lang as word", "lang as mask")
    got = langid.predict(frame, langid.learn(frame)).collect()
    assert sum(r["lang_pred"] == r["lang"] == r["code"] for r in got) >= 0.98 * len(data)
    assert langid.predict(frame.limit(0), langid.learn(frame.limit(0))).count() == 0


def test_quality_verdicts_on_rows_outside_the_fit(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    rated = quality.score(docs.where("doc_id % 2 = 1"), model).join(labels, "doc_id")
    good, bad = rated.where("quality = 1"), rated.where("quality = 0")
    assert good.where("kept").count() >= 0.95 * good.count() and bad.where("not kept").count() >= 0.85 * bad.count()


def test_empty_tables_and_clashing_names(spark):
    frame = spark.createDataFrame([(None, None), (1, ""), (1, "the same words"), (1, "the same words"), (2, "x " * 200_000)], "doc_id long, text string")
    odd = frame.selectExpr("*", "1 as ids", "2 as start", "3 as sequence_id", "4 as n_tokens", "5 as score", "6 as kept")
    for f in (frame, odd):
        encoded = bpe.encode(f, public_tokenizers.path("byte_bpe_50k.tiktoken"), ["doc_id"], with_ids=False)
        packed = packing.pack(f, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
        assert encoded.count() == 5 and packed.agg({"doc_tokens": "count"}).first()[0] >= 5
        assert packed.select("doc_id").distinct().count() == 3
    assert bpe.encode(odd.limit(0), public_tokenizers.path("byte_bpe_50k.tiktoken"), ["doc_id"], with_ids=False).count() == 0
    assert packing.pack(odd.limit(0), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False).count() == 0


def library():
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(docs):
    own = library()
    for frame in docs:
        want = []
        for r in frame.collect():
            text = r["text"] or ""
            ids = own.encode_ordinary(text)
            want.append((str(r["doc_id"]), len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        got = [(str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode(frame, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()]
        assert sorted(got) == sorted(want)


def test_prefix_table_appends_and_edits():
    import random

    random.seed(2)
    v = bpe.Vocabulary(bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.json")))
    own = library()
    for _ in range(300):
        a, b, c = ("".join(random.choice("thereinaouéss") for _ in range(random.randint(0, 12))).encode() for _ in range(3))
        table = bpe.PrefixTable(v, a)
        table.append(b)
        assert table.ids() == (own._encode_single_piece(a + b) if a + b else [])
        cut = random.randint(0, len(a))
        table.edit(cut, len(a), c)
        now = a[:cut] + c + b
        assert table.ids() == (own._encode_single_piece(now) if now else [])


def test_packing_holds_every_id_once(docs):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    for frame in docs:
        rows = packing.pack(frame, public_tokenizers.path("byte_bpe_50k.json")).collect()
        want = sorted(str((r["doc_id"], [*own.encode(r["text"] or "", add_special_tokens=False).ids, 0])) for r in frame.collect())
        whole, sequences = {}, {}
        for r in rows:
            assert zlib.crc32(struct.pack(f"<{r['length']}I", *r["ids"])) == r["ids_crc32"] and len(r["ids"]) == r["length"]
            whole.setdefault(str(r["doc_id"]), []).append(r)
            sequences.setdefault(r["sequence_id"], []).append(r)
        got = []
        for parts in whole.values():
            starts = sum(p["start"] == 0 for p in parts)
            parts.sort(key=lambda p: p["start"])
            for k in range(starts):  # repeated rows are packed each
                got.append(str((parts[0]["doc_id"], [i for p in parts[k::starts] for i in p["ids"]])))
        assert sorted(got) == want
        for parts in sequences.values():
            at = 0
            for p in sorted(parts, key=lambda p: p["offset"]):
                assert p["offset"] == at
                at += p["length"]
            assert at <= 1024
        total = sum(r["length"] for r in rows)
        if len(rows) > 100:
            assert total / (1024 * len(sequences)) > 0.98


def test_packing_takes_added_tokens_as_the_library_does(spark, docs):
    from tokenizers import Tokenizer

    own, e = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), "<|endoftext|>"
    texts = ["abc <|endoftext|> def", e, e + e + " x", f"x  {e}\n\n{e}", "<|endof", "text|> the two before make none", "", f"é{e}漢字{e[:-1]}{e}", None, "plain text", f"{e[:5]}{e}"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["ids"] for r in packing.pack(frame, public_tokenizers.path("byte_bpe_50k.json"), added_tokens=True).collect()}
    assert [got[i] for i in range(len(texts))] == [[*own.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]


def test_packing_query_takes_added_tokens(spark, tmp_path):
    spark.createDataFrame([(1, "abc <|endoftext|> def")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    (row,) = queries.op10_packing(spark, str(tmp_path)).collect()
    assert (row["doc_tokens"], row["ids_crc32"]) == (5, zlib.crc32(struct.pack("<5I", 39305, 220, 50256, 825, 0)))
