"""Hard negatives and centroid clustering against brute force, toxicity on held-out rows."""

import hashlib
import math
import random
import zlib
from collections import Counter
from dataclasses import replace

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from convoforge.llm import centroids, negatives, queries, toxicity

SF = "/root/testdata/sf0.001"


def equals_sql(spark, name, columns):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = sorted(tuple(r) for r in queries.QUERIES[name](spark, SF).select(*columns).collect())
    assert got and got == sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall())


def test_hard_negatives_equal_sql(spark):
    equals_sql(spark, "op11_negatives", ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])


def test_centroids_equal_sql(spark):
    equals_sql(spark, "op12_centroids", ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])


def brute_negatives(rows, anchor, top=5, scale=256):
    kept = [(i, v, [math.floor(scale * float(np.float32(x))) for x in vec]) for i, vec, v in rows if i is not None and v is not None and vec and all(x is not None and math.isfinite(x) for x in vec)]
    width = Counter(len(x) for *_, x in kept).most_common(1)[0][0]
    kept = [(i, v, x) for i, v, x in kept if len(x) == width]
    out = []
    for n, (i, label, x) in enumerate(kept):
        if not anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), j, v) for m, (j, v, y) in enumerate(kept) if m != n)
        for s, j, v in [t for t in scored if t[2] == label][:top]:
            below = [(t, k) for t, k, w in scored if w != label and 80 * -s <= 100 * -t <= 100 * -s][:top]
            out += [(i, j, r + 1, k, -s, -t) for r, (t, k) in enumerate(below)]
    return sorted(out)


def odd_vectors(n=300, width=6):
    rng = random.Random(5)
    near = [[rng.gauss(0, 0.4) for _ in range(width)] for _ in range(4)]
    rows = [(i, [x + rng.gauss(0, 0.1) for x in near[i % 4]], i % 3) for i in range(n)]
    rows += [(1000 + i, rows[0][1], i % 2) for i in range(60)]  # copies, more of them than any answer holds
    rows += [(20, rows[20][1], 20 % 3), (20, rows[21][1], 0), (40, rows[40][1], 1)]  # repeated ids
    rows += [(None, rows[1][1], 1), (2001, None, 1), (2002, rows[2][1], None), (2003, [], 2), (2004, [1.0] * (width + 1), 0)]
    rows += [(2010, [float("nan")] + [1.0] * (width - 1), 0), (2020, [None] + [1.0] * (width - 1), 0), (2030, [float("inf")] * width, 1), (2040, [0.0] * width, 2)]
    rows += [(2050, [-x for x in rows[5][1]], 0), (2060, [1e30] * width, 1)]
    return rows


def frame(spark, rows):
    table = spark.createDataFrame([(i, v, label, "x") for i, v, label in rows], "vec_id long, embedding array<float>, label int, score string")
    return table.withColumn("id", F.lit(7)).withColumn("node", F.lit("clash"))


@pytest.mark.parametrize("p", [negatives.Params(), negatives.Params(cells=4, block=32, wave=5, sample=50)])
def test_hard_negatives_match_brute_force_on_odd_rows(spark, p):
    rows = odd_vectors()
    got = negatives.mine(frame(spark, rows).repartition(3), F.col("id") % 10 == 0, p)
    small = [r for r in rows if not (r[1] and r[1][0] == 1e30)]
    want = brute_negatives(small, lambda i: i % 10 == 0)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 100
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_hard_negatives_of_empty_tables(spark):
    assert negatives.mine(frame(spark, odd_vectors()[:3]).limit(0), F.col("id") % 10 == 0).count() == 0
    assert negatives.mine(frame(spark, odd_vectors()[1:9]), F.col("id") % 10 == 0).count() == 0


def test_bounds_hold_every_score_and_spare_most(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-200, 200, (500, 16))
    edges = np.ceil(np.quantile(x[:100], np.arange(1, 64) / 64, axis=0)).T.astype(np.int64)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array([0] * 500), pa.array([[i] for i in range(500)]), pa.array(x.tolist(), pa.list_(pa.int32()))], ["node", "label", "members", "vec"])
    (row,) = negatives._blocks(iter([batch]), 16, edges, negatives.Params())
    block = negatives.Block.of(row, 0, 16, edges)
    q = rng.integers(-200, 200, (40, 16))
    lower, upper = block.bounds(q)
    score = q @ x.T
    assert (lower <= score).all() and (score <= upper).all()
    assert ((upper >= np.sort(lower, 1)[:, -6:-5]).sum(1) < 100).all()


def brute_clusters(rows, p):
    kept = [(i, [math.floor(p.scale * float(np.float32(x))) for x in v]) for i, v, _ in rows if v and len(v) == p.width and all(x is not None and math.isfinite(x) and abs(x) < 1e5 for x in v)]
    digest = lambda i: hashlib.sha256(f"{p.seed}:{i}".encode()).hexdigest() if i is not None else "~"
    c = [x for _, x in sorted(((digest(i), x) for i, x in kept))[: p.k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, m, strict=True)), j) for j, m in enumerate(c))
    for _ in range(p.rounds):
        own = [near(x)[1] for _, x in kept]
        for j in range(len(c)):
            if members := [x for (_, x), o in zip(kept, own, strict=True) if o == j]:
                c[j] = [sum(col) // len(members) for col in zip(*members, strict=True)]
    last = [(i, *near(x)) for i, x in kept]
    inertia = Counter()
    for _, d, j in last:
        inertia[j] += d
    text = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted(((i, j, d, inertia[j], inertia.total(), text[j]) for i, d, j in last), key=str)


@pytest.mark.parametrize("k, rounds", [(8, 10), (3, 0), (40, 4), (1, 2)])
def test_centroids_match_brute_force_on_odd_rows(spark, k, rounds):
    p = centroids.Params(k=k, rounds=rounds, width=6, block=16)
    got = centroids.cluster(frame(spark, odd_vectors()).repartition(3), p)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_clusters(odd_vectors(), p)


def test_centroids_of_few_rows_and_ties(spark):
    p = centroids.Params(k=8, rounds=3, width=2, scale=1)
    grid = [(i, [float(i % 5), float(i // 5)], 0) for i in range(25)] * 2  # many equal distances
    assert sorted((tuple(r) for r in centroids.cluster(frame(spark, grid), p).collect()), key=str) == brute_clusters(grid, p)
    few = grid[:3]
    assert sorted((tuple(r) for r in centroids.cluster(frame(spark, few), p).collect()), key=str) == brute_clusters(few, p)
    assert centroids.cluster(frame(spark, few).limit(0), p).count() == 0


def test_exponion_scans_less_than_all_and_leaves_settled_vectors_alone():
    rng = np.random.default_rng(3)
    c = rng.integers(-1000, 1000, (50, 8))
    x = c[rng.integers(0, 50, 2000)] + rng.integers(-30, 30, (2000, 8))
    g = centroids.Geometry(c)
    a, u, low, _ = centroids.exponion(x, np.zeros(2000, np.int32), np.full(2000, np.inf, np.float32), np.zeros(2000, np.float32), g)
    square = ((x[:, None] - c[None]) ** 2).sum(-1)
    assert (a == square.argmin(1)).all()
    assert (u >= np.sqrt(square.min(1))).all() and (low <= np.sqrt(np.sort(square, 1)[:, 1])).all()
    assert centroids.exponion(x, a, u, low, g)[3] == 0
    c2 = c + rng.integers(-5, 5, c.shape)
    moved = np.sqrt(((c2 - c) ** 2).sum(1))
    b, *_, scans = centroids.exponion(x, a, (u + moved[a]).astype(np.float32) + 1, low - np.float32(moved.max()) - 1, centroids.Geometry(c2))
    assert (b == ((x[:, None] - c2[None]) ** 2).sum(-1).argmin(1)).all() and scans < 2000 * 50 / 20


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in queries.op13_toxicity(spark, folder).collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    told = Counter((r["toxic"], got[r["doc_id"]]["predicted"]) for r in labels if got[r["doc_id"]]["held_out"])
    assert told[1, 1] >= 0.85 * (told[1, 0] + told[1, 1]) and told[0, 1] <= 0.01 * told[0, 0], told
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())


def brute_features(text, p):
    def mix(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 % 2**64
        x ^= x >> 27
        x = x * 0x94D049BB133111EB % 2**64
        return x ^ (x >> 31)

    def word_hash(w):  # the hash of the shared helper, word by word
        from convoforge.llm.textbytes import segment_hashes

        data = np.frombuffer(w.encode(), np.uint8)
        return int(segment_hashes(data, np.array([0]), np.array([len(data)]))[0])

    lower = "".join(c.lower() if c < "\x80" else c for c in text or "")
    words = "".join(c if c >= "\x80" or c.isalnum() else " " for c in lower).split(" ")
    words = [w for w in words if w]
    hashes = [word_hash(w) for w in words]
    found = {mix(h) for h in hashes}
    found |= {mix((word_hash(w[:n]) + (n << 32)) % 2**64) for w in words for n in p.stems if len(w) > n}
    found |= {mix((a * 0xA0761D6478BD642F + b + g) % 2**64) for g in p.gaps for a, b in zip(hashes, hashes[g:], strict=False)}
    return sorted({f >> (64 - p.bits) for f in found})


def test_toxicity_features_match_a_plain_count():
    import pyarrow as pa

    texts = ["Du BIST, ein-Tölpel!", "", None, "one", "a b c d e f ünïcödé wörds\nand lines", "x " * 3000, "…—é"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([0] * len(texts)), pa.array(texts)], ["place", "label", "text"])
    p = toxicity.Params()
    (out,) = toxicity._features(iter([batch]), p)
    assert out["ids"].to_pylist() == [brute_features(t, p) for t in texts]


def test_ftrl_keeps_few_weights_and_matches_plain_steps():
    p = toxicity.Params(bits=8, l1=0.5, rate=0.5)
    rng = random.Random(2)
    rows = []
    for _ in range(300):
        y = rng.random() < 0.3
        rows.append((np.array(sorted({rng.randrange(3, 250) for _ in range(12)} | ({1} if y else {2}))), int(y)))
    got, bias = toxicity.ftrl(iter(rows * 2), p, -1.0)
    z, n = {}, {}
    z[-1] = (p.smooth / p.rate + p.l2) * 1.0

    def weight(i):
        zi, l1 = z.get(i, 0.0), 0.0 if i == -1 else p.l1
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((p.smooth + math.sqrt(n.get(i, 0.0))) / p.rate + p.l2)

    for at, y in rows * 2:
        ids = [*map(int, at), -1]
        w = {i: weight(i) for i in ids}
        g = 1 / (1 + math.exp(-sum(w.values()))) - y
        for i in ids:
            s = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / p.rate
            z[i], n[i] = z.get(i, 0.0) + g - s * w[i], n.get(i, 0.0) + g * g
    assert np.allclose(got, [weight(i) for i in range(256)]) and math.isclose(bias, weight(-1))
    assert got[1] > 1 > -0.5 > got[2] and (got == 0).sum() > 50


def test_toxicity_of_odd_rows(spark):
    schema = "doc_id long, text string, score string, label string"
    rows = [(i, f"word{i} some more words " + ("vile " if i % 3 == 0 else ""), "s", "l") for i in range(90)]
    rows += [(None, "vile", "s", "l"), (500, None, "s", "l"), (501, "", "s", "l"), (0, rows[0][1], "s", "l"), (502, "plain words " * 50_000 + "vile", "s", "l")]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(None, 1), (3, 0), (700, 1)], "doc_id long, toxic int")
    p = toxicity.Params(l1=0.2)
    got = toxicity.score(docs, toxicity.fit(docs, labels, p), p, carry=["doc_id", "text"]).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["predicted"] == int("vile" in (r["text"] or "")), r["doc_id"]
    assert len({r["score"] for r in got if r["doc_id"] in (500, 501)}) == len({r["score"] for r in got if r["doc_id"] == 0}) == 1
    assert set(toxicity.score(docs, toxicity.fit(docs, labels.limit(0), p)).columns) == {"doc_id", "text", "label", "score", "predicted"}
    assert {r["predicted"] for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect()} == {0}
    assert {r["predicted"] for r in toxicity.score(docs, toxicity.fit(docs, labels.withColumn("toxic", F.lit(1)))).collect()} == {1}
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0
    few = replace(p, max_train_rows=40, max_train_features=100)
    assert len(toxicity.fit(docs, labels, few).at) <= 100
