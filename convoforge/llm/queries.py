"""The numbered queries: each applies its operator to its whole table and derives the agreed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, centroids, langid, line_dedup, negatives, packing, pii, quality, secret_scan, sharding, simhash, toxicity
from .scratch import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(_table(spark, sf_dir, "documents"), carry=["doc_id"])


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(_table(spark, sf_dir, "documents"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.group(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")), carry=["doc_id"])


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    third = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    rated = langid.predict(docs, langid.learn(docs.where(third != 1)), carry=["doc_id"])
    return rated.select("doc_id", F.coalesce(third == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sharding.keyed(_table(spark, sf_dir, "documents")).select("doc_id", "sort_hash", "size", "text_crc32")
    docs = written(docs, "shard-keys")
    rows = sharding.assign(docs, keys=docs)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.tiktoken"), ["doc_id"], with_ids=False)


def op9_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), with_ids=False, added_tokens=True)


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.pmod("vec_id", F.lit(7)) == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return negatives.mine(_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=label)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    model = toxicity.fit(docs.where(~held_out), _table(spark, sf_dir, "labels"))
    rated = toxicity.score(docs, model, carry=["doc_id"])
    return rated.select("doc_id", held_out.alias("held_out"), "score", "predicted")


QUERIES = {f.__name__: f for f in (op1_lines, op2_secrets, op3_neighbours, op4_simhash, op5_quality, op6_language, op7_shards, op8_bpe, op9_personal, op10_packing, op11_negatives, op12_centroids, op13_toxicity)}


def _lloyd_sql(k: int = 8, rounds: int = 10, width: int = 64) -> str:
    """Plain rounds over all centroids, written out one after the other."""
    steps = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {width})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1 AS j, x FROM v ORDER BY j LIMIT {k})",
    ]
    for turn in range(rounds + 1):
        steps.append(
            f"a{turn} AS MATERIALIZED (SELECT r, vec_id, x, m.d AS distance, m.j AS cluster FROM (SELECT v.r, any_value(v.vec_id) AS vec_id, any_value(v.x) AS x, min({{'d': list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, 'j': c.j}}) AS m FROM v, c{turn} c GROUP BY v.r))"
        )
        if turn < rounds:
            steps.append(
                f"s{turn} AS (SELECT cluster, list(s ORDER BY i) AS x FROM (SELECT cluster, i, floor(sum(e)::DOUBLE / count(*))::BIGINT AS s FROM (SELECT cluster, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM a{turn}) GROUP BY cluster, i) GROUP BY cluster), "
                f"c{turn + 1} AS MATERIALIZED (SELECT c.j, coalesce(s.x, c.x) AS x FROM c{turn} c LEFT JOIN s{turn} s ON c.j = s.cluster)"
            )
    return (
        f"WITH {', '.join(steps)} SELECT a.vec_id, a.cluster::INTEGER AS cluster, a.distance, (sum(a.distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia, "
        f"(sum(a.distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON a.cluster = c.j"
    )


#: Those that SQL can say.
ORACLE_SQL: dict[str, str] = {
    "op11_negatives": """
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END) AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.r AS ar, a.vec_id AS anchor_id, b.r, b.vec_id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM e a JOIN e b ON a.r <> b.r WHERE a.vec_id % 100 = 0
), p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id, (row_number() OVER (PARTITION BY p.ar, p.r ORDER BY n.score DESC, n.vec_id))::INTEGER AS rank,
  n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.ar = p.ar AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
QUALIFY rank <= 5""",
    "op12_centroids": _lloyd_sql(),
    "op1_lines": """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), g AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT k.doc_id, k.line, k.pos, g.key IS NOT NULL AND k.doc_id <> g.keeper AS gone FROM k LEFT JOIN g ON k.key = g.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
}
