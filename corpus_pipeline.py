"""From documents to packed sequences: quality rules, line dedup, near-dedup, secret redaction, packing.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept. All but the last return the columns of
``documents``; ``n_chars`` follows the text. Further columns of any name are carried along, texts may be of any length, and
an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoforge.llm import line_dedup, packing, quality, secret_scan, simhash
from convoforge.llm.scratch import drop, working, written


def _apart(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """The rows with columns c0, c1, ... besides doc_id and text, so no name of the caller meets one of an operator."""
    columns = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*columns)
    return plain.withColumns({c: F.col(columns[docs.columns.index(c)]) for c in ("doc_id", "text")}), columns


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the classifier reject go.

    A null, empty or very short text goes; a null or repeated doc_id is judged by its text like any other; without labels
    of both classes the rules alone decide.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows, columns = _apart(docs)
    return quality.score(rows, quality.fit(rows.select("doc_id", "text"), labels), carry=columns).where("kept").select(*columns).toDF(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least five documents hold stay in the largest doc_id alone; every document stays.

    A null text becomes an empty one; rows without doc_id keep all their lines and count for none; rows that repeat a
    doc_id are one document.
    """
    rows, columns = _apart(docs)
    text = columns[docs.columns.index("text")]
    kept = line_dedup.dedup(rows.drop(text), carry=[c for c in columns if c != text] + ["text"])
    return _counted(kept.withColumnRenamed("text", text).select(*columns).toDF(*docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays, that of the smallest doc_id; groups without ids keep one too.

    Texts without words, null ones too, are one group; rows that repeat a doc_id count apart.
    """
    return simhash.representatives(docs).select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a marker; every document stays, a null text as it is."""
    return _counted(secret_scan.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their ids, sequence and offset; a null or empty text is its end mark alone."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), added_tokens=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("near dedup", near_dedup),
    ("secret scan", secrets),
    ("packing", pack),
]

#: SQL can't express the fingerprints, the classifier and the tokens.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stage writes for itself goes once its rows are written; those go once the next stage's are."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with working(spark):
            docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"), stays=True)
        if last is not None:
            drop(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
