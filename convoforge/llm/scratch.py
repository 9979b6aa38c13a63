"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


#: Paths of the tables written inside the innermost ``working`` block.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where that is unset (tests, one machine), a temporary folder of our own."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not shared:
        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="convoforge-")
        sc.setCheckpointDir(shared)
        shared = sc.getCheckpointDir()
    return shared.rstrip("/")


def written(df: DataFrame, name: str, by: str | None = None, stays: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: lineage ends there, and a lost executor costs nothing written.

    ``by``: one folder for each value of this column, so that readers of some values open no other. ``stays``: the table
    outlives the ``working`` block around it.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    if (made := _MADE.get()) is not None and not stays:
        made.append(path)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


@contextmanager
def working(spark: SparkSession) -> Iterator[None]:
    """Tables that ``written`` makes inside the block are deleted when it ends, also when it fails.

    Operators return frames that read such tables, so the block holds the write of the result as well:

        with working(spark):
            simhash.group(docs).write.parquet(out)
    """
    made: list[str] = []
    mark = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(mark)
        for path in made:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop(df: DataFrame) -> None:
    """Delete the files of a table made by ``written`` once no later step reads it."""
    spark = df.sparkSession
    root = folder(spark).split(":", 1)[-1].lstrip("/")
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if root in name:
            _delete(spark, name)
