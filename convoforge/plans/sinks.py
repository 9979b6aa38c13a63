"""Guards, copies and small driver-side files, on any file system that Hadoop knows."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicon import MTIME_SLACK_S
from ..sources.listing import inside
from ..sources.scratch import checkpointed
from ..sources.stores import opened


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(p)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole, from the driver."""
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(text.encode())
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def write_json(spark: SparkSession, path: str, value: object) -> None:
    write_text(spark, path, json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n")


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def guard(spark: SparkSession, out: str, sources: list[str], marker: str) -> None:
    """Refuse a destination inside a source (links followed), or one that holds files but not our marker."""
    fs, p = _fs(spark, out)
    for source in sources:
        if inside(spark, out, source):
            raise ValueError(f"{out} lies inside the source {source}")
    if fs.exists(p):
        if not fs.isDirectory(p):
            raise ValueError(f"{out} is a file")
        if len(fs.listStatus(p)) and not exists(spark, f"{out}/{marker}"):
            raise ValueError(f"{out} is not empty and has no {marker}")


def write_texts(rows: DataFrame, out: str) -> int:
    """Each (file, text) row becomes the file ``out``/file; a name given twice has the last text. Returns how many there are.

    Tasks write below a staging folder, each attempt under a name of its own; once all are done, other tasks move the
    files that finished attempts told of into place. If writing fails, the staging folder goes and ``out`` is as it was.
    """
    spark, out = rows.sparkSession, out.rstrip("/")
    stage = f"{out}/_staging-{uuid.uuid4().hex}"

    def write(batches: Iterator) -> Iterator:
        import pandas as pd

        own = uuid.uuid4().hex
        for at, rows in enumerate(batches):
            staged = []
            for i, text in enumerate(rows["text"]):
                staged.append(f"{stage}/{own}/{at}-{i}")
                store, path = opened(staged[-1])
                if not i and not at:
                    store.create_dir(path.rpartition("/")[0], recursive=True)
                with store.open_output_stream(path) as f:
                    f.write((text or "").encode())
            yield pd.DataFrame({"file": rows["file"], "staged": staged})

    def place(batches: Iterator) -> Iterator:
        import pandas as pd

        for rows in batches:
            for file, staged in zip(rows["file"], rows["staged"], strict=True):
                store, path = opened(staged)
                target = opened(f"{out}/{file}")[1]
                if store.get_file_info(path).is_file:  # else this was done by an attempt whose end was not heard of
                    store.create_dir(target.rpartition("/")[0], recursive=True)
                    store.move(path, target)
            yield pd.DataFrame({"file": rows["file"]})

    one = rows.groupBy("file").agg(F.max("text").alias("text"))
    try:
        staged = checkpointed(one.mapInPandas(write, "file string, staged string"))
        return staged.mapInPandas(place, "file string").count()
    finally:
        delete(spark, stage)


def write_counted(rows: DataFrame, out: str, parts: tuple[str, ...], patterns: dict[str, str]) -> tuple[dict[str, int], dict[str, int]]:
    """(part, value) rows as lines of text below ``out``/<part>.jsonl: lines by part, and matches of each pattern in all lines.

    Counts are taken while the lines are written, in one pass; folders come into place once all are whole, and a part without lines has none.
    """
    spark, stage = rows.sparkSession, f"{out}/_staging-{uuid.uuid4().hex}"
    seen = Observation()
    found = [F.sum(F.size(F.regexp_extract_all("value", F.lit(p), F.lit(0)))).alias(f"found {k}") for k, p in patterns.items()]
    counted = rows.select("part", "value").observe(seen, *(F.count_if(F.col("part") == p).alias(f"lines {p}") for p in parts), *found)
    try:
        counted.write.partitionBy("part").text(stage)
        lines = {p: n for p in parts if (n := seen.get[f"lines {p}"])}
        fs, _ = _fs(spark, out)
        for part in parts:
            target = _fs(spark, f"{out}/{part}.jsonl")[1]
            fs.delete(target, True)
            if part in lines:
                fs.rename(_fs(spark, f"{stage}/part={part}")[1], target)
    finally:
        delete(spark, stage)
        if not fs_entries(spark, out):
            delete(spark, out)
    return lines, {k: n for k in patterns if (n := seen.get[f"found {k}"])}


def fs_entries(spark: SparkSession, path: str) -> int:
    fs, p = _fs(spark, path)
    return len(fs.listStatus(p)) if fs.exists(p) else 0


def hash_files(plan: DataFrame) -> DataFrame:
    """(relpath, sha256) of (relpath, source) rows, read in pieces in tasks; null where a file can't be read."""

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pandas as pd

        for rows in batches:
            said = []
            for source in rows["source"]:
                try:
                    store, path = opened(source)
                    own = hashlib.sha256()
                    with store.open_input_stream(path) as stream:
                        while piece := stream.read(1 << 20):
                            own.update(piece)
                    said.append(own.hexdigest())
                except OSError:
                    said.append(None)
            yield pd.DataFrame({"relpath": rows["relpath"], "sha256": said})

    return plan.select("relpath", "source").mapInPandas(run, "relpath string, sha256 string")


def copy_files(plan: DataFrame, keep_same: bool = False) -> DataFrame:
    """Copy (source, target) rows in tasks, keeping modification times where the file system allows; one row per file with
    copied and, where it failed, error. Targets that exist are replaced, or with ``keep_same`` kept where size and time are
    the source's (``kept``)."""

    def run(batches: Iterator) -> Iterator:
        import os
        import shutil
        from pathlib import Path

        import pandas as pd
        from pyarrow import fs as pafs

        local = lambda x: x.removeprefix("file://").removeprefix("file:") if x.startswith(("/", "file:")) else None
        for rows in batches:
            said, kept = [], []
            for source, target in zip(rows["source"], rows["target"], strict=True):
                kept.append(False)
                try:
                    a, b = local(source), local(target)
                    if a and b and keep_same and os.path.exists(b):
                        old, new = os.stat(b), os.stat(a)
                        kept[-1] = old.st_size == new.st_size and abs(old.st_mtime - new.st_mtime) <= MTIME_SLACK_S
                    if kept[-1]:
                        pass
                    elif a and b:
                        Path(b).parent.mkdir(parents=True, exist_ok=True)
                        part = f"{b}.{os.getpid()}.part"
                        shutil.copy2(a, part)
                        os.replace(part, b)  # a task that is run again leaves no half file
                    else:
                        pafs.copy_files(source, target)
                    said.append("")
                except OSError as e:
                    said.append(str(e))
            yield pd.DataFrame({"source": rows["source"], "target": rows["target"], "copied": [not x for x in said], "kept": kept, "error": said})

    return plan.select("source", "target").mapInPandas(run, "source string, target string, copied boolean, kept boolean, error string")
