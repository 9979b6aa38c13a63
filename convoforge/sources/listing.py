"""Files below a folder, as they lie there: empty ones too, and no symbolic link followed.

Spark's own listing follows links and passes over files of no bytes, so local folders are listed here, level by level:
few folders by the driver, many by tasks. Folders of other stores, which know no links, are listed by Spark.

Defined results: a link, whether to a file, to a folder or to nothing, is told as a link and never read; a folder that can't
be read is told as ``unreadable``; what is neither file, folder nor link (a socket, say) is left out; a missing root is empty.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import checkpointed

ENTRY = "path string, uri string, kind string, size_bytes long, modified_unix long"
#: Up to so many folders of a level are listed by the driver.
FEW_FOLDERS = 32


def local(path: str) -> str | None:
    """The plain path of a local path or URI; null for other stores."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    return path if "://" not in path else None


def canonical(spark: SparkSession, path: str) -> str:
    """The path with all links in it followed (also those of folders above a file that is not there yet), as a URI where not local."""
    here = local(path)
    if here is not None:
        return os.path.realpath(here)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def inside(spark: SparkSession, path: str, folder: str) -> bool:
    """Whether a path, once links are followed, lies in a folder or is it."""
    return (canonical(spark, path) + "/").startswith(canonical(spark, folder).rstrip("/") + "/")


def entries(folder: str) -> list[tuple[str, str, str, int, int]]:
    """What lies directly in a local folder."""
    try:
        found = sorted(os.scandir(folder), key=lambda e: e.name)
    except OSError:
        return [(folder, f"file:{folder}", "unreadable", 0, 0)]
    out = []
    for e in found:
        try:
            said = e.stat(follow_symlinks=False)
        except OSError:  # gone since
            continue
        kind = "link" if stat.S_ISLNK(said.st_mode) else "folder" if stat.S_ISDIR(said.st_mode) else "file" if stat.S_ISREG(said.st_mode) else None
        if kind:
            out.append((e.path, f"file:{e.path}", kind, said.st_size, int(said.st_mtime)))
    return out


def _listed(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b in batches:
        rows = [r for folder in b["path"].to_pylist() for r in entries(folder)]
        names = [c.split()[0] for c in ENTRY.split(", ")]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)


def walk(spark: SparkSession, root: str) -> DataFrame:
    """(path, uri, kind, size_bytes, modified_unix) of everything below ``root``; kinds are file, folder, link and unreadable."""
    top = local(root)
    if top is None:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        bare = F.regexp_replace("path", r"\A[a-z][a-z0-9+.-]*:(//[^/]*)?(?=/)", "")
        return files.select(bare.alias("path"), F.col("path").alias("uri"), F.lit("file").alias("kind"), F.col("length").alias("size_bytes"), F.unix_timestamp("modificationTime").alias("modified_unix"))
    top = os.path.abspath(top)
    rows: list[tuple[str, str, str, int, int]] = []
    folders, parts = [top] if os.path.isdir(top) else [], []
    while folders and len(folders) <= FEW_FOLDERS:
        level = [e for folder in folders for e in entries(folder)]
        rows += level
        folders = [e[0] for e in level if e[2] == "folder"]
    level = spark.createDataFrame([(f,) for f in folders], "path string")
    while folders:  # too many for the driver: from here on, tasks list them
        level = checkpointed(level.repartition(min(level.count(), 4 * spark.sparkContext.defaultParallelism)).mapInArrow(_listed, ENTRY))
        parts.append(level)
        level = level.where("kind = 'folder'").select("path")
        folders = level.limit(1).collect()
    return reduce(DataFrame.unionByName, parts, spark.createDataFrame(rows, ENTRY))


def files(spark: SparkSession, root: str, ending: str = "") -> DataFrame:
    return walk(spark, root).where((F.col("kind") == "file") & F.endswith("path", F.lit(ending))).drop("kind")


def warnings(listed: DataFrame, most: int = 20) -> list[str]:
    """What a user should hear of a listing: how many links were skipped and folders could not be read, with the first few."""
    out = []
    for kind, said in (("link", "symbolic links were skipped"), ("unreadable", "folders could not be read")):
        rows = listed.where(F.col("kind") == kind)
        n = rows.count()
        if n:
            some = [r["path"] for r in rows.orderBy("path").limit(most).collect()]
            out.append(f"{n} {said}: {', '.join(some)}{', ...' if n > most else ''}")
    return out
