"""Plans and reports over file inventories: what to copy, what to merge, what fails verification, what to restore.

Inventories are tables of (relpath, size_bytes, mtime) and, where hashed, sha256; times are whole seconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L

SKIPPED_DIRS, RUNTIME_DIRS = ("node_modules", ".git"), ("terminals", "agent-tools")


def same_time(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.abs(a - b) <= L.MTIME_SLACK_S


def walked(files: DataFrame, skip_runtime: bool = False) -> DataFrame:
    """Files that a backup looks at: none below dependency or version-control folders, nor (if asked) below top-level runtime ones."""
    dirs = F.slice(F.split("relpath", "/"), 1, F.greatest(F.size(F.split("relpath", "/")) - 1, F.lit(0)))
    rows = files.where(~F.arrays_overlap(dirs, F.array(*map(F.lit, SKIPPED_DIRS))))
    return rows.where(~F.coalesce(F.try_element_at(dirs, F.lit(2)).isin(*RUNTIME_DIRS), F.lit(False))) if skip_runtime else rows


def copy_plan(source: DataFrame, destination: DataFrame) -> DataFrame:
    """Every source file with action copy (new, or of another size or time) or keep."""
    there = destination.select("relpath", F.col("size_bytes").alias("_size"), F.col("mtime").alias("_mtime"))
    rows = source.join(there, "relpath", "left")
    keep = F.coalesce((F.col("size_bytes") == F.col("_size")) & same_time("mtime", "_mtime"), F.lit(False))
    return rows.withColumn("action", F.when(keep, "keep").otherwise("copy")).drop("_size", "_mtime")


def merge_manifest(prior: DataFrame, current: DataFrame, key: str = "relpath") -> DataFrame:
    """Prior rows that this run did not see, and all of this run's rows."""
    return prior.join(current.select(key), key, "left_anti").unionByName(current, allowMissingColumns=True)


def reuse_hashes(files: DataFrame, prior: DataFrame) -> DataFrame:
    """Adds the prior sha256 of files that kept size and time; null where one must be computed."""
    old = prior.select("relpath", F.col("sha256").alias("_old"), F.col("size_bytes").alias("_size"), F.col("mtime").alias("_mtime"))
    same = (F.col("size_bytes") == F.col("_size")) & same_time("mtime", "_mtime")
    return files.drop("sha256").join(old, "relpath", "left").withColumn("sha256", F.when(same, F.col("_old"))).drop("_old", "_size", "_mtime")


def safe_path(c: Column | str) -> Column:
    """Relative, and never upwards."""
    c = F.col(c) if isinstance(c, str) else c
    return (c != "") & ~F.startswith(c, F.lit("/")) & ~F.arrays_overlap(F.split(c, "/"), F.array(F.lit(".."))) & ~F.contains(c, F.lit("\\"))


def verify(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(relpath, project, status): unhashed, unsafe, missing, ok or failed for every manifest row, and unlisted for files
    of projects with at least one hash that no row covers. A row without relpath is looked up by project and file name
    and passes if any file of that name has its hash."""
    rows = manifest.select("project", "relpath", "file", "sha256", F.monotonically_increasing_id().alias("_row"))
    have = files.select(F.col("relpath").alias("_at"), F.col("project").alias("_project"), F.element_at(F.split("relpath", "/"), -1).alias("_name"), F.col("sha256").alias("_now"))
    exact = rows.where("relpath is not null").join(have.select("_at", "_now"), F.col("relpath") == F.col("_at"), "left")
    named = rows.where("relpath is null").join(have, (F.col("project") == F.col("_project")) & (F.col("file") == F.col("_name")), "left")
    named = named.groupBy("project", "relpath", "file", "sha256", "_row").agg(F.max("_at").alias("_at"), F.max(F.when(F.col("_now") == F.col("sha256"), F.col("_now"))).alias("_now"))
    status = (
        F.when(F.col("sha256").isNull(), "unhashed").when(F.col("relpath").isNotNull() & ~safe_path("relpath"), "unsafe")
        .when(F.col("_at").isNull(), "missing").when(F.col("_now") == F.col("sha256"), "ok").otherwise("failed")
    )
    label = F.coalesce("relpath", F.concat_ws("/", "project", "file")).alias("relpath")
    listed = [x.select(label, "project", status.alias("status")) for x in (exact, named)]
    hashed = manifest.where("sha256 is not null").select(F.col("project").alias("_project")).distinct()
    loose = have.join(hashed, "_project", "left_semi")
    loose = loose.join(manifest.where("relpath is not null").select(F.col("relpath").alias("_at")).distinct(), "_at", "left_anti")
    loose = loose.join(manifest.where("relpath is null").select(F.col("project").alias("_project"), F.col("file").alias("_name")).distinct(), ["_project", "_name"], "left_anti")
    unlisted = loose.select(F.col("_at").alias("relpath"), F.col("_project").alias("project"), F.lit("unlisted").alias("status"))
    return listed[0].unionAll(listed[1]).unionAll(unlisted)


def verdict(report: DataFrame) -> DataFrame:
    """One row of counts; intact unless something failed, is missing, unsafe or unlisted (rows without a hash do no harm)."""
    kinds = ("ok", "failed", "missing", "unsafe", "unhashed", "unlisted")
    counted = report.agg(*(F.count_if(F.col("status") == k).alias(k) for k in kinds))
    return counted.withColumn("intact", (F.col("failed") + F.col("missing") + F.col("unsafe") + F.col("unlisted")) == 0)


def restore_plan(backup: DataFrame, target: DataFrame, projects: list[str] | None = None) -> DataFrame:
    """Every backed-up file with action copy (missing), overwrite (differs) or keep; nothing of the target is deleted."""
    there = target.select("relpath", F.col("size_bytes").alias("_size"), F.col("mtime").alias("_mtime"))
    rows = backup.where(F.col("project").isin(*projects)) if projects else backup
    same = (F.col("size_bytes") == F.col("_size")) & same_time("mtime", "_mtime")
    action = F.when(F.col("_size").isNull(), "copy").when(same, "keep").otherwise("overwrite")
    return rows.join(there, "relpath", "left").withColumn("action", action).drop("_size", "_mtime")


def totals(files: DataFrame) -> DataFrame:
    """(project, files, bytes), by project."""
    return files.groupBy("project").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes")).orderBy("project")
