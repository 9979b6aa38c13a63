"""Incremental backups of a transcript root, their verification, and restoring from them.

A backup holds projects/ (the copied tree), attachments/ (files from elsewhere that users mention) and two Parquet
manifests beside a small marker file. The manifest is replaced as a whole, after all copies.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import integrity, media, parse
from ..sources import listing, transcripts
from ..sources.scratch import checkpointed
from . import sinks

MARKER = "backup.json"
ROW = "relpath string, project string, file string, size_bytes long, mtime long, sha256 string"
NOTHING = "relpath string, project string, size_bytes long, mtime long"


@dataclass
class BackupSummary:
    copied: int = 0
    unchanged: int = 0
    attachments: int = 0
    hashed: int = 0
    warnings: list[str] = field(default_factory=list)


def _tree(spark: SparkSession, folder: str, hashed: bool = False, ending: str = "") -> DataFrame:
    if not sinks.exists(spark, folder):
        return spark.createDataFrame([], NOTHING + (", sha256 string" if hashed else ""))
    rows = transcripts.inventory(spark, folder, ending)
    if not hashed:
        return rows
    rows = checkpointed(rows)
    return rows.join(sinks.hash_files(rows.select("relpath", F.concat(F.lit(f"{folder}/"), "relpath").alias("source"))), "relpath", "left")


def _marker(spark: SparkSession, backup: str) -> dict | None:
    """What the marker file says; none if there is none, or if it can't be read."""
    if not sinks.exists(spark, f"{backup}/{MARKER}"):
        return None
    try:
        said = json.loads(sinks.read_text(spark, f"{backup}/{MARKER}"))
    except ValueError:
        return None
    return said if isinstance(said, dict) else None


def manifest(spark: SparkSession, backup: str, name: str) -> DataFrame:
    """The rows of the transcripts or attachments manifest; a manifest that can't be read counts as none."""
    folder = (_marker(spark, backup) or {}).get(name)
    if not folder or not sinks.exists(spark, f"{backup}/{folder}"):
        return spark.createDataFrame([], ROW)
    return spark.read.schema(ROW).parquet(f"{backup}/{folder}")


def _hashed(files: DataFrame, prior: DataFrame, out: str, summary: BackupSummary) -> DataFrame:
    """Adds sha256: that of the prior manifest where size and time are the same, else computed in tasks."""
    rows = checkpointed(integrity.reuse_hashes(files, prior))
    todo = rows.where("sha256 is null").select("relpath", F.concat(F.lit(f"{out}/"), "relpath").alias("source"))
    made = checkpointed(sinks.hash_files(todo))
    summary.hashed += made.count()
    return rows.join(made.withColumnRenamed("sha256", "made"), "relpath", "left").withColumn("sha256", F.coalesce("sha256", "made")).drop("made")


def resolve(spark: SparkSession, path: str, plain: bool = True) -> str:
    """The transcript root that a path means: a backup's projects (told by its marker), those of the backup one level up, or
    with ``plain`` any folder that is there."""
    if path == "~" or path.startswith("~/"):
        path = os.path.expanduser(path)
    path = path.rstrip("/") or "/"
    if sinks.exists(spark, f"{path}/{MARKER}") and sinks.exists(spark, f"{path}/projects"):
        return f"{path}/projects"
    if sinks.exists(spark, path) and (plain or sinks.exists(spark, f"{path.rpartition('/')[0]}/{MARKER}")):
        return path
    raise LookupError(f"{path} holds no transcripts")


def backup(spark: SparkSession, root: str, out: str, projects: list[str] | None = None, skip_runtime: bool = False, hashes: bool = True) -> BackupSummary:
    sinks.guard(spark, out, [root], MARKER)
    root, out = root.rstrip("/"), out.rstrip("/")
    listed = checkpointed(listing.walk(spark, root))
    source = integrity.walked(transcripts.inventory(spark, root, listed=listed), skip_runtime)
    source = source.where(F.col("project").isin(*projects)) if projects else source
    plan = integrity.copy_plan(source, _tree(spark, f"{out}/projects"))
    pairs = plan.where("action = 'copy'").select(F.concat(F.lit(f"{root}/"), "relpath").alias("source"), F.concat(F.lit(f"{out}/projects/"), "relpath").alias("target"))
    total = source.count()
    done = sinks.copy_files(pairs).agg(F.count_if("copied").alias("ok"), F.count_if(~F.col("copied")).alias("bad")).first()
    summary = BackupSummary(copied=done["ok"], unchanged=total - done["ok"] - done["bad"], warnings=listing.warnings(listed))
    if done["bad"]:
        summary.warnings.append(f"{done['bad']} files could not be copied")

    if sinks.exists(spark, f"{out}/{MARKER}") and _marker(spark, out) is None:
        kept = f"{out}/{MARKER}.corrupt"
        sinks.write_text(spark, kept, sinks.read_text(spark, f"{out}/{MARKER}"))
        summary.warnings.append(f"the manifest could not be read; a copy is kept as {kept}, its rows are not merged")
    prior, prior_extra = manifest(spark, out, "transcripts"), manifest(spark, out, "attachments")
    unknown = F.lit(None).cast("string")
    now = _tree(spark, f"{out}/projects", False, ".jsonl").join(source.select("relpath"), "relpath", "left_semi")
    now = now.withColumns({"relpath": F.concat(F.lit("projects/"), "relpath"), "file": F.element_at(F.split("relpath", "/"), -1)})
    now = _hashed(now, prior, out, summary) if hashes else now.withColumn("sha256", unknown)

    messages = parse.messages(transcripts.records(transcripts.session_files(spark, root).join(source.select(F.concat(F.lit(f"{root}/"), "relpath").alias("path")), "path", "left_semi")))
    refs = media.references(messages).where(~F.startswith(media.normal_path("media_path"), F.lit(root + "/"))).select("media_path").distinct()
    extra = refs.select(F.col("media_path").alias("source"), F.concat(F.lit(f"{out}/attachments/"), T.attachment_name("media_path")).alias("target"))
    summary.attachments = sinks.copy_files(extra, keep_same=True).where("copied").count()
    held = _tree(spark, f"{out}/attachments")
    held = held.withColumns({"file": F.col("relpath"), "project": F.lit("attachments"), "relpath": F.concat(F.lit("attachments/"), "relpath")})

    held = _hashed(held, prior_extra, out, summary) if hashes else held.withColumn("sha256", unknown)

    stamp, names = uuid.uuid4().hex[:12], {}
    columns = [c.split()[0] for c in ROW.split(", ")]
    for name, old, new in (("transcripts", prior, now), ("attachments", prior_extra, held)):
        names[name] = f"manifest/{name}-{stamp}"
        integrity.merge_manifest(old, new.select(*columns)).write.parquet(f"{out}/{names[name]}")
    sinks.write_json(spark, f"{out}/{MARKER}", {"tool": "convoforge", "last_run_unix": int(time.time()), **names})
    return summary


def verify(spark: SparkSession, out: str) -> DataFrame:
    """(relpath, project, status) of every manifest row and of unlisted transcripts; reads only."""
    if not sinks.exists(spark, f"{out}/{MARKER}"):
        raise LookupError(f"{out} is no backup")
    below = lambda name, ending: _tree(spark, f"{out}/{name}", True, ending).withColumn("relpath", F.concat(F.lit(f"{name}/"), "relpath"))
    main = integrity.verify(manifest(spark, out, "transcripts"), below("projects", ".jsonl"))
    extra = integrity.verify(manifest(spark, out, "attachments"), below("attachments", "").withColumn("project", F.lit("attachments")))
    return main.unionAll(extra.where("status <> 'unlisted'"))


def restore(spark: SparkSession, out: str, target: str, projects: list[str] | None = None, dry_run: bool = False) -> DataFrame:
    """The plan of (relpath, action), carried out unless ``dry_run``; raises if a file can't be copied."""
    out, target = out.rstrip("/"), target.rstrip("/")
    plan = integrity.restore_plan(_tree(spark, f"{out}/projects"), _tree(spark, target), projects).select("relpath", "action")
    plan = checkpointed(plan)  # what was to do, also after it is done
    if not dry_run:
        todo = plan.where("action <> 'keep'").select(F.concat(F.lit(f"{out}/projects/"), "relpath").alias("source"), F.concat(F.lit(f"{target}/"), "relpath").alias("target"))
        bad = sinks.copy_files(todo).where(~F.col("copied")).count()
        if bad:
            raise OSError(f"{bad} files could not be restored")
    return plan
