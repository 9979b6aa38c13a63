"""Files that users mention: references, their kinds, and whether the file is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def normal_path(c: Column | str) -> Column:
    return F.regexp_replace(c, "/{2,}", "/")


def references(messages: DataFrame) -> DataFrame:
    """(path, line_index, media_path, kind, name): each file once per session, at its first mention by the user."""
    found = messages.where("role = 'user'").select("path", "line_index", F.posexplode(T.media_paths("full_text")).alias("pos", "media_path"))
    found = found.withColumn("_key", normal_path("media_path"))
    first = found.groupBy("path", "_key").agg(F.min(F.struct("line_index", "pos", "media_path")).alias("x")).select("path", "x.line_index", "x.media_path")
    return first.withColumns({"kind": T.media_kind("media_path"), "name": F.element_at(F.split("media_path", "/"), -1)})


def resolve(references: DataFrame, inventory: DataFrame, root: str | None = None) -> DataFrame:
    """Adds exists, size_bytes and within_root by a left join on the path; ``inventory`` has file and size_bytes."""
    have = inventory.select(normal_path("file").alias("_key"), "size_bytes").dropDuplicates(["_key"])
    rows = references.withColumn("_key", normal_path("media_path")).join(have, "_key", "left")
    inside = F.startswith(F.col("_key"), F.lit(root.rstrip("/") + "/")) if root else F.lit(False)
    return rows.withColumns({"exists": F.col("size_bytes").isNotNull(), "within_root": inside}).drop("_key")


def locate(references: DataFrame, inventory: DataFrame, projects: DataFrame, root: str, boundary: str | None = None, live: bool = True) -> DataFrame:
    """Adds found (the file a reference stands for, or null) and rule, which says how it was found. The first rule that meets a file wins:

    inside: the path itself, below the root or the boundary; outside: the path itself anywhere else, if the source is
    ``live`` (files named by a backup's transcripts are not trusted); moved: the part after a known project's folder, below
    that project in the root (of several named, the first by name); captured: the backup's copy in ``attachments`` beside the root. Paths with a ".." part match
    no file. ``inventory`` has file; ``projects`` (project_slug) is joined by the parts of each path.
    """
    root = root.rstrip("/")
    below = lambda c, top: F.startswith(c, F.lit(top.rstrip("/") + "/"))
    paths = references.select("media_path").where("media_path is not null").distinct().withColumn("_key", normal_path("media_path"))
    within = below(F.col("_key"), root) | (below(F.col("_key"), boundary) if boundary else F.lit(False))
    own = paths.where(within | F.lit(live)).select("media_path", F.when(within, 1).otherwise(2).alias("_rule"), F.lit("").alias("_by"), F.col("_key").alias("_file"))
    parts = paths.select("media_path", "_key", F.posexplode(F.split("_key", "/")).alias("_at", "_by"))
    parts = parts.join(projects.select(F.col("project_slug").alias("_by")).where("_by <> ''").distinct(), "_by")
    first = parts.groupBy("media_path", "_key", "_by").agg(F.min("_at").alias("_at"))
    names = F.split("_key", "/")
    rest = F.array_join(F.slice(names, F.col("_at") + 2, F.size(names)), "/")
    moved = first.select("media_path", F.lit(3).alias("_rule"), "_by", F.concat(F.lit(root + "/"), "_by", F.lit("/"), rest).alias("_file"))
    captured = paths.select("media_path", F.lit(4).alias("_rule"), F.lit("").alias("_by"), F.concat(F.lit(root.rsplit("/", 1)[0] + "/attachments/"), T.attachment_name("media_path")).alias("_file"))
    have = inventory.select(normal_path("file").alias("_file")).where(~F.col("_file").rlike(r"/\.\.(/|\z)")).distinct()
    met = own.union(moved).union(captured).join(have, "_file", "left_semi")
    best = met.groupBy("media_path").agg(F.min(F.struct("_rule", "_by", "_file")).alias("_x"))
    rule = F.col("_x._rule")
    named = F.when(rule == 1, "inside").when(rule == 2, "outside").when(rule == 3, "moved").when(rule == 4, "captured")
    return references.join(best, "media_path", "left").withColumns({"found": F.col("_x._file"), "rule": named}).drop("_x")
