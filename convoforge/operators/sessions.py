"""Projects and sessions: names, titles, counts, order and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T

UNTITLED, UNREADABLE = "(untitled session)", "(unreadable)"


def title_lines(lines: DataFrame) -> DataFrame:
    """The numbered lines a title may come from: the first few, as far as they end within the first bytes of the file.

    Longer lines only move by their lengths. A line ending of two bytes counts as one. A column ``begin`` tells at which byte
    the first of the given lines of a path begins, 0 without it.
    """
    size = F.octet_length("line")
    head = lines.where(F.col("line_index") < L.TITLE_LINES).select(*lines.columns, size.alias("_size"))
    head = head.withColumn("line", F.when(F.col("_size") <= L.TITLE_BYTES, F.col("line")))
    end = F.sum(F.col("_size") + 1).over(Window.partitionBy("path").orderBy("line_index").rowsBetween(Window.unboundedPreceding, 0)) - 1
    begin = F.coalesce("begin", F.lit(0)) if "begin" in lines.columns else F.lit(0)
    return head.withColumn("_end", begin + end).where(F.col("_end") <= L.TITLE_BYTES).drop("_size", "_end", "begin")


def titles(messages: DataFrame) -> DataFrame:
    """(path, title): the first typed query among the first raw lines, on one line and cut."""
    asked = messages.where((F.col("line_index") < L.TITLE_LINES) & F.col("user_query").isNotNull())
    return asked.groupBy("path").agg(F.min_by(T.title("user_query"), "line_index").alias("title"))


def with_titles(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    return sessions.drop("title").join(titles(messages), "path", "left").withColumn("title", F.coalesce("title", F.lit(UNTITLED)))


def projects(sessions: DataFrame) -> DataFrame:
    """One row per project: names, session counts, last activity; latest first, then by name."""
    rows = sessions.groupBy("project_slug").agg(
        F.max("modified_unix").alias("last_activity"),
        F.count_if(~F.col("is_subagent")).alias("main_sessions"),
        F.count_if("is_subagent").alias("subagent_sessions"),
    )
    rows = rows.withColumns({"display_name": T.slug_name("project_slug"), "workspace_hint": T.slug_hint("project_slug")})
    return rows.orderBy(F.desc_nulls_last("last_activity"), "display_name", "project_slug")


def ordered(sessions: DataFrame) -> DataFrame:
    return sessions.orderBy(F.desc_nulls_last("modified_unix"), "path")


def pick_projects(projects: DataFrame, needle: str = "") -> DataFrame:
    """Projects with sessions whose name or slug contains the needle."""
    named = F.contains(F.lower("display_name"), F.lit(needle.lower())) | F.contains(F.lower("project_slug"), F.lit(needle.lower()))
    return projects.where((F.col("main_sessions") + F.col("subagent_sessions") > 0) & named)


def pick_sessions(sessions: DataFrame, needle: str = "") -> DataFrame:
    """Main sessions that match by title or id, or that have a child which does."""
    hit = F.contains(F.lower("title"), F.lit(needle.lower())) | F.contains(F.lower("id"), F.lit(needle.lower()))
    child = sessions.where(F.col("is_subagent") & hit).select("project_slug", F.col("parent_id").alias("id"), F.lit(True).alias("_child")).distinct()
    rows = sessions.where(~F.col("is_subagent")).join(child, ["project_slug", "id"], "left")
    return rows.where(hit | F.coalesce("_child", F.lit(False))).drop("_child")


def select(sessions: DataFrame, with_subagents: bool) -> DataFrame:
    """The sessions to export: each path once, child sessions only if wanted, and no child whose id is also a main session's."""
    rows = sessions.where(F.lit(with_subagents) | ~F.col("is_subagent")).dropDuplicates(["path"])
    if not with_subagents:
        return rows
    mains = rows.where(~F.col("is_subagent"))
    return mains.unionByName(rows.where("is_subagent").join(mains.select("id").distinct(), "id", "left_anti"))


def children_of(sessions: DataFrame) -> DataFrame:
    """(project_slug, parent_id, children): the ids of each parent's child sessions, in order."""
    return sessions.where("is_subagent").groupBy("project_slug", "parent_id").agg(F.array_sort(F.collect_list("id")).alias("children"))
