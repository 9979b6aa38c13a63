"""Turns: a typed user message opens one once the assistant has spoken; everything else joins the open turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def segment(messages: DataFrame) -> DataFrame:
    """Adds turn_id (from 0) to messages of (path, line_index, role, is_injected).

    One window over each path: a running count of assistant messages, and its value at the last typed user message
    before the row. Nothing is ordered but the rows of a path.
    """
    so_far = Window.partitionBy("path").orderBy("line_index").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("path").orderBy("line_index").rowsBetween(Window.unboundedPreceding, -1)
    typed = (F.col("role") == "user") & ~F.col("is_injected")
    rows = messages.withColumn("_spoken", F.count_if(F.col("role") == "assistant").over(so_far))
    last = F.last(F.when(typed, F.col("_spoken")), ignorenulls=True).over(before)
    first = F.lag("line_index").over(Window.partitionBy("path").orderBy("line_index")).isNull()
    opens = first | (typed & (F.col("_spoken") > F.coalesce(last, F.lit(0))))
    rows = rows.withColumn("_opens", opens)
    return rows.withColumn("turn_id", F.count_if("_opens").over(so_far) - 1).drop("_spoken", "_opens")


def gather(segmented: DataFrame) -> DataFrame:
    """Per turn, the ordered user and assistant messages as arrays of (line_index, text)."""
    of = lambda role: F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("line_index", F.col("full_text").alias("text")))))
    return segmented.groupBy("path", "turn_id").agg(of("user").alias("user"), of("assistant").alias("assistant"))


def first_query(messages: DataFrame) -> DataFrame:
    return messages.where("user_query is not null").groupBy("path").agg(F.min_by("user_query", "line_index").alias("first_query"))


def final_answer(messages: DataFrame) -> DataFrame:
    spoken = messages.where((F.col("role") == "assistant") & ~T.is_blank("full_text"))
    return spoken.groupBy("path").agg(F.max_by("full_text", "line_index").alias("answer"))


def islands(rows: DataFrame, order: list, key: str = "path") -> DataFrame:
    """Adds island (from 0): runs of neighbouring rows with the same key in the given order, per project."""
    w = Window.partitionBy("project_slug").orderBy(*order)
    changed = ~F.col(key).eqNullSafe(F.lag(key).over(w)) | F.row_number().over(w).eqNullSafe(1)
    rows = rows.withColumn("_new", changed)
    return rows.withColumn("island", F.count_if("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_new")
