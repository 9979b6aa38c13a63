"""A message index that follows transcripts as they are written.

Appended tables of raw lines (path, line_index, line, seen) come in as a stream, are parsed like any others, and go out
as index rows; a line that is read twice within the watermark is indexed once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators import parse

LINES = "path string, line_index long, line string, seen timestamp"


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(LINES).parquet(folder)


def index_rows(lines: DataFrame, late: str = "1 hour") -> DataFrame:
    once = lines.withWatermark("seen", late).dropDuplicatesWithinWatermark(["path", "line_index"])
    messages = parse.messages(parse.records(once))
    rows = messages.select("path", "line_index", "seen", "role", parse.tool_names("blocks").alias("tools"), T.index_snippet(F.coalesce("user_query", "full_text")).alias("snippet"))
    return rows.where((F.size("tools") > 0) | (F.col("snippet") != ""))


def activity(lines: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Messages and skipped lines per path and window, once the watermark has passed the window."""
    records = parse.records(lines.withWatermark("seen", late))
    count = lambda k: F.count_if(F.col("kind") == k)
    return records.groupBy(F.window("seen", window), "path").agg(count("message").alias("messages"), count("skipped").alias("skipped"))


def start_index(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Follow ``folder`` into the Parquet table ``out``; each trigger takes all that is new."""
    rows = index_rows(read_lines(spark, folder))
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
