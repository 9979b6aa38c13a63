"""Transcript files below a root folder, as tables of files, sessions and projects.

Three layouts hold sessions: <slug>/agent-transcripts/<id>/<id>.jsonl, the flat <slug>/agent-transcripts/<id>.jsonl, and
child sessions <slug>/agent-transcripts/<id>/subagents/<sub>.jsonl. Everything else is ignored.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import parse
from ..operators.sessions import UNTITLED, title_lines, with_titles
from . import listing, splits

NESTED = r"/([^/]+)/agent-transcripts/([^/]+)/([^/]+)\.jsonl\z"
FLAT = r"/([^/]+)/agent-transcripts/([^/]+)\.jsonl\z"
CHILD = r"/([^/]+)/agent-transcripts/([^/]+)/subagents/([^/]+)\.jsonl\z"


def default_root(tool: str, home: str | None = None) -> str | None:
    """The folder below the user's home where a tool keeps its projects; null without a home."""
    home = home or os.environ.get("HOME")
    return f"{home.rstrip('/')}/.{tool}/projects" if home else None


def bare_path(c: Column | str) -> Column:
    """A file's path without scheme and host."""
    return F.regexp_replace(c, r"\A[a-z][a-z0-9+.-]*:(//[^/]*)?(?=/)", "")


def binary_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)


def layout(path: Column | str) -> Column:
    """struct(project_slug, id, is_subagent, parent_id, parent_path), or null for files that are no sessions."""
    path = F.col(path) if isinstance(path, str) else path
    at = lambda pattern, i: F.regexp_extract(path, pattern, i)

    def made(pattern: str, name: int, child: bool) -> Column:
        parent = at(pattern, 2) if child else F.lit(None).cast("string")
        above = F.concat(F.regexp_replace(path, r"/subagents/[^/]+\z", "/"), at(pattern, 2), F.lit(".jsonl")) if child else F.lit(None).cast("string")
        return F.struct(at(pattern, 1).alias("project_slug"), at(pattern, name).alias("id"), F.lit(child).alias("is_subagent"), parent.alias("parent_id"), above.alias("parent_path"))

    return (
        F.when(path.rlike(CHILD), made(CHILD, 3, True))
        .when(path.rlike(NESTED) & (at(NESTED, 2) == at(NESTED, 3)), made(NESTED, 2, False))
        .when(path.rlike(FLAT), made(FLAT, 2, False))
    )


def with_layout(files: DataFrame) -> DataFrame:
    rows = files.withColumn("_l", layout("path")).where("_l is not null")
    return rows.select(*files.columns, "_l.*")


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, modified_unix, size_bytes and the columns of ``layout``); bytes that are not UTF-8 become U+FFFD.

    A file is one row, so this is for small ones, and none of no bytes is seen; ``session_files`` and ``numbered_lines`` read files of any size.
    """
    raw = binary_files(spark, root, "*.jsonl").select(
        bare_path("path").alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
        F.unix_timestamp("modificationTime").alias("modified_unix"), F.col("length").alias("size_bytes"),
    )
    return with_layout(raw)


def session_files(spark: SparkSession, root: str) -> DataFrame:
    """Sessions by file status alone, empty files too, with the ``uri`` to read them by; links are not followed, contents not read."""
    return with_layout(listing.files(spark, root, ".jsonl").select("path", "uri", "modified_unix", "size_bytes"))


def read_sessions(spark: SparkSession, root: str) -> DataFrame:
    return session_files(spark, root).drop("uri")


def session_at(spark: SparkSession, sessions: DataFrame, path: str, root: str) -> DataFrame:
    """The listed session of exactly this path, if it lies inside ``root`` also once links are followed; no row otherwise."""
    return sessions.where(F.col("path") == path) if listing.inside(spark, path, root) else sessions.limit(0)


def session_json(sessions: DataFrame) -> DataFrame:
    """What is told of a session: seven fields, with the time 0 where none is known."""
    rows = sessions if "title" in sessions.columns else sessions.withColumn("title", F.lit(UNTITLED))
    return rows.select("id", "path", "title", F.coalesce("modified_unix", F.lit(0).cast("long")).alias("modified_unix"), "size_bytes", "is_subagent", "parent_id")


def numbered_lines(files: DataFrame) -> DataFrame:
    """(path, line_index, line) of files with their ``content``, or of ``session_files``, which are read in byte ranges."""
    return parse.lines(files.select("path", "content")) if "content" in files.columns else splits.lines(files)


def records(files: DataFrame) -> DataFrame:
    return parse.records(numbered_lines(files))


def titled_sessions(files: DataFrame) -> DataFrame:
    return with_titles(files.drop("content", "uri"), parse.messages(parse.records(title_lines(numbered_lines(files)))))


def projects_on_disk(spark: SparkSession, root: str) -> list[str]:
    """Names of all folders directly below the root, also those without a session; none if the root can't be read."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory())


def inventory(spark: SparkSession, root: str, ending: str = "", listed: DataFrame | None = None) -> DataFrame:
    """(relpath, project, size_bytes, mtime) of every file below the root; project is the first folder of relpath."""
    top = listing.local(root)
    whole = os.path.abspath(top) if top is not None else listing.canonical(spark, root)
    base = F.length(bare_path(F.lit(whole.rstrip("/") + "/")))
    rows = (listing.walk(spark, root) if listed is None else listed).where((F.col("kind") == "file") & F.endswith("path", F.lit(ending)))
    rows = rows.withColumn("relpath", F.substring("path", base + 1, F.length("path")))
    return rows.select("relpath", F.element_at(F.split("relpath", "/"), 1).alias("project"), "size_bytes", F.col("modified_unix").alias("mtime"))


def from_conversations(conversations: DataFrame) -> DataFrame:
    """Messages of a table (conv_id, turn, role, text): one session per conversation; roles but user and assistant go.

    A null text is empty. The whole text of a user message is its query.
    """
    text = F.coalesce("text", F.lit(""))
    block = F.struct(F.lit("text").alias("kind"), text.alias("text"), *(F.lit(None).cast("string").alias(c) for c in ("tool_name", "tool_input", "other_type")))
    query = F.when((F.col("role") == "user") & (T.trim(text) != ""), T.trim(text))
    rows = conversations.where(F.col("role").isin("user", "assistant")).select(
        F.col("conv_id").cast("string").alias("path"), F.col("turn").cast("long").alias("line_index"), "role", F.array(block).alias("blocks"),
        text.alias("full_text"), query.alias("user_query"), F.lit(None).cast("string").alias("timestamp"),
    )
    return rows.withColumns({"has_user_query": F.col("user_query").isNotNull(), "is_injected": (F.col("role") == "user") & T.is_injected("user_query")})


def sessions_of(conversations: DataFrame) -> DataFrame:
    rows = conversations.groupBy("conv_id").agg(F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("size_bytes"))
    none = F.lit(None).cast("string")
    return rows.select(
        F.col("conv_id").cast("string").alias("path"), F.lit("conversations").alias("project_slug"), F.col("conv_id").cast("string").alias("id"),
        F.lit(False).alias("is_subagent"), none.alias("parent_id"), none.alias("parent_path"), F.lit(0).cast("long").alias("modified_unix"), "size_bytes",
    )
