"""Search over messages: hits in raw lines, an index without full texts, filters, facets and pages of results."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..sources import splits
from ..sources.scratch import checkpointed, written
from .parse import lines, tool_names


#: Most files of a wave that is picked by sorting.
WAVE_FILES = 100_000


def hits_in_lines(numbered: DataFrame, needle: str) -> DataFrame:
    return numbered.where(T.contains_folded("line", needle))


def hits_in_files(files: DataFrame, needle: str) -> DataFrame:
    """(path, line_index, line): whole files are sifted before any is cut into lines; a needle never spans lines."""
    return hits_in_lines(lines(files.where(T.contains_folded("content", needle))), needle)


def search(files: DataFrame, needle: str, cap: int = L.SEARCH_CAP) -> DataFrame:
    """The first hits by path and line, with the text around them."""
    found = hits_in_files(files, needle).orderBy("path", "line_index").limit(cap)
    return found.select("path", "line_index", T.match_snippet("line", needle).alias("snippet"))


@dataclass
class Found:
    """``hits`` as ``search`` gives them, and how many files were looked at for them."""

    hits: DataFrame
    files_scanned: int
    waves: int


def in_waves(files: DataFrame, read: Callable[[DataFrame], DataFrame], needle: str, cap: int = L.SEARCH_CAP, first: int | None = None, growth: int = 4) -> Found:
    """Files of (path, ...) in the order of their paths, in waves of growing size, until ``cap`` hits are found.

    ``read`` gives (path, line_index, line) of a wave's files. Waves that would hold over ``WAVE_FILES`` take all that is left.
    """
    spark = files.sparkSession
    files = written(files, "search-files")
    take, last, scanned, parts, left, waves = first or 4 * spark.sparkContext.defaultParallelism, None, 0, [], cap, 0
    while left > 0:
        rest = files if last is None else files.where(F.col("path") > last)
        wave = checkpointed(rest.orderBy("path").limit(take)) if take <= WAVE_FILES else rest
        about = wave.agg(F.count("*").alias("n"), F.max("path").alias("last")).first()
        if not about["n"]:
            break
        waves += 1
        found = hits_in_lines(read(wave), needle).orderBy("path", "line_index", "line").limit(left)
        found = checkpointed(found.select("path", "line_index", T.match_snippet("line", needle).alias("snippet")))
        got = found.agg(F.count("*").alias("n"), F.max("path").alias("last")).first()
        parts.append(found)
        left -= got["n"]
        scanned += about["n"] if left > 0 else wave.where(F.col("path") <= got["last"]).count()
        last, take = about["last"], take * growth
    none = spark.createDataFrame([], "path string, line_index long, snippet string")
    return Found(reduce(DataFrame.unionByName, parts, none) if parts else none, scanned, waves)


def search_files(files: DataFrame, needle: str, cap: int = L.SEARCH_CAP, split_bytes: int = splits.SPLIT_BYTES) -> Found:
    """The first hits by path and line in files of (path, uri, size_bytes); files behind the wave that meets the cap are never opened."""
    return in_waves(files.select("path", "uri", "size_bytes"), lambda wave: splits.lines(wave, split_bytes, needle), needle, cap)


def scanned(files: DataFrame, found: DataFrame, cap: int = L.SEARCH_CAP) -> DataFrame:
    """(files_scanned): files by path up to the one in which ``search`` met its cap; all of them if it never did."""
    last = found.agg(F.count("*").alias("n"), F.max("path").alias("path")).first()
    rows = files.where(F.col("path") <= last["path"]) if last["n"] >= cap else files
    return rows.agg(F.count("*").alias("files_scanned"))


def index(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row per message worth finding: tools, media, a short text, and its session's columns; no full text."""
    text = F.coalesce("user_query", "full_text")
    paths = F.when(F.col("role") == "user", T.media_paths("full_text")).otherwise(F.array().cast("array<string>"))
    media = F.transform(paths, lambda p: F.struct(F.element_at(F.split(p, "/"), -1).alias("name"), T.media_kind(p).alias("kind"), p.alias("path")))
    rows = messages.select("path", "line_index", "role", tool_names("blocks").alias("tools"), media.alias("media"), T.index_snippet(text).alias("snippet"))
    rows = rows.where((F.size("tools") > 0) | (F.size("media") > 0) | (F.col("snippet") != ""))
    return rows.join(sessions.select("path", "project_slug", "title", "is_subagent", "modified_unix"), "path")


def find(index: DataFrame, numbered: DataFrame | None = None, query: str = "", project: str | None = None, media: list[str] = [], tools: list[str] = []) -> DataFrame:
    """All index rows that pass every filter given; any of several media kinds or tools will do. No filter: no rows.

    A query needs two bytes to count; ``numbered`` holds the raw lines it is looked up in.
    """
    query = query.strip()
    has_query = len(query.encode()) >= 2
    if not (has_query or media or tools):
        return index.limit(0)
    rows = index.where(F.col("project_slug") == project) if project is not None else index
    rows = rows.where(F.exists("media", lambda m: m["kind"].isin(*media))) if media else rows
    rows = rows.where(F.arrays_overlap("tools", F.array(*map(F.lit, tools)))) if tools else rows
    return rows.join(hits_in_lines(numbered, query).select("path", "line_index"), ["path", "line_index"], "left_semi") if has_query else rows


def page(found: DataFrame, projects: DataFrame, cap: int = L.FIND_CAP) -> DataFrame:
    """The latest hits with their project's name. ``projects`` is a small table of names, joined after the cut."""
    top = found.orderBy(F.desc("modified_unix"), "path", "line_index").limit(cap)
    names = projects.select("project_slug", "display_name")
    return top.join(names, "project_slug", "left").withColumn("display_name", F.coalesce("display_name", "project_slug"))


def page_total(found: DataFrame, cap: int = L.FIND_CAP) -> DataFrame:
    """(total, truncated): how many hits there are, and whether a page leaves some out."""
    return found.agg(F.count("*").alias("total")).withColumn("truncated", F.col("total") > cap)


def per_session(found: DataFrame, shown: int = 4) -> DataFrame:
    """The first hits of each session, and how many more it has."""
    w = Window.partitionBy("path")
    rows = found.withColumns({"nth": F.row_number().over(w.orderBy("line_index")), "more": F.greatest(F.count("*").over(w) - shown, F.lit(0))})
    return rows.where(F.col("nth") <= shown)


def card(found: DataFrame) -> DataFrame:
    """What a result's card shows: the first tools, images and other files, and how many images are left out."""
    images, others = F.filter("media", lambda m: m["kind"] == "image"), F.filter("media", lambda m: m["kind"] != "image")
    return found.withColumns({
        "tools": F.slice("tools", 1, L.SHOWN_TOOLS), "images": F.slice(images, 1, L.SHOWN_IMAGES), "files": F.slice(others, 1, L.SHOWN_FILES),
        "more_images": F.greatest(F.size(images) - L.SHOWN_IMAGES, F.lit(0)),
    })


def facets(index: DataFrame) -> DataFrame:
    """Per session, its sorted distinct tools and media kinds."""
    sets = index.groupBy("project_slug", "path").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("tools")))).alias("tools"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.transform("media", lambda m: m["kind"]))))).alias("kinds"),
    )
    return sets


def facet_values(index: DataFrame) -> DataFrame:
    """(facet, value, messages) over all sessions."""
    tools = index.select(F.lit("tool").alias("facet"), F.explode("tools").alias("value"))
    kinds = index.select(F.lit("media").alias("facet"), F.explode(F.array_distinct(F.transform("media", lambda m: m["kind"]))).alias("value"))
    return tools.unionAll(kinds).groupBy("facet", "value").agg(F.count("*").alias("messages"))


def session_view(segmented: DataFrame) -> DataFrame:
    """What a reader of one session sees: every message with its turn, flags, narration, answer, tools and files."""
    split = T.split_thinking("full_text")
    spoken = F.col("role") == "assistant"
    return segmented.select(
        "path", "turn_id", "line_index", "role", "is_injected", "user_query", "timestamp", F.when(spoken, split["thinking"]).alias("thinking"),
        F.when(spoken, split["answer"]).alias("answer"), F.col("full_text").alias("raw"), tool_names("blocks").alias("tools"),
        F.when(~spoken, T.media_paths("full_text")).otherwise(F.array().cast("array<string>")).alias("media"),
    )
