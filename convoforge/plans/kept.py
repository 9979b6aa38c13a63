"""A message index that is kept: written once, and renewed only for files that changed.

Below one folder lie, for each renewal, a generation of three tables: ``rows`` (what ``finder.index`` makes), ``ranges`` (the
byte ranges of each file, the number of their first line, and a Bloom filter of the trigrams in their lines) and
``files`` (every file that is there, by path, size and time, the generations that hold its rows, and its facets). Of a
file that has grown only the tail is read: ``files`` notes how many whole lines were read, the byte behind them, and a
mark of the bytes before it. A file that shrank, or whose mark differs, is read anew, and its older rows count no more; so
do those of a last line that had no end yet. A small marker names the generation in force; it is replaced last, so a renewal that fails changes nothing, and readers go on with
the tables they opened. ``compact`` writes all rows in force anew.

``search`` asks the filters which ranges may hold a needle and reads only those, in waves by path that end once the cap
is met; every line is compared itself, so a filter can only spare work. Needles under three bytes read every range.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..operators import finder, parse, sessions
from ..sources import splits, stores, transcripts
from ..sources.scratch import checkpointed
from . import sinks

MARKER = "index.json"
#: Bits of a filter for each distinct trigram, and the most bits of one.
BITS_EACH, MOST_BITS = 10, 1 << 22


@dataclass
class Renewal:
    """Files read whole, files of which the tail was read, files left as they were, and files no longer there."""

    parsed: int = 0
    grown: int = 0
    kept: int = 0
    gone: int = 0


def _codes(text: bytes):
    """The trigrams of a text as numbers, A-Z lower-cased; none reaches over a line's end."""
    import numpy as np

    x = np.frombuffer(text.lower(), np.uint8).astype(np.uint32)
    if len(x) < 3:
        return x[:0]
    fine = (x[:-2] != 10) & (x[1:-1] != 10) & (x[2:] != 10)
    return ((x[:-2] << 16) | (x[1:-1] << 8) | x[2:])[fine]


def _places(codes, bits: int):
    """Three places of each trigram in a filter of ``bits`` (a power of two)."""
    import numpy as np

    x = codes.astype(np.uint64)
    shift = np.uint64(64 - bits.bit_length() + 1)
    return [(x * np.uint64(k)) >> shift for k in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _filter(codes) -> bytes:
    """A Bloom filter of distinct trigrams."""
    import numpy as np

    bits = min(MOST_BITS, max(64, 1 << (BITS_EACH * len(codes)).bit_length()))
    on = np.zeros(bits, bool)
    for at in _places(codes, bits):
        on[at] = True
    return np.packbits(on, bitorder="little").tobytes()


def _trigrams(lines: Iterator[bytes], few: int | None = None):
    """The distinct trigrams of lines, in order. A table of all there may be is made for more than ``few`` bytes alone."""
    import numpy as np

    few, seen, held, size = splits.PIECE_BYTES if few is None else few, None, [], 0
    for line in lines:
        held.append(line)
        size += len(line)
        if size > few:
            seen = np.zeros(1 << 24, bool) if seen is None else seen
            seen[_codes(b"\n".join(held))] = True
            held, size = [], 0
    last = np.unique(_codes(b"\n".join(held)))
    if seen is None:
        return last
    seen[last] = True
    return np.flatnonzero(seen)


def filtered(ranges: DataFrame) -> DataFrame:
    """Adds ``grams`` to ranges with their ``first``: a Bloom filter over the trigrams of the lines that begin in each."""
    import pyarrow as pa

    columns = ["path", "uri", "size_bytes", "begin", "start", "end", "first"]

    def made(uri: str, start: int, end: int, skip: bool) -> bytes:
        def lines() -> Iterator[bytes]:
            try:
                yield from splits._lines(uri, start, end, skip)
            except OSError:
                pass

        return _filter(_trigrams(lines()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                row = b.slice(i, 1)
                uri, start, end, begin = (row[c][0].as_py() for c in ("uri", "start", "end", "begin"))
                grams = pa.array([made(uri, start, end, start > begin)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(row[c] for c in columns), grams], [*columns, "grams"])

    schema = "path string, uri string, size_bytes long, begin long, start long, end long, first long, grams binary"
    return splits.dealt(ranges).select(*columns).mapInArrow(run, schema)


def may_hold(ranges: DataFrame, needle: str) -> DataFrame:
    """The ranges whose filters don't rule the needle out."""
    import pyarrow as pa

    wanted = _codes(needle.encode())
    if not len(wanted):
        return ranges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            good = []
            for grams in b["grams"]:
                on = np.frombuffer(grams.as_py(), np.uint8)
                good.append(all(((on[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all() for at in _places(wanted, 8 * len(on))))
            yield b.filter(pa.array(good))

    return ranges.mapInArrow(run, ranges.schema)


def _said(spark: SparkSession, folder: str) -> dict | None:
    if not sinks.exists(spark, f"{folder}/{MARKER}"):
        return None
    try:
        said = json.loads(sinks.read_text(spark, f"{folder}/{MARKER}"))
    except ValueError:
        return None
    return said if isinstance(said, dict) and said.get("generations") else None


def _facets(rows: DataFrame) -> DataFrame:
    """(path, facets) with facets as array of (facet, value, messages)."""
    tools = rows.select("path", F.lit("tool").alias("facet"), F.explode("tools").alias("value"))
    kinds = rows.select("path", F.lit("media").alias("facet"), F.explode(F.array_distinct(F.transform("media", lambda m: m["kind"]))).alias("value"))
    counted = tools.unionAll(kinds).groupBy("path", "facet", "value").agg(F.count("*").alias("messages"))
    return counted.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("facet", "value", "messages"))).alias("facets"))


_PARTS = "array<struct<generation:string,first:bigint,until:bigint,until_byte:bigint>>"
_FACETS = "array<struct<facet:string,value:string,messages:bigint>>"
#: Bytes at either end of what was read that a mark is made of.
MARK_BYTES = 1 << 16


def _marked(files: DataFrame, whole: bool) -> DataFrame:
    """(path, mark) of files of (path, uri, offset): a hash of the first and last bytes before the offset, or (``whole``) of all."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            marks = []
            for uri, offset in zip(b["uri"].to_pylist(), b["offset"].to_pylist(), strict=True):
                own = hashlib.sha256(str(offset).encode())
                try:
                    store, path = stores.opened(uri)
                    with store.open_input_file(path) as f:
                        for at, to in [(0, offset)] if whole else [(0, min(offset, MARK_BYTES)), (max(0, offset - MARK_BYTES), offset)]:
                            f.seek(at)
                            while at < to and (piece := f.read(min(to - at, splits.PIECE_BYTES))):
                                own.update(piece)
                                at += len(piece)
                    marks.append(own.hexdigest())
                except OSError:
                    marks.append(None)
            yield pa.RecordBatch.from_arrays([b["path"], pa.array(marks, pa.string())], ["path", "mark"])

    return files.select("path", "uri", "offset").mapInArrow(run, "path string, mark string")


def _ends(ranges: DataFrame) -> DataFrame:
    """(path, lines, offset): how many lines of each file end with a newline, and the byte behind the last of them."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines, offsets = [], []
            for uri, start, end, begin, first in zip(*(b[c].to_pylist() for c in ("uri", "start", "end", "begin", "first")), strict=True):
                n, at = first, begin
                try:
                    store, path = stores.opened(uri)
                    with store.open_input_file(path) as f:
                        f.seek(start)
                        while start < end and (piece := f.read(min(splits.PIECE_BYTES, end - start))):
                            n += piece.count(b"\n")
                            if (last := piece.rfind(b"\n")) >= 0:
                                at = start + last + 1
                            start += len(piece)
                except OSError:
                    pass
                lines.append(n), offsets.append(at)
            yield pa.RecordBatch.from_arrays([b["path"], pa.array(lines, pa.int64()), pa.array(offsets, pa.int64())], ["path", "lines", "offset"])

    # The line open at a range's start is counted by the range it began in.
    numbers = F.when(F.col("start") > F.col("begin"), F.col("first") - 1).otherwise(F.col("first"))
    each = ranges.select("path", "uri", "start", "end", "begin", numbers.alias("first")).mapInArrow(run, "path string, lines long, offset long")
    return each.groupBy("path").agg(F.max("lines").alias("lines"), F.max("offset").alias("offset"))


def renew(files: DataFrame, folder: str, split_bytes: int = splits.SPLIT_BYTES, whole_marks: bool = False) -> Renewal:
    """Bring the index up to ``files`` (as ``transcripts.session_files`` gives them).

    ``whole_marks``: tell a changed file from a grown one by all bytes that were read of it, not by those at both ends alone.
    """
    spark = files.sparkSession
    name = uuid.uuid4().hex[:12]
    listed = checkpointed(files)
    said = _said(spark, folder)
    known = f"size_bytes long, modified_unix long, parts {_PARTS}, facets {_FACETS}, title string, lines long, offset long, mark string"
    old = spark.read.parquet(f"{folder}/files-{said['generations'][-1]}") if said else spark.createDataFrame([], f"path string, {known}")
    was = old.select("path", F.col("size_bytes").alias("old_size"), F.col("modified_unix").alias("old_time"), "parts", "facets", "title", "lines", "offset", "mark")
    rows = listed.join(was, "path", "left")
    same = (F.col("size_bytes") == F.col("old_size")) & (F.col("modified_unix") == F.col("old_time"))
    rows = checkpointed(rows.withColumn("same", F.coalesce(same, F.lit(False))))
    gone = old.join(listed.select("path"), "path", "left_anti").count()
    maybe = rows.where(~F.col("same") & (F.col("size_bytes") >= F.col("offset")))
    marks = _marked(maybe, whole_marks).withColumnRenamed("mark", "now")
    rows = rows.join(marks, "path", "left").withColumn("grown", ~F.col("same") & F.coalesce(F.col("mark") == F.col("now"), F.lit(False)))
    rows = checkpointed(rows.drop("old_size", "old_time", "now"))

    new = rows.where(~F.col("same"))
    start = F.when(F.col("grown"), F.col("offset")).otherwise(0)
    ranges = splits.numbered(splits.splits(new.withColumn("start", start), split_bytes))
    base = new.select("path", F.when(F.col("grown"), F.col("lines")).otherwise(0).alias("base"))
    ranges = checkpointed(ranges.join(base, "path").withColumn("first", F.col("first") + F.col("base")).drop("base"))
    filtered(ranges).write.parquet(f"{folder}/ranges-{name}")
    ends = _ends(ranges)
    lines = splits.read_lines(ranges)
    messages = parse.messages(parse.records(lines))
    head = lines.where(F.col("line_index") < L.TITLE_LINES).join(new.select("path", start.alias("begin")), "path")
    titled = sessions.titles(parse.messages(parse.records(sessions.title_lines(head)))).withColumnRenamed("title", "found")
    blank = F.lit(sessions.UNTITLED)
    sessions_ = new.drop("uri", "title").withColumn("title", blank)  # readers take titles and times from ``files``
    finder.index(messages, sessions_).write.parquet(f"{folder}/rows-{name}")

    first = F.when(F.col("grown"), F.col("lines")).otherwise(0)
    part = lambda generation, first, until, byte: F.struct(generation.alias("generation"), first.alias("first"), until.alias("until"), byte.alias("until_byte"))
    none = F.lit(None).cast("long")
    # What older generations hold ends where the tail begins.
    older = F.transform("parts", lambda x: part(x["generation"], x["first"], F.least(F.coalesce(x["until"], F.col("lines")), F.col("lines")), F.least(F.coalesce(x["until_byte"], F.col("offset")), F.col("offset"))))
    parts = F.concat(F.when(F.col("grown"), older).otherwise(F.array().cast(_PARTS)), F.array(part(F.lit(name), first, none, none)).cast(_PARTS))
    made = new.withColumn("parts", parts).withColumn("lines", first).withColumn("offset", start)
    made = made.join(ends.select("path", F.col("lines").alias("n"), F.col("offset").alias("to")), "path", "left")
    made = made.withColumns({"lines": F.coalesce("n", "lines"), "offset": F.coalesce("to", "offset")}).drop("n", "to", "mark")
    made = checkpointed(made)
    made = made.join(_marked(made, whole_marks), "path", "left").join(titled, "path", "left")
    made = made.withColumn("title", F.coalesce(F.when(F.col("grown") & (F.col("title") != blank), F.col("title")), "found", blank)).drop("found")
    generations = [*(said or {}).get("generations", []), name]
    held = _in_force(spark, folder, "rows", generations, made)
    made = made.drop("facets").join(_facets(held), "path", "left")
    now = rows.where("same").unionByName(made).withColumn("facets", F.coalesce("facets", F.array().cast(_FACETS)))
    now.drop("same", "grown").write.parquet(f"{folder}/files-{name}")
    done = rows.agg(F.count_if("same").alias("same"), F.count_if("grown").alias("grown"), F.count("*").alias("all")).first()
    sinks.write_json(spark, f"{folder}/{MARKER}", {"generations": _used(spark, folder, generations)})
    return Renewal(parsed=done["all"] - done["same"] - done["grown"], grown=done["grown"], kept=done["same"], gone=gone)


def _used(spark: SparkSession, folder: str, generations: list[str]) -> list[str]:
    """The generations that some file still has rows in, and the last."""
    parts = spark.read.parquet(f"{folder}/files-{generations[-1]}").select(F.explode("parts.generation").alias("g")).distinct()
    have = {r["g"] for r in parts.collect()}  # a row per renewal
    return [g for g in generations[:-1] if g in have] + [generations[-1]]


def _in_force(spark: SparkSession, folder: str, kind: str, generations: list[str], files: DataFrame) -> DataFrame:
    """The rows or ranges of ``files`` that count, out of all generations."""
    tables = [spark.read.parquet(f"{folder}/{kind}-{g}").withColumn("generation", F.lit(g)) for g in generations]
    every = reduce(DataFrame.unionByName, tables)
    parts = files.select("path", F.explode("parts").alias("p")).select("path", "p.generation", F.col("p.first").alias("_first"), F.col("p.until").alias("_until"), F.col("p.until_byte").alias("_byte"))
    rows = every.join(parts, ["path", "generation"])
    if kind == "rows":
        rows = rows.where((F.col("line_index") >= F.col("_first")) & (F.col("_until").isNull() | (F.col("line_index") < F.col("_until"))))
    else:
        rows = rows.withColumn("end", F.least("end", F.coalesce("_byte", "end"))).where("start < end")
    return rows.drop("generation", "_first", "_until", "_byte")


@dataclass
class Kept:
    """An opened index."""

    files: DataFrame
    rows: DataFrame
    ranges: DataFrame


def opened(spark: SparkSession, folder: str) -> Kept:
    said = _said(spark, folder)
    if not said:
        raise LookupError(f"{folder} holds no index")
    files = spark.read.parquet(f"{folder}/files-{said['generations'][-1]}")
    rows = _in_force(spark, folder, "rows", said["generations"], files).drop("project_slug", "title", "is_subagent", "modified_unix")
    rows = rows.join(files.select("path", "project_slug", "title", "is_subagent", "modified_unix"), "path")
    return Kept(files, rows, _in_force(spark, folder, "ranges", said["generations"], files))


def compact(spark: SparkSession, folder: str) -> None:
    """All rows in force as one generation."""
    kept, name = opened(spark, folder), uuid.uuid4().hex[:12]
    kept.rows.write.parquet(f"{folder}/rows-{name}")
    kept.ranges.write.parquet(f"{folder}/ranges-{name}")
    whole = F.array(F.struct(F.lit(name).alias("generation"), F.lit(0).cast("long").alias("first"), F.lit(None).cast("long").alias("until"), F.lit(None).cast("long").alias("until_byte")))
    kept.files.withColumn("parts", whole.cast(_PARTS)).write.parquet(f"{folder}/files-{name}")
    sinks.write_json(spark, f"{folder}/{MARKER}", {"generations": [name]})


def facet_values(kept: Kept) -> DataFrame:
    """(facet, value, messages) over all sessions, from what is noted of each file."""
    return kept.files.select(F.explode("facets").alias("f")).groupBy("f.facet", "f.value").agg(F.sum("f.messages").alias("messages"))


def facets(kept: Kept) -> DataFrame:
    """(project_slug, path, tools, kinds) of sessions that have any row."""
    of = lambda kind: F.transform(F.filter("facets", lambda f: f["facet"] == kind), lambda f: f["value"])
    rows = kept.rows.select("path").distinct()
    return kept.files.join(rows, "path", "left_semi").select("project_slug", "path", F.sort_array(of("tool")).alias("tools"), F.sort_array(of("media")).alias("kinds"))


def search(kept: Kept, needle: str, cap: int = L.SEARCH_CAP) -> finder.Found:
    """As ``finder.search_files``, reading only ranges that may hold the needle."""
    return finder.in_waves(kept.files.select("path", "size_bytes"), lambda wave: splits.read_lines(may_hold(kept.ranges.join(wave, "path", "left_semi"), needle), needle), needle, cap)


def find(kept: Kept, query: str = "", project: str | None = None, media: list[str] = [], tools: list[str] = []) -> DataFrame:
    """As ``finder.find`` over the kept rows."""
    numbered = splits.read_lines(may_hold(kept.ranges, query.strip()), query.strip()) if len(query.strip().encode()) >= 2 else None
    return finder.find(kept.rows, numbered, query, project, media, tools)


def index_root(spark: SparkSession, root: str, folder: str) -> Renewal:
    sinks.guard(spark, folder, [root], MARKER)
    return renew(transcripts.session_files(spark, root), folder)
