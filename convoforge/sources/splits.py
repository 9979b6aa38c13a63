"""Lines of files of any size: byte ranges are read by many tasks, and lines keep the numbers a sequential reader gives.

``splits`` cuts files into ranges; ``numbered`` counts the lines of all ranges but the last of a file and adds them up, so
each range knows the number of its first line; ``read_lines`` reads the ranges. A line belongs to the range it begins in,
and is read to its end, wherever that lies. Files that fit in one range are not read for counting.

Defined results: a file of no bytes has no lines; the text behind the last newline is a line, an empty one is not; blank
lines keep their numbers; bytes that are not UTF-8 become U+FFFD; a file that is gone or can't be read has no lines, and
one that grew since it was listed is read as it was long then (a line begun before that end is read whole).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import checkpointed
from .stores import opened

#: Bytes of a range.
SPLIT_BYTES = 64 << 20
#: Bytes read at once, and lines (or bytes of lines) sent on at once.
PIECE_BYTES, BATCH_LINES = 1 << 20, 2000


def splits(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, uri, size_bytes, start, end) of files of (path, uri, size_bytes[, start]); reading begins at ``start``, 0 if there is none."""
    begin = F.col("start") if "start" in files.columns else F.lit(0)
    rows = files.select("path", "uri", F.col("size_bytes").cast("long").alias("size_bytes"), begin.cast("long").alias("begin")).where("size_bytes > begin")
    rows = rows.withColumn("start", F.explode(F.sequence("begin", F.col("size_bytes") - 1, F.lit(split_bytes).cast("long"))))
    return rows.withColumn("end", F.least(F.col("start") + split_bytes, "size_bytes"))


def _begun(uri: str, start: int, end: int, skip: bool) -> int:
    """How many lines begin in a range. ``skip``: the range starts inside a file whose earlier bytes are others' to read."""
    import numpy as np

    store, path = opened(uri)
    at, last = (start - 1, end - 1) if skip else (start, end - 1)
    n = 0 if skip else 1
    with store.open_input_file(path) as f:
        f.seek(at)
        while at < last and (piece := f.read(min(PIECE_BYTES, last - at))):
            n += int(np.count_nonzero(np.frombuffer(piece, np.uint8) == 10))
            at += len(piece)
    return n


def _lines(uri: str, start: int, end: int, skip: bool) -> Iterator[bytes]:
    store, path = opened(uri)
    with store.open_input_file(path) as f:
        at = start - 1 if skip else start
        f.seek(at)
        rest: list[bytes] = []  # of the line that is open
        begun, waiting = at, skip  # where the open line began; whether it is another range's
        while True:
            piece = f.read(PIECE_BYTES)
            from_ = 0
            while (to := piece.find(b"\n", from_)) >= 0:
                if not waiting:
                    yield b"".join([*rest, piece[from_:to]])
                rest, waiting, from_, begun = [], False, to + 1, at + to + 1
                if begun >= end:
                    return
            if not piece:
                if not waiting and (rest or begun < at):
                    yield b"".join(rest)
                return
            if not waiting:
                rest.append(piece[from_:])
            at += len(piece)
            if waiting and at >= end:  # no line begins here
                return


def numbered(ranges: DataFrame) -> DataFrame:
    """Adds ``first``, the number of the first line of each range; only files of several ranges are read for it."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = []
            for uri, start, end, begin in zip(*(b[c].to_pylist() for c in ("uri", "start", "end", "begin")), strict=True):
                try:
                    n.append(_begun(uri, start, end, start > begin))
                except OSError:
                    n.append(0)
            yield pa.RecordBatch.from_arrays([b["path"], b["start"], pa.array(n, pa.int64())], ["path", "start", "n"])

    several = dealt(ranges.where("end < size_bytes"))
    counts = several.select("path", "uri", "start", "end", "begin").mapInArrow(run, "path string, start long, n long")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    rows = ranges.join(counts, ["path", "start"], "left").withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return checkpointed(rows.drop("n"))


def dealt(ranges: DataFrame, task_bytes: int = 2 * SPLIT_BYTES) -> DataFrame:
    """Ranges dealt evenly over as many tasks as their bytes call for."""
    said = ranges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("bytes")).first()
    least = ranges.sparkSession.sparkContext.defaultParallelism
    return ranges.repartition(max(1, min(said["n"], max(least, -(-said["bytes"] // task_bytes)))))


def read_lines(ranges: DataFrame, needle: str | None = None) -> DataFrame:
    """(path, line_index, line) of ranges with their ``first``. ``needle``: only lines that hold it, A-Z and a-z alike."""
    import pyarrow as pa

    wanted = needle.encode().lower() if needle else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, uri, start, end, begin, first in zip(*(b[c].to_pylist() for c in ("path", "uri", "start", "end", "begin", "first")), strict=True):
                numbers, texts, size = [], [], 0

                def made(path=path):
                    return pa.RecordBatch.from_arrays([pa.array([path] * len(texts)), pa.array(numbers, pa.int64()), pa.array(texts, pa.binary())], ["path", "line_index", "line"])

                try:
                    for i, line in enumerate(_lines(uri, start, end, start > begin), first):
                        if wanted is None or wanted in line.lower():
                            numbers.append(i), texts.append(line)
                            size += len(line)
                            if len(texts) >= BATCH_LINES or size >= 4 * PIECE_BYTES:
                                yield made()
                                numbers, texts, size = [], [], 0
                except OSError:
                    pass
                if texts:
                    yield made()

    rows = dealt(ranges).select("path", "uri", "start", "end", "begin", "first").mapInArrow(run, "path string, line_index long, line binary")
    return rows.withColumn("line", F.regexp_replace(F.make_valid_utf8(F.col("line").cast("string")), r"\r\z", ""))


def lines(files: DataFrame, split_bytes: int = SPLIT_BYTES, needle: str | None = None) -> DataFrame:
    """(path, line_index, line) of files of (path, uri, size_bytes)."""
    return read_lines(numbered(splits(files, split_bytes)), needle)
