"""Sessions as records: minimum of turns, train/validation split, chunks, and the lines of each output format."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..plans.options import ExportOptions
from ..sources.scratch import checkpointed, written
from .render import cpt_assistant, sft_assistant, trainable

SOURCE = "agent-transcript"


def enough_turns(turns: DataFrame, least: int = 1) -> DataFrame:
    """Turns of sessions that have at least max(least, 1) of them."""
    return turns.withColumn("_n", F.count("*").over(Window.partitionBy("path"))).where(F.col("_n") >= max(least, 1)).drop("_n")


def val_count(n: Column, fraction: float) -> Column:
    """Sessions held out of n: the rounded share (half away from zero, in single precision), never all of them."""
    share = F.round(n.cast("float") * F.lit(min(max(fraction, 0.0), 0.5)).cast("float")).cast("long")
    return F.when((share >= n) & (n > 0), n - 1).otherwise(share)


def split(sessions: DataFrame, fraction: float) -> DataFrame:
    """Adds split (train, val): the latest sessions by modified time, then path, are val.

    Ranks come from one range-partitioned sort: rows are counted by partition, and each row's rank is its place in its
    partition plus the rows before it, so no task sees all sessions.
    """
    if fraction <= 0:
        return sessions.withColumn("split", F.lit("train"))
    keys = sessions.select("path", "modified_unix").repartitionByRange(F.asc_nulls_first("modified_unix"), F.asc("path"))
    placed = keys.withColumn("_part", F.spark_partition_id())
    # The same text of the plan twice would sample its ranges twice; a checkpoint makes both uses see the same rows.
    placed = checkpointed(placed)
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    order = Window.orderBy("_part")  # one row per partition, however many sessions there are
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_total", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(F.asc_nulls_first("modified_unix"), "path"))
    ranked = placed.withColumn("_nth", nth).join(F.broadcast(before.drop("_n")), "_part")
    late = F.col("_before") + F.col("_nth") > F.col("_total") - val_count(F.col("_total"), fraction)
    return sessions.join(ranked.select("path", F.when(late, "val").otherwise("train").alias("split")), "path")


def turn_size() -> Column:
    """Bytes of the largest text that a turn can make."""
    return F.octet_length("user") + F.octet_length("thinking") + F.greatest(F.octet_length("answer"), F.octet_length("native"))


def sized(turns: DataFrame) -> DataFrame:
    return turns.withColumn("_size", turn_size().cast("long"))


def chunk_starts(sizes: DataFrame, limit: int) -> DataFrame:
    """(path, turn_id, chunk, starts) of (path, turn_id, size): the chunk of each turn, filled greedily up to ``limit`` bytes.

    Turns of a path pass through a task in order, and only the bytes of the open chunk are carried from one batch to the
    next, so a session of any length takes the memory of a batch.
    """
    import numpy as np
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_path, at, filled = None, 0, 0
        for b in batches:
            paths = b["path"].dictionary_encode()
            code = paths.indices.to_numpy()
            size = b["size"].to_numpy()
            chunk = np.zeros(len(b), np.int64)
            starts = np.zeros(len(b), bool)
            edges = [*np.flatnonzero(np.diff(code, prepend=-1)), len(b)]
            for first, last in zip(edges[:-1], edges[1:], strict=True):
                path = paths.dictionary[code[first]].as_py()
                if path != open_path:
                    open_path, at, filled = path, -1, 0  # nothing is open
                total = np.cumsum(size[first:last])
                done, i = 0, 0  # bytes before i
                while i < last - first:
                    if at < 0 or filled and filled + int(total[i]) - done > limit:
                        at, filled = at + 1, 0
                        starts[first + i] = True
                    room = limit - filled + done
                    to = max(i + 1, int(np.searchsorted(total, room, "right")))  # a turn larger than the limit is alone
                    chunk[first + i : first + to] = at
                    filled, done, i = filled + int(total[to - 1]) - done, int(total[to - 1]), to
            yield pa.RecordBatch.from_arrays([b["path"], b["turn_id"], pa.array(chunk), pa.array(starts)], ["path", "turn_id", "chunk", "starts"])

    ordered = sizes.select("path", "turn_id", "size").repartition("path").sortWithinPartitions("path", "turn_id")
    return ordered.mapInArrow(run, "path string, turn_id long, chunk long, starts boolean")


def chunk(turns: DataFrame, limit: int = L.CHUNK_BYTES) -> DataFrame:
    """Per path, runs of turns of at most ``limit`` bytes (0: no limit); a larger turn is a chunk of its own.

    (path, chunk, chunks, turns, size). Turns are written out once, unless they are ``sized`` and written already; their sizes
    alone are ordered by path, and texts meet by chunk, never by session (but where there is no limit, and a session is one
    record).
    """
    turn = F.struct("turn_id", F.col("_size").alias("size"), "user", "thinking", "answer", "native")
    rows = turns if "_size" in turns.columns else written(sized(turns), "turns")
    if limit <= 0:
        chunks = rows.groupBy("path").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
        chunks = chunks.select("path", F.lit(0).cast("long").alias("chunk"), F.lit(1).cast("long").alias("chunks"), "turns")
    else:
        placed = written(chunk_starts(rows.select("path", "turn_id", F.col("_size").alias("size")), limit), "turn-chunks")
        chunks = rows.join(placed.drop("starts"), ["path", "turn_id"]).groupBy("path", "chunk").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
        counts = placed.where("starts").groupBy("path").agg(F.count("*").alias("chunks"))
        chunks = chunks.join(counts, "path").select("path", "chunk", "chunks", "turns")
    return chunks.withColumn("size", F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["size"]))


def _total(field: str) -> Column:
    return F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + F.octet_length(t[field]))


def metadata(kind: str, o: ExportOptions) -> Column:
    """A record's metadata as JSON with sorted keys. ``kind``: sft or cpt. Needs the session's columns beside the chunk's.

    Sessions that can be parents carry their calls on the first chunk; the key ``oversize`` only stands where it is true.
    """
    first = F.col("chunk") == 0
    common = {
        "answer_chars": _total("answer"), "chunk": F.col("chunk"), "chunks": F.col("chunks"), "is_subagent": F.col("is_subagent"),
        "modified_unix": F.coalesce("modified_unix", F.lit(0)), "parent_session_id": F.col("parent_id"), "project": F.col("project_slug"),
        "session_id": F.col("id"), "source": F.lit(SOURCE), "think_chars": _total("thinking"), "turns": F.size("turns").cast("long"),
    }
    common |= {"kind": F.lit("session")} if kind == "cpt" else {"user_kind": F.when(F.col("is_subagent"), "agent_brief").otherwise("human")}
    calls = {"task_calls": F.when(first, F.col("task_calls")).otherwise(F.slice("task_calls", 1, 0)), "unmatched_task_calls": F.when(first, F.col("unmatched")).otherwise(0)}
    out = None
    for parent in ((True, False) if o.inline else (False,)):
        for big in (True, False) if o.max_record_chars > 0 else (False,):
            have = common | (calls if parent else {}) | ({"oversize": F.lit(True)} if big else {})
            made = F.to_json(F.struct(*(have[k].alias(k) for k in sorted(have))), {"ignoreNullFields": "false"})
            if not parent and not big:
                return made if out is None else out.otherwise(made)
            test = (~F.col("is_subagent") if parent else F.lit(True)) & ((F.col("size") > o.max_record_chars) if big else F.lit(True))
            out = F.when(test, made) if out is None else out.when(test, made)
    return out


def _said(t: Column, o: ExportOptions) -> Column:
    return sft_assistant(t["thinking"], t["answer"], t["native"], o.thinking)


def _with_metadata(key: str, body: Column, kind: str, o: ExportOptions) -> Column:
    if not o.with_metadata:
        return F.concat(F.lit(f'{{"{key}":'), body, F.lit("}"))
    if key < "metadata":
        return F.concat(F.lit(f'{{"{key}":'), body, F.lit(',"metadata":'), metadata(kind, o), F.lit("}"))
    return F.concat(F.lit('{"metadata":'), metadata(kind, o), F.lit(f',"{key}":'), body, F.lit("}"))


def chatml(o: ExportOptions) -> Column:
    """{"messages": [{"content", "role"}, ...], "metadata"}, user and assistant in turn."""
    pair = lambda t: F.array(F.struct(t["user"].alias("content"), F.lit("user").alias("role")), F.struct(_said(t, o).alias("content"), F.lit("assistant").alias("role")))
    return _with_metadata("messages", F.to_json(F.flatten(F.transform("turns", pair))), "sft", o)


def sharegpt(o: ExportOptions) -> Column:
    pair = lambda t: F.array(F.struct(F.lit("human").alias("from"), t["user"].alias("value")), F.struct(F.lit("gpt").alias("from"), _said(t, o).alias("value")))
    return _with_metadata("conversations", F.to_json(F.flatten(F.transform("turns", pair))), "sft", o)


def dialogue(o: ExportOptions) -> Column:
    """Turns as running text under headings; a child session names its parent first."""
    parent = F.when(F.col("is_subagent") & F.col("parent_id").isNotNull(), F.concat(F.lit("# Subagent transcript (spawned by session "), F.substring("parent_id", 1, 8), F.lit(")\n\n")))
    said = lambda t: F.concat(F.lit("## User\n\n"), T.trim(t["user"]), F.lit("\n\n## Assistant\n\n"), T.trim(cpt_assistant(t["answer"], t["native"], o.thinking)))
    body = F.array_join(F.transform("turns", said), "\n\n")
    return F.regexp_replace(F.concat(F.coalesce(parent, F.lit("")), body), r"(?U)\s+\z", "")


def _json_string(c: Column) -> Column:
    whole = F.to_json(F.struct(c.alias("x")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def cpt(o: ExportOptions) -> Column:
    return _with_metadata("text", _json_string(F.coalesce(F.col("dialogue"), F.lit(""))), "cpt", o)


def cpt_records(chunks: DataFrame, o: ExportOptions) -> DataFrame:
    """chunks with their sessions' columns -> adds dialogue and record; blank dialogues go."""
    return chunks.withColumn("dialogue", dialogue(o)).where(~T.is_blank("dialogue")).withColumn("record", cpt(o))


def attachment_records(attachments: DataFrame, o: ExportOptions) -> DataFrame:
    """(path of the session's columns, text) of readable attachments -> adds record. The text stands as it is."""
    rows = attachments.where(F.octet_length("text") <= L.ATTACHMENT_BYTES).where(~T.is_blank("text"))
    if not o.with_metadata:
        return rows.withColumn("record", F.concat(F.lit('{"text":'), _json_string(F.col("text")), F.lit("}")))
    have = {
        "answer_chars": F.octet_length("text").cast("long"), "chunk": F.lit(0), "chunks": F.lit(1), "is_subagent": F.col("is_subagent"), "kind": F.lit("attachment"),
        "modified_unix": F.coalesce("modified_unix", F.lit(0)), "parent_session_id": F.col("parent_id"), "project": F.col("project_slug"),
        "session_id": F.col("id"), "source": F.lit(SOURCE), "think_chars": F.lit(0), "turns": F.lit(0),
    }
    made = F.to_json(F.struct(*(have[k].alias(k) for k in sorted(have))), {"ignoreNullFields": "false"})
    return rows.withColumn("record", F.concat(F.lit('{"metadata":'), made, F.lit(',"text":'), _json_string(F.col("text")), F.lit("}")))


def text_file_name(slug: Column | str, id_: Column | str) -> Column:
    return F.concat(T.file_name(slug), F.lit("__"), T.file_name(id_), F.lit(".txt"))


def prepare(rendered: DataFrame, sessions: DataFrame, calls: DataFrame | None, o: ExportOptions) -> DataFrame:
    """Trainable turns of all sessions as chunks beside their session's columns and split.

    Turns are written before they are chunked and their sessions split, so each is rendered once.
    """
    turns = written(sized(enough_turns(trainable(rendered), o.min_turns)), "turns")
    chunks = chunk(turns, o.max_record_chars)
    kept = split(sessions.join(turns.select("path").distinct(), "path", "left_semi"), o.val_fraction)
    rows = chunks.join(kept, "path")
    if o.inline:
        call = "array<struct<background:boolean,child_transcript:string,description:string,match:string,spawn_order:bigint,subagent_type:string,task_prompt_hash:string>>"
        rows = rows.join(calls, "path", "left") if calls is not None else rows.withColumns({"task_calls": F.lit(None).cast(call), "unmatched": F.lit(0).cast("long")})
        rows = rows.withColumns({"task_calls": F.coalesce("task_calls", F.array().cast(call)), "unmatched": F.coalesce("unmatched", F.lit(0))})
    return rows
