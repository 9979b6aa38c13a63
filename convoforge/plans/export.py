"""From transcripts to a dataset directory: select, parse, render, split, chunk, write, scan, manifest."""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..operators import linkage, media, parse, records, render, sessions, turns
from ..sources import stores, transcripts
from ..sources.scratch import written
from . import sinks
from .options import ExportOptions

MANIFEST = "manifest.json"


@dataclass
class ExportSummary:
    sessions: int = 0
    skipped: int = 0
    sft_records: int = 0
    cpt_records: int = 0
    media_referenced: int = 0
    media_copied: int = 0
    secrets_detected: dict[str, int] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)


def chunks_of(messages: DataFrame, chosen: DataFrame, everyone: DataFrame, o: ExportOptions) -> DataFrame:
    """Chunks of the chosen sessions with all columns that records need. ``everyone``: all sessions, for linkage.

    With linkage, messages, calls, children and links are read more than once and written out for that.
    """
    if o.inline:
        messages, everyone, chosen = written(messages, "messages"), written(everyone, "everyone"), written(chosen, "chosen")
    mine = turns.segment(messages.join(chosen.select("path"), "path", "left_semi"))
    links = calls = None
    if o.inline:
        parents = chosen.where(~F.col("is_subagent")).select("path")
        tasks = written(linkage.tasks(messages.join(parents, "path", "left_semi")), "tasks")
        linked = written(linkage.link(tasks, written(linkage.children(messages, everyone), "children")), "links")
        # Parents without a Task call have an empty map: their calls, if any, are unresolved, not ordinary.
        by_hash = linkage.by_hash(linked)
        kind = by_hash.schema["links"].dataType
        links = parents.join(by_hash, "path", "left").withColumn("links", F.coalesce("links", F.create_map().cast(kind)))
        calls = linkage.per_session(linked)
    return records.prepare(render.render(mine, links, o), chosen, calls, o)


def export(spark: SparkSession, root: str, out: str, o: ExportOptions = ExportOptions(), project: str | None = None, paths: list[str] | None = None) -> ExportSummary:
    """Write the datasets that ``o`` asks for below ``out``; the manifest comes last, so its presence says the rest is whole."""
    sinks.guard(spark, out, [root], MANIFEST)
    sinks.delete(spark, f"{out}/{MANIFEST}")
    files = transcripts.session_files(spark, root)
    if project is not None:
        if project not in transcripts.projects_on_disk(spark, root):
            raise LookupError(f"no project {project}")
        files = files.where(F.col("project_slug") == project)
    parsed = transcripts.records(files).persist(StorageLevel.DISK_ONLY)
    messages = parse.messages(parsed)
    everyone = sessions.with_titles(files.drop("uri"), messages)
    chosen = everyone.where(F.col("path").isin(*paths)) if paths is not None else everyone
    chosen = sessions.select(chosen, o.with_subagents).persist(StorageLevel.DISK_ONLY)
    chunks = chunks_of(messages, chosen, everyone, o).persist(StorageLevel.DISK_ONLY)
    summary = ExportSummary(sessions=chunks.select("path").distinct().count())
    summary.skipped = chosen.count() - summary.sessions

    counts: dict[str, int] = {}

    def lines(name: str, rows: DataFrame) -> None:
        made, secrets = sinks.write_counted(rows.select(F.col("split").alias("part"), F.col("record").alias("value")), f"{out}/{name}", ("train", "val"), L.SECRET_FAMILIES)
        counts.update({f"{name}/{part}.jsonl": n for part, n in made.items()})
        for kind, n in secrets.items():
            summary.secrets_detected[kind] = summary.secrets_detected.get(kind, 0) + n

    if o.sft_chatml:
        lines("sft_chatml", chunks.withColumn("record", records.chatml(o)))
    if o.sft_sharegpt:
        lines("sft_sharegpt", chunks.withColumn("record", records.sharegpt(o)))
    refs = media.references(messages.join(chosen.select("path"), "path", "left_semi"))
    if o.cpt_jsonl:
        rows = records.cpt_records(chunks, o).select("split", "record")
        if o.inline_readable_attachments:
            split = chunks.select("path", "split").distinct()
            rows = rows.unionAll(records.attachment_records(readable(spark, refs).join(chosen, "path").join(split, "path"), o).select("split", "record"))
        lines("cpt", rows)
    if o.cpt_txt:
        whole = chunks.groupBy("path").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "turns"))), lambda x: x["turns"])).alias("turns"))
        whole = whole.join(chosen, "path").withColumn("text", records.dialogue(o)).withColumn("file", records.text_file_name("project_slug", "id"))
        sinks.delete(spark, f"{out}/cpt_txt")
        sinks.write_texts(whole.where(~T.is_blank("text")), f"{out}/cpt_txt")

    files_seen = refs.select("media_path").distinct()
    summary.media_referenced = files_seen.count()
    if o.copy_media and summary.media_referenced:
        copies = files_seen.select(F.col("media_path").alias("source"), F.concat(F.lit(f"{out}/media/"), T.attachment_name("media_path")).alias("target"))
        done = sinks.copy_files(copies).agg(F.count_if("copied").alias("ok"), F.count_if(~F.col("copied")).alias("bad")).first()
        summary.media_copied = done["ok"]
        if done["bad"]:
            summary.warnings.append(f"{done['bad']} media files could not be copied")

    sinks.write_text(spark, f"{out}/README.md", card(o, chunks))
    summary.sft_records = sum(n for k, n in counts.items() if k.startswith("sft"))
    summary.cpt_records = sum(n for k, n in counts.items() if k.startswith("cpt"))
    per_session = chunks.groupBy("path").agg(F.sum(F.size("turns")).alias("turns_trainable"))
    stats = parse.stats(parsed).join(per_session, "path").join(chosen, "path")
    stats.select("id", "project_slug", "title", "is_subagent", "parent_id", "turns_trainable", "skipped_lines", "errored_turns", F.col("path").alias("source_path")).write.mode("overwrite").json(f"{out}/sessions.jsonl")
    sinks.write_json(spark, f"{out}/{MANIFEST}", {
        "tool": "convoforge", "created_unix": int(time.time()), "options": asdict(o), "sessions": "sessions.jsonl", "session_count": summary.sessions,
        "file_line_counts": counts, "secrets_detected": summary.secrets_detected, "media": {"referenced": summary.media_referenced, "copied": summary.media_copied}, "warnings": summary.warnings,
    })
    for held in (parsed, chosen, chunks):
        held.unpersist()
    return summary


def readable(spark: SparkSession, refs: DataFrame) -> DataFrame:
    """(path, media_path, text) of referenced readable files that exist, hold UTF-8 and are small enough; read in tasks."""
    def run(batches):
        for rows in batches:
            texts = []
            for p in rows["media_path"]:
                try:
                    store, path = stores.opened(p)
                    about = store.get_file_info(path)
                    if not about.is_file or about.size > L.ATTACHMENT_BYTES:
                        texts.append(None)
                    else:
                        with store.open_input_stream(path) as f:
                            texts.append(f.read().decode())
                except (OSError, ValueError):  # not there, not text, or no path at all
                    texts.append(None)
            yield rows.assign(text=texts)

    return refs.where("kind = 'readable'").select("path", "media_path").mapInPandas(run, "path string, media_path string, text string").where("text is not null")


def card(o: ExportOptions, chunks: DataFrame) -> str:
    """A short description of the dataset; detections of secrets stand in the manifest alone."""
    seen = chunks.agg(F.countDistinct("path").alias("sessions"), F.countDistinct("project_slug").alias("projects"), F.coalesce(F.sum(F.size("turns")), F.lit(0)).alias("turns")).first()
    formats = [n for n, on in (("ChatML messages", o.sft_chatml), ("ShareGPT conversations", o.sft_sharegpt), ("text records", o.cpt_jsonl), ("text files", o.cpt_txt)) if on]
    thinking = {"tagged": "Narration stands in one <think> block before the answer.", "strip": "Narration was removed.", "verbatim": "Narration stays where it was written."}[o.thinking]
    agents = {"inline": "Results of delegated runs stand inside the calls that asked for them.", "drop": "Delegated runs were left out.", "separate": "Delegated runs are sessions of their own."}[o.subagent_mode]
    limit = f"Records hold at most {o.max_record_chars} bytes of text, unless a single turn is larger (`oversize`)." if o.max_record_chars else "Each session is one record."
    lines = [
        "# Dataset", "", f"{seen['turns']} turns of {seen['sessions']} sessions from {seen['projects']} projects.", "", f"Formats: {', '.join(formats) or 'none'}.", "", thinking, agents, limit,
        "Known credential formats were replaced by markers." if o.redact_secrets else "Credentials were not removed; the manifest counts those found.", "",
    ]
    return "\n".join(lines)
