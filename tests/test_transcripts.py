"""Parsing, turns, linkage, export, search, backup and streaming on transcripts written for the purpose."""

import datetime
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from convoforge.__main__ import main
from convoforge.functions import text as T
from convoforge.operators import finder, integrity, linkage, media, parse, records, sessions, turns
from convoforge.plans import backup, export, sinks
from convoforge.plans.options import PRESETS, ExportOptions, from_mapping
from convoforge.sources import transcripts
from convoforge.streaming import index as stream


def say(role, *blocks):
    return json.dumps({"role": role, "message": {"content": [b if isinstance(b, dict) else {"type": "text", "text": b} for b in blocks]}})


def ask(text):
    return say("user", f"<user_query>{text}</user_query>")


def task(prompt, background=False):
    return {"type": "tool_use", "name": "Task", "input": {"prompt": prompt, "description": "d", "subagent_type": "t", "run_in_background": background}}


def lines(spark, *texts, path="p"):
    return parse.lines(spark.createDataFrame([(path, "\n".join(texts))], "path string, content string"))


def kinds(spark, *texts):
    return [r["kind"] for r in parse.records(lines(spark, *texts)).orderBy("line_index").collect()]


def test_line_kinds(spark):
    deep = "[" * 2000 + "]" * 2000
    odd = ['{"role":"weird","message":{}}', '{"role":"user","mess', "[1,2]", '{"a":1}{"b":2}', "1,2", '1,"x":2', '{"a":1}}', '{"a":1}]', deep]
    assert kinds(spark, *odd) == ["skipped"] * len(odd)
    assert kinds(spark, "", "  ", "﻿" + ask("x"), ask("x") + "\r", '{"type":"turn_ended","status":"success"}') == ["blank", "blank", "message", "message", "marker"]
    marks = [{"status": "success"}, {"status": "success", "error": None}, {"status": "error"}, {}]
    rows = parse.records(lines(spark, *(json.dumps({"type": "turn_ended", "role": "user", **m}) for m in marks))).orderBy("line_index").collect()
    assert [r["errored"] for r in rows] == [False, True, True, True]


def test_hostile_content(spark):
    shapes = ["hi", 5, None, {}, [], [1, None, "x"], [{"type": "text", "text": 5}], [{"type": "tool_use"}], [{"text": "no type"}]]
    got = parse.messages(parse.records(lines(spark, *(json.dumps({"role": "user", "message": {"content": s}}) for s in shapes)))).orderBy("line_index").collect()
    assert len(got) == 9 and [r["full_text"] for r in got] == ["hi"] + [""] * 8
    assert [(b["kind"], b["tool_name"], b["tool_input"]) for b in got[7]["blocks"]] == [("tool_use", "(unnamed tool)", "null")]
    assert got[8]["blocks"][0]["other_type"] == "" and all(r["is_injected"] for r in got)
    first = parse.messages(parse.records(lines(spark, say("assistant", "", "a", "", "b")))).first()
    assert first["full_text"] == "a\n\n\n\nb"
    big = "x" * (8 << 20)
    assert parse.messages(parse.records(lines(spark, ask(big)))).select(F.length("user_query")).first()[0] == len(big)


def brute_turns(rows):
    out, turn, spoke = [], -1, False
    for role, injected in rows:
        if turn < 0 or (role == "user" and not injected and spoke):
            turn, spoke = turn + 1, False
        spoke = spoke or role == "assistant"
        out.append(turn)
    return out


def test_turns_match_a_sequential_walk(spark):
    random.seed(3)
    data = {f"p{i}": [(random.choice(["user", "assistant"]), random.random() < 0.3) for _ in range(random.randint(1, 12))] for i in range(300)}
    rows = [(p, 2 * i, r, r == "user" and j) for p, x in data.items() for i, (r, j) in enumerate(x)]
    got = turns.segment(spark.createDataFrame(rows, "path string, line_index long, role string, is_injected boolean"))
    by = {}
    for r in got.orderBy("path", "line_index").collect():
        by.setdefault(r["path"], []).append(r["turn_id"])
    assert by == {p: brute_turns(x) for p, x in data.items()}
    assert turns.segment(got.drop("turn_id").limit(0)).count() == 0


def brute_links(tasks, kids):
    used, out = [], []
    for order, prompt, background in tasks:
        hit = None
        if prompt:
            free = [k for k in kids if k[0] not in used]
            hit = next((("exact", k) for k in free if k[1] == prompt), None) or next((("substring", k) for k in free if prompt in k[1]), None)
        if hit:
            used.append(hit[1][0])
        out.append([order, hit[0] if hit else "none", hit[1][0] if hit else None, hit[1][3] if hit and not background else None])
    for row, (_, prompt, _) in zip(out, tasks, strict=True):
        if row[1] == "none" and prompt:
            again = next((k for k in kids if k[0] in used and prompt in k[2]), None)
            if again:
                row[1], row[2] = "resume", again[0]
    return [tuple(r) for r in out]


def test_linkage_matches_a_sequential_fold(spark):
    random.seed(8)
    word = lambda: random.choice(["a", "b", "ab", "abc", "bc", ""])
    tasks, kids = {}, {}
    for m in range(60):
        tasks[f"m{m:02}"] = [(i, word(), random.random() < 0.3) for i in range(random.randint(1, 6))]
        kids[f"m{m:02}"] = [(f"k{i}", q := word(), q + " " + word(), f"answer {i}") for i in range(random.randint(0, 4))]
    t = spark.createDataFrame([(m, i, "t", "d", p, p, b) for m, x in tasks.items() for i, p, b in x], "master_path string, spawn_order long, subagent_type string, description string, prompt string, prompt_hash string, background boolean")
    k = spark.createDataFrame([(m, *x) for m, y in kids.items() for x in y], "master_path string, path string, first_query string, all_user string, answer string")
    got = {}
    for r in linkage.link(t, k).orderBy("master_path", "spawn_order").collect():
        got.setdefault(r["master_path"], []).append((r["spawn_order"], r["match"], r["child_path"], r["result"]))
    assert got == {m: brute_links(tasks[m], kids[m]) for m in tasks}


@pytest.mark.parametrize("limit,want", [(450, [2, 1]), (0, [3]), (100, [1, 1, 1]), (600, [3])])
def test_chunks(spark, limit, want):
    rows = spark.createDataFrame([("p", i, "u" * 100, "", "a" * 100, "a" * 50) for i in range(3)], "path string, turn_id long, user string, thinking string, answer string, native string")
    got = records.chunk(rows, limit).orderBy("chunk").collect()
    assert [len(r["turns"]) for r in got] == want and {r["chunks"] for r in got} == {len(want)}
    assert [r["turn_id"] for c in got for r in c["turns"]] == [0, 1, 2]


def test_linkage_of_many_children_under_one_parent(spark):
    n = 20_000
    t = spark.range(n).select(F.lit("m").alias("master_path"), F.col("id").alias("spawn_order"), F.lit("t").alias("subagent_type"), F.lit("d").alias("description"), F.concat(F.lit("job "), F.col("id") % 5000, F.lit(";")).alias("prompt"), F.lit("h").alias("prompt_hash"), F.lit(False).alias("background"))
    k = spark.range(n).select(F.lit("m").alias("master_path"), F.format_string("k%06d", "id").alias("path"), F.concat(F.when(F.col("id") % 2 == 0, "please do ").otherwise(""), F.lit("job "), F.col("id") % 5000, F.lit(";")).alias("first_query"), F.lit("").alias("all_user"), F.concat(F.lit("answer "), "id").alias("answer"))
    got = {r["spawn_order"]: (r["match"], r["child_path"], r["result"]) for r in linkage.link(t, k).collect()}
    assert len(got) == n
    for i in range(n):  # the i-th call of a prompt takes the i-th of its four children
        assert got[i] == ("exact" if i % 2 else "substring", f"k{i:06d}", f"answer {i}")
    pairs = spark.createDataFrame([("m", i, "t", "d", p, p, False) for i, p in enumerate(["", "x", "x", "y"])], t.schema)
    kids = spark.createDataFrame([("m", "b", None, None, None), ("m", "a", "x", "x y", "done"), ("q", "c", "x", "x", "of nobody")], "master_path string, path string, first_query string, all_user string, answer string")
    assert [(r["match"], r["child_path"], r["result"]) for r in linkage.link(pairs, kids).orderBy("spawn_order").collect()] == [("none", None, None), ("exact", "a", "done"), ("resume", "a", None), ("resume", "a", None)]
    assert linkage.link(t.limit(0), k).count() == 0 and linkage.link(pairs, kids.limit(0)).where("match = 'none'").count() == 4


def brute_chunks(sizes, limit):
    out, at, filled = [], 0, 0
    for size in sizes:
        if filled > 0 and filled + size > limit:
            at, filled = at + 1, 0
        out.append(at)
        filled += size
    return out


def test_chunks_match_a_sequential_fill_over_batches(spark):
    random.seed(6)
    data = {f"p{i}": [random.choice([0, 1, 5, 40, 99, 100, 101, 250]) for _ in range(random.choice([1, 3, 30, 700]))] for i in range(12)}
    rows = spark.createDataFrame([(p, i, n) for p, x in data.items() for i, n in enumerate(x)], "path string, turn_id long, size long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = {}
        for r in records.chunk_starts(rows, 100).orderBy("path", "turn_id").collect():
            got.setdefault(r["path"], []).append((r["chunk"], r["starts"]))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for p, x in data.items():
        want = brute_chunks(x, 100)
        assert got[p] == [(c, i == 0 or c != want[i - 1]) for i, c in enumerate(want)]
    assert records.chunk_starts(rows.limit(0), 100).count() == 0


def test_chunks_of_a_session_of_millions_of_turns(spark):
    rows = spark.range(3_000_000, numPartitions=4).select(F.lit("p").alias("path"), F.col("id").alias("turn_id"), (F.col("id") % 7 * 100).alias("size"))
    placed = records.chunk_starts(rows, 100_000)
    said = placed.join(rows, ["path", "turn_id"]).groupBy("chunk").agg(F.sum("size").alias("bytes"), F.count_if("starts").alias("starts"))
    said = said.agg(F.count("*").alias("n"), F.max("bytes").alias("most"), F.sum("bytes").alias("all"), F.max("starts").alias("starts")).first()
    assert said["most"] <= 100_000 and said["starts"] == 1 and said["n"] == len({*brute_chunks([i % 7 * 100 for i in range(3_000_000)], 100_000)})


@pytest.mark.parametrize("n,fraction,want", [(10, 0.25, 3), (5, 0.5, 3), (1, 0.5, 0), (4, 0.9, 2), (3, 0.0, 0)])
def test_split_holds_out_the_latest(spark, n, fraction, want):
    rows = spark.createDataFrame([(f"p{i:02}", i if i else None) for i in range(n)], "path string, modified_unix long")
    got = {r["path"]: r["split"] for r in records.split(rows, fraction).collect()}
    assert len(got) == n and sorted(p for p, s in got.items() if s == "val") == [f"p{i:02}" for i in range(n - want, n)]


@pytest.fixture()
def root(tmp_path):
    base = tmp_path / "projects"

    def put(rel, *texts, raw=None):
        f = base / rel
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(raw if raw is not None else ("\n".join(texts) + "\n").encode())
        os.utime(f, (1_700_000_000 + len(rel), 1_700_000_000 + len(rel)))
        return f

    note = tmp_path / "note.txt"
    note.write_text("attached words")
    at = "my-proj/agent-transcripts"
    put(f"{at}/m1/m1.jsonl", ask(f"start with {note}"), say("assistant", "Working.", task("do A"), task("do B", True), task("nobody")), '{"type":"turn_ended","status":"success"}', ask("thanks"), say("assistant", "Welcome ghp_" + "a" * 36))
    put(f"{at}/m1/subagents/s1.jsonl", ask("do A"), say("assistant", "A is done."))
    put(f"{at}/m1/subagents/s2.jsonl", ask("please do B now"), say("assistant", "B is done."))
    put(f"{at}/m1/subagents/m1.jsonl", ask("fork"), say("assistant", "forked"))
    put(f"{at}/flat.jsonl", ask("flat one"), say("assistant", "yes"), "{torn")
    put(f"{at}/x/other.jsonl", ask("mismatch"))
    put("other/agent-transcripts/bad/bad.jsonl", raw=ask("ok").encode() + b"\n\xff\xfe\xff\n")
    put("other/agent-transcripts/empty/empty.jsonl", raw=b"")
    put("other/stray.txt", "x")
    (base / "lonely").mkdir()
    return base


def test_scan(spark, root):
    rows = {r["path"].rsplit("/", 1)[1]: r for r in transcripts.titled_sessions(transcripts.read_files(spark, str(root))).where("not is_subagent").collect()}
    assert sorted(rows) == ["bad.jsonl", "flat.jsonl", "m1.jsonl"]
    assert rows["flat.jsonl"]["title"] == "flat one"
    assert transcripts.projects_on_disk(spark, str(root)) == ["lonely", "my-proj", "other"]
    stats = {r["path"].rsplit("/", 1)[1]: r for r in parse.stats(transcripts.records(transcripts.read_files(spark, str(root)))).collect()}
    assert (stats["bad.jsonl"]["messages"], stats["bad.jsonl"]["skipped_lines"]) == (1, 1) and stats["flat.jsonl"]["skipped_lines"] == 1
    shown = sessions.projects(transcripts.read_sessions(spark, str(root))).collect()
    assert {(r["project_slug"], r["main_sessions"], r["subagent_sessions"]) for r in shown} == {("my-proj", 2, 3), ("other", 2, 0)}


def test_export_inline(spark, root, tmp_path):
    out = str(tmp_path / "out")
    o = ExportOptions(sft_sharegpt=True, cpt_jsonl=True, cpt_txt=True, inline_readable_attachments=True, val_fraction=0.4)
    summary = export.export(spark, str(root), out, o)
    manifest = json.loads((tmp_path / "out" / "manifest.json").read_text())
    assert summary.sessions == 2 and summary.skipped == 2 and summary.secrets_detected["github"] >= 1 and summary.media_copied == 1
    got = {}
    for name, n in manifest["file_line_counts"].items():
        got[name] = [json.loads(r[0]) for r in spark.read.text(f"{out}/{name}").collect()]
        assert len(got[name]) == n
    chat = got["sft_chatml/train.jsonl"] + got["sft_chatml/val.jsonl"]
    assert len(got["sft_chatml/val.jsonl"]) == 1 and len({tuple(sorted(r)) for r in chat}) == 1
    for r in chat:
        assert [m["role"] for m in r["messages"]] == ["user", "assistant"] * (len(r["messages"]) // 2)
    main_ = next(r for r in chat if r["metadata"]["session_id"] == "m1")
    said = main_["messages"][1]["content"]
    assert '"output":"A is done.","status":"completed"' in said and "spawned_in_background" in said and "unresolved" in said and "B is done" not in said
    assert [c["match"] for c in main_["metadata"]["task_calls"]] == ["exact", "substring", "none"] and main_["metadata"]["unmatched_task_calls"] == 1
    texts = got["cpt/train.jsonl"] + got.get("cpt/val.jsonl", [])
    assert [r["text"] for r in texts if r["metadata"]["kind"] == "attachment"] == ["attached words"]
    assert sorted(p.name for p in (tmp_path / "out" / "cpt_txt").iterdir()) == ["my-proj__flat.txt", "my-proj__m1.txt"]
    with pytest.raises(ValueError):
        sinks.guard(spark, str(root / "x"), [str(root)], "manifest.json")
    (tmp_path / "full").mkdir()
    (tmp_path / "full" / "f").write_text("x")
    with pytest.raises(ValueError):
        export.export(spark, str(root), str(tmp_path / "full"))
    export.export(spark, str(root), out, o)  # its own output may be replaced


def test_export_separate_and_redacted(spark, root, tmp_path):
    out = str(tmp_path / "out")
    summary = export.export(spark, str(root), out, ExportOptions(subagent_mode="separate", redact_secrets=True, thinking="strip"), project="my-proj")
    rows = [json.loads(r[0]) for r in spark.read.text(f"{out}/sft_chatml/train.jsonl").collect()]
    assert sorted((r["metadata"]["session_id"], r["metadata"]["user_kind"]) for r in rows) == [("flat", "human"), ("m1", "human"), ("s1", "agent_brief"), ("s2", "agent_brief")]
    assert summary.secrets_detected == {} and all("task_calls" not in r["metadata"] for r in rows)
    with pytest.raises(LookupError):
        export.export(spark, str(root), str(tmp_path / "no"), project="nope")


def test_nothing_to_train_on(spark, tmp_path):
    f = tmp_path / "r/p/agent-transcripts/a/a.jsonl"
    f.parent.mkdir(parents=True)
    f.write_text(ask("x") + "\n" + say("assistant", {"type": "tool_use", "name": "Read", "input": {}}) + "\n")
    summary = export.export(spark, str(tmp_path / "r"), str(tmp_path / "o"))
    assert (summary.sessions, summary.skipped, summary.sft_records) == (0, 1, 0)
    assert (tmp_path / "o/manifest.json").exists() and (tmp_path / "o/README.md").exists() and not (tmp_path / "o/sft_chatml").exists()


def test_find(spark, root):
    files = transcripts.read_files(spark, str(root))
    numbered = parse.lines(files.select("path", "content"))
    messages = parse.messages(parse.records(numbered))
    index = finder.index(messages, sessions.with_titles(files.drop("content"), messages))
    assert finder.find(index, numbered, "x").count() == 0 and finder.find(index).count() == 0
    assert finder.find(index, numbered, "DONE", "my-proj").count() == 2
    assert finder.find(index, tools=["Task"]).count() == 1 and finder.find(index, media=["readable", "image"]).count() == 1
    hit = finder.search(files, "flat ONE").collect()
    assert len(hit) == 1 and "flat one" in hit[0]["snippet"]
    page = finder.page(finder.find(index, numbered, "done"), sessions.projects(files).limit(0)).collect()
    assert {r["display_name"] for r in page} == {"my-proj"}


def test_every_type_a_file_is_served_as(spark):
    want = {
        "bmp": "image/bmp", "TIFF": "image/tiff", "ico": "image/x-icon", "mkv": "video/x-matroska", "m4v": "video/mp4", "avi": "video/x-msvideo", "flac": "audio/flac", "opus": "audio/ogg",
        "m4a": "audio/mp4", "caf": "audio/x-caf", "jsonl": "application/json", "log": "text/plain; charset=utf-8", "html": "text/plain; charset=utf-8", "tsv": "text/plain; charset=utf-8", "exe": "application/octet-stream",
    }
    rows = spark.createDataFrame([(f"/a/b.{x}", x) for x in want] + [("/a/none", "none")], "path string, ext string")
    got = {r["ext"]: r["mime"] for r in rows.select("ext", T.mime_type("path").alias("mime")).collect()}
    assert got == want | {"none": "application/octet-stream"}


def test_backup_verify_restore(spark, root, tmp_path):
    out, back = str(tmp_path / "b"), str(tmp_path / "back")
    first = backup.backup(spark, str(root), out)
    assert first.copied == 9 and first.attachments == 1
    again = backup.backup(spark, str(root), out, projects=["my-proj"])
    assert again.copied == 0 and again.unchanged == 6
    assert first.hashed == 9 and again.hashed == 0  # known hashes are used again
    marker = tmp_path / "b" / backup.MARKER
    said = marker.read_text()
    sinks.write_text(spark, str(marker), "{ torn")
    assert backup.manifest(spark, out, "transcripts").count() == 0
    mended = backup.backup(spark, str(root), out)
    assert mended.warnings and (tmp_path / "b" / f"{backup.MARKER}.corrupt").read_text() == "{ torn" and marker.read_text() != said
    verdict = lambda: integrity.verdict(backup.verify(spark, out)).first().asDict()
    assert verdict() == {"ok": 9, "failed": 0, "missing": 0, "unsafe": 0, "unhashed": 0, "unlisted": 0, "intact": True}
    plan = backup.restore(spark, out, back, dry_run=True)
    assert plan.where("action = 'copy'").count() == 9 and not os.path.exists(back)
    backup.restore(spark, out, back, projects=["other"])
    assert sorted(os.listdir(back)) == ["other"]
    assert backup.restore(spark, out, back, projects=["other"]).where("action <> 'keep'").count() == 0
    at = tmp_path / "b/projects/my-proj/agent-transcripts"
    (at / "flat.jsonl").write_text("edited")
    (at / "m1/subagents/s1.jsonl").unlink()
    (at / "new.jsonl").write_text("x")
    assert {k: v for k, v in verdict().items() if v} == {"ok": 7, "failed": 1, "missing": 1, "unlisted": 1}
    assert main(["verify", out], spark) == 1 and main(["verify", back], spark) == 1
    assert backup.resolve(spark, out).endswith("/projects")


def test_options():
    o = from_mapping({"thinking": "nope", "min_turns": "x", "val_fraction": 0.2, "redact_secrets": True, "unknown": 1}, PRESETS["agentic"])
    assert (o.thinking, o.min_turns, o.val_fraction, o.redact_secrets, o.include_tool_calls) == ("tagged", 1, 0.2, True, True)


def test_stream_indexes_each_line_once(spark, tmp_path):
    now = datetime.datetime(2026, 1, 1)
    rows = [("p", i, say("assistant", f"text {i}"), now) for i in range(5)] + [("p", 9, "{torn", now)]
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    spark.createDataFrame(rows, stream.LINES).write.parquet(folder)
    stream.start_index(spark, folder, out, state).awaitTermination(120)
    more = spark.createDataFrame([*rows[3:5], ("p", 6, ask("new"), now)], stream.LINES)
    more.write.mode("append").parquet(folder)
    stream.start_index(spark, folder, out, state).awaitTermination(120)
    assert sorted(r["line_index"] for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3, 4, 6]
    seen = stream.activity(spark.createDataFrame(rows, stream.LINES)).first()
    assert (seen["messages"], seen["skipped"]) == (5, 1)


def test_media_are_located_by_the_first_rule_that_meets_a_file(spark):
    named = ["/b/projects/p/a.png", "/home/a.png", "/old/p/x/a.png", "/gone/a.png", "/none/a.png", None, "/b/projects/../x.png", "/old/q/p/p/a.png"]
    refs = spark.createDataFrame([(i, n) for i, n in enumerate(named)], "i int, media_path string")
    kept = spark.range(1).select(F.concat(F.lit("/b/attachments/"), T.attachment_name(F.lit("/gone/a.png")))).first()[0]
    have = spark.createDataFrame([("/b//projects/p/a.png",), ("/home/a.png",), ("/b/projects/p/x/a.png",), (kept,), ("/b/projects/../x.png",), ("/b/projects/p/p/a.png",)], "file string")
    slugs = spark.createDataFrame([("p",), ("q",), ("",), ("p",)], "project_slug string")

    def found(**how):
        return [(r.rule, r.found) for r in media.locate(refs, have, slugs, "/b/projects/", **how).orderBy("i").collect()]

    moved = [("moved", "/b/projects/p/x/a.png"), ("captured", kept), (None, None), (None, None), (None, None), ("moved", "/b/projects/p/p/a.png")]
    assert found() == [("inside", named[0]), ("outside", named[1]), *moved]
    assert found(live=False) == [("inside", named[0]), (None, None), *moved]
    assert found(live=False, boundary="/home")[1] == ("inside", named[1])
    assert media.locate(refs.limit(0), have, slugs, "/b/projects").count() == 0


def test_cards_show_the_first_of_each(spark):
    files = [(f"{i}.png", "image") for i in range(7)] + [(f"{i}.pdf", "document") for i in range(6)]
    rows = spark.createDataFrame([("a", list("abcdef"), files), ("b", [], [])], "path string, tools array<string>, media array<struct<name:string,kind:string>>")
    one, none = finder.card(rows).orderBy("path").collect()
    assert (one.tools, [m.name for m in one.images], [m.name for m in one.files], one.more_images) == (list("abcd"), [f"{i}.png" for i in range(5)], [f"{i}.pdf" for i in range(4)], 2)
    assert (none.tools, none.images, none.files, none.more_images) == ([], [], [], 0)


def test_projects_and_sessions_are_picked_and_ordered(spark):
    rows = [("p-one", "/a", False, 5, "s"), ("p-one", "/b", True, 9, "t"), ("p-two", "/c", False, None, "u"), ("p-two", "/d", False, 5, "v")]
    every = spark.createDataFrame(rows, "project_slug string, path string, is_subagent boolean, modified_unix long, id string")
    assert [r.path for r in sessions.ordered(every).collect()] == ["/b", "/a", "/d", "/c"]
    found = sessions.projects(every)
    assert [r.project_slug for r in sessions.pick_projects(found, "ONE").collect()] == ["p-one"]
    assert sessions.pick_projects(found).count() == 2 and sessions.pick_projects(found, "zzz").count() == 0
    assert transcripts.default_root("tool", "/h/") == "/h/.tool/projects"


def test_titles_come_from_the_first_bytes(spark, tmp_path):
    from convoforge.functions.lexicon import TITLE_BYTES

    first = ask("asked late")
    empty = len(say("assistant", "").encode())
    room = TITLE_BYTES - len(first) - 1 - empty
    folder = tmp_path / "proj" / "agent-transcripts"
    folder.mkdir(parents=True)
    for name, texts in {
        "fits": [say("assistant", "x" * room), first], "over": [say("assistant", "x" * (room + 1)), first], "eighth": ["{}"] * 7 + [first], "ninth": ["{}"] * 8 + [first],
        "wide": [json.dumps({"role": "assistant", "message": {"content": "é" * (room // 2 + 40)}}, ensure_ascii=False), first], "none": [""], "long": [ask("y" * TITLE_BYTES), first],
    }.items():
        (folder / f"{name}.jsonl").write_text("\n".join(texts))
    for files in (transcripts.session_files(spark, str(tmp_path)), transcripts.read_files(spark, str(tmp_path))):
        got = {r["id"]: r["title"] for r in transcripts.titled_sessions(files).collect()}
        assert {k for k, v in got.items() if v == "asked late"} == {"fits", "eighth"}
        assert len(got) >= 6 and got["over"] == got["long"] == sessions.UNTITLED
    tail = spark.createDataFrame([("p", 3, first, TITLE_BYTES - len(first)), ("q", 3, first, TITLE_BYTES - len(first) + 1)], "path string, line_index long, line string, begin long")
    assert [r["path"] for r in sessions.title_lines(tail).collect()] == ["p"]


def _seen_through(df, seen):
    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema)


def test_turns_are_rendered_once_and_messages_read_once(spark):
    from convoforge.operators import parse
    from convoforge.operators import records as R
    from convoforge.operators import sessions as S
    from convoforge.plans import export as E
    from convoforge.plans.fixtures import views
    from convoforge.plans.options import ExportOptions

    v = views(spark, "/root/testdata/sf0.001")
    messages, everyone = parse.messages(parse.records(v["lines"])), v["sessions"].drop("conv_id")
    n = messages.count()
    seen = spark.sparkContext.accumulator(0)
    inline = ExportOptions(include_tool_calls=True, val_fraction=0.1)
    assert E.chunks_of(_seen_through(messages, seen), S.select(everyone, False), everyone, inline).count() and seen.value == n
    turns = spark.createDataFrame([(f"p{i % 7}", i, "ask", "", "say", "say") for i in range(50)], "path string, turn_id long, user string, thinking string, answer string, native string")
    own = spark.createDataFrame([(f"p{i}", i) for i in range(7)], "path string, modified_unix long")
    for most in (0, 20):
        seen = spark.sparkContext.accumulator(0)
        rows = R.prepare(_seen_through(turns, seen), own, None, ExportOptions(subagent_mode="separate", max_record_chars=most, val_fraction=0.25))
        assert {r["split"] for r in rows.collect()} == {"train", "val"} and seen.value == 50
