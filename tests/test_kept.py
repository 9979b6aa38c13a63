"""The kept index, search in waves, and text files that are committed."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from convoforge.__main__ import main
from convoforge.operators import finder, parse, sessions
from convoforge.plans import kept, sinks
from convoforge.sources import splits, transcripts


def say(role, text, *tools):
    blocks = [{"type": "text", "text": text}] + [{"type": "tool_use", "name": t, "input": {}} for t in tools]
    return json.dumps({"role": role, "message": {"content": blocks}})


def put(root, name, lines, at=1_700_000_000):
    f = root / "proj" / "agent-transcripts" / name / f"{name}.jsonl"
    f.parent.mkdir(parents=True, exist_ok=True)
    f.write_text("\n".join(lines) + "\n")
    os.utime(f, (at, at))


@pytest.fixture()
def root(tmp_path):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    for i in range(12):
        lines = [say("user", f"<user_query>start {word()} of s{i:02}</user_query>")]
        lines += [say("assistant", " ".join(word() for _ in range(8)) + (" NeedLe" if i in (3, 4, 9) and j % 5 == 0 else ""), *(["Read"] if j % 2 else [])) for j in range(20)]
        put(tmp_path / "root", f"s{i:02}", lines)
    return tmp_path / "root"


def listed(spark, root):
    return transcripts.session_files(spark, str(root))


def names(rows):
    return sorted((os.path.basename(r["path"]), r["line_index"]) for r in rows)


def test_only_changed_files_are_parsed_again(spark, root, tmp_path):
    folder = str(tmp_path / "index")
    assert kept.index_root(spark, str(root), folder) == kept.Renewal(parsed=12, kept=0, gone=0)
    assert kept.index_root(spark, str(root), folder) == kept.Renewal(parsed=0, kept=12, gone=0)
    put(root, "s05", [say("user", "<user_query>another start</user_query>"), say("assistant", "shorter needle", "Grep")], 1_700_000_100)
    put(root, "s99", [say("assistant", "new", "Read")])
    os.remove(root / "proj/agent-transcripts/s00/s00.jsonl")
    assert kept.index_root(spark, str(root), folder) == kept.Renewal(parsed=2, kept=10, gone=1)

    def check():
        held = kept.opened(spark, folder)
        numbered = transcripts.numbered_lines(listed(spark, root))
        messages = parse.messages(parse.records(numbered))
        fresh = finder.index(messages, sessions.with_titles(listed(spark, root).drop("uri"), messages))
        columns = ["path", "line_index", "role", "tools", "snippet", "title", "project_slug"]
        as_rows = lambda f: sorted(map(str, f.select(*columns).collect()))
        assert as_rows(held.rows) == as_rows(fresh)
        assert sorted(map(tuple, kept.facet_values(held).collect())) == sorted(map(tuple, finder.facet_values(fresh).collect())) != []
        per = lambda f: sorted(map(str, f.select("path", "tools", "kinds").collect()))
        assert per(kept.facets(held)) == per(finder.facets(fresh))
        assert names(kept.find(held, "needle", tools=["Grep"]).collect()) == names(finder.find(fresh, numbered, "needle", tools=["Grep"]).collect()) == [("s05.jsonl", 1)]
        assert names(kept.find(held, "needle").collect()) == names(finder.find(fresh, numbered, "needle").collect())

    check()
    kept.compact(spark, folder)
    check()
    assert len(json.loads((tmp_path / "index" / kept.MARKER).read_text())["generations"]) == 1


@pytest.mark.parametrize("split_bytes", [300, 1 << 20])
def test_tails_of_growing_files_are_read_from_where_reading_ended(spark, tmp_path, split_bytes):
    base, folder = tmp_path / "root", str(tmp_path / "index")
    at = base / "proj/agent-transcripts"
    first = [say("assistant", f"line {i} of the start", *(["Read"] if i % 2 else [])) for i in range(9)]
    for name in ("grows", "torn", "shrinks", "swapped", "renamed", "still", "late"):
        put(base, name, first)
    (at / "torn/torn.jsonl").write_text("\n".join(first) + "\n" + (whole := say("assistant", "was torn here", "Edit"))[:-9])
    (at / "late/late.jsonl").write_text(say("assistant", "no question yet"))  # no newline: may still go on

    def scan():
        done = kept.renew(listed(spark, base), folder, split_bytes)
        held = kept.opened(spark, folder)
        numbered = transcripts.numbered_lines(listed(spark, base))
        messages = parse.messages(parse.records(numbered))
        fresh = finder.index(messages, sessions.with_titles(listed(spark, base).drop("uri"), messages))
        columns = ["path", "line_index", "tools", "snippet", "title", "modified_unix"]
        assert sorted(map(str, held.rows.select(*columns).collect())) == sorted(map(str, fresh.select(*columns).collect()))
        assert sorted(map(tuple, kept.facet_values(held).collect())) == sorted(map(tuple, finder.facet_values(fresh).collect()))
        read = lambda rows: sorted(map(str, rows.where("line <> ''").select("path", "line_index", "line").collect()))
        assert read(splits.read_lines(held.ranges)) == read(numbered)
        return done

    assert scan() == kept.Renewal(parsed=7)
    for turn in (1, 2):
        more = [say("user", f"<user_query>more of {turn}</user_query>"), say("assistant", f"added {turn}", "Grep")]
        with (at / "grows/grows.jsonl").open("a") as f:
            f.write("\n".join(more) + "\n" + '{"torn')
        if turn == 1:
            (at / "torn/torn.jsonl").write_text("\n".join(first) + "\n" + whole + "\n" + more[0] + "\n")
            (at / "late/late.jsonl").write_text(say("assistant", "no question yet") + "\n" + more[0] + "\n")
            (at / "shrinks/shrinks.jsonl").write_text("\n".join(first[:3]) + "\n")
            (at / "swapped/swapped.jsonl").write_text("\n".join(reversed(first)) + "\n" + more[0] + "\n")
            (at / "renamed").rename(at / "other")
            (at / "other/renamed.jsonl").rename(at / "other/other.jsonl")
            # Grown: grows, torn, late (its one line had no end); anew: shrinks, swapped, other.
            assert scan() == kept.Renewal(parsed=3, grown=3, kept=1, gone=1)
        else:
            assert scan() == kept.Renewal(grown=1, kept=6)
    kept.compact(spark, folder)
    assert scan() == kept.Renewal(kept=7)


def test_filters_spare_files_and_lose_no_hit(spark, root, tmp_path):
    folder = str(tmp_path / "index")
    kept.renew(listed(spark, root), folder, split_bytes=700)
    held = kept.opened(spark, folder)
    for needle in ("nEEdle", "start", "s03", "zzzz", "ab", "a", "agent", "role"):
        left = kept.may_hold(held.ranges, needle)
        want = names(splits.lines(listed(spark, root), 1 << 20, needle).collect())
        assert names(splits.read_lines(left, needle).collect()) == want
        if needle == "nEEdle":
            assert len(want) == 12 and left.select("path").distinct().count() == 3 and 12 <= left.count() <= 20 < held.ranges.count()
        if needle == "zzzz":
            assert left.count() == 0
    found = kept.search(held, "needle")
    assert names(found.hits.collect()) == names(splits.lines(listed(spark, root), 1 << 20, "needle").collect()) and found.files_scanned == 12


def test_search_opens_no_file_behind_its_cap(spark, root):
    files = listed(spark, root).withColumn("uri", F.when(F.col("path") >= F.lit(str(root / "proj/agent-transcripts/s06")), "/no/such/file").otherwise(F.col("uri")))
    found = finder.in_waves(files, lambda wave: splits.lines(wave, 1 << 20, "needle"), "needle", cap=6, first=2, growth=2)
    hits = found.hits.collect()
    assert names(hits) == [("s03.jsonl", i) for i in (1, 6, 11, 16)] + [("s04.jsonl", i) for i in (1, 6)]
    assert (found.files_scanned, found.waves) == (5, 2)  # waves of 2 and 4 files
    whole = finder.search_files(listed(spark, root), "needle")
    assert whole.hits.count() == 12 and whole.files_scanned == 12
    assert all("NeedLe" in r["snippet"] for r in whole.hits.collect())
    none = finder.search_files(listed(spark, root).limit(0), "needle")
    assert (none.hits.count(), none.files_scanned) == (0, 0)


def test_index_and_search_from_a_shell(spark, root, tmp_path, capsys):
    folder = str(tmp_path / "index")
    assert main(["index", str(root), folder], spark) == 0 and "'parsed': 12" in capsys.readouterr().out
    assert main(["search", str(root), "needle", "--index", folder], spark) == 0
    said = capsys.readouterr().out
    assert "NeedLe" in said and "12 files scanned" in said
    assert main(["search", str(root / "none"), "needle"], spark) == 1 and main(["search", str(root), "x", "--index", str(root)], spark) == 1


def test_text_files_are_committed_or_not_there(spark, tmp_path):
    rows = spark.createDataFrame([(f"a{i % 7}/f{i}.txt", f"text {i}\n" * (i % 50)) for i in range(200)] + [("a0/f0.txt", "last"), ("none.txt", None)], "file string, text string")
    out = tmp_path / "out"
    assert sinks.write_texts(rows, str(out)) == 201
    assert sorted(p.name for p in out.iterdir()) == [*(f"a{i}" for i in range(7)), "none.txt"]
    assert all((out / f"a{i % 7}/f{i}.txt").read_text() == f"text {i}\n" * (i % 50) for i in range(1, 200)) and (out / "a0/f0.txt").read_text() == "last"
    bad = rows.withColumn("text", F.when(F.col("file") == "a3/f73.txt", F.raise_error(F.lit("torn"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="torn"):
        sinks.write_texts(bad, str(tmp_path / "bad"))
    assert not (tmp_path / "bad").exists() or not os.listdir(tmp_path / "bad")
    assert sinks.write_texts(rows, str(out)) == 201  # files that are there are replaced


def test_lines_are_counted_while_they_are_written(spark, tmp_path):
    rows = spark.range(1000, numPartitions=5).select(F.when(F.col("id") % 10 == 0, "val").otherwise("train").alias("part"), F.concat(F.lit("key k"), "id", F.lit(" key")).alias("value"))
    out = tmp_path / "sft"
    assert sinks.write_counted(rows, str(out), ("train", "val"), {"k": "key", "none": "nothing"}) == ({"train": 900, "val": 100}, {"k": 2000})
    assert sorted(p.name for p in out.iterdir() if not p.name.startswith(".")) == ["train.jsonl", "val.jsonl"] and spark.read.text(f"{out}/val.jsonl").count() == 100
    assert sinks.write_counted(rows.where("part = 'train'"), str(out), ("train", "val"), {}) == ({"train": 900}, {})
    assert not (out / "val.jsonl").exists() and spark.read.text(f"{out}/train.jsonl").count() == 900
    assert sinks.write_counted(rows.limit(0), str(tmp_path / "none"), ("train", "val"), {"k": "key"}) == ({}, {}) and not (tmp_path / "none").exists()


def test_filters_of_small_files_cost_what_they_hold():
    import tracemalloc

    lines = [f"line {i} of a Small file".encode() for i in range(300)]
    tracemalloc.start()
    few = kept._trigrams(iter(lines))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1 << 21  # a table of all trigrams takes 16 MB
    assert few.tolist() == kept._trigrams(iter(lines), few=100).tolist() == sorted(set(kept._codes(b"\n".join(lines)).tolist()))
    assert kept._filter(few) == kept._filter(kept._trigrams(iter(lines), few=1000))
