"""Listing with links, empty and unreadable entries; sessions and backups that use it."""

import json
import os

import pytest

from convoforge.plans import backup, sinks
from convoforge.sources import listing, transcripts


@pytest.fixture()
def tree(tmp_path):
    at = tmp_path / "root" / "p" / "agent-transcripts"
    for name in ("a", "b"):
        (at / name).mkdir(parents=True)
    line = json.dumps({"role": "user", "message": {"content": [{"type": "text", "text": "<user_query>hi</user_query>"}]}})
    (at / "a" / "a.jsonl").write_text(line + "\n")
    (at / "b" / "b.jsonl").write_text("")
    outside = tmp_path / "outside"
    (outside / "x").mkdir(parents=True)
    (outside / "x" / "x.jsonl").write_text(line + "\n")
    (at / "in.jsonl").symlink_to(at / "a" / "a.jsonl")
    (at / "out.jsonl").symlink_to(outside / "x" / "x.jsonl")
    (at / "gone.jsonl").symlink_to(tmp_path / "nowhere")
    (at / "x").symlink_to(outside / "x")
    return tmp_path


@pytest.mark.parametrize("few", [32, 1])
def test_links_are_told_and_not_followed(spark, tree, monkeypatch, few):
    monkeypatch.setattr(listing, "FEW_FOLDERS", few)
    root = str(tree / "root")
    listed = listing.walk(spark, root)
    got = {r["path"].removeprefix(root + "/p/agent-transcripts/"): (r["kind"], r["size_bytes"]) for r in listed.collect()}
    assert {k for k, v in got.items() if v[0] == "link"} == {"in.jsonl", "out.jsonl", "gone.jsonl", "x"}
    assert got["b/b.jsonl"] == ("file", 0) and got["a/a.jsonl"][0] == "file" and "x/x.jsonl" not in got
    assert len(got) == 4 + 2 + 2 + 2  # links, files, folders here, folders above
    said = listing.warnings(listed)
    assert len(said) == 1 and said[0].startswith("4 symbolic links were skipped") and "gone.jsonl" in said[0]
    found = {r["id"]: r["size_bytes"] for r in transcripts.read_sessions(spark, root).collect()}
    assert set(found) == {"a", "b"} and found["b"] == 0
    assert transcripts.read_sessions(spark, str(tree / "none")).count() == 0


def test_many_folders_are_listed_by_tasks(spark, tmp_path):
    for i in range(90):
        (tmp_path / f"p{i}" / "agent-transcripts" / "s").mkdir(parents=True)
        (tmp_path / f"p{i}" / "agent-transcripts" / "s" / "s.jsonl").write_text("x" * i)
    rows = listing.files(spark, str(tmp_path), ".jsonl").collect()
    assert sorted(r["size_bytes"] for r in rows) == list(range(90)) and all(os.stat(r["path"]).st_size == r["size_bytes"] for r in rows)


def test_paths_are_contained_once_links_are_followed(spark, tree):
    root = str(tree / "root")
    (tree / "alias").symlink_to(tree / "root")
    assert listing.inside(spark, str(tree / "alias" / "new" / "deeper"), root) and listing.inside(spark, root, root)
    assert not listing.inside(spark, str(tree / "root2"), root) and not listing.inside(spark, f"{root}/p/agent-transcripts/x/x.jsonl", root)
    with pytest.raises(ValueError, match="inside"):
        sinks.guard(spark, str(tree / "alias" / "out"), [root], "m")
    everyone = transcripts.session_files(spark, root)
    path = f"{root}/p/agent-transcripts/a/a.jsonl"
    assert transcripts.session_at(spark, everyone, path, root).count() == 1
    assert transcripts.session_at(spark, everyone, f"{root}/p/agent-transcripts/x/x.jsonl", root).count() == 0
    fields = transcripts.session_json(everyone.drop("uri")).where("path like '%a.jsonl'").first()
    assert len(fields) == 7 and fields["path"] == path


def test_empty_sessions_are_backed_up_and_links_warned_of(spark, tree):
    out = str(tree / "b")
    done = backup.backup(spark, str(tree / "root"), out)
    assert done.copied == 2 and any("4 symbolic links" in w for w in done.warnings)
    assert os.path.getsize(f"{out}/projects/p/agent-transcripts/b/b.jsonl") == 0
    assert not os.path.lexists(f"{out}/projects/p/agent-transcripts/x")
    assert backup.verify(spark, out).where("status <> 'ok'").count() == 0
    again = backup.backup(spark, str(tree / "root"), out)
    assert again.copied == 0 and again.unchanged == 2


def test_sources_are_resolved_by_the_marker(spark, tree):
    out = str(tree / "b")
    backup.backup(spark, str(tree / "root"), out)
    assert backup.resolve(spark, out) == f"{out}/projects"
    os.remove(f"{out}/{backup.MARKER}")
    assert backup.resolve(spark, out) == out  # a folder that only looks like a backup is a plain one
    with pytest.raises(LookupError):
        backup.resolve(spark, out, plain=False)
