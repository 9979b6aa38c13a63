"""Command line: export, find, search, index, backup, verify, restore."""

from __future__ import annotations

import argparse
import sys
from dataclasses import asdict

from pyspark.sql import SparkSession

from .operators import finder, parse, sessions
from .plans import backup, export, kept
from .plans.options import PRESETS, from_mapping
from .sources import transcripts


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="convoforge", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)
    e = commands.add_parser("export", help="write training datasets")
    e.add_argument("root"), e.add_argument("out")
    e.add_argument("--preset", choices=[*PRESETS], default="chat")
    e.add_argument("--project"), e.add_argument("--thinking"), e.add_argument("--val-fraction", type=float), e.add_argument("--min-turns", type=int), e.add_argument("--max-record-chars", type=int)
    for flag in ("redact-secrets", "include-tool-calls", "final-response-only", "include-subagents"):
        e.add_argument(f"--{flag}", action="store_true", default=None)
    f = commands.add_parser("find", help="search messages")
    f.add_argument("root"), f.add_argument("query", nargs="?", default=""), f.add_argument("--project"), f.add_argument("--media", action="append", default=[]), f.add_argument("--tool", action="append", default=[])
    q = commands.add_parser("search", help="look for words in raw lines; stops at the first 500 hits")
    q.add_argument("root"), q.add_argument("query"), q.add_argument("--index", help="a folder written by the index command")
    i = commands.add_parser("index", help="write or renew a kept index")
    i.add_argument("root"), i.add_argument("folder")
    b = commands.add_parser("backup", help="copy what is new or changed")
    b.add_argument("root"), b.add_argument("out"), b.add_argument("--project", action="append"), b.add_argument("--skip-runtime", action="store_true"), b.add_argument("--no-hashes", action="store_true")
    v = commands.add_parser("verify", help="check a backup against its manifest")
    v.add_argument("out")
    r = commands.add_parser("restore", help="bring back what is missing or differs")
    r.add_argument("out"), r.add_argument("target"), r.add_argument("--project", action="append"), r.add_argument("--dry-run", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("convoforge").getOrCreate()
    try:
        if a.command == "export":
            given = {k: v for k, v in vars(a).items() if v is not None}
            if given.pop("include_subagents", False):
                given["subagent_mode"] = "separate"
            print(asdict(export.export(spark, a.root, a.out, from_mapping(given, PRESETS[a.preset]), a.project)))
        elif a.command == "find":
            files = transcripts.session_files(spark, backup.resolve(spark, a.root))
            numbered = transcripts.numbered_lines(files)
            messages = parse.messages(parse.records(numbered))
            index = finder.index(messages, sessions.with_titles(files.drop("uri"), messages))
            finder.page(finder.find(index, numbered, a.query, a.project, a.media, a.tool), sessions.projects(files)).select("path", "line_index", "snippet").show(50, False)
        elif a.command == "search":
            files = transcripts.session_files(spark, backup.resolve(spark, a.root))
            found = kept.search(kept.opened(spark, a.index), a.query) if a.index else finder.search_files(files, a.query)
            found.hits.orderBy("path", "line_index").show(50, False)
            print(f"{found.files_scanned} files scanned")
        elif a.command == "index":
            print(asdict(kept.index_root(spark, backup.resolve(spark, a.root), a.folder)))
        elif a.command == "backup":
            print(asdict(backup.backup(spark, a.root, a.out, a.project, a.skip_runtime, not a.no_hashes)))
        elif a.command == "verify":
            from .operators.integrity import verdict

            row = verdict(backup.verify(spark, a.out)).first()
            print(row.asDict())
            return 0 if row["intact"] else 1
        else:
            backup.restore(spark, a.out, a.target, a.project, a.dry_run).groupBy("action").count().show()
    except (LookupError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
