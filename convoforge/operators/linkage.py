"""Delegated runs: which child transcript answers which Task call.

Calls are taken in document order; each takes the first unused child whose first query equals its prompt, else the first
unused one whose first query contains it. A call left over that some used child was asked as well is a resume. The
matching is one fold per parent, over rows that stream by in order: prompts and numbers of children are held, never the
texts of children, and no pair of a call and a child is formed that doesn't match.

Defined results: an empty prompt never matches; a call or child without a counterpart stays; of calls that share a
prompt the last one speaks for all of them in ``by_hash``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .parse import string_at, tool_calls

if TYPE_CHECKING:
    import pyarrow as pa

TASK = "Task"


def tasks(messages: DataFrame) -> DataFrame:
    """Task calls with spawn_order (from 0 in each path)."""
    calls = tool_calls(messages.where("role = 'assistant'")).where(F.col("tool_name") == TASK).withColumn("_v", F.try_parse_json("tool_input"))
    at = lambda name: F.coalesce(string_at(F.col("_v"), f"$.{name}"), F.lit(""))
    background = T.let(F.try_variant_get("_v", "$.run_in_background", "variant"), lambda x: F.when(F.schema_of_variant(x) == "BOOLEAN", F.try_variant_get(x, "$", "boolean")))
    order = F.row_number().over(Window.partitionBy("path").orderBy("line_index", "block_pos")) - 1
    rows = calls.select(
        "path", order.cast("long").alias("spawn_order"), at("subagent_type").alias("subagent_type"), at("description").alias("description"),
        T.collapse(at("prompt")).alias("prompt"), T.prompt_hash(at("prompt")).alias("prompt_hash"), F.coalesce(background, F.lit(False)).alias("background"),
    )
    return rows.withColumnRenamed("path", "master_path")


def children(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """(master_path, path, first_query, all_user, answer) of child sessions; ``sessions`` has path and parent_path."""
    subs = sessions.where("parent_path is not null").select("path", F.col("parent_path").alias("master_path"))
    asked, spoken = F.col("user_query").isNotNull(), (F.col("role") == "assistant") & ~T.is_blank("full_text")
    told = messages.join(subs.select("path"), "path", "left_semi").groupBy("path").agg(
        F.array_sort(F.collect_list(F.when(asked, F.struct("line_index", "user_query")))).alias("q"),
        F.max_by(F.when(spoken, F.col("full_text")), F.when(spoken, F.col("line_index"))).alias("answer"),
    )
    queries = F.transform("q", lambda x: x["user_query"])
    told = told.select("path", T.collapse(F.try_element_at(queries, F.lit(1))).alias("first_query"), T.collapse(F.array_join(queries, " \x1f")).alias("all_user"), "answer")
    blank = F.lit("")
    return subs.join(told, "path", "left").select("master_path", "path", F.coalesce("first_query", blank).alias("first_query"), F.coalesce("all_user", blank).alias("all_user"), "answer")


class Fold:
    """The calls and children of one parent, met one after the other: prompts, then first queries, then all that users said.

    Of calls only distinct prompts are held, of children their paths; their texts pass through an automaton of the
    prompts, which tells what each contains. What is kept of that are numbers of children.
    """

    def __init__(self) -> None:
        self.prompts: dict[str, int] = {}
        self.calls: list[tuple[int, int]] = []  # spawn_order, number of the prompt (-1: empty)
        self.paths: list[str] = []
        self.equal: dict[int, list[int]] = {}
        self.inside: dict[int, list[int]] = {}
        self.match: list[str] = []
        self.child: list[int] = []
        self.used: set[int] = set()
        self.again: dict[int, int] = {}
        self.automaton = self.pending = None

    def call(self, order: int, prompt: str) -> None:
        self.calls.append((order, self.prompts.setdefault(prompt, len(self.prompts)) if prompt else -1))

    def kid(self, path: str, query: str) -> None:
        if self.automaton is None:
            self.automaton = _automaton(self.prompts)
        n = len(self.paths)
        self.paths.append(path)
        for p in _held(self.automaton, query):
            self.inside.setdefault(p, []).append(n)
        if query in self.prompts:
            self.equal.setdefault(self.prompts[query], []).append(n)

    def settle(self) -> None:
        """Calls in order, each to the first unused child. Lists are walked once: what is used stays used."""
        at = {"exact": dict.fromkeys(self.equal, 0), "substring": dict.fromkeys(self.inside, 0)}
        for _, p in self.calls:
            said, who = "none", -1
            for name, lists in (("exact", self.equal), ("substring", self.inside)):
                own, i = lists.get(p, []), at[name].get(p, 0)
                while i < len(own) and own[i] in self.used:
                    i += 1
                if p in at[name]:
                    at[name][p] = i
                if i < len(own):
                    said, who = name, own[i]
                    self.used.add(who)
                    break
            self.match.append(said)
            self.child.append(who)
        left = {p for (_, p), m in zip(self.calls, self.match, strict=True) if m == "none" and p >= 0}
        self.pending = _automaton({t: n for t, n in self.prompts.items() if n in left})

    def heard(self, n: int, said: str) -> None:
        """All that users said in child ``n``; children come in their order."""
        if n in self.used:
            for p in _held(self.pending, said):
                self.again.setdefault(p, n)

    def links(self) -> Iterator[tuple[int, str, str | None]]:
        if len(self.match) < len(self.calls):
            self.settle()
        for (order, p), match, child in zip(self.calls, self.match, self.child, strict=True):
            if match == "none" and p in self.again:
                match, child = "resume", self.again[p]
            yield order, match, self.paths[child] if child >= 0 else None


def _automaton(prompts: dict[str, int]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for text, n in prompts.items():
        out.add_word(text, n)
    out.make_automaton()
    return out


def _held(automaton, text: str) -> set[int]:
    """The numbers of the prompts that a text contains."""
    return {n for _, n in automaton.iter(text)} if len(automaton) and text else set()


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each parent in order: calls, children with their first query, children with all that users said."""
    import pyarrow as pa

    def told(parent: str, fold: Fold) -> Iterator[pa.RecordBatch]:
        rows = list(fold.links())
        for i in range(0, len(rows), 10_000):
            order, match, child = zip(*rows[i : i + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([parent] * len(order)), pa.array(order, pa.int64()), pa.array(match), pa.array(child, pa.string())], ["master_path", "spawn_order", "match", "child_path"])

    parent, fold, n = None, Fold(), 0
    for b in batches:
        for own, kind, order, path, text in zip(*(b[c].to_pylist() for c in ("master_path", "kind", "spawn_order", "path", "text")), strict=True):
            if own != parent:
                yield from told(parent, fold)
                parent, fold, n = own, Fold(), 0
            if kind == 0:
                fold.call(order, text)
            elif not fold.calls:  # a parent that never asked
                continue
            elif kind == 1:
                fold.kid(path, text)
            else:
                if fold.pending is None:
                    fold.settle()
                fold.heard(n, text)
                n += 1
    yield from told(parent, fold)


def link(tasks: DataFrame, children: DataFrame) -> DataFrame:
    """One row per call: match (exact, substring, resume, none), child_path and, for foreground calls, result.

    Parents pass through tasks in order, their calls before their children; answers join the links afterwards.
    """
    order, none = F.col("spawn_order").cast("long"), F.lit(None)
    calls = tasks.select("master_path", F.lit(0).alias("kind"), order.alias("spawn_order"), none.cast("string").alias("path"), F.coalesce("prompt", F.lit("")).alias("text"))
    kids = [children.select("master_path", F.lit(k).alias("kind"), none.cast("long").alias("spawn_order"), "path", F.coalesce(c, F.lit("")).alias("text")) for k, c in ((1, "first_query"), (2, "all_user"))]
    rows = calls.unionAll(kids[0]).unionAll(kids[1]).repartition("master_path").sortWithinPartitions("master_path", "kind", "spawn_order", "path")
    links = rows.mapInArrow(_folded, "master_path string, spawn_order long, match string, child_path string")
    answers = children.select(F.col("path").alias("child_path"), "master_path", "answer")
    told = tasks.select("master_path", order.alias("spawn_order"), "subagent_type", "description", "prompt_hash", "background").join(links, ["master_path", "spawn_order"])
    told = told.join(answers, ["master_path", "child_path"], "left")
    result = F.when(~F.col("background") & F.col("match").isin("exact", "substring"), F.col("answer"))
    return told.select("master_path", "spawn_order", "subagent_type", "description", "prompt_hash", "background", "match", "child_path", result.alias("result"))


def by_hash(links: DataFrame) -> DataFrame:
    """(path, links): per parent a map from prompt hash to what rendering needs of the last call with that prompt."""
    last = links.groupBy("master_path", "prompt_hash").agg(F.max_by(F.struct("background", "match", "result"), "spawn_order").alias("last"))
    return last.groupBy(F.col("master_path").alias("path")).agg(F.map_from_entries(F.collect_list(F.struct("prompt_hash", "last"))).alias("links"))


def per_session(links: DataFrame) -> DataFrame:
    """(path, task_calls, unmatched): the metadata of a parent's calls."""
    call = F.struct(
        F.col("background"), F.col("child_path").alias("child_transcript"), F.col("description"), F.col("match"), F.col("spawn_order"),
        F.col("subagent_type"), F.col("prompt_hash").alias("task_prompt_hash"),
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("spawn_order", call.alias("call")))), lambda x: x["call"])
    return links.groupBy(F.col("master_path").alias("path")).agg(ordered.alias("task_calls"), F.count_if(F.col("match") == "none").alias("unmatched"))
