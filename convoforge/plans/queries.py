"""One query per operator, over whole tables, and the same in plain SQL for another engine to check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..operators import finder, integrity, linkage, media, parse, records, render, sessions, turns
from ..sources import splits, transcripts
from ..sources.scratch import shared_folder
from . import kept, sinks
from .export import chunks_of
from .fixtures import WITH, views
from .options import ExportOptions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        name = f"q_{f.__name__}"
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep


# Pieces of SQL.


def _any(x: str, phrases, how: str = "starts_with") -> str:
    return "(" + " OR ".join(f"{how}({x}, '{p.replace(chr(39), chr(39) * 2)}')" for p in phrases) + ")"


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _squash(x: str) -> str:
    return _trim(rf"regexp_replace({x}, '\s+', ' ', 'g')")


def _plain(x: str) -> str:
    return f"translate({x}, '’‘ʼ', '''''''')"


def _structured(x: str) -> str:
    return rf"(contains({x}, '```') OR regexp_matches({x}, '(?m)^[ \t]*(- |\* |\| |#|[0-9]\. )'))"


def _planning(x: str) -> str:
    """Whether trimmed text x is deliberation."""
    p = _plain(x)
    marks = " + ".join(f"CAST(contains({p}, '{m.replace(chr(39), chr(39) * 2)}') AS INT)" for m in L.MARKERS)
    return f"(strlen({x}) >= 40 AND NOT {_structured(x)} AND ({marks} >= 2 OR starts_with({p}, 'I ') OR starts_with({p}, 'I''') OR (starts_with({p}, 'The user') AND {_any(p, L.PLANNING, 'contains')})))"


def _opening(x: str) -> str:
    """Whether trimmed text x is deliberation without a header."""
    p = _plain(x)
    strong = f"(strlen({x}) >= 60 OR (NOT contains({x}, chr(10)) AND strlen({x}) >= 10))"
    return (
        f"(NOT {_structured(x)} AND NOT starts_with({p}, 'Let me know') AND CASE WHEN {_any(p, L.STRONG_OPENERS)} THEN {strong} "
        f"WHEN strlen({x}) < 60 THEN false ELSE {_any(p, L.WEAK_OPENERS)} AND {_planning(x)} END)"
    )


_MSG = (
    WITH + r""", asked AS (
  SELECT *, CASE WHEN role = 'user' THEN nullif(""" + _trim(r"regexp_extract(body, '<user_query>((?s:.*?))</user_query>', 1)") + r""", '') END AS user_query
  FROM messages WHERE role IN ('user', 'assistant')
), msg AS (
  SELECT *, role = 'user' AND (user_query IS NULL OR """ + _any("user_query", L.INJECTED_PREFIXES) + """) AS is_injected FROM asked
)"""
)
_TURN = _MSG + """, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY path ORDER BY line_index) AS rn FROM msg
), walk AS (
  SELECT path, line_index, rn, CAST(0 AS BIGINT) AS turn_id, role = 'assistant' AS spoke FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.path, n.line_index, n.rn, w.turn_id + CASE WHEN n.role = 'user' AND NOT n.is_injected AND w.spoke THEN 1 ELSE 0 END,
    n.role = 'assistant' OR (w.spoke AND (n.role = 'assistant' OR n.is_injected))
  FROM walk w JOIN numbered n ON n.path = w.path AND n.rn = w.rn + 1
), turned AS (SELECT m.*, w.turn_id FROM msg m JOIN walk w ON m.path = w.path AND m.line_index = w.line_index)"""
_LINKS_OFF = r"regexp_replace({x}, '\[([^\]]+)\]\([0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}\)', '\1', 'g')"
_HEADER = r"'^\*\*[A-Z][^*\n]{2,70}\*\*$'"
#: Paragraphs of texts(k, x), marked as narration or not; the texts hold no header glued to another line.
_SPLIT = """, paras AS (
  SELECT k, unnest(string_split(x, chr(10) || chr(10))) AS p, generate_subscripts(string_split(x, chr(10) || chr(10)), 1) AS pos FROM texts
), looked AS (
  SELECT *, regexp_matches(""" + _trim("string_split(p, chr(10))[1]") + f""", {_HEADER}) AS head, array_to_string(string_split(p, chr(10))[2:], ' ') AS rest FROM paras
), judged AS (
  SELECT *, head AND """ + _trim("rest") + """ = '' AS bare, """ + _trim("p") + """ AS t, """ + _trim("rest") + """ AS r FROM looked
), flagged AS (
  SELECT *, CASE WHEN head THEN NOT bare AND """ + _planning("r") + " ELSE " + _opening("t") + """ END AS own, NOT head AND """ + _planning("t") + """ AS plan FROM judged
), marked AS (
  SELECT *, own OR (bare AND coalesce(lead(plan) OVER (PARTITION BY k ORDER BY pos), false)) OR (plan AND coalesce(lag(bare) OVER (PARTITION BY k ORDER BY pos), false)) AS think FROM flagged
), split AS (
  SELECT k, """ + _trim("coalesce(string_agg(t, chr(10) || chr(10) ORDER BY pos) FILTER (think AND t <> ''), '')") + """ AS thinking,
    """ + _trim("coalesce(string_agg(p, chr(10) || chr(10) ORDER BY pos) FILTER (NOT think), '')") + """ AS answer FROM marked GROUP BY k
)"""  # fmt: skip


def _cut(source: str, name: str) -> str:
    """One round of cutting the last sentence of (k, x) if it only announces."""
    said = _any(_plain("last"), L.INTENTS, "contains")
    return rf""", {name} AS (
  SELECT k, CASE WHEN strlen(last) < 300 AND NOT contains(last, chr(10)) AND regexp_matches(last, '[.!…]$') AND {said} AND NOT ends_with(r, '`') THEN substr(r, 1, length(r) - length(last)) ELSE r END AS x
  FROM (SELECT k, r, regexp_extract(r, '^(?s:.*\n\n)?(?s:.*[.!?][ \t\n\r\f])?((?s:.*))$', 1) AS last FROM (SELECT k, regexp_replace(x, '\s+$', '') AS r FROM {source}))
)"""


def _cuts(source: str) -> str:
    out = "".join(_cut(a, b) for a, b in zip([source, "cut1", "cut2", "cut3"], ["cut1", "cut2", "cut3", "cut4"], strict=True))
    return out + r", cut AS (SELECT k, regexp_replace(x, '\s+$', '') AS x FROM cut4)"


# Inputs.


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views(spark, sf_dir)["lines"]


def _messages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = views(spark, sf_dir)
    return parse.messages(parse.records(v["lines"])), v["sessions"].drop("conv_id")


def _decorated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views(spark, sf_dir)["messages"]


# Export.

_DIRECT = ExportOptions(subagent_mode="separate", max_record_chars=2_000)
_RENDERED = _TURN + """, texts AS (
  SELECT path || '|' || CAST(line_index AS VARCHAR) AS k, """ + _trim(_LINKS_OFF.format(x="body")) + """ AS x FROM turned WHERE role = 'assistant'
)""" + _SPLIT + """, said AS (
  SELECT t.path, t.turn_id, string_agg(s.thinking, chr(10) || chr(10) ORDER BY line_index) FILTER (s.thinking <> '') AS thinking,
    string_agg(s.answer, chr(10) || chr(10) ORDER BY line_index) FILTER (s.answer <> '') AS answer, string_agg(x.x, chr(10) || chr(10) ORDER BY line_index) FILTER (x.x <> '') AS native
  FROM turned t JOIN split s ON s.k = t.path || '|' || CAST(line_index AS VARCHAR) JOIN texts x ON x.k = s.k GROUP BY ALL
), whole AS (SELECT path || '|' || CAST(turn_id AS VARCHAR) AS k, coalesce(answer, '') AS x FROM said)""" + _cuts("whole") + """, heard AS (
  SELECT path, turn_id, coalesce(string_agg(q, chr(10) || chr(10) ORDER BY line_index) FILTER (q <> ''), '') AS u
  FROM (SELECT path, turn_id, line_index, CASE WHEN role = 'user' AND NOT is_injected THEN """ + _trim(_LINKS_OFF.format(x="user_query")) + """ END AS q FROM turned) GROUP BY ALL
), rendered AS (
  SELECT h.path, h.turn_id, h.u AS user_text, coalesce(s.thinking, '') AS thinking, coalesce(""" + _trim("c.x") + """, '') AS answer, coalesce(s.native, '') AS native
  FROM heard h LEFT JOIN said s ON s.path = h.path AND s.turn_id = h.turn_id LEFT JOIN cut c ON c.k = h.path || '|' || CAST(h.turn_id AS VARCHAR)
)"""  # fmt: skip
_CHUNKED = _RENDERED + """, chosen AS (
  SELECT * FROM sessions WHERE NOT is_subagent OR id NOT IN (SELECT id FROM sessions WHERE NOT is_subagent)
), good AS (
  SELECT r.*, strlen(user_text) + strlen(thinking) + greatest(strlen(answer), strlen(native)) AS size, row_number() OVER (PARTITION BY r.path ORDER BY turn_id) AS rn
  FROM rendered r JOIN chosen USING (path) WHERE """ + _trim("user_text") + """ <> '' AND answer <> ''
), pack AS (
  SELECT path, turn_id, rn, CAST(0 AS BIGINT) AS chunk, size AS filled FROM good WHERE rn = 1
  UNION ALL
  SELECT g.path, g.turn_id, g.rn, p.chunk + CASE WHEN p.filled + g.size > 2000 THEN 1 ELSE 0 END, CASE WHEN p.filled + g.size > 2000 THEN g.size ELSE p.filled + g.size END
  FROM pack p JOIN good g ON g.path = p.path AND g.rn = p.rn + 1
), chunked AS (SELECT g.*, p.chunk, max(p.chunk) OVER (PARTITION BY g.path) + 1 AS chunks FROM good g JOIN pack p ON p.path = g.path AND p.rn = g.rn)"""
_TAGGED = """CASE WHEN thinking = '' THEN answer ELSE '<think>' || chr(10) || thinking || chr(10) || '</think>' || chr(10) || chr(10) || answer END"""
_META = """',"metadata":' || to_json({{'answer_chars': CAST(sum(strlen(answer)) AS BIGINT), 'chunk': chunk, 'chunks': chunks, 'is_subagent': is_subagent{kind}, 'modified_unix': modified_unix{over}, 'parent_session_id': parent_id,
  'project': project_slug, 'session_id': id, 'source': 'agent-transcript', 'think_chars': CAST(sum(strlen(thinking)) AS BIGINT), 'turns': count(*){user}}}) || '}}'"""


def _meta(kind: str) -> str:
    parts = {"kind": ", 'kind': 'session'" if kind == "cpt" else "", "user": "" if kind == "cpt" else ", 'user_kind': CASE WHEN is_subagent THEN 'agent_brief' ELSE 'human' END"}
    return f"CASE WHEN sum(size) > 2000 THEN {_META.format(over=chr(44) + chr(32) + chr(39) + 'oversize' + chr(39) + ': true', **parts)} ELSE {_META.format(over='', **parts)} END"


def _sft_sql(key: str, ask: str, say: str) -> str:
    pairs = f"to_json(flatten(list([{ask}, {say}] ORDER BY turn_id)))"
    return _CHUNKED + f"""
SELECT path, chunk, chunks, '{{"{key}":' || {pairs} || {_meta("sft")} AS record FROM chunked JOIN sessions USING (path) GROUP BY path, chunk, chunks, is_subagent, modified_unix, parent_id, project_slug, id"""


def _chunks(spark: SparkSession, sf_dir: str, o: ExportOptions) -> DataFrame:
    messages, everyone = _messages(spark, sf_dir)
    return chunks_of(messages, sessions.select(everyone, o.with_subagents), everyone, o)


@query(_sft_sql("messages", "{'content': user_text, 'role': 'user'}", f"{{'content': {_TAGGED}, 'role': 'assistant'}}"))
def k5_chatml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir, _DIRECT).select("path", "chunk", "chunks", records.chatml(_DIRECT).alias("record"))


@query(_sft_sql("conversations", "{'from': 'human', 'value': user_text}", f"{{'from': 'gpt', 'value': {_TAGGED}}}"))
def k6_sharegpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir, _DIRECT).select("path", "chunk", "chunks", records.sharegpt(_DIRECT).alias("record"))


_DIALOGUE = """CASE WHEN is_subagent THEN '# Subagent transcript (spawned by session ' || substr(parent_id, 1, 8) || ')' || chr(10) || chr(10) ELSE '' END
  || string_agg('## User' || chr(10) || chr(10) || user_text || chr(10) || chr(10) || '## Assistant' || chr(10) || chr(10) || native, chr(10) || chr(10) ORDER BY turn_id)"""


@query(_CHUNKED + f"""
SELECT path, chunk, {_DIALOGUE} AS dialogue, '{{"metadata":' || substr({_meta("cpt")}, 13, length({_meta("cpt")}) - 13) || ',"text":' || to_json({_DIALOGUE}) || '}}' AS record
FROM chunked JOIN sessions USING (path) GROUP BY path, chunk, chunks, is_subagent, modified_unix, parent_id, project_slug, id""")
def k7_k10_cpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.cpt_records(_chunks(spark, sf_dir, _DIRECT), _DIRECT).select("path", "chunk", "dialogue", "record")


@query(_RENDERED + " SELECT path, turn_id, user_text, thinking, answer, native FROM rendered")
def k1_k2_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages, _ = _messages(spark, sf_dir)
    return render.render(turns.segment(messages), None, _DIRECT).withColumnRenamed("user", "user_text")


@query(_RENDERED + f"""
SELECT path, turn_id, answer AS strip, native AS verbatim, {_TAGGED} AS tagged, CASE WHEN false THEN '' ELSE native END AS corpus FROM rendered WHERE {_trim("user_text")} <> '' AND answer <> ''""")
def k3_k4_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages, _ = _messages(spark, sf_dir)
    good = render.trainable(render.render(turns.segment(messages), None, _DIRECT))
    said = lambda mode: render.sft_assistant("thinking", "answer", "native", mode).alias(mode)
    return good.select("path", "turn_id", said("strip"), said("verbatim"), said("tagged"), render.cpt_assistant("answer", "native", "tagged").alias("corpus"))


@query(_CHUNKED + """, dated AS (SELECT path, row_number() OVER (ORDER BY modified_unix, path) AS rn, count(*) OVER () AS n FROM sessions WHERE path IN (SELECT path FROM chunked)),
held AS (SELECT path, CASE WHEN rn > n - CASE WHEN round(n * 0.25) >= n THEN n - 1 ELSE CAST(round(n * 0.25) AS BIGINT) END THEN 'val' ELSE 'train' END AS split FROM dated)
SELECT split, count(*) AS lines FROM (SELECT DISTINCT path, chunk FROM chunked) JOIN held USING (path) GROUP BY split""")
def a7_k14_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the written train and validation files, as counted while they were written."""
    o = ExportOptions(subagent_mode="separate", max_record_chars=2_000, val_fraction=0.25)
    rows = _chunks(spark, sf_dir, o).select(F.col("split").alias("part"), records.chatml(o).alias("value"))
    counts, _ = sinks.write_counted(rows, shared_folder(spark, "sft"), ("train", "val"), L.SECRET_FAMILIES)
    return spark.createDataFrame([*counts.items()], "split string, lines long")


@query(_CHUNKED + " SELECT path, chunk, max(chunks) AS chunks, count(*) AS turns, CAST(sum(size) AS BIGINT) AS size FROM chunked GROUP BY path, chunk")
def o4_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir, _DIRECT).select("path", "chunk", "chunks", F.size("turns").cast("long").alias("turns"), "size")


@query(_CHUNKED + " SELECT path, turn_id, size FROM good QUALIFY count(*) OVER (PARTITION BY path) >= 2")
def f7_f8_trainable(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages, everyone = _messages(spark, sf_dir)
    chosen = sessions.select(everyone, True).select("path")
    good = render.trainable(render.render(turns.segment(messages.join(chosen, "path", "left_semi")), None, _DIRECT))
    return records.enough_turns(good, 2).select("path", "turn_id", records.turn_size().cast("long").alias("size"))


@query(WITH + """, ranked AS (SELECT path, row_number() OVER (ORDER BY modified_unix, path) AS rn, count(*) OVER () AS n FROM sessions)
SELECT path, CASE WHEN rn > n - CASE WHEN round(n * 0.15) >= n THEN n - 1 ELSE CAST(round(n * 0.15) AS BIGINT) END THEN 'val' ELSE 'train' END AS split FROM ranked""")
def o3_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.split(views(spark, sf_dir)["sessions"], 0.15).select("path", "split")


@query(WITH + " SELECT path, id, is_subagent FROM sessions WHERE NOT is_subagent OR id NOT IN (SELECT id FROM sessions WHERE NOT is_subagent)")
def j2_u2_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = views(spark, sf_dir)["sessions"]
    return sessions.select(every.unionAll(every), True).select("path", "id", "is_subagent")


# Linkage.

_TASKS_SQL = _MSG + """, kids AS (SELECT s.path, s.parent_path, s.conv_id FROM sessions s WHERE is_subagent),
tasks AS (
  SELECT s.path AS master_path, o AS spawn_order, CASE WHEN o IN (0, 3) THEN 'Work on item #' || CAST(conv_id + 1 AS VARCHAR) || ';' WHEN o = 1 THEN 'work on item #' || CAST(conv_id + 2 AS VARCHAR) || ';' ELSE 'nobody was asked this' END AS prompt,
    o = 1 AND conv_id % 14 = 0 AS background, conv_id + 1 + o % 3 AS kid
  FROM sessions s, (SELECT unnest([0, 1, 2, 3]) AS o) WHERE conv_id % 7 = 0 AND s.path IN (SELECT path FROM messages WHERE role = 'assistant' AND line_index = 1)
), first AS (SELECT path, """ + _squash("arg_min(user_query, line_index)") + """ AS q FROM msg WHERE user_query IS NOT NULL GROUP BY path),
final AS (SELECT path, arg_max(""" + "body" + """, line_index) AS a FROM msg WHERE role = 'assistant' AND """ + _trim("body") + """ <> '' GROUP BY path),
linked AS (
  SELECT t.*, CASE WHEN spawn_order = 3 AND f.q = t.prompt THEN 'resume' WHEN f.q = t.prompt THEN 'exact' WHEN contains(f.q, t.prompt) THEN 'substring' ELSE 'none' END AS match, CASE WHEN contains(f.q, t.prompt) THEN k.path END AS child_path,
    CASE WHEN contains(f.q, t.prompt) AND NOT t.background AND spawn_order < 3 THEN a.a END AS result
  FROM tasks t LEFT JOIN kids k ON k.conv_id = t.kid AND k.parent_path = t.master_path LEFT JOIN first f ON f.path = k.path LEFT JOIN final a ON a.path = k.path
)"""  # fmt: skip


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages, everyone = _messages(spark, sf_dir)
    return linkage.link(linkage.tasks(messages), linkage.children(messages, everyone))


@query(_TASKS_SQL + " SELECT master_path, CAST(spawn_order AS BIGINT) AS spawn_order, substr(sha256(prompt), 1, 16) AS prompt_hash, background, coalesce(match, 'none') AS match, child_path, result FROM linked")
def j3_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linked(spark, sf_dir).select("master_path", "spawn_order", "prompt_hash", "background", "match", "child_path", "result")


@query(_TASKS_SQL + " SELECT master_path AS path, count(*) AS calls, count(*) FILTER (coalesce(match, 'none') = 'none') AS unmatched FROM linked GROUP BY 1")
def a10_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.per_session(_linked(spark, sf_dir)).select("path", F.size("task_calls").cast("long").alias("calls"), "unmatched")


@query(_TASKS_SQL + " SELECT master_path AS path, substr(sha256(prompt), 1, 16) AS prompt_hash, background, coalesce(match, 'none') AS match FROM linked QUALIFY row_number() OVER (PARTITION BY master_path, prompt ORDER BY spawn_order DESC) = 1")
def j4_w3_last_per_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.by_hash(_linked(spark, sf_dir)).select("path", F.explode("links").alias("prompt_hash", "x")).select("path", "prompt_hash", "x.background", "x.match")


_LIKELY = """{{"name": "Task", "status": "{0}"}}"""


#: Answers of child runs that are told, as texts to split.
_CHILD_TEXTS = "SELECT DISTINCT 'c' || child_path AS k, " + _LINKS_OFF.format(x="result") + " AS x FROM linked WHERE result IS NOT NULL"
#: What is said of the last call with each prompt, and each call with it.
_TOLD = f""", told AS (
  SELECT k, CASE WHEN answer = '' THEN {_trim("x")} ELSE answer END AS t FROM split JOIN texts USING (k)
), last AS (SELECT * FROM linked QUALIFY row_number() OVER (PARTITION BY master_path, prompt ORDER BY spawn_order DESC) = 1),
said AS (
  SELECT l.master_path, l.prompt, CASE WHEN background THEN '{_LIKELY.format("spawned_in_background")}' WHEN match = 'resume' THEN '{_LIKELY.format("resumed")}' WHEN result IS NULL THEN '{_LIKELY.format("unresolved")}'
    ELSE to_json({{'name': 'Task', 'output': CASE WHEN length(t) > {L.RESULT_CHARS} THEN left(t, {L.RESULT_CHARS}) || ' [truncated]' ELSE t END, 'status': 'completed'}}) END AS outcome
  FROM last l LEFT JOIN told ON told.k = 'c' || l.child_path
), blocks AS (
  SELECT master_path AS path, CAST(spawn_order AS BIGINT) AS block_pos, '```tool_call' || chr(10) || '{{"name": "Task", "input": {{"description":"part","prompt":"' || CASE WHEN spawn_order = 1 THEN replace(prompt, 'work on', 'work on ') ELSE prompt END
  || '","run_in_background":' || CASE WHEN background THEN 'true' ELSE 'false' END || ',"subagent_type":"general"}}}}' || chr(10) || '```' || chr(10) || chr(10) || '```tool_result' || chr(10) || outcome || chr(10) || '```' AS said
  FROM tasks JOIN said USING (master_path, prompt)
)"""


@query(_TASKS_SQL + f", texts AS ({_CHILD_TEXTS})" + _SPLIT + _TOLD + " SELECT path, block_pos, said FROM blocks")
def t23_k2_task_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every Task call as it stands in its parent's text."""
    messages, everyone = _messages(spark, sf_dir)
    by_hash = linkage.by_hash(linkage.link(linkage.tasks(messages), linkage.children(messages, everyone)))
    calls = messages.where("role = 'assistant'").select("path", "line_index", F.posexplode("blocks").alias("pos", "block")).where("block.tool_name = 'Task'")
    return calls.join(by_hash, "path").select("path", (F.col("pos") - 1).cast("long").alias("block_pos"), render.task_call(F.col("block"), F.col("links")).alias("said"))


@query(_TASKS_SQL + " SELECT master_path, CAST(spawn_order AS BIGINT) AS spawn_order, prompt, background FROM tasks")
def w2_spawn_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.tasks(_messages(spark, sf_dir)[0]).select("master_path", "spawn_order", "prompt", "background")


_MESSAGE_KEY = "'m' || path || '|' || CAST(line_index AS VARCHAR)"


@query(_TURN + _TASKS_SQL[len(_MSG):] + f""", heads AS (
  SELECT path, turn_id, max(line_index) AS line_index FROM turned WHERE role = 'assistant' GROUP BY ALL
), texts AS ({_CHILD_TEXTS}
  UNION ALL SELECT {_MESSAGE_KEY}, {_trim(_LINKS_OFF.format(x="body"))} FROM turned JOIN heads USING (path, turn_id, line_index)
)""" + _SPLIT + _TOLD + f""", tooled AS (
  SELECT path, string_agg(said, chr(10) || chr(10) ORDER BY block_pos) AS tools FROM blocks GROUP BY path
), spoken AS (
  SELECT h.path, h.turn_id, s.answer, CASE WHEN h.line_index = 1 THEN t.tools END AS tools FROM heads h JOIN split s ON s.k = {_MESSAGE_KEY.replace("path", "h.path").replace("line_index", "h.line_index")} LEFT JOIN tooled t ON t.path = h.path
), whole AS (SELECT path || '|' || CAST(turn_id AS VARCHAR) AS k, answer AS x FROM spoken WHERE tools IS NULL)""" + _cuts("whole") + f""", answered AS (
  SELECT path, turn_id, CASE WHEN tools IS NULL THEN {_trim("c.x")} WHEN answer = '' THEN tools ELSE answer || chr(10) || chr(10) || tools END AS a
  FROM spoken p LEFT JOIN cut c ON c.k = p.path || '|' || CAST(p.turn_id AS VARCHAR)
), heard AS (
  SELECT path, turn_id, coalesce(string_agg(q, chr(10) || chr(10) ORDER BY line_index) FILTER (q <> ''), '') AS u
  FROM (SELECT path, turn_id, line_index, CASE WHEN role = 'user' AND NOT is_injected THEN {_trim(_LINKS_OFF.format(x="user_query"))} END AS q FROM turned) GROUP BY ALL
)
SELECT any_value(project_slug) || '__' || any_value(id) || '.txt' AS file, string_agg('## User' || chr(10) || chr(10) || {_trim("u")} || chr(10) || chr(10) || '## Assistant' || chr(10) || chr(10) || {_trim("a")}, chr(10) || chr(10) ORDER BY turn_id) AS text
FROM heard JOIN answered USING (path, turn_id) JOIN sessions USING (path) WHERE NOT is_subagent AND {_trim("u")} <> '' AND {_trim("a")} <> '' GROUP BY path""")
def k9_dialogue_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = ExportOptions(max_record_chars=0, thinking="strip", final_response_only=True)
    rows = _chunks(spark, sf_dir, o)
    return rows.select(records.text_file_name("project_slug", "id").alias("file"), records.dialogue(o).alias("text"))


_PACK = _CHUNKED[_CHUNKED.index("pack AS (") :].replace("> 2000", f"> {L.CHUNK_BYTES}")
_CALLS = """list({'background': background, 'child_transcript': child_path, 'description': 'part', 'match': match, 'spawn_order': CAST(spawn_order AS BIGINT), 'subagent_type': 'general', 'task_prompt_hash': substr(sha256(prompt), 1, 16)} ORDER BY spawn_order)"""
_READ = """'```tool_call' || chr(10) || '{"name": "Read", "input": {"path":"/data/a.md"}}' || chr(10) || '```'"""


@query(_TURN + _TASKS_SQL[len(_MSG):] + f""", texts AS ({_CHILD_TEXTS}
  UNION ALL SELECT {_MESSAGE_KEY}, {_trim(_LINKS_OFF.format(x="body"))} FROM turned WHERE role = 'assistant'
)""" + _SPLIT + _TOLD + f""", tooled AS (
  SELECT path, CAST(1 AS BIGINT) AS line_index, string_agg(said, chr(10) || chr(10) ORDER BY block_pos) AS tools FROM blocks GROUP BY path
), spoken AS (
  SELECT t.path, t.turn_id, t.line_index, s.thinking, s.answer, coalesce(b.tools, CASE WHEN t.line_index % 3 = 0 THEN {_READ} END) AS tools
  FROM turned t JOIN split s ON s.k = {_MESSAGE_KEY.replace("path", "t.path").replace("line_index", "t.line_index")} LEFT JOIN tooled b ON b.path = t.path AND b.line_index = t.line_index WHERE t.role = 'assistant'
), joined AS (
  SELECT path, turn_id, coalesce(string_agg(thinking, chr(10) || chr(10) ORDER BY line_index) FILTER (thinking <> ''), '') AS thinking, bool_or(tools IS NOT NULL) AS has_tools,
    coalesce(string_agg(concat_ws(chr(10) || chr(10), nullif(answer, ''), tools), chr(10) || chr(10) ORDER BY line_index) FILTER (answer <> '' OR tools IS NOT NULL), '') AS a,
    coalesce(string_agg(concat_ws(chr(10) || chr(10), nullif(x, ''), tools), chr(10) || chr(10) ORDER BY line_index) FILTER (x <> '' OR tools IS NOT NULL), '') AS native
  FROM spoken JOIN texts ON k = {_MESSAGE_KEY} GROUP BY ALL
), whole AS (SELECT path || '|' || CAST(turn_id AS VARCHAR) AS k, a AS x FROM joined WHERE NOT has_tools)""" + _cuts("whole") + f""", heard AS (
  SELECT path, turn_id, coalesce(string_agg(q, chr(10) || chr(10) ORDER BY line_index) FILTER (q <> ''), '') AS u
  FROM (SELECT path, turn_id, line_index, CASE WHEN role = 'user' AND NOT is_injected THEN {_trim(_LINKS_OFF.format(x="user_query"))} END AS q FROM turned) GROUP BY ALL
), answered AS (
  SELECT j.path, turn_id, {_trim("u")} AS user_text, thinking, {_trim("CASE WHEN has_tools THEN a ELSE c.x END")} AS answer, native FROM joined j JOIN heard USING (path, turn_id) LEFT JOIN cut c ON c.k = j.path || '|' || CAST(turn_id AS VARCHAR)
), good AS (
  SELECT a.*, strlen(user_text) + strlen(thinking) + greatest(strlen(answer), strlen(native)) AS size, row_number() OVER (PARTITION BY path ORDER BY turn_id) AS rn
  FROM answered a JOIN sessions USING (path) WHERE NOT is_subagent AND user_text <> '' AND answer <> ''
), """ + _PACK + f""", dated AS (SELECT path, row_number() OVER (ORDER BY modified_unix, path) AS rn, count(*) OVER () AS n FROM sessions WHERE path IN (SELECT path FROM chunked)),
held AS (SELECT path, CASE WHEN rn > n - CASE WHEN round(n * 0.1) >= n THEN n - 1 ELSE CAST(round(n * 0.1) AS BIGINT) END THEN 'val' ELSE 'train' END AS split FROM dated),
calls AS (SELECT master_path AS path, {_CALLS} AS calls, count(*) FILTER (match = 'none') AS unmatched FROM linked GROUP BY 1)
SELECT path, chunk, any_value(h.split) AS split, '{{"messages":' || to_json(flatten(list([{{'content': user_text, 'role': 'user'}}, {{'content': {_TAGGED}, 'role': 'assistant'}}] ORDER BY turn_id))) || ',"metadata":'
  || regexp_replace(to_json({{'answer_chars': CAST(sum(strlen(answer)) AS BIGINT), 'chunk': chunk, 'chunks': any_value(chunks), 'is_subagent': false, 'modified_unix': any_value(modified_unix), 'oversize': sum(size) > {L.CHUNK_BYTES}, 'parent_session_id': NULL,
    'project': any_value(project_slug), 'session_id': any_value(id), 'source': 'agent-transcript', 'task_calls': CASE WHEN chunk = 0 THEN coalesce(any_value(calls), []) ELSE [] END, 'think_chars': CAST(sum(strlen(thinking)) AS BIGINT), 'turns': count(*),
    'unmatched_task_calls': CASE WHEN chunk = 0 THEN coalesce(any_value(unmatched), 0) ELSE 0 END, 'user_kind': 'human'}}), ',"oversize":false', '') || '}}' AS record
FROM chunked JOIN sessions USING (path) JOIN held h USING (path) LEFT JOIN calls USING (path) GROUP BY path, chunk""")
def k2_inline_chatml(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = ExportOptions(include_tool_calls=True, val_fraction=0.1)
    return _chunks(spark, sf_dir, o).select("path", "chunk", "split", records.chatml(o).alias("record"))


# Reading.

_PROJECT = "regexp_extract(path, '/t/(proj-[0-9]+)/', 1)"


@query(WITH + f""", whole AS (SELECT {_PROJECT} AS project, path, path || chr(9) || line_index || chr(9) || coalesce(line, '') AS line FROM lines)
SELECT project, row_number() OVER (PARTITION BY project ORDER BY line) - 1 AS line_index, line FROM whole""")
def s8_s9_split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of a project in one long file, read again in ranges of 4 KiB."""
    whole = F.concat_ws("\t", "path", F.col("line_index").cast("string"), F.coalesce("line", F.lit("")))
    rows = _lines(spark, sf_dir).select(F.expr(_PROJECT).alias("project"), whole.alias("line"))
    folder = shared_folder(spark, "project-lines")
    rows.repartition("project").sortWithinPartitions("project", "line").write.partitionBy("project").text(folder)
    files = transcripts.binary_files(spark, folder, "*.txt").select("path", F.col("path").alias("uri"), F.col("length").alias("size_bytes"))
    found = splits.lines(files, 4096)
    return found.select(F.regexp_extract("path", "/project=([^/]+)/", 1).alias("project"), "line_index", "line")


# Parsing.


@query(WITH + """ SELECT path, line_index, CASE WHEN trim(line) = '' THEN 'blank' WHEN NOT json_valid(line) THEN 'skipped' WHEN line ->> '$.type' = 'turn_ended' THEN 'marker'
  WHEN line ->> '$.role' IN ('user', 'assistant') THEN 'message' ELSE 'skipped' END AS kind, CASE WHEN json_valid(line) AND line ->> '$.type' = 'turn_ended' THEN line ->> '$.status' <> 'success' END AS errored FROM lines""")
def p1_p2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.records(_lines(spark, sf_dir)).select("path", "line_index", "kind", "errored")


@query(WITH + """, blocks AS (SELECT path, line_index, unnest(CAST(json_extract(line, '$.message.content[*]') AS JSON[])) AS b FROM lines WHERE json_valid(line) AND line ->> '$.role' IN ('user', 'assistant'))
SELECT path, line_index, b ->> '$.type' AS kind, b ->> '$.text' AS text, b ->> '$.name' AS tool_name FROM blocks""")
def p3_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _messages(spark, sf_dir)[0].select("path", "line_index", F.explode("blocks").alias("b"))
    return rows.select("path", "line_index", "b.kind", "b.text", "b.tool_name")


@query(_MSG + """ SELECT path, line_index, role, body AS full_text, user_query, is_injected, CASE WHEN role = 'user' THEN nullif(regexp_extract(body, '<timestamp>(.*?)</timestamp>', 1), '') END AS timestamp FROM msg""")
def p5_p8_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir)[0].select("path", "line_index", "role", "full_text", "user_query", "is_injected", "timestamp")


@query(WITH + """, k AS (SELECT path, CASE WHEN trim(line) = '' THEN 'blank' WHEN NOT json_valid(line) THEN 'skipped' WHEN line ->> '$.type' = 'turn_ended' THEN line ->> '$.status'
  WHEN line ->> '$.role' IN ('user', 'assistant') THEN 'message' ELSE 'skipped' END AS kind FROM lines)
SELECT path, count(*) FILTER (kind = 'message') AS messages, count(*) FILTER (kind = 'skipped') AS skipped_lines, count(*) FILTER (kind = 'error') AS errored_turns FROM k GROUP BY path""")
def p9_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.stats(parse.records(_lines(spark, sf_dir)))


@query(WITH + """, b AS (SELECT path, line_index, unnest(CAST(json_extract(line, '$.message.content[*]') AS JSON[])) AS b, generate_subscripts(CAST(json_extract(line, '$.message.content[*]') AS JSON[]), 1) - 1 AS pos
  FROM lines WHERE json_valid(line) AND line ->> '$.role' IN ('user', 'assistant'))
SELECT path, line_index, CAST(pos AS BIGINT) AS block_pos, b ->> '$.name' AS tool_name, CAST(b -> '$.input' AS VARCHAR) AS tool_input FROM b WHERE b ->> '$.type' = 'tool_use'""")
def p10_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.tool_calls(_messages(spark, sf_dir)[0])


# Turns.


@query(_TURN + " SELECT path, line_index, turn_id FROM turned")
def w1_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.segment(_messages(spark, sf_dir)[0]).select("path", "line_index", "turn_id")


@query(_TURN + """ SELECT path, turn_id, count(*) FILTER (role = 'user') AS n_user, count(*) FILTER (role = 'assistant') AS n_assistant,
  coalesce(string_agg(body, '|' ORDER BY line_index) FILTER (role = 'assistant'), '') AS said FROM turned GROUP BY path, turn_id""")
def a5_turn_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns.gather(turns.segment(_messages(spark, sf_dir)[0]))
    size = lambda c: F.size(c).cast("long")
    return rows.select("path", "turn_id", size("user").alias("n_user"), size("assistant").alias("n_assistant"), F.array_join(F.transform("assistant", lambda x: x["text"]), "|").alias("said"))


@query(_MSG + """ SELECT path, arg_min(user_query, line_index) FILTER (user_query IS NOT NULL) AS first_query, arg_max(body, line_index) FILTER (role = 'assistant' AND """ + _trim("body") + """ <> '') AS answer FROM msg GROUP BY path""")
def w5_w6_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages, _ = _messages(spark, sf_dir)
    return messages.select("path").distinct().join(turns.first_query(messages), "path", "left").join(turns.final_answer(messages), "path", "left")


@query(WITH + """, w AS (SELECT path, project_slug, modified_unix, is_subagent, lag(is_subagent) OVER o AS was FROM sessions WINDOW o AS (PARTITION BY project_slug ORDER BY modified_unix, path))
SELECT path, count(*) FILTER (was IS NULL OR was <> is_subagent) OVER (PARTITION BY project_slug ORDER BY modified_unix, path) - 1 AS island FROM w""")
def a13_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.islands(views(spark, sf_dir)["sessions"], ["modified_unix", "path"], "is_subagent").select("path", "island")


# Projects, sessions, search.


@query(WITH + """ SELECT project_slug, max(modified_unix) AS last_activity, count(*) FILTER (NOT is_subagent) AS main_sessions, count(*) FILTER (is_subagent) AS subagent_sessions,
  string_split(project_slug, '-')[-1] AS display_name, '/' || replace(project_slug, '-', '/') AS workspace_hint FROM sessions GROUP BY project_slug""")
def f1_o1_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.projects(views(spark, sf_dir)["sessions"])


_TITLED = _MSG + """, titled AS (
  SELECT s.*, coalesce((SELECT CASE WHEN length(q) > 90 THEN substr(q, 1, 90) || '…' ELSE q END FROM (SELECT """ + _squash("arg_min(user_query, line_index)") + """ AS q FROM msg m WHERE m.path = s.path AND user_query IS NOT NULL AND line_index < 8)), '(untitled session)') AS title
  FROM sessions s
)"""  # fmt: skip


@query(_TITLED + " SELECT path, title FROM titled")
def s5_s6_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages, every = _messages(spark, sf_dir)
    return sessions.with_titles(every, messages).select("path", "title")


@query(_TITLED + """ SELECT path, title FROM titled s WHERE NOT is_subagent AND (contains(lower(title), 'the') OR contains(lower(id), 'the')
  OR EXISTS (FROM titled c WHERE c.is_subagent AND c.project_slug = s.project_slug AND c.parent_id = s.id AND (contains(lower(c.title), 'the') OR contains(lower(c.id), 'the'))))""")
def f6_pick_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages, every = _messages(spark, sf_dir)
    return sessions.pick_sessions(sessions.with_titles(every, messages), "the").select("path", "title")


@query(WITH + " SELECT project_slug, parent_id, string_agg(id, ',' ORDER BY id) AS children FROM sessions WHERE is_subagent GROUP BY 1, 2")
def j9_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.children_of(views(spark, sf_dir)["sessions"]).withColumn("children", F.array_join("children", ","))


_INDEX = _MSG + """, tools AS (
  SELECT m.path, m.line_index, CASE WHEN role = 'assistant' AND line_index = 1 AND conv_id % 7 = 0 THEN 'Task' WHEN role = 'assistant' AND line_index % 3 = 0 THEN 'Read' ELSE '' END AS tools FROM msg m
), idx AS (
  SELECT m.path, m.line_index, role, tools, CASE WHEN role = 'user' THEN regexp_extract(body, '/data/n[0-9]+\\.pdf') ELSE '' END AS media, substr(""" + _squash("coalesce(user_query, body)") + """, 1, 200) AS snippet, s.project_slug, s.modified_unix
  FROM msg m JOIN tools t USING (path, line_index) JOIN sessions s USING (path)
), kept AS (SELECT * FROM idx WHERE tools <> '' OR media <> '' OR snippet <> '')"""  # fmt: skip
_INDEX = _INDEX.replace("\\\\.", "\\.")


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages, every = _messages(spark, sf_dir)
    return finder.index(messages, every.withColumn("title", F.lit("")))


@query(_INDEX + " SELECT path, line_index, role, tools, media, snippet, project_slug FROM kept")
def q3_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _index(spark, sf_dir)
    return rows.select("path", "line_index", "role", F.array_join("tools", ",").alias("tools"), F.array_join(F.transform("media", lambda m: m["path"]), ",").alias("media"), "snippet", "project_slug")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The fixture may give two rows one index: each goes to a file of its own of the same path.
    nth = F.row_number().over(Window.partitionBy("path", "line_index").orderBy("line"))
    rows = _lines(spark, sf_dir).withColumn("nth", nth)
    files = rows.groupBy("path", "nth").agg(F.array_sort(F.collect_list(F.struct("line_index", "line"))).alias("l"))
    # Blank lines stand where the fixture has no row.
    before = lambda i: F.when(i > 0, F.get("l", i - 1)["line_index"]).otherwise(0)
    content = F.array_join(F.transform("l", lambda x, i: F.concat(F.repeat(F.lit("\n"), (x["line_index"] - before(i)).cast("int")), F.coalesce(x["line"], F.lit("")))), "")
    return files.select("path", content.alias("content"), "nth")


def _fixture_path() -> Column:
    """The path as the fixture has it, of a file written below some folder."""
    return F.regexp_extract("path", r"(/t/proj-.*)\z", 1).alias("path")


def _session_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture's transcripts as files of their own in the shared folder."""
    folder = shared_folder(spark, "transcripts")
    sinks.write_texts(_files(spark, sf_dir).select(F.concat(F.lit("n"), F.col("nth").cast("string"), "path").alias("file"), F.col("content").alias("text")), folder)
    files = transcripts.binary_files(spark, folder, "*.jsonl").select(transcripts.bare_path("path").alias("path"), F.col("path").alias("uri"), F.unix_timestamp("modificationTime").alias("modified_unix"), F.col("length").alias("size_bytes"))
    return files.withColumns({"project_slug": F.expr(_PROJECT), "is_subagent": F.contains("path", F.lit("/subagents/"))})


@query(WITH + " SELECT path, line_index FROM lines WHERE contains(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'then')")
def q2_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finder.hits_in_files(_files(spark, sf_dir), "THEN").select("path", "line_index")


@query(_INDEX + """, low AS (SELECT path, line_index, translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM lines)
SELECT path, line_index, snippet FROM kept JOIN low USING (path, line_index) WHERE contains(low, 'the') AND tools = 'Read' AND project_slug = 'proj-0'""")
def q4_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finder.find(_index(spark, sf_dir), _lines(spark, sf_dir), "The", "proj-0", [], ["Read"]).select("path", "line_index", "snippet")


@query(_INDEX + """, top AS (SELECT path, line_index, project_slug, modified_unix FROM kept WHERE media <> '' OR tools = 'Task' ORDER BY modified_unix DESC, path, line_index LIMIT 500)
SELECT path, line_index, string_split(project_slug, '-')[-1] AS display_name FROM top WHERE line_index >= 0 AND (path, line_index) IN (SELECT (path, line_index) FROM kept WHERE media <> '')""")
def o5_j5_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = finder.find(_index(spark, sf_dir), media=["document"], tools=[])
    both = found.unionByName(finder.find(_index(spark, sf_dir), tools=["Task"]))
    rows = finder.page(both, sessions.projects(views(spark, sf_dir)["sessions"]))
    return rows.where(F.size("media") > 0).select("path", "line_index", "display_name")


@query(_INDEX + """ SELECT count(*) AS total, count(*) > 500 AS truncated FROM kept WHERE media <> ''""")
def o5_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finder.page_total(finder.find(_index(spark, sf_dir), media=["document"]))


@query(_INDEX + """, n AS (SELECT path, line_index, row_number() OVER (PARTITION BY path ORDER BY line_index) AS nth, count(*) OVER (PARTITION BY path) AS c FROM kept)
SELECT path, line_index, nth, greatest(c - 2, 0) AS more FROM n WHERE nth <= 2""")
def w8_per_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finder.per_session(_index(spark, sf_dir), 2).select("path", "line_index", F.col("nth").cast("long").alias("nth"), F.col("more").cast("long").alias("more"))


@query(_INDEX + """ SELECT path, coalesce(string_agg(DISTINCT tools, ',' ORDER BY tools) FILTER (tools <> ''), '') AS tools, CASE WHEN bool_or(media <> '') THEN 'document' ELSE '' END AS kinds FROM kept GROUP BY path""")
def a3_q5_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finder.facets(_index(spark, sf_dir)).select("path", F.array_join("tools", ",").alias("tools"), F.array_join("kinds", ",").alias("kinds"))


@query(_INDEX + """ SELECT 'tool' AS facet, tools AS value, count(*) AS messages FROM kept WHERE tools <> '' GROUP BY tools UNION ALL SELECT 'media', 'document', count(*) FROM kept WHERE media <> '' HAVING count(*) > 0""")
def a4_facet_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finder.facet_values(_index(spark, sf_dir))


_VIEW = _TURN + ", texts AS (SELECT path || '|' || CAST(line_index AS VARCHAR) AS k, body AS x FROM turned WHERE role = 'assistant')" + _SPLIT


@query(_VIEW + """ SELECT path, turn_id, line_index, role, is_injected, user_query, thinking, answer FROM turned t LEFT JOIN split s ON s.k = t.path || '|' || CAST(line_index AS VARCHAR)""")
def q6_session_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finder.session_view(turns.segment(_messages(spark, sf_dir)[0])).select("path", "turn_id", "line_index", "role", "is_injected", "user_query", "thinking", "answer")


_FOUND = WITH + """, low AS (SELECT path, line_index, line, instr(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'en') AS pos FROM lines),
hit AS (SELECT * FROM low WHERE pos > 0 ORDER BY path, line_index, line LIMIT 500),
sides AS (SELECT *, left(line, CAST(pos - 1 AS BIGINT)) AS b, substr(line, pos + 2) AS a FROM hit),
cut AS (SELECT *, coalesce(list_min(list_filter(range(0, 81), lambda k: strlen(right(b, k)) >= 80)), length(b)) AS kb, coalesce(list_min(list_filter(range(0, 81), lambda k: strlen(left(a, k)) >= 80)), length(a)) AS ka FROM sides)"""


@query(_FOUND + """ SELECT path, line_index, '…' || trim(replace(replace(replace(right(b, kb) || substr(line, pos, 2) || left(a, ka), chr(92) || 'n', ' '), chr(92) || 't', ' '), chr(92) || chr(34), chr(34)), chr(32) || chr(9) || chr(10) || chr(13)) || '…' AS snippet FROM cut""")
def q1_o6_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finder.search_files(_session_files(spark, sf_dir), "EN").hits.withColumn("path", _fixture_path())


@query(_FOUND + """ SELECT CASE WHEN (SELECT count(*) FROM hit) >= 500 THEN (SELECT count(DISTINCT path) FROM lines WHERE path <= (SELECT max(path) FROM hit)) ELSE (SELECT count(DISTINCT path) FROM lines) END AS files_scanned""")
def a14_files_scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = finder.search_files(_session_files(spark, sf_dir), "EN").files_scanned
    return spark.range(1).select(F.lit(scanned).cast("long").alias("files_scanned"))


def _kept(spark: SparkSession, sf_dir: str) -> kept.Kept:
    folder = shared_folder(spark, "kept-index")
    kept.renew(_session_files(spark, sf_dir), folder)
    return kept.opened(spark, folder)


@query(_INDEX + """ SELECT 'tool' AS facet, tools AS value, count(*) AS messages FROM kept WHERE tools <> '' GROUP BY tools UNION ALL SELECT 'media', 'document', count(*) FROM kept WHERE media <> '' HAVING count(*) > 0""")
def q5_kept_facet_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept.facet_values(_kept(spark, sf_dir))


@query(WITH + " SELECT path, line_index FROM lines WHERE contains(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'item #')")
def q2_kept_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits in the ranges that the filters leave."""
    ranges = kept.may_hold(_kept(spark, sf_dir).ranges, "ITEM #")
    return finder.hits_in_lines(splits.read_lines(ranges, "ITEM #"), "ITEM #").select(_fixture_path(), "line_index")


# Media.


@query(_MSG + """, found AS (SELECT path, min(line_index) AS line_index, regexp_extract(body, '/data/n[0-9]+\\.pdf') AS media_path FROM msg WHERE role = 'user' GROUP BY path, regexp_extract(body, '/data/n[0-9]+\\.pdf'))
SELECT path, line_index, media_path, 'document' AS kind, string_split(media_path, '/')[-1] AS name FROM found WHERE media_path <> ''""".replace("\\\\.", "\\."))
def t14_u5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.references(_messages(spark, sf_dir)[0])


_EXT = "png jpg JPEG gif webp svg bmp ico heic tif tiff mp4 m4v mov webm mkv avi mp3 wav m4a aac flac ogg opus aiff caf pdf md markdown txt LOG csv tsv json jsonl html py docx bin".split()
_FILE_NAMES = "'/data/' || source || '/my file (' || CAST(doc_id AS STRING) || ').' || CASE doc_id % " + str(len(_EXT)) + " " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_EXT)) + " END"


@query(f"""WITH n AS (SELECT doc_id, {_FILE_NAMES} AS p FROM documents), e AS (SELECT *, lower(string_split(p, '.')[-1]) AS e FROM n)
SELECT doc_id, CASE WHEN e IN ('png', 'jpg', 'jpeg', 'gif', 'webp', 'svg', 'bmp', 'ico', 'heic', 'tif', 'tiff') THEN 'image' WHEN e IN ('mp4', 'm4v', 'mov', 'webm', 'mkv', 'avi') THEN 'video'
    WHEN e IN ('mp3', 'wav', 'm4a', 'aac', 'flac', 'ogg', 'opus', 'aiff', 'caf') THEN 'audio' WHEN e IN ('pdf', 'docx') THEN 'document' WHEN e = 'bin' THEN 'other' ELSE 'readable' END AS kind,
  CASE WHEN e IN ('png', 'gif', 'webp', 'bmp', 'heic', 'jpeg', 'tiff') THEN 'image/' || e WHEN e = 'jpg' THEN 'image/jpeg' WHEN e = 'tif' THEN 'image/tiff' WHEN e = 'svg' THEN 'image/svg+xml' WHEN e = 'ico' THEN 'image/x-icon'
    WHEN e IN ('mp4', 'm4v') THEN 'video/mp4' WHEN e = 'mov' THEN 'video/quicktime' WHEN e = 'webm' THEN 'video/webm' WHEN e = 'mkv' THEN 'video/x-matroska' WHEN e = 'avi' THEN 'video/x-msvideo'
    WHEN e = 'mp3' THEN 'audio/mpeg' WHEN e = 'm4a' THEN 'audio/mp4' WHEN e IN ('ogg', 'opus') THEN 'audio/ogg' WHEN e = 'caf' THEN 'audio/x-caf' WHEN e IN ('wav', 'aac', 'flac', 'aiff') THEN 'audio/' || e
    WHEN e = 'pdf' THEN 'application/pdf' WHEN e IN ('json', 'jsonl') THEN 'application/json' WHEN e IN ('md', 'markdown', 'txt', 'log', 'csv', 'tsv', 'html') THEN 'text/plain; charset=utf-8' ELSE 'application/octet-stream' END AS mime,
  substr(sha256(p), 1, 8) || '-' || regexp_replace(string_split(p, '/')[-1], '[^A-Za-z0-9._-]', '_', 'g') AS name FROM e""")
def t15_t16_t24_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views(spark, sf_dir)["documents"].selectExpr("doc_id", f"{_FILE_NAMES} AS p")
    return rows.select("doc_id", T.media_kind("p").alias("kind"), T.mime_type("p").alias("mime"), T.attachment_name("p").alias("name"))


@query(f"""WITH n AS (SELECT doc_id, {_FILE_NAMES} AS p FROM documents) SELECT doc_id, doc_id % 3 = 0 AS there, starts_with(p, '/data/src1/') AS inside FROM n""")
def j6_media_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views(spark, sf_dir)["documents"].selectExpr("doc_id", f"{_FILE_NAMES} AS media_path")
    have = rows.where("doc_id % 3 = 0").select(F.regexp_replace("media_path", "/data/", "//data/").alias("file"), F.lit(1).alias("size_bytes"))
    return media.resolve(rows, have, "/data/src1").select("doc_id", F.col("exists").alias("there"), F.col("within_root").alias("inside"))


_NAMED = "CASE doc_id % 5 WHEN 0 THEN '/data/projects/' || source WHEN 1 THEN '/home/u' WHEN 2 THEN '/old/' || source || '/assets' WHEN 3 THEN '/away' ELSE '/none' END || '/f' || CAST(doc_id AS STRING) || '.pdf'"
_THERE = """SELECT p AS file FROM named WHERE doc_id % 5 < 2 AND doc_id % 7 <> 0
UNION ALL SELECT '/data/projects/' || source || '/assets/f' || CAST(doc_id AS STRING) || '.pdf' FROM named WHERE doc_id % 5 = 2 AND doc_id % 7 <> 1
UNION ALL SELECT '/data/attachments/' || substr(sha, 1, 8) || '-f' || CAST(doc_id AS STRING) || '.pdf' FROM named WHERE doc_id % 5 IN (1, 3)"""


@query(f"""WITH named AS (SELECT doc_id, source, {_NAMED} AS p, sha256({_NAMED}) AS sha FROM documents), there AS ({_THERE}),
c AS (SELECT doc_id, p, CASE WHEN starts_with(p, '/old/') THEN '/data/projects/' || substr(p, 6) END AS moved, '/data/attachments/' || substr(sha, 1, 8) || '-' || string_split(p, '/')[-1] AS kept FROM named),
f AS (SELECT doc_id, p, p IN (FROM there) AS own, moved, moved IN (FROM there) AS m, kept, kept IN (FROM there) AS k FROM c)
SELECT doc_id, CASE WHEN own THEN p WHEN m THEN moved WHEN k THEN kept END AS found,
  CASE WHEN own THEN CASE WHEN starts_with(p, '/data/projects/') THEN 'inside' ELSE 'outside' END WHEN m THEN 'moved' WHEN k THEN 'captured' END AS rule FROM f""")
def q8_media_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = views(spark, sf_dir)["documents"].selectExpr("doc_id", "source", f"{_NAMED} AS p", f"sha2({_NAMED}, 256) AS sha")
    named.createOrReplaceTempView("named")
    references = named.selectExpr("doc_id", "p AS media_path")
    slugs = named.selectExpr("source AS project_slug").distinct()
    return media.locate(references, spark.sql(_THERE), slugs, "/data/projects").select("doc_id", "found", "rule")


# Text.


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decorated(spark, sf_dir).where("role = 'assistant'")


@query(WITH + ", texts AS (SELECT path || '|' || CAST(line_index AS VARCHAR) AS k, body AS x FROM messages WHERE role = 'assistant')" + _SPLIT + " SELECT k, thinking, answer FROM split")
def t1_split_thinking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _texts(spark, sf_dir).select(F.concat("path", F.lit("|"), F.col("line_index").cast("string")).alias("k"), T.split_thinking("body").alias("s"))
    return rows.select("k", "s.thinking", "s.answer")


@query(WITH + f""", t AS (SELECT path, line_index, {_trim("body")} AS x FROM messages)
SELECT path, line_index, {_structured("x")} AS structured, {_opening("x")} AS headerless, {_planning("x")} AS planning FROM t""")
def t5_t6_t7_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _decorated(spark, sf_dir)
    return rows.select("path", "line_index", T.has_structure(T.trim("body")).alias("structured"), T.is_headerless_deliberation("body").alias("headerless"), T.is_deliberation("body").alias("planning"))


_GLUED = "'Done.' || chr(10) || body || chr(10) || chr(32) || chr(10) || body"


@query(WITH + f""", t AS (SELECT path, line_index, string_split({_GLUED}, chr(10)) AS l FROM messages), x AS (SELECT path, line_index, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM t),
b AS (SELECT *, lag(x) OVER (PARTITION BY path, line_index ORDER BY i) AS before FROM x)
SELECT path, line_index, string_agg(CASE WHEN i > 1 AND regexp_matches({_trim("x")}, {_HEADER}) AND {_trim("before")} <> '' THEN chr(10) || x ELSE x END, chr(10) ORDER BY i) AS x FROM b GROUP BY path, line_index""")
def t3_header_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decorated(spark, sf_dir).select("path", "line_index", T.normalize_header_breaks(F.expr(_GLUED)).alias("x"))


@query(WITH + f""", t AS (SELECT path, line_index, {_trim("replace(body, chr(39), '’')")} AS x FROM messages)
SELECT path, line_index, replace(x, '’', chr(39)) AS plain, {_planning("x")} AS deliberation, {_opening("x")} AS headerless FROM t""")
def t4_curly_apostrophes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = T.trim(F.replace("body", F.lit("'"), F.lit("’")))
    return _decorated(spark, sf_dir).select("path", "line_index", T.plain_apostrophes(x).alias("plain"), T.is_deliberation(x).alias("deliberation"), T.is_headerless_deliberation(x).alias("headerless"))


_TAGS = "'x <user_query> ' || coalesce(text, '') || ' </user_query> y <user_query></user_query><user_query><user_query>' || source"


@query(f"""SELECT doc_id, CASE WHEN {_trim("coalesce(text, '')")} = '' THEN '' ELSE {_trim("coalesce(text, '')")} || chr(10) || chr(10) END || '<user_query>' || source AS q FROM documents""")
def p6_open_and_nested_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views(spark, sf_dir)["documents"].select("doc_id", T.extract_query(F.expr(_TAGS)).alias("q"))


_SLUG = "CASE doc_id % 4 WHEN 0 THEN CAST(doc_id AS STRING) WHEN 1 THEN source || '-' || CAST(doc_id AS STRING) WHEN 2 THEN source || '-' ELSE 'home-u-' || source END"


@query(f"""WITH s AS (SELECT doc_id, {_SLUG} AS slug FROM documents) SELECT doc_id, CASE WHEN regexp_full_match(slug, '[0-9]+') THEN 'project ' || slug WHEN ends_with(slug, '-') THEN slug ELSE string_split(slug, '-')[-1] END AS name,
CASE WHEN regexp_full_match(slug, '[0-9]+') THEN '' ELSE '/' || replace(slug, '-', '/') END AS hint FROM s""")
def s7_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    slug = F.expr(_SLUG)
    return views(spark, sf_dir)["documents"].select("doc_id", T.slug_name(slug).alias("name"), T.slug_hint(slug).alias("hint"))


@query(WITH + f" SELECT path, line_index, {_LINKS_OFF.format(x='body')} AS x FROM messages")
def t8_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decorated(spark, sf_dir).select("path", "line_index", T.strip_chat_links("body").alias("x"))


@query(WITH + ", texts AS (SELECT path || '|' || CAST(line_index AS VARCHAR) AS k, body || CASE WHEN line_index % 2 = 1 THEN ' Next, I look at it. Time to go!' ELSE '' END AS x FROM messages)" + _cuts("texts") + " SELECT k, x FROM cut")
def t9_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _decorated(spark, sf_dir)
    text = F.concat("body", F.when(F.col("line_index") % 2 == 1, " Next, I look at it. Time to go!").otherwise(""))
    return rows.select(F.concat("path", F.lit("|"), F.col("line_index").cast("string")).alias("k"), T.strip_trailing_intent(text).alias("x"))


@query(f"""SELECT doc_id, replace(replace(t, '<think>', '<' || chr(8203) || 'think>'), '</think>', '<' || chr(8203) || '/think>') AS safe, {_squash("t")} AS flat, substr(sha256({_squash("t")}), 1, 16) AS prompt_hash,
  substr({_squash("t")}, 1, 200) AS snippet, regexp_replace(t, '[^A-Za-z0-9_-]', '_', 'g') AS file, contains(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the ') AS hit
FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '<think> a </think>  ' || text ELSE text END AS t FROM documents)""")
def t11_t20_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<think> a </think>  "), "text")).otherwise(F.col("text"))
    rows = views(spark, sf_dir)["documents"].select("doc_id", t.alias("t"))
    return rows.select(
        "doc_id", T.neutralize_think_tags("t").alias("safe"), T.collapse("t").alias("flat"), T.prompt_hash("t").alias("prompt_hash"), T.index_snippet("t").alias("snippet"), T.file_name("t").alias("file"),
        T.contains_folded("t", "THE ").alias("hit"),
    )


_FAKE = """text || CASE doc_id % 5 WHEN 0 THEN ' ghp_' || repeat('a1B2', 10) WHEN 1 THEN ' AKIA' || repeat('Q7', 8) || ' and Bearer ' || repeat('x.9', 8) WHEN 2 THEN ' hf_' || repeat('Zz9', 11) ELSE '' END"""


def _secret_count(kind: str) -> str:
    return f"len(regexp_extract_all(t, '{L.SECRET_FAMILIES[kind]}'))"


def _redacted(x: str) -> str:
    for kind, pattern in L.SECRET_FAMILIES.items():
        x = f"regexp_replace({x}, '{pattern}', '[redacted:{kind}]', 'g')"
    return x


@query(f"""WITH d AS (SELECT doc_id, {_FAKE} AS t FROM documents), n AS ({" UNION ALL ".join(f"SELECT '{k}' AS kind, {_secret_count(k)} AS n FROM d" for k in L.SECRET_FAMILIES)})
SELECT kind, CAST(sum(n) AS BIGINT) AS n FROM n GROUP BY kind HAVING sum(n) > 0""")
def t22_a6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views(spark, sf_dir)["documents"].selectExpr(f"{_FAKE} AS t")
    return rows.select(F.explode(T.scan_secrets("t")).alias("kind", "n")).groupBy("kind").agg(F.sum("n").alias("n"))


@query(f"SELECT doc_id, {_redacted('t')} AS t FROM (SELECT doc_id, {_FAKE} AS t FROM documents)")
def t22_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views(spark, sf_dir)["documents"].selectExpr("doc_id", f"{_FAKE} AS t").select("doc_id", T.redact_secrets("t").alias("t"))


@query("""SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1048576 THEN CAST(floor(n_chars / 1024 + 0.5) AS BIGINT) || ' KB' ELSE printf('%.1f MB', floor(n_chars / 1048576 * 10 + 0.5) / 10) END AS size FROM documents""")
def t30_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views(spark, sf_dir)["documents"].select("doc_id", T.size_label("n_chars").alias("size"))


_UNIX = "CASE WHEN doc_id % 9 = 0 THEN 0 ELSE 1700000000 + doc_id * 25261 END"


@query(f"""SELECT doc_id, CASE WHEN u = 0 THEN '?' ELSE strftime(make_timestamp(u * 1000000), '%m/%d/%Y, %I:%M %p') END AS at FROM (SELECT doc_id, {_UNIX} AS u FROM documents)""")
def t30_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views(spark, sf_dir)["documents"].selectExpr("doc_id", f"{_UNIX} AS u")
    return rows.select("doc_id", T.date_label("u").alias("at"))


_ESCAPED = "CASE WHEN doc_id % 3 = 0 THEN '~/' ELSE 'a+%zz%; ' END || replace(text, ' ', '%20') || '%C3%A9'"


@query(f"""SELECT doc_id, url_decode(t) AS plain, CASE WHEN starts_with(t, '~/') THEN '/home/u' || substr(t, 2) ELSE t END AS path FROM (SELECT doc_id, {_ESCAPED} AS t FROM documents)""")
def t25_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views(spark, sf_dir)["documents"].selectExpr("doc_id", f"{_ESCAPED} AS t")
    return rows.select("doc_id", T.url_decode("t").alias("plain"), T.expand_home("t", "/home/u/").alias("path"))


# A fence inside every other text, closed in some, and line ends near the cut of others.
_FENCED = """CASE WHEN doc_id % 2 = 0 THEN substr(text, 1, 300 + doc_id % 1500) || '```py' || chr(10) || substr(text, 301 + doc_id % 1500) || CASE WHEN doc_id % 6 = 0 THEN '```' ELSE '' END
  WHEN doc_id % 4 = 1 THEN substr(text, 1, 700 + doc_id % 900) || chr(10) || substr(text, 701 + doc_id % 900) ELSE text END"""


@query(f"""WITH t AS (SELECT doc_id, {_FENCED} AS t FROM documents), h AS (SELECT *, left(t, 1600) AS head FROM t),
p AS (SELECT *, len(string_split(head, '```')) - 1 AS fences, regexp_extract(head, '(?s)^(.*)```', 1) AS b, regexp_extract(head, '(?s)^(.*)\n', 1) AS l FROM h)
SELECT doc_id, CASE WHEN length(t) <= 1600 THEN t WHEN fences % 2 = 1 AND b <> '' THEN regexp_replace(b, '\\s+$', '') WHEN length(l) > 960 THEN l ELSE head END AS shown FROM p""")
def t27_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views(spark, sf_dir)["documents"].selectExpr("doc_id", f"{_FENCED} AS t").select("doc_id", T.preview("t").alias("shown"))


@query(f"""WITH t AS (SELECT doc_id, string_split({_FENCED}, '```') AS l FROM documents), x AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM t),
p AS (SELECT doc_id, i, i % 2 = 0 AS code, CASE WHEN i % 2 = 0 THEN regexp_replace(x, '^[A-Za-z0-9_+-]*\n', '') ELSE x END AS text FROM x)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS nth, code, text FROM p WHERE code OR text <> ''""")
def t29_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views(spark, sf_dir)["documents"].selectExpr("doc_id", f"{_FENCED} AS t")
    return rows.select("doc_id", F.posexplode(T.fence_parts("t")).alias("nth", "p")).select("doc_id", "nth", "p.code", "p.text")


@query("SELECT doc_id, regexp_replace(text, '(?i)(the)', '[\\1]', 'g') AS t FROM documents")
def t29_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.transform(T.highlighted("text", "The"), lambda p: F.when(p["hit"], F.concat(F.lit("["), p["text"], F.lit("]"))).otherwise(p["text"]))
    return views(spark, sf_dir)["documents"].select("doc_id", F.array_join(marked, "").alias("t"))


_WORDS = "translate(line, chr(34) || chr(92) || chr(9) || chr(13), '')"
_INPUT = f"""CASE (doc_id + nth) % 5 WHEN 0 THEN '{{"path":5,"command":"' || {_WORDS} || '"}}' WHEN 1 THEN '{{"description":"' || {_WORDS} || '","url":"/u"}}' WHEN 2 THEN '{{"path":"' || {_WORDS} || '"}}'
  WHEN 3 THEN '{{"other":"x","query":null}}' ELSE 'no json' END"""
_TELLING = ", ".join(f"CASE WHEN json_type(j, '$.{k}') = 'VARCHAR' THEN json_extract_string(j, '$.{k}') END" for k in L.TELLING_FIELDS)


@query(f"""WITH l AS (SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS nth, unnest(string_split(text, chr(10))) AS line FROM documents),
r AS (SELECT doc_id, nth, {_INPUT} AS r FROM l), j AS (SELECT doc_id, nth, CASE WHEN json_valid(r) THEN r ELSE '{{}}' END AS j FROM r), x AS (SELECT doc_id, nth, coalesce({_TELLING}) AS x FROM j)
SELECT doc_id, nth, CASE WHEN x IS NULL THEN 'Tool' WHEN length(x) > 66 THEN 'Tool: ' || substr(x, 1, 66) || '…' ELSE 'Tool: ' || x END AS told FROM x""")
def t28_tool_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views(spark, sf_dir)["documents"].select("doc_id", F.posexplode(F.split("text", "\n")).alias("nth", "line")).selectExpr("doc_id", "nth", f"{_INPUT} AS r")
    return rows.select("doc_id", "nth", T.tool_summary(F.lit("Tool"), "r").alias("told"))



# Integrity.

_VERIFY = WITH + """, base AS (
  SELECT m.*, row_number() OVER () AS row FROM manifest m
), found AS (
  SELECT b.project, b.relpath, b.file, b.sha256, f.relpath AS there, f.sha256 AS hash FROM base b LEFT JOIN files f ON (b.relpath IS NOT NULL AND f.relpath = b.relpath) OR (b.relpath IS NULL AND f.project = b.project AND f.file = b.file)
), report AS (
  SELECT coalesce(relpath, project || '/' || file) AS relpath, project, CASE WHEN sha256 IS NULL THEN 'unhashed' WHEN starts_with(relpath, '../') THEN 'unsafe' WHEN there IS NULL THEN 'missing' WHEN hash = sha256 THEN 'ok' ELSE 'failed' END AS status FROM found
  UNION ALL
  SELECT relpath, project, 'unlisted' FROM files f WHERE project IN (SELECT project FROM manifest WHERE sha256 IS NOT NULL) AND relpath NOT IN (SELECT relpath FROM manifest WHERE relpath IS NOT NULL)
    AND NOT EXISTS (FROM manifest m WHERE m.relpath IS NULL AND m.project = f.project AND m.file = f.file)
)"""


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir)
    return integrity.verify(v["manifest"], v["files"])


@query(_VERIFY + " SELECT relpath, project, status FROM report")
def j7_b7_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir)


@query(_VERIFY + """ SELECT count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'unsafe') AS unsafe,
  count(*) FILTER (status = 'unhashed') AS unhashed, count(*) FILTER (status = 'unlisted') AS unlisted, count(*) FILTER (status NOT IN ('ok', 'unhashed')) = 0 AS intact FROM report""")
def a12_b8_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.verdict(_report(spark, sf_dir))


_OTHER = "SELECT relpath, project, size_bytes + CASE WHEN doc_id % 4 = 1 THEN 1 ELSE 0 END AS size_bytes, mtime + doc_id % 6 AS mtime, sha256 FROM files WHERE doc_id % 3 <> 0"


@query(WITH + f""", there AS ({_OTHER}) SELECT f.relpath, CASE WHEN t.size_bytes = f.size_bytes AND abs(t.mtime - f.mtime) <= 2 THEN 'keep' ELSE 'copy' END AS action FROM files f LEFT JOIN there t USING (relpath)""")
def j8_b2_copy_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = views(spark, sf_dir)["files"]
    return integrity.copy_plan(files, spark.sql(_OTHER)).select("relpath", "action")


@query(WITH + f""", there AS ({_OTHER}) SELECT f.relpath, CASE WHEN t.relpath IS NULL THEN 'copy' WHEN t.size_bytes = f.size_bytes AND abs(t.mtime - f.mtime) <= 2 THEN 'keep' ELSE 'overwrite' END AS action
FROM files f LEFT JOIN there t USING (relpath) WHERE f.project IN ('src1', 'src2')""")
def b9_restore_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = views(spark, sf_dir)["files"]
    return integrity.restore_plan(files, spark.sql(_OTHER), ["src1", "src2"]).select("relpath", "action")


@query(WITH + f""", there AS ({_OTHER}) SELECT relpath, size_bytes FROM files WHERE relpath NOT IN (SELECT relpath FROM there) UNION ALL SELECT relpath, size_bytes FROM there""")
def j11_u4_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = views(spark, sf_dir)["files"]
    return integrity.merge_manifest(files.drop("file", "doc_id"), spark.sql(_OTHER)).select("relpath", "size_bytes")


@query(WITH + f""", there AS ({_OTHER}) SELECT f.relpath, CASE WHEN t.size_bytes = f.size_bytes AND abs(t.mtime - f.mtime) <= 2 THEN t.sha256 END AS sha256 FROM files f LEFT JOIN there t USING (relpath)""")
def j10_reuse_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = views(spark, sf_dir)["files"]
    return integrity.reuse_hashes(files, spark.sql(_OTHER)).select("relpath", "sha256")


@query(WITH + " SELECT project, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM files GROUP BY project")
def a11_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.totals(views(spark, sf_dir)["files"])
