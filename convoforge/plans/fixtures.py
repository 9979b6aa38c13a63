"""Transcript-shaped views over the conversations table, in SQL that Spark and other engines read alike.

The plain table has no tags, tools, child sessions or torn lines, so queries on it would leave most operators idle. The
views add them by fixed rules on conv_id and turn; every row of conversations stays. The file views leave out some documents
on purpose (missing and unlisted files).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NL, Q, BS, APO = "chr(10)", "chr(34)", "chr(92)", "chr(39)"


def _s(x: str) -> str:
    return f"CAST({x} AS STRING)"


_PARENT = "(conv_id - conv_id % 7)"
_PATH = f"'/t/proj-' || {_s(_PARENT + ' % 5')} || '/agent-transcripts/s'"

SESSIONS = f"""
SELECT conv_id, {_PATH} || {_s(_PARENT)} || CASE WHEN conv_id % 7 IN (1, 2) THEN '/subagents/s' ELSE '/s' END
    || {_s("conv_id")} || '.jsonl' AS path,
  CASE WHEN conv_id % 35 = 1 THEN 's' || {_s(_PARENT)} ELSE 's' || {_s("conv_id")} END AS id,
  'proj-' || {_s(_PARENT + " % 5")} AS project_slug, conv_id % 7 IN (1, 2) AS is_subagent,
  CASE WHEN conv_id % 7 IN (1, 2) THEN 's' || {_s(_PARENT)} END AS parent_id,
  CASE WHEN conv_id % 7 IN (1, 2) THEN {_PATH} || {_s(_PARENT)} || '/s' || {_s(_PARENT)} || '.jsonl' END AS parent_path,
  1700000000 + (conv_id % 50) * 3600 AS modified_unix, CAST(sum(length(text)) AS BIGINT) AS size_bytes
FROM conversations GROUP BY conv_id"""

#: The written text of each row.
MESSAGES = f"""
SELECT s.path, s.conv_id, turn AS line_index, role,
  CASE
    WHEN role = 'user' AND turn = 0 AND s.conv_id % 7 = 1 THEN '<user_query>Work on item #' || {_s("s.conv_id")} || ';</user_query>'
    WHEN role = 'user' AND turn = 0 AND s.conv_id % 7 = 2 THEN '<user_query>Please  work on item #' || {_s("s.conv_id")} || '; ' || text || '</user_query>'
    WHEN role = 'user' AND turn % 8 = 6 THEN text
    WHEN role = 'user' AND turn % 8 = 4 THEN '<user_query>The above subagent result: ' || text || '</user_query>'
    WHEN role = 'user' THEN '<timestamp>Tuesday, Jul 7, 2026, 2:35 PM (UTC+2)</timestamp>' || {NL} || '<user_query>' || {NL} || text || ' see /data/n' || {_s("s.conv_id")} || '.pdf' || {NL} || '</user_query>'
    WHEN role = 'assistant' AND turn % 4 = 1 THEN '**Planning the next step**' || {NL} || {NL} || 'I need to look at the notes first. I will check them.' || {NL} || {NL} || text
    WHEN role = 'assistant' AND turn % 4 = 3 THEN text || ' Let me run the check now.'
    WHEN role = 'assistant' THEN 'I' || {APO} || 'll start with the list and then look at all of the parts in it, one by one.' || {NL} || {NL} || text || ' [notes](0a1b2c3d-0000-1111-2222-0123456789ab)'
    ELSE text END AS body
FROM conversations c JOIN sessions s ON c.conv_id = s.conv_id"""

_ESC = f"replace(replace(replace(body, {BS}, {BS} || {BS}), {Q}, {BS} || {Q}), {NL}, {BS} || 'n')"
_TASK = """',{"type":"tool_use","name":"Task","input":{"description":"part","prompt":"' || %s || '","run_in_background":' || %s || ',"subagent_type":"general"}}'"""
_TASKS = (
    _TASK % (f"'Work on item #' || {_s('conv_id + 1')} || ';'", "'false'")
    + " || " + _TASK % (f"'work on  item #' || {_s('conv_id + 2')} || ';'", "CASE WHEN conv_id % 14 = 0 THEN 'true' ELSE 'false' END")
    + " || " + _TASK % ("'nobody was asked this'", "'false'")
    + " || " + _TASK % (f"'Work on item #' || {_s('conv_id + 1')} || ';'", "'false'")
)

#: Raw lines: the messages, and on some sessions a marker, a torn line, a blank one and one with trailing junk.
LINES = f"""
SELECT path, line_index, '{{"role":"' || role || '","message":{{"content":[{{"type":"text","text":"' || {_ESC} || '"}}'
  || CASE WHEN role = 'assistant' AND line_index = 1 AND conv_id % 7 = 0 THEN {_TASKS}
          WHEN role = 'assistant' AND line_index % 3 = 0 THEN ',{{"type":"tool_use","name":"Read","input":{{"path":"/data/a.md"}}}}' ELSE '' END
  || ']}}}}' AS line
FROM messages
UNION ALL SELECT path, 100, '{{"type":"turn_ended","status":"' || CASE WHEN conv_id % 3 = 0 THEN 'error' ELSE 'success' END || '"}}' FROM sessions WHERE conv_id % 2 = 0
UNION ALL SELECT path, 101, '{{"role":"user","mess' FROM sessions WHERE conv_id % 4 = 0
UNION ALL SELECT path, 102, '  ' FROM sessions WHERE conv_id % 6 = 0
UNION ALL SELECT path, 103, '{{"a":1}}{{"b":2}}' FROM sessions WHERE conv_id % 8 = 0"""

#: A backed-up tree as the documents table, and its manifest: some rows edited, unhashed, missing, unlisted or unsafe.
FILES = f"""
SELECT 'projects/' || source || '/d' || {_s("doc_id")} || '.jsonl' AS relpath, source AS project, 'd' || {_s("doc_id")} || '.jsonl' AS file,
  CAST(length(text) AS BIGINT) AS size_bytes, 1700000000 + doc_id AS mtime, sha2_text AS sha256, doc_id
FROM hashed WHERE doc_id % 11 <> 3"""
MANIFEST = f"""
SELECT source AS project, CASE WHEN doc_id % 9 = 4 THEN NULL WHEN doc_id % 31 = 5 THEN '../d' || {_s("doc_id")} ELSE 'projects/' || source || '/d' || {_s("doc_id")} || '.jsonl' END AS relpath,
  'd' || {_s("doc_id")} || '.jsonl' AS file, CAST(length(text) AS BIGINT) + CASE WHEN doc_id % 10 = 2 THEN 1 ELSE 0 END AS size_bytes,
  1700000000 + doc_id + doc_id % 5 AS mtime, CASE WHEN doc_id % 13 = 6 THEN NULL WHEN doc_id % 17 = 2 THEN 'edited' ELSE sha2_text END AS sha256
FROM hashed WHERE doc_id % 7 <> 1"""


def views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """conversations and documents tables, and the views above, as DataFrames."""
    out = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("conversations", "documents")}
    out["conversations"].createOrReplaceTempView("conversations")
    out["documents"].selectExpr("*", "sha2(text, 256) AS sha2_text").createOrReplaceTempView("hashed")
    for name, sql in (("sessions", SESSIONS), ("messages", MESSAGES), ("lines", LINES), ("files", FILES), ("manifest", MANIFEST)):
        out[name] = spark.sql(sql)
        out[name].createOrReplaceTempView(name)
    return out


#: The same views as common table expressions.
WITH = f"""WITH RECURSIVE sessions AS ({SESSIONS}), messages AS ({MESSAGES}), lines AS ({LINES}),
hashed AS (SELECT *, sha256(text) AS sha2_text FROM documents), files AS ({FILES}), manifest AS ({MANIFEST})"""
