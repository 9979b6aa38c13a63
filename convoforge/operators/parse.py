"""Tolerant parsing of transcript lines.

``lines`` numbers the raw lines of whole files; ``records`` classifies each line as message, marker, skipped or blank;
``messages`` keeps the messages with their blocks, texts and flags. A line that is not one JSON value, or whose role is
unknown, is counted and never fatal.

Defined results: a null or blank line is ``blank`` and not counted as skipped; repeated keys in one object make the line
``skipped`` unless ``spark.sql.variant.allowDuplicateKeys`` is set; extra columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

BLANK = r"(?U)^[\s\x{feff}]+|\s+\z"


def lines(files: DataFrame) -> DataFrame:
    """path, line_index (raw, from 0) and line of files given as (path, content, ...)."""
    rest = [c for c in files.columns if c not in ("content", "line_index", "line")]
    numbered = files.select(*rest, F.posexplode(F.split("content", "\n")).alias("line_index", "line"))
    return numbered.withColumns({"line_index": F.col("line_index").cast("long"), "line": F.regexp_replace("line", r"\r\z", "")})


def string_at(v: Column, path: str) -> Column:
    """The string at a path of a variant; null where there is none or it is of another type."""
    return T.let(F.try_variant_get(v, path, "variant"), lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))


def _block(x: Column) -> Column:
    def made(kind: Column) -> Column:
        name = F.coalesce(string_at(x, "$.name"), F.lit("(unnamed tool)"))
        given = F.coalesce(F.to_json(F.try_variant_get(x, "$.input", "variant")), F.lit("null"))
        return F.struct(
            F.when(kind.isin("text", "tool_use"), kind).otherwise("other").alias("kind"),
            F.when(kind == "text", F.coalesce(string_at(x, "$.text"), F.lit(""))).alias("text"),
            F.when(kind == "tool_use", name).alias("tool_name"),
            F.when(kind == "tool_use", given).alias("tool_input"),
            F.when(~kind.isin("text", "tool_use"), kind).alias("other_type"),
        )

    return T.let(F.coalesce(string_at(x, "$.type"), F.lit("")), made)


_BLOCK = "struct<kind:string,text:string,tool_name:string,tool_input:string,other_type:string>"


def _blocks(content: Column) -> Column:
    single = F.array(F.struct(F.lit("text").alias("kind"), string_at(content, "$").alias("text"), *(F.lit(None).cast("string").alias(c) for c in ("tool_name", "tool_input", "other_type"))))
    listed = F.transform(F.try_variant_get(content, "$", "array<variant>"), _block)
    return F.coalesce(F.when(F.schema_of_variant(content) == "STRING", single), listed, F.array()).cast(f"array<{_BLOCK}>")


def block_texts(blocks: Column | str, between: str) -> Column:
    """Text blocks joined; a separator only follows what is not empty."""
    texts = F.transform(F.filter(blocks, lambda b: b["kind"] == "text"), lambda b: b["text"])
    return F.aggregate(texts, F.lit(""), lambda acc, t: F.when(acc == "", t).otherwise(F.concat(acc, F.lit(between), t)))


def _once(rows: DataFrame, made: Column) -> DataFrame:
    """Rows with the fields of struct ``made`` in place of columns of those names.

    A generator keeps filters on the fields above it: pushed below, they would compute the fields once more.
    """
    rest = [c for c in rows.columns if c != "_made"]
    out = rows.select(*rest, F.explode(F.array(made)).alias("_made"))
    return out.select(*(c for c in rest if c not in out.schema["_made"].dataType.names), "_made.*")


def records(lines: DataFrame) -> DataFrame:
    """Adds kind (blank, skipped, marker, message), errored, role and content (VARIANT) to numbered lines."""
    parsed = lambda a, x, b: F.try_parse_json(F.concat(F.lit(a), x, F.lit(b)))

    def classified(body: Column, v: Column) -> Column:
        # Inside an object as well as inside a list, a line only parses if it is one JSON value and nothing else.
        valid = v.isNotNull() & parsed("[", body, "]").isNotNull()

        def made(type_: Column) -> Column:
            role, marker = string_at(v, "$.r.role"), type_ == "turn_ended"
            kind = F.when(body == "", "blank").when(~valid, "skipped").when(marker, "marker").when(role.isin("user", "assistant"), "message").otherwise("skipped")
            failed = F.try_variant_get(v, "$.r.error", "variant").isNotNull() | ~string_at(v, "$.r.status").eqNullSafe("success")
            return T.let(kind, lambda k: F.struct(
                k.alias("kind"), F.when(k == "marker", failed).alias("errored"), F.when(k == "message", role).alias("role"),
                F.when(k == "message", F.try_variant_get(v, "$.r.message.content", "variant")).alias("content"),
            ))

        return T.let(F.coalesce(string_at(v, "$.r.type"), F.lit("")), made)

    body = F.coalesce(F.regexp_replace("line", BLANK, ""), F.lit(""))
    rec = T.let(body, lambda b: T.let(parsed('{"r":', b, "}"), lambda v: classified(b, v)))
    return _once(lines, rec).drop("line")


def messages(records: DataFrame) -> DataFrame:
    """One row per message: role, blocks, full_text, user_query, has_user_query, is_injected, timestamp."""
    user = F.col("role") == "user"

    def texts(blocks: Column) -> Column:
        def flags(flat: Column) -> Column:
            return T.let(F.when(user, T.extract_query(flat)), lambda q: F.struct(
                blocks.alias("blocks"), block_texts(blocks, "\n\n").alias("full_text"), q.alias("user_query"), F.when(user, T.extract_timestamp(flat)).alias("timestamp"),
                q.isNotNull().alias("has_user_query"), (user & T.is_injected(q)).alias("is_injected"),
            ))

        return T.let(block_texts(blocks, "\n"), flags)

    rows = records.where("kind = 'message'").drop("kind", "errored")
    return _once(rows, T.let(_blocks(F.col("content")), texts)).drop("content")


def stats(records: DataFrame) -> DataFrame:
    """Per path: messages, skipped_lines, errored_turns."""
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    kind = F.col("kind")
    return records.groupBy("path").agg(count(kind == "message").alias("messages"), count(kind == "skipped").alias("skipped_lines"), count(F.col("errored")).alias("errored_turns"))


def tool_calls(messages: DataFrame) -> DataFrame:
    """One row per tool call, in document order: path, line_index, block_pos, tool_name, tool_input."""
    found = messages.select("path", "line_index", F.posexplode("blocks").alias("block_pos", "block")).where("block.kind = 'tool_use'")
    return found.select("path", "line_index", F.col("block_pos").cast("long").alias("block_pos"), "block.tool_name", "block.tool_input")


def tool_names(blocks: Column | str) -> Column:
    """Distinct tool names, first seen first."""
    return F.array_distinct(F.transform(F.filter(blocks, lambda b: b["kind"] == "tool_use"), lambda b: b["tool_name"]))
