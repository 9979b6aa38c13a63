"""Turns as training text: what the user asked, what the assistant thought, answered, and wrote in full."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..plans.options import ExportOptions
from .linkage import TASK
from .parse import string_at

_PIECE = "struct<thinking:string,answer:string,native:string,tool:boolean>"


def _user(o: ExportOptions) -> Column:
    text = F.col("full_text") if o.user_content == "raw_full" else F.when(~F.col("is_injected"), F.coalesce("user_query", F.lit("")))
    text = T.strip_chat_links(text) if o.clean_assistant else text
    text = T.redact_secrets(text) if o.redact_secrets else text
    return F.nullif(T.trim(text), F.lit(""))


def tool_call(name: Column | str, given: Column | str) -> Column:
    """A fenced block with the call's name and input."""
    name = F.col(name) if isinstance(name, str) else name
    quoted = F.replace(F.replace(F.replace(name, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return F.concat(F.lit('```tool_call\n{"name": "'), quoted, F.lit('", "input": '), given, F.lit("}\n```"))


def inlined_result(result: Column | str) -> Column:
    """A delegated run's answer as it stands in its parent: cleaned, and cut to a fixed length."""

    def cleaned(text: Column) -> Column:
        return T.let(T.trim(T.split_thinking(text)["answer"]), lambda a: F.when(a == "", T.trim(text)).otherwise(a))

    return T.let(T.let(T.strip_chat_links(result), cleaned), lambda x: T.cut(x, L.RESULT_CHARS, " [truncated]"))


def task_call(block: Column, links: Column) -> Column:
    """A Task call with what became of it: the answer of its run, or why there is none."""
    call = tool_call(block["tool_name"], block["tool_input"])
    prompt = F.coalesce(string_at(F.try_parse_json(block["tool_input"]), "$.prompt"), F.lit(""))
    status = lambda s: F.lit(f'{{"name": "{TASK}", "status": "{s}"}}')

    def told(link: Column) -> Column:
        done = F.to_json(F.struct(F.lit(TASK).alias("name"), inlined_result(link["result"]).alias("output"), F.lit("completed").alias("status")))
        return (
            F.when(link.isNull(), status("unresolved")).when(link["background"], status("spawned_in_background"))
            .when(link["match"] == "resume", status("resumed")).when(link["result"].isNull(), status("unresolved")).otherwise(done)
        )

    return F.concat(call, F.lit("\n\n```tool_result\n"), T.let(F.try_element_at(links, T.prompt_hash(prompt)), told), F.lit("\n```"))


def _pieces(o: ExportOptions) -> Column:
    def text(block: Column) -> Column:
        clean = T.strip_chat_links(block["text"]) if o.clean_assistant else block["text"]
        split = lambda t: T.let(T.split_thinking(t), lambda s: F.struct(s["thinking"].alias("thinking"), s["answer"].alias("answer"), t.alias("native"), F.lit(False).alias("tool")).cast(_PIECE))
        return T.let(T.trim(clean), lambda t: F.when(t != "", split(t)))

    def tool(said: Column) -> Column:
        return F.struct(F.lit("").alias("thinking"), said.alias("answer"), said.alias("native"), F.lit(True).alias("tool")).cast(_PIECE)

    def piece(block: Column) -> Column:
        out = F.when(block["kind"] == "text", text(block))
        call = block["kind"] == "tool_use"
        if o.inline:  # sessions that have no map of links are not parents: their Task calls are ordinary calls
            out = out.when(call & (block["tool_name"] == TASK) & F.col("links").isNotNull(), tool(task_call(block, F.col("links"))))
        if o.include_tool_calls:
            out = out.when(call, tool(tool_call(block["tool_name"], block["tool_input"])))
        return out

    return F.filter(F.transform("blocks", piece), lambda p: p.isNotNull())


def render(segmented: DataFrame, links: DataFrame | None = None, o: ExportOptions = ExportOptions()) -> DataFrame:
    """(path, turn_id, user, thinking, answer, native) of every turn; ``links`` as made by ``linkage.by_hash``.

    Windows, the join with links and the grouping all go by path, so one exchange serves them.
    """
    rows = segmented
    if o.inline:
        if links is None:
            rows = rows.withColumn("links", F.lit(None).cast("map<string,struct<background:boolean,match:string,result:string>>"))
        else:
            rows = rows.join(links, "path", "left")
    rows = rows.withColumns({"_user": F.when(F.col("role") == "user", _user(o)), "_pieces": F.when(F.col("role") == "assistant", _pieces(o))})
    ordered = lambda c: F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("line_index", F.col(c).alias("x")))))
    turns = rows.groupBy("path", "turn_id").agg(ordered("_user").alias("u"), ordered("_pieces").alias("a"))
    spoken = F.slice("a", -1, 1) if o.final_response_only else F.col("a")
    spoken = F.when(F.size("a") > 0, F.flatten(F.transform(spoken, lambda m: m["x"]))).otherwise(F.array().cast(f"array<{_PIECE}>"))
    turns = turns.select("path", "turn_id", F.array_join(F.transform("u", lambda m: m["x"]), "\n\n").alias("user"), spoken.alias("p"))
    joined = lambda field: F.array_join(F.filter(F.transform("p", lambda x: x[field]), lambda s: ~T.is_blank(s)), "\n\n")
    answer = joined("answer")
    if o.clean_assistant:
        answer = F.when(F.exists("p", lambda x: x["tool"]), answer).otherwise(T.strip_trailing_intent(answer))
    said = {"thinking": joined("thinking"), "answer": answer, "native": joined("native")}
    final = {k: T.redact_secrets(T.trim(v)) if o.redact_secrets else T.trim(v) for k, v in said.items()}
    return turns.select("path", "turn_id", "user", *(v.alias(k) for k, v in final.items()))


def trainable(turns: DataFrame) -> DataFrame:
    """Turns with both a question and an answer."""
    return turns.where(~T.is_blank("user") & ~T.is_blank("answer"))


def sft_assistant(thinking: Column | str, answer: Column | str, native: Column | str, mode: str) -> Column:
    thinking, answer, native = (F.col(c) if isinstance(c, str) else c for c in (thinking, answer, native))
    if mode == "strip":
        return answer
    if mode == "verbatim":
        return native
    tagged = F.concat(F.lit("<think>\n"), T.neutralize_think_tags(T.trim(thinking)), F.lit("\n</think>\n\n"), T.neutralize_think_tags(answer))
    return F.when(T.is_blank(thinking), answer).otherwise(tagged)


def cpt_assistant(answer: Column | str, native: Column | str, mode: str) -> Column:
    answer, native = (F.col(c) if isinstance(c, str) else c for c in (answer, native))
    return answer if mode == "strip" else native
