"""Text functions as column expressions.

Lengths are code points where the name says chars and bytes where it says bytes; white space is Unicode's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with the value computed once per row however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trim(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+\z", "")


def collapse(c: Column | str) -> Column:
    """White space runs become one space; none at the ends."""
    return trim(F.regexp_replace(_col(c), r"(?U)\s+", " "))


def is_blank(c: Column | str) -> Column:
    return F.coalesce(~_col(c).rlike(r"(?U)\S"), F.lit(True))


def ascii_lower(c: Column | str) -> Column:
    return F.translate(_col(c), UPPER, LOWER)


def contains_folded(c: Column | str, needle: str) -> Column:
    """ASCII-case-insensitive search."""
    return F.contains(ascii_lower(c), F.lit(needle.translate(str.maketrans(UPPER, LOWER))))


def cut(c: Column | str, chars: int, mark: str = "…") -> Column:
    c = _col(c)
    return F.when(F.length(c) > chars, F.concat(F.substring(c, 1, chars), F.lit(mark))).otherwise(c)


def title(query: Column | str) -> Column:
    return cut(collapse(query), L.TITLE_CHARS)


def slug_hint(slug: Column | str) -> Column:
    """A workspace path guessed from a project slug; all-digit slugs hold none."""
    slug = _col(slug)
    return F.when(slug.rlike("^[0-9]*$") & (slug != ""), "").otherwise(F.concat(F.lit("/"), F.translate(slug, "-", "/")))


def slug_name(slug: Column | str) -> Column:
    slug = _col(slug)
    last = F.element_at(F.split(slug, "-"), -1)
    return F.when(slug.rlike("^[0-9]+$"), F.concat(F.lit("project "), slug)).when(last == "", slug).otherwise(last)


def extract_query(c: Column | str) -> Column:
    """All <user_query> texts, trimmed and joined by a blank line; null if there are none. An unclosed tag takes the rest."""
    found = F.regexp_extract_all(_col(c), F.lit(r"(?s)<user_query>(.*?)(?:</user_query>|\z)"), F.lit(1))
    return F.nullif(F.array_join(F.filter(F.transform(found, trim), lambda x: x != ""), "\n\n"), F.lit(""))


def extract_timestamp(c: Column | str) -> Column:
    return F.nullif(trim(F.regexp_extract(_col(c), r"(?s)<timestamp>(.*?)</timestamp>", 1)), F.lit(""))


def starts_with_any(c: Column | str, phrases: tuple[str, ...]) -> Column:
    """``phrases`` hold letters, apostrophes, commas and spaces alone, so they stand in a pattern as they are."""
    return _col(c).rlike(r"\A(?:" + "|".join(phrases) + ")")


def contains_any(c: Column | str, phrases: tuple[str, ...]) -> Column:
    return _col(c).rlike("|".join(phrases))


def count_phrases(c: Column | str, phrases: tuple[str, ...]) -> Column:
    """How many of the phrases occur; they may overlap."""
    return F.size(F.filter(F.split(F.lit("|".join(phrases)), r"\|"), lambda phrase: F.contains(c, phrase)))


def is_injected(query: Column | str) -> Column:
    """A user record without a query, or with one that the harness wrote."""
    query = _col(query)
    return query.isNull() | starts_with_any(F.regexp_replace(query, r"(?U)^\s+", ""), L.INJECTED_PREFIXES)


def plain_apostrophes(c: Column | str) -> Column:
    return F.translate(_col(c), "’‘ʼ", "'''")


def has_structure(c: Column | str) -> Column:
    """A code fence, list, table, heading or numbered line: something made to be delivered."""
    c = _col(c)
    return F.contains(c, F.lit("```")) | c.rlike(r"(?m)^[^\S\n]*(- |\* |\| |#|[0-9]\. )")


def _plans(plain: Column) -> Column:
    first = plain.rlike(r"\AI[ ']")
    about = F.startswith(plain, F.lit("The user")) & contains_any(plain, L.PLANNING)
    return first | about | (count_phrases(plain, L.MARKERS) >= 2)


def is_deliberation(c: Column | str) -> Column:
    """Planning prose: two markers of it, or a first-person start, or plans about what the user wants."""
    return let(trim(c), lambda t: (F.octet_length(t) >= 40) & ~has_structure(t) & let(plain_apostrophes(t), _plans))


def is_headerless_deliberation(c: Column | str) -> Column:
    def verdict(t: Column, plain: Column) -> Column:
        size = F.octet_length(t)
        strong, weak = starts_with_any(plain, L.STRONG_OPENERS), starts_with_any(plain, L.WEAK_OPENERS)
        short = (size >= 60) | (~F.contains(t, F.lit("\n")) & (size >= 10))
        kept = has_structure(t) | F.startswith(plain, F.lit("Let me know"))
        return ~kept & F.when(strong, short).when(size < 60, False).otherwise(weak & is_deliberation(t))

    return let(trim(c), lambda t: let(plain_apostrophes(t), lambda plain: verdict(t, plain)))


HEADER = r"^\*\*[A-Z][^*\n]{2,70}\*\*$"


def normalize_header_breaks(c: Column | str) -> Column:
    """A blank line before each bold header line that follows a line of text."""

    def apart(lines: Column) -> Column:
        glued = lambda x, i: trim(x).rlike(HEADER) & (i > 0) & ~is_blank(F.try_element_at(lines, i))
        return F.transform(lines, lambda x, i: F.when(glued(x, i), F.concat(F.lit("\n"), x)).otherwise(x))

    return F.array_join(let(F.split(_col(c), "\n"), apart), "\n")


def _look(text: Column) -> Column:
    """What a paragraph is by itself: bare header, narration of its own, or plans that a bare header before it makes narration."""

    def of(lines: Column) -> Column:
        body = F.array_join(F.slice(lines, 2, F.size(lines)), " ")
        return F.struct(text.alias("text"), trim(F.element_at(lines, 1)).rlike(HEADER).alias("head"), body.alias("body"))

    def judged(p: Column) -> Column:
        bare = p["head"] & is_blank(p["body"])
        own = F.when(p["head"], ~bare & is_deliberation(p["body"])).otherwise(is_headerless_deliberation(p["text"]))
        return F.struct(p["text"].alias("text"), bare.alias("bare"), own.alias("own"), (~p["head"] & is_deliberation(p["text"])).alias("plan"))

    return let(let(F.split(text, "\n"), of), judged)


def split_thinking(c: Column | str) -> Column:
    """struct(thinking, answer): paragraphs of planning narration, and the rest. Headers of narration go with it."""

    def flagged(told: Column) -> Column:
        at = lambda i, field: F.coalesce(F.when(i >= 0, F.try_element_at(told, F.greatest(i, F.lit(0)) + 1)[field]), F.lit(False))
        think = lambda p, i: p["own"] | (p["bare"] & at(i + 1, "plan")) | (p["plan"] & at(i - 1, "bare"))
        return F.transform(told, lambda p, i: F.struct(p["text"].alias("text"), think(p, i).alias("think")))

    def parted(parts: Column) -> Column:
        thinking = F.filter(F.transform(F.filter(parts, lambda p: p["think"]), lambda p: trim(p["text"])), lambda x: x != "")
        answer = F.transform(F.filter(parts, lambda p: ~p["think"]), lambda p: p["text"])
        return F.struct(trim(F.array_join(thinking, "\n\n")).alias("thinking"), trim(F.array_join(answer, "\n\n")).alias("answer"))

    told = F.transform(F.split(normalize_header_breaks(c), "\n\n"), _look)
    return let(let(told, flagged), parted)


def strip_chat_links(c: Column | str) -> Column:
    """[label](uuid) becomes label; other links stay."""
    uuid = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
    return F.regexp_replace(_col(c), rf"\[([^\]]+)\]\({uuid}\)", "$1")


def clean_answer(c: Column | str) -> Column:
    return split_thinking(strip_chat_links(c))["answer"]


def _cut_intent(right: Column) -> Column:
    def cut_off(last: Column) -> Column:
        said = contains_any(plain_apostrophes(last), L.INTENTS)
        drop = (F.octet_length(last) < 300) & ~F.contains(last, F.lit("\n")) & last.rlike(r"[.!…]\z") & said & ~F.endswith(right, F.lit("`"))
        return F.when(drop, F.substring(right, F.lit(1), F.length(right) - F.length(last))).otherwise(right)

    return let(F.regexp_extract(right, r"(?s)(?:.*\n\n)?(?:.*[.!?][ \t\n\r\f])?(.*)\z", 1), cut_off)


def strip_trailing_intent(c: Column | str, rounds: int = 4) -> Column:
    """Cut up to four last sentences that only announce what comes next."""
    text = _col(c)
    for _ in range(rounds):
        text = let(F.regexp_replace(text, r"(?U)\s+\z", ""), _cut_intent)
    return F.regexp_replace(text, r"(?U)\s+\z", "")


def neutralize_think_tags(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"<(/?)think>", "<​$1think>")


def prompt_hash(c: Column | str) -> Column:
    return F.substring(F.sha2(collapse(c), 256), 1, 16)


_ANY = "|".join(sorted([*" ".join(L.EXTENSIONS[k] for k in ("image", "video", "audio", "document")).split(), *L.EXTRACTED_READABLE.split()], key=len, reverse=True))
MEDIA_PATH = r"""(?iU)(/[^\s"'`<>|*?\x00\\]+\.(?:""" + _ANY + "))"


def media_paths(c: Column | str) -> Column:
    """Absolute paths of media files in running text, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(_col(c), F.lit(MEDIA_PATH), F.lit(1)))


def extension(path: Column | str) -> Column:
    return ascii_lower(F.regexp_extract(_col(path), r"\.([^./]+)\z", 1))


def media_kind(path: Column | str) -> Column:
    named = [(ext, kind) for kind, names in L.EXTENSIONS.items() for ext in names.split()]
    return F.coalesce(F.try_element_at(_map(named), extension(path)), F.lit("other"))


def mime_type(path: Column | str) -> Column:
    return F.coalesce(F.try_element_at(_map(L.MIME_TYPES.items()), extension(path)), F.lit("application/octet-stream"))


def _map(pairs) -> Column:
    return F.str_to_map(F.lit(",".join(f"{k}={v}" for k, v in pairs)), F.lit(","), F.lit("="))


def attachment_name(path: Column | str) -> Column:
    base = F.regexp_replace(F.element_at(F.split(_col(path), "/"), -1), r"[^A-Za-z0-9._-]", "_")
    return F.concat(F.substring(F.sha2(_col(path), 256), 1, 8), F.lit("-"), base)


def file_name(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), "[^A-Za-z0-9_-]", "_")


def index_snippet(c: Column | str) -> Column:
    return F.substring(collapse(c), 1, L.SNIPPET_CHARS)


def _bytes_before(text: Column, least: int) -> Column:
    """The shortest tail of ``text`` that has at least so many bytes, in whole characters."""
    grow = lambda acc, ch: F.when(F.octet_length(acc) >= least, acc).otherwise(F.concat(ch, acc))
    return F.aggregate(F.reverse(F.split(F.substring(text, -least, least), "")), F.lit(""), grow)


def _bytes_after(text: Column, least: int) -> Column:
    grow = lambda acc, ch: F.when(F.octet_length(acc) >= least, acc).otherwise(F.concat(acc, ch))
    return F.aggregate(F.split(F.substring(text, 1, least), ""), F.lit(""), grow)


def match_snippet(line: Column | str, needle: str) -> Column:
    """The text around the first match, with marks on both sides; escapes of JSON lines are undone. Null without a match."""
    line, size = _col(line), len(needle)

    def around(at: Column) -> Column:
        before = _bytes_before(F.substring(line, F.lit(1), at - 1), L.CONTEXT_BYTES)
        after = _bytes_after(F.substring(line, at + size, F.lit(L.CONTEXT_BYTES)), L.CONTEXT_BYTES)
        text = F.concat(before, F.substring(line, at, F.lit(size)), after)
        plain = F.replace(F.replace(F.replace(text, F.lit("\\n"), F.lit(" ")), F.lit("\\t"), F.lit(" ")), F.lit('\\"'), F.lit('"'))
        return F.when(at > 0, F.concat(F.lit("…"), trim(plain), F.lit("…")))

    return let(F.instr(ascii_lower(line), needle.translate(str.maketrans(UPPER, LOWER))), around)


def scan_secrets(c: Column | str) -> Column:
    """map(family -> matches) of the public credential formats, families without a match left out."""
    entries = F.array(*(F.struct(F.lit(k).alias("key"), F.size(F.regexp_extract_all(_col(c), F.lit(p), F.lit(0))).cast("long").alias("value")) for k, p in L.SECRET_FAMILIES.items()))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"] > 0))


def redact_secrets(c: Column | str) -> Column:
    out = _col(c)
    for kind, pattern in L.SECRET_FAMILIES.items():
        out = F.regexp_replace(out, pattern, f"[redacted:{kind}]")
    return out


def short_timestamp(c: Column | str) -> Column:
    """"Tuesday, Jul 7, 2026, 2:35 PM (UTC+2)" -> "Jul 7, 2:35 PM"."""
    return F.regexp_replace(F.regexp_extract(_col(c), r"([A-Z][a-z]{2} \d{1,2}, \d{4}, \d{1,2}:\d{2} [AP]M)", 1), r", \d{4},", ",")


def size_label(c: Column | str) -> Column:
    """Bytes below a KB, whole KB (halves up) below a MB, then MB with one digit."""
    n = _col(c)
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1 << 20, F.format_string("%d KB", F.floor(n / 1024 + 0.5))).otherwise(F.format_string("%.1f MB", n / (1 << 20)))


def date_label(unix: Column | str, zone: str = "UTC") -> Column:
    """"07/07/2026, 02:35 PM" in the given time zone; "?" for no time and for time zero."""
    unix = _col(unix)
    utc = F.timestamp_add("SECOND", unix, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.when(unix.isNull() | (unix == 0), "?").otherwise(F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), utc), "MM/dd/yyyy, hh:mm a"))


def url_decode(c: Column | str) -> Column:
    """Percent escapes undone; a plus stays, and so does a percent sign that starts no escape. Bytes that are not UTF-8 become U+FFFD."""
    safe = F.regexp_replace(F.replace(_col(c), F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.url_decode(safe)


def expand_home(c: Column | str, home: str) -> Column:
    c = _col(c)
    return F.when(F.startswith(c, F.lit("~/")), F.concat(F.lit(home.rstrip("/")), F.substring(c, F.lit(2), F.length(c)))).otherwise(c)


def preview(c: Column | str, chars: int = L.PREVIEW_CHARS) -> Column:
    """The start of a long text, cut before a code fence that would stay open, else at a line end past 60 % of the length."""
    c = _col(c)

    def cut_off(head: Column) -> Column:
        fences = F.size(F.split(head, "```")) - 1
        before = F.regexp_extract(head, r"(?s)\A(.*)```", 1)
        line = F.regexp_extract(head, r"(?s)\A(.*)\n", 1)
        fenced = (fences % 2 == 1) & (before != "")
        return F.when(fenced, F.regexp_replace(before, r"(?U)\s+\z", "")).when(F.length(line) > chars * 0.6, line).otherwise(head)

    return F.when(F.length(c) <= chars, c).otherwise(let(F.substring(c, 1, chars), cut_off))


def fence_parts(c: Column | str) -> Column:
    """array(struct(code, text)): prose and code between fences in turn, without language names and empty prose."""
    parts = F.transform(
        F.split(_col(c), "```"),
        lambda x, i: F.struct((i % 2 == 1).alias("code"), F.when(i % 2 == 1, F.regexp_replace(x, r"\A[A-Za-z0-9_+-]*\n", "")).otherwise(x).alias("text")),
    )
    return F.filter(parts, lambda p: p["code"] | (p["text"] != ""))


def highlighted(c: Column | str, term: str) -> Column:
    """array(struct(hit, text)): the text cut at every occurrence of the term, letter case aside."""
    if not term:
        return F.filter(F.array(F.struct(F.lit(False).alias("hit"), _col(c).alias("text"))), lambda p: p["text"] != "")
    quoted = "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    pieces = F.regexp_extract_all(_col(c), F.lit(f"(?isu){quoted}|.+?(?={quoted}|\\z)"), F.lit(0))
    return F.transform(pieces, lambda x: F.struct(x.rlike(f"(?isu)\\A{quoted}\\z").alias("hit"), x.alias("text")))


def tool_summary(name: Column | str, tool_input: Column | str) -> Column:
    """The tool's name, and the first of the telling fields of its JSON input that is a string, cut."""
    name = _col(name)

    def told(given: Column) -> Column:
        field = lambda k: F.try_variant_get(given, f"$.{k}", "variant")
        texts = [F.when(F.schema_of_variant(field(k)) == "STRING", F.try_variant_get(given, f"$.{k}", "string")) for k in L.TELLING_FIELDS]
        return let(F.coalesce(*texts), lambda x: F.when(x.isNull(), name).otherwise(F.concat(name, F.lit(": "), cut(x, L.SUMMARY_CHARS))))

    return let(F.try_parse_json(_col(tool_input)), told)
