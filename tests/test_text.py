"""Text functions on small tables of cases with known results."""

import pytest
from pyspark.sql import functions as F

from convoforge.functions import text as T


def run(spark, make, texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in frame.orderBy("i").select(make(F.col("t"))).collect()]


def test_header_breaks_and_split(spark):
    plan = "**Looking at files**\n\nI need to read the files first and then I will decide what to do."
    texts = [plan + "\n\nHere is the answer.", "done.\n**Looking at files**\nI need to read the files and I will check them all.\n\nAnswer.", "**Result**\n\n- item one\n- item two", "plain answer", "", None, "Let me check the file.", "Let me know if that works."]
    got = run(spark, T.split_thinking, texts)
    assert got[0]["thinking"] == plan and got[0]["answer"] == "Here is the answer."
    assert got[1]["answer"] == "done.\n\nAnswer." and got[1]["thinking"].startswith("**Looking at files**\nI need")
    assert (got[2]["thinking"], got[2]["answer"]) == ("", texts[2])
    assert (got[3]["thinking"], got[3]["answer"]) == ("", "plain answer")
    assert (got[4]["thinking"], got[4]["answer"]) == ("", "")
    assert got[6]["thinking"] == "Let me check the file." and got[7]["answer"] == texts[7]
    assert run(spark, T.normalize_header_breaks, ["a\n**Head line**\nb", "a\n\n**Head line**", "**Head line**\nb"]) == ["a\n\n**Head line**\nb", "a\n\n**Head line**", "**Head line**\nb"]


def test_curly_apostrophes_count(spark):
    assert run(spark, T.is_deliberation, ["I’ll read it and then I’m going to fix the two places.", "short I'll", "- I will and I need to list things in here now"]) == [True, False, False]


def test_trailing_intent(spark):
    texts = ["Done. Let me run it.", "Done. Now I'll check.\n\nLet me go!", "Let me know.", "code `Let me x.`", "Done. Let me ask?", "I am done.", "a. " + "Let me b. " * 6]
    assert run(spark, T.strip_trailing_intent, texts) == ["Done.", "Done.", "", "code `Let me x.`", "Done. Let me ask?", "I am done.", "a. Let me b. Let me b."]


@pytest.mark.parametrize("text,want", [("<user_query> a </user_query> x <user_query>b</user_query>", "a\n\nb"), ("<user_query>open", "open"), ("<user_query> </user_query>", None), ("none", None), ("<user_query>a<user_query>b</user_query>", "a<user_query>b"), ("```\n<user_query>in fence</user_query>```", "in fence")])
def test_queries(spark, text, want):
    assert run(spark, T.extract_query, [text]) == [want]


def test_names_and_paths(spark):
    assert run(spark, T.slug_name, ["123", "a-b-c", "a-", ""]) == ["project 123", "c", "a-", ""]
    assert run(spark, T.slug_hint, ["123", "a-b"]) == ["", "/a/b"]
    paths = run(spark, T.media_paths, ["see /a/b.png and '/c d/e.pdf' twice /a/b.png, /x.mdx //h.com/y.md /n.py", "/" + "a" * 100_000])
    assert paths == [["/a/b.png", "/e.pdf", "/x.md", "//h.com/y.md"], []]
    assert run(spark, T.media_kind, ["/a.PNG", "/a.py", "/a.mkv", "/a.opus", "/a.docx", "/a.zip", "/a"]) == ["image", "readable", "video", "audio", "document", "other", "other"]
    assert run(spark, T.short_timestamp, ["Tuesday, Jul 7, 2026, 2:35 PM (UTC+2)"]) == ["Jul 7, 2:35 PM"]
    assert run(spark, T.strip_chat_links, ["[a b](0a1b2c3d-0000-1111-2222-0123456789ab) [c](http://x)"]) == ["a b [c](http://x)"]


def test_snippets_count_bytes(spark):
    text = "é" * 100 + "Needle" + "x" * 200
    assert run(spark, lambda c: T.match_snippet(c, "needle"), [text, "none", 'a\\n\\"b needle'])[:3] == ["…" + "é" * 40 + "Needle" + "x" * 80 + "…", None, '…a "b needle…']


def test_redaction_is_complete(spark):
    texts = ["ghp_" + "a" * 36, "x AKIA" + "A" * 16, "Bearer " + "a1" * 15, "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY----- tail", "sk-" + "b" * 30, "nothing"]
    assert [len(x) for x in run(spark, T.scan_secrets, texts)] == [1, 1, 1, 1, 1, 0]
    assert run(spark, lambda c: T.scan_secrets(T.redact_secrets(c)), texts) == [{}] * 6
    assert run(spark, T.redact_secrets, texts)[3] == "[redacted:private_key] tail"


def test_think_tags_and_sizes(spark):
    assert run(spark, T.neutralize_think_tags, ["<think>a</think>"]) == ["<​think>a<​/think>"]
    assert run(spark, lambda c: T.size_label(c.cast("long")), ["10", "2048", "2560", "1048575", "3145728"]) == ["10 B", "2 KB", "3 KB", "1024 KB", "3.0 MB"]
    assert run(spark, T.is_blank, [None, "", "  \n", "x"]) == [True, True, True, False]


def test_previews_keep_fences_whole(spark):
    texts = ["a" * 5, "ab\n```py\ncode", "```" + "c" * 20, "abcdefgh\nij", "a\nbcdefghijk", None, "ab ```` cdefghi"]
    assert run(spark, lambda c: T.preview(c, 10), texts) == ["aaaaa", "ab", "```ccccccc", "abcdefgh", "a\nbcdefghi", None, "ab `"]
    parts = run(spark, T.fence_parts, ["a```py\nx```b", "```x", "", None])
    assert [p and [tuple(x) for x in p] for p in parts] == [[(False, "a"), (True, "x"), (False, "b")], [(True, "x")], [], None]


def test_highlights(spark):
    got = run(spark, lambda c: T.highlighted(c, "a.\\E"), ["xA.\\Ey a. a.\\ea.\\E", "", "none\n", None])
    assert [g and "".join(f"[{p.text}]" if p.hit else p.text for p in g) for g in got] == ["x[A.\\E]y a. [a.\\e][a.\\E]", [], "none\n", None]
    assert [len(g) for g in run(spark, lambda c: T.highlighted(c, ""), ["abc", ""])] == [1, 0]
    long = run(spark, lambda c: T.highlighted(c, "zz"), ["ab " * 300_000 + "zz"])[0]
    assert [p.hit for p in long] == [False, True]


def test_labels_of_tools_dates_and_paths(spark):
    inputs = ['{"description": "d", "command": "ls"}', '{"path": 1}', '{"path": ""}', "[1]", "broken", None, '{"url": "' + "u" * 70 + '"}']
    assert run(spark, lambda c: T.tool_summary(F.lit("Run"), c), inputs) == ["Run: ls", "Run", "Run: ", "Run", "Run", "Run", "Run: " + "u" * 66 + "…"]
    assert run(spark, lambda c: T.date_label(c.cast("long")), ["1783427700", "0", None]) == ["07/07/2026, 12:35 PM", "?", "?"]
    assert run(spark, lambda c: T.date_label(c.cast("long"), "Europe/Paris"), ["1783427700"]) == ["07/07/2026, 02:35 PM"]
    assert run(spark, T.url_decode, ["a%20b+c%", "%zz%41", "%C3%A9", "%ff", None]) == ["a b+c%", "%zzA", "é", "\ufffd", None]
    assert run(spark, lambda c: T.expand_home(c, "/h"), ["~/x", "~", "/~/x"]) == ["/h/x", "~", "/~/x"]
