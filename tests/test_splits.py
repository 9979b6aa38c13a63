"""Lines read in byte ranges against a sequential reader."""

import os
import random

import pytest
from pyspark.sql import functions as F

from convoforge.sources import splits, transcripts


def sequential(data):
    lines = data.decode(errors="replace").split("\n")
    return [x.removesuffix("\r") for x in (lines[:-1] if lines[-1] == "" else lines)]


def put(folder, name, data):
    f = folder / "p" / "agent-transcripts" / f"{name}.jsonl"
    f.parent.mkdir(parents=True, exist_ok=True)
    f.write_bytes(data)
    return str(f)


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    folder, rng = tmp_path_factory.mktemp("odd"), random.Random(4)
    texts = {
        "plain": b"a\nbb\nccc\n", "torn": b"a\nbb\n{torn", "empty": b"", "one": b"x", "breaks": b"\n" * 57, "crlf": b"a\r\nb\r\n\r\nlast\r",
        "bad": b"ok\n\xff\xfe\xff\nok\xe2\x82\nmore", "long": b"x" * 5000 + b"\n" + b"y" * 40 + b"\n" + b"z" * 3000,
        "many": b"\n".join(bytes(rng.choices(b"abc \r\xc3\xa9", k=rng.randrange(0, 90))) for _ in range(700)),
    }
    return folder, {put(folder, k, v): v for k, v in texts.items()}


@pytest.mark.parametrize("size", [1, 7, 64, 1000, 1 << 20])
def test_ranges_give_the_lines_of_a_sequential_reader(spark, odd, size, monkeypatch):
    folder, texts = odd
    small = {p: v for p, v in texts.items() if size > 1 or len(v) < 100}
    files = transcripts.session_files(spark, str(folder)).where(F.col("path").isin(list(small)))
    got = {}
    for r in splits.lines(files, size).collect():
        got.setdefault(r["path"], {})[r["line_index"]] = r["line"]
    for p, data in small.items():
        want = sequential(data)
        if "bad" in p:  # how many U+FFFD stand for bytes is the engine's choice
            assert sorted(got[p]) == list(range(len(want))) and got[p][0] == "ok" and "�" in got[p][1] + got[p][2]
        else:
            assert got.get(p, {}) == dict(enumerate(want)), p


def test_small_files_are_not_counted_and_missing_ones_do_no_harm(spark, odd):
    folder, texts = odd
    ranges = splits.splits(transcripts.session_files(spark, str(folder)), 1 << 20)
    assert ranges.where("end < size_bytes").count() == 0 and ranges.count() == len([v for v in texts.values() if v])
    gone = spark.createDataFrame([("/no/such.jsonl", "/no/such.jsonl", 500)], "path string, uri string, size_bytes long")
    assert splits.lines(gone, 64).count() == 0 and splits.lines(gone.limit(0)).count() == 0


def test_reading_begins_where_it_is_told_and_keeps_needles(spark, odd):
    folder, texts = odd
    files = transcripts.session_files(spark, str(folder)).where("path like '%many%'")
    (data,) = [v for p, v in texts.items() if "many" in p]
    at = data.index(b"\n", len(data) // 2) + 1
    tail = splits.read_lines(splits.numbered(splits.splits(files.withColumn("start", F.lit(at)), 512)))
    assert [r["line"] for r in tail.orderBy("line_index").collect()] == sequential(data[at:])
    found = splits.lines(files, 512, "BA").collect()
    assert sorted(r["line_index"] for r in found) == [i for i, x in enumerate(sequential(data)) if "ba" in x]


def test_records_of_large_and_small_reading_agree(spark, odd):
    folder, _ = odd
    by_range, whole = (transcripts.numbered_lines(f(spark, str(folder))).where("line <> ''") for f in (transcripts.session_files, transcripts.read_files))
    assert sorted(map(tuple, by_range.select("path", "line_index", "line").collect())) == sorted(map(tuple, whole.select("path", "line_index", "line").collect()))


@pytest.mark.skipif(not os.environ.get("LARGE_FILES"), reason="writes 3 GB; set LARGE_FILES to run it")
def test_one_file_of_three_gigabytes(spark, tmp_path):
    f = tmp_path / "p" / "agent-transcripts" / "big.jsonl"
    f.parent.mkdir(parents=True)
    block = b"".join(b"%07d" % i + b"x" * (i % 97) + b"\n" for i in range(60_000))
    n = 3 * (1 << 30) // len(block) + 1
    with f.open("wb") as out:
        for _ in range(n):
            out.write(block)
    rows = transcripts.numbered_lines(transcripts.session_files(spark, str(tmp_path))).withColumn("task", F.spark_partition_id())
    at = F.col("line_index") % 60_000
    bad = (F.substring("line", 1, 7).cast("long") != at) | (F.length("line") != 7 + at % 97)
    said = rows.agg(F.count("*").alias("n"), F.max("line_index").alias("last"), F.count_if(bad).alias("bad"), F.countDistinct("task").alias("tasks")).first()
    assert (said["n"], said["last"], said["bad"]) == (60_000 * n, 60_000 * n - 1, 0) and said["tasks"] >= 16
