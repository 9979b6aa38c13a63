"""Secret scan in DataFrame operations alone: known formats, then a battery of randomness tests.

Known formats give the base spans. Beyond them, every long run of encoding characters is a candidate. Its encoding is
inferred (decimal, hexadecimal, letters of one case, base32, base36, base62 or base64), and each distinct candidate is
tested once against three pictures of ordinary text, all of which it must refute:

* characters: ordinary text uses an alphabet unevenly, so chi-squared grows with the length; a small value refutes it;
* runs: ordinary text seldom changes between digits, small and capital letters; many runs refute it;
* serial correlation: counters and alphabets step evenly; a correlation of neighbours well above zero is a veto.

Where both of the first two speak for chance, their p-values are combined by Fisher's method, else the larger counts;
runs say nothing about an alphabet of one class. The result is never below Fisher's, so it stays a p-value. Long candidates get more weight (their tests have more power; the mean weight
is one), and a Benjamini-Hochberg step on the weighted p-values of all distinct candidates holds the share of false
discoveries at ``false_rate``. It reads the p-values from a histogram of fixed size. Candidates that touch a base span are
no hypotheses: they are left out before the step. Spans of accepted candidates are added as kind ``random``.

Defined results: other columns, whatever their names, are carried by ``redact`` and ignored by ``report``; null and empty texts have no spans; repeated rows are each reported; a null doc_id is kept; an empty
table gives an empty result; offsets are code points, ends exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

#: Kinds in the order in which spans that start together are listed; pattern and, for some, the least length.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = ("assign", "access", "hex", "random")
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
ANY = r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]{16}|[A-Za-z0-9+/_-]{20}"
ORDER = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/-_="


@dataclass(frozen=True)
class Params:
    """``uneven``: how far ordinary text departs from a uniform alphabet; ``change``: how often neighbours in it change class;
    ``agree``: p-values up to which both tests are combined."""

    false_rate: float = 0.05
    uneven: float = 1.0
    letter_coincidence: float = 0.065
    change: float = 0.12
    correlation: float = 0.5
    agree: float = 0.2
    correlation_deviations: float = 3.0
    weight_length: int = 64
    bin_width: float = 0.05
    bins: int = 400


def _found(text: Column) -> Column:
    """For each kind: lengths of the stretches between matches, and the matches, leftmost first."""

    def one(kind: str, pattern: str) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
        return F.struct(F.lit(kind).alias("kind"), gaps.alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"))

    patterns = zip(KINDS, (ASSIGN, ACCESS, HEX, CANDIDATE), strict=True)
    return F.when(text.rlike(ANY), F.filter(F.array(*(one(k, p) for k, p in patterns)), lambda x: F.size(x["matches"]) > 0))


def _phi(z: Column) -> Column:
    """The normal distribution function, by its logistic approximation."""
    return 1 / (1 + F.exp(F.greatest(F.least(-(1.5976 * z + 0.070565992 * z * z * z), F.lit(700.0)), F.lit(-700.0))))


def p_values(tokens: DataFrame, p: Params = Params()) -> DataFrame:
    """Adds ``p`` to distinct ``token`` rows: the chance at most that ordinary text looks as random as this.

    The work is in the rows, which are few bytes: they are dealt over all tasks.
    """
    tasks = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bare = F.regexp_replace("token", "=+$", "")
    size = (
        F.when(F.col("bare").rlike("^[0-9]+$"), 10).when(F.col("bare").rlike("^([0-9a-f]+|[0-9A-F]+)$"), 16).when(F.col("bare").rlike("^([a-z]+|[A-Z]+)$"), 26).when(F.col("bare").rlike("^[A-Z2-7]+$"), 32)
        .when(F.col("bare").rlike("^([0-9a-z]+|[0-9A-Z]+)$"), 36).when(F.col("bare").rlike("^[0-9A-Za-z]+$"), 62).otherwise(64)
    )
    rows = tokens.repartition(tasks, F.xxhash64("token", F.lit(1))).withColumn("bare", bare).withColumn("k", size.cast("double")).withColumn("chars", F.split("bare", ""))
    rows = rows.withColumn("chars", F.filter("chars", lambda c: c != "")).withColumn("n", F.size("chars").cast("double"))
    times = lambda c: F.length("bare") - F.length(F.replace("bare", c))  # noqa: E731  signs are ASCII
    squares = F.aggregate(F.array_distinct("chars"), F.lit(0.0), lambda s, c: s + F.pow(times(c).cast("double"), F.lit(2.0)))
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    rows = rows.withColumn("chi", F.col("k") * squares / F.col("n") - F.col("n"))
    rows = rows.withColumn("joined", F.regexp_replace("bare", "[^0-9A-Za-z]", ""))  # signs between words are no change of class, nor is the small letter after a capital
    rows = rows.withColumn("runs", F.size(F.regexp_extract_all(F.col("joined"), F.lit("[0-9]+|[A-Z]?[a-z]+|[A-Z]+"), F.lit(0))).cast("double"))
    rows = rows.withColumn("codes", F.transform("chars", lambda c: F.instr(F.lit(ORDER), c).cast("double")))
    rows = rows.withColumn("mean", add("codes") / F.col("n"))
    rows = rows.withColumn("dev", F.transform("codes", lambda x: x - F.col("mean")))
    spread = add(F.transform("dev", lambda d: d * d))
    pairs = F.zip_with(F.expr("slice(dev, 1, size(dev) - 1)"), F.expr("slice(dev, 2, size(dev) - 1)"), lambda a, b: a * b)
    rows = rows.withColumn("serial", F.when(spread > 0, add(pairs) / spread).otherwise(1.0))
    shift = F.col("n") * F.greatest(F.lit(p.uneven), p.letter_coincidence * F.col("k") - 1)
    chi = _phi((F.col("chi") - (F.col("k") - 1) - shift) / F.sqrt(2 * (F.col("k") - 1) + 4 * shift))
    steps = F.greatest(F.length("joined") - 1, F.lit(1)).cast("double")
    runs = _phi((steps * p.change - (F.col("runs") - 1)) / F.sqrt(steps * p.change * (1 - p.change)))
    rows = rows.select("token", "n", "k", "serial", chi.alias("chi"), runs.alias("runs"))
    larger, product = F.greatest("chi", "runs"), F.greatest(F.col("chi") * F.col("runs"), F.lit(1e-300))
    both = F.when(larger <= p.agree, product * (1 - F.log(product))).otherwise(larger)
    even = F.abs("serial") >= F.greatest(F.lit(p.correlation), p.correlation_deviations / F.sqrt("n"))
    tested = F.when(even, F.lit(1.0)).when(F.col("k").isin(10, 26), F.col("chi")).otherwise(both)
    return rows.select("token", F.col("n").cast("int").alias("n"), tested.alias("p"))


def discoveries(tested: DataFrame, p: Params = Params()) -> DataFrame:
    """The tokens whose weighted p-value passes the Benjamini-Hochberg step."""
    weight = F.sqrt(F.least(F.col("n"), F.lit(p.weight_length)).cast("double"))
    total = tested.agg(F.count("*").alias("m"), F.avg(weight).alias("mean")).first()
    if not total["m"]:
        return tested.select("token").limit(0)
    level = -F.log10(F.greatest(F.col("p") * total["mean"] / weight, F.lit(1e-300)))
    binned = tested.withColumn("bin", F.least(F.floor(level / p.bin_width), F.lit(p.bins)).cast("int"))
    counts = {r["bin"]: r["n"] for r in binned.groupBy("bin").agg(F.count("*").alias("n")).collect()}  # at most bins + 1 rows
    passed, best = 0, p.bins + 1
    for b in range(p.bins, -1, -1):
        passed += counts.get(b, 0)
        if passed and total["m"] * 10 ** (-b * p.bin_width) <= p.false_rate * passed:
            best = b
    return binned.where(F.col("bin") >= best).select("token")


def spans(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per row of ``docs``: row, doc_id, text_hash, and ``found``, its spans in order (start, rank, kind, end)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64(text).alias("text_hash"), _found(text).alias("matched"))
    rows = written(rows, "secret-matches")
    each = rows.where("matched is not null").select("row", F.explode("matched").alias("m"))
    each = each.select("row", "m.kind", F.posexplode(F.arrays_zip(F.col("m.gaps").alias("gaps"), F.col("m.matches").alias("matches")))).where("col.matches is not null")
    each = each.select("row", "kind", "pos", F.col("col.gaps").alias("gap"), F.col("col.matches").alias("token"))
    before = F.sum(F.col("gap") + F.length("token")).over(Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    each = each.withColumn("end", before.cast("long")).withColumn("start", F.col("end") - F.length("token"))
    each = each.where((F.col("kind") != "assign") | (F.length(F.regexp_extract("token", ASSIGN, 1)) >= 6)).drop("pos", "gap")
    fixed = F.col("kind") != "random"
    by = Window.partitionBy("row").orderBy("start", "end")
    reach = F.max(F.when(fixed, F.col("end"))).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    follow = F.min(F.when(fixed, F.col("start"))).over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    alone = (F.coalesce(reach, F.lit(0)) <= F.col("start")) & (F.coalesce(follow, F.lit(1 << 60)) >= F.col("end"))
    each = written(each.withColumn("alone", alone).where(fixed | F.col("alone")).drop("alone"), "secret-spans")
    candidates = each.where("kind = 'random'")  # those that touch a base span are no hypotheses
    tested = written(p_values(candidates.select("token").distinct(), p), "secret-tests")
    base = each.where(fixed).select("row", "kind", "start", "end")
    every = base.unionByName(candidates.join(discoveries(tested, p), "token", "left_semi").select("row", "kind", "start", "end"))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    found = every.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end"))).alias("found"))
    return rows.select("row", "doc_id", "text_hash").join(found, "row", "left")


def _written_out(found: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","), F.lit(""))


def report(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """Counts of each kind, the digest of the base spans, and all spans written out."""
    rows = spans(docs, p)
    of = lambda kind: F.coalesce(F.size(F.filter("found", lambda s: s["kind"] == kind)), F.lit(0)).cast("long")
    count = lambda kind: F.when(F.col("found").isNull(), F.lit(0)).otherwise(of(kind)).cast("long").alias(f"n_{kind}")
    base = _written_out(F.filter("found", lambda s: s["kind"] != "random"))
    return rows.select("doc_id", *map(count, KINDS), F.sha2(base, 256).alias("base_sha256"), _written_out(F.col("found")).alias("spans"))


def redact(docs: DataFrame, marker: str = "[secret]", p: Params = Params()) -> DataFrame:
    """``docs`` with every span replaced by ``marker``; overlapping spans become one."""
    found = spans(docs.select("doc_id", "text"), p).where("found is not null").groupBy("doc_id", "text_hash").agg(F.first("found").alias("found"))
    merged = F.aggregate(
        "found",
        F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["end"] > s["start"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(done, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
    )
    found = found.withColumn("cut", F.when(F.size("found") > 0, merged)).drop("found")
    columns = [f"c{i}" for i in range(len(docs.columns))]  # other columns may have any name
    doc_id, text = (columns[docs.columns.index(c)] for c in ("doc_id", "text"))
    plain = docs.toDF(*columns).withColumns({"id_hash": F.xxhash64(doc_id), "text_hash": F.xxhash64(F.coalesce(text, F.lit("")))})
    found = found.select(F.xxhash64("doc_id").alias("id_hash"), "text_hash", "cut")
    rows = plain.join(found, ["id_hash", "text_hash"], "left")
    last = F.element_at("cut", -1)["end"]
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform("cut", lambda c: c["end"]))
    kept = F.zip_with(begins, "cut", lambda b, c: F.when(c.isNotNull(), F.substring(text, b.cast("int") + 1, (c["start"] - b).cast("int"))).otherwise(F.substring(text, b.cast("int") + 1, F.length(text))))
    clean = F.when(F.col("cut").isNull() | last.isNull(), F.col(text)).otherwise(F.array_join(kept, marker))
    return rows.withColumn(text, clean).select(*columns).toDF(*docs.columns)
