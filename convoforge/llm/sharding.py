"""Shards of near-equal bytes by histogram sort, in DataFrame operations alone.

Rows are ordered by a hash of their text, then doc_id (its hash, where it is no integer), so that equal texts lie
together. Exact bytes and rows below candidate key boundaries are counted over all partitions, 256 candidates for each
open splitter and pass, of which the driver gets the one interval that holds the target; a splitter is done when the
bytes below one of its candidates meet the target within the tolerance, or when only a single key is left between two
candidates (then the nearer one is taken). Boundaries between hash values are tried first, and a shard ends inside a
group of equal texts only where the group holds more than ``group_share`` of a shard's bytes. Each shard is cut into
``parts`` ranges in the same way, one exchange brings the rows of a range together, and a row's slot follows from the
exact number of rows below its range and its place in the range. What comes to the driver or is broadcast is one row for
each splitter: ``shards`` and one for every ``parts_rows`` rows.

Defined results: a null text has no bytes (its checksum is that of no bytes); a null doc_id sorts first; repeated rows
are all placed, in neighbouring slots; with fewer rows than shards some shards stay empty; an empty table gives an
empty result; further columns, whatever their names, are carried along, but those named like the results are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .scratch import written

HEAD, STEP = 12, 8
LEAST = -(1 << 63)


@dataclass(frozen=True)
class Params:
    """``parts_rows``: rows a sorted range should hold at most; ``overhead`` counts for every row beside its bytes."""

    shards: int = 40
    tolerance: float = 0.001
    overhead: int = 16
    parts_rows: int = 2_000_000
    least_parts: int = 4
    group_share: float = 0.2


@dataclass(frozen=True)
class Splitter:
    """Rows whose (hash, doc) is below (``hash``, ``doc``) lie before it: so many rows and bytes."""

    hash: int
    doc: int
    rows: int
    bytes: int


def keyed(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """Adds sort_hash, size and text_crc32."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({
        "sort_hash": F.shiftrightunsigned(F.xxhash64(text), 1),
        "size": (F.octet_length(text) + p.overhead).cast("long"),
        "text_crc32": F.crc32(text.cast("binary")),
    })


def _doc(keys: DataFrame) -> Column:
    """doc_id, or its hash, as a number; nulls first."""
    integer = isinstance(keys.schema["doc_id"].dataType, IntegralType)
    value = F.col("doc_id").cast("long") if integer else F.xxhash64("doc_id")
    return F.when(F.col("doc_id").isNull(), F.lit(LEAST)).otherwise(value)


def splitters(keys: DataFrame, n: int, tolerance: float, parts: int = 1, group_share: float = 0.0) -> list[Splitter]:
    """The n - 1 boundaries of n ranges of near-equal bytes; every ``parts``-th spares groups of up to ``group_share`` of ``parts`` ranges."""
    total = keys.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).first()
    if not total["rows"]:
        return []
    goals = {i: total["bytes"] * i / n for i in range(1, n)}
    slack, spared = tolerance * total["bytes"] / n, group_share * total["bytes"] * parts / n
    done: dict[int, Splitter] = {}
    # A splitter yet open: hash and prefix of the interval that holds it, rows and bytes below that.
    open_: dict[int, tuple[int, int, int, int]] = {i: (0, 0, 0, 0) for i in goals}
    spark = keys.sparkSession
    rows = keys.select("sort_hash", _doc(keys).bitwiseXOR(F.lit(LEAST)).alias("doc"), "size")  # doc: unsigned order

    def refine(shift: int, was: int, by_doc: bool) -> None:
        """One pass: count below the boundaries at ``shift`` bits inside the open intervals, which are ``was`` bits wide."""
        column = "doc" if by_doc else "sort_hash"
        prefix = F.shiftrightunsigned(column, was) if was < 64 else F.lit(0)
        here = rows.select((F.col("sort_hash") if by_doc else F.lit(0)).cast("long").alias("hash"), prefix.cast("long").alias("prefix"), F.shiftrightunsigned(column, shift).alias("digit"), "size")
        goal = spark.createDataFrame([(h, x, i, float(goals[i] - b)) for i, (h, x, _, b) in open_.items()], "hash long, prefix long, i int, goal double")
        counted = here.join(F.broadcast(goal.select("hash", "prefix").distinct()), ["hash", "prefix"]).groupBy("hash", "prefix", "digit")
        by = Window.partitionBy("hash", "prefix").orderBy(F.col("digit").bitwiseXOR(F.lit(LEAST))).rowsBetween(Window.unboundedPreceding, 0)
        counted = counted.agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
        counted = counted.withColumns({"rows_to": F.sum("rows").over(by), "bytes_to": F.sum("bytes").over(by)})
        held = (F.col("goal") <= F.col("bytes_to")) & (F.col("goal") > F.col("bytes_to") - F.col("bytes"))
        for r in counted.join(F.broadcast(goal), ["hash", "prefix"]).where(held).drop("goal").collect():
            i, digit = r["i"], r["digit"] % (1 << 64)
            name, _, below_rows, below_bytes = open_.pop(i)
            after_rows, after_bytes = below_rows + r["rows_to"], below_bytes + r["bytes_to"]
            below_rows, below_bytes = after_rows - r["rows"], after_bytes - r["bytes"]
            low_miss, high_miss = goals[i] - below_bytes, after_bytes - goals[i]
            single = shift == 0 and (by_doc or (i % parts == 0 and r["bytes"] <= spared))
            if min(low_miss, high_miss) <= slack or r["rows"] == 1 or single:
                edge, counts = (digit << shift, (below_rows, below_bytes)) if low_miss <= high_miss else ((digit + 1) << shift, (after_rows, after_bytes))
                done[i] = Splitter(*((name, edge) if by_doc else (edge, 0)), *counts)
            else:
                where = (name, r["digit"]) if by_doc else (r["digit"], 0) if shift == 0 else (0, r["digit"])
                open_[i] = (*where, below_rows, below_bytes)

    was, shift = 63, 63 - HEAD
    while open_ and was > 0:
        refine(shift, was, False)
        was, shift = shift, max(shift - STEP, 0)
    if open_:
        ends = rows.join(F.broadcast(spark.createDataFrame([(h,) for h, *_ in open_.values()], "sort_hash long").distinct()), "sort_hash")
        ends = ends.agg(F.min(F.col("doc").bitwiseXOR(F.lit(LEAST))), F.max(F.col("doc").bitwiseXOR(F.lit(LEAST)))).first()
        low, high = (x - LEAST for x in ends)
        was = -(-max((low ^ high).bit_length(), 1) // STEP) * STEP
        common = low >> was if was < 64 else 0
        open_.update({i: (h, common, *below) for i, (h, _, *below) in open_.items()})
        while open_ and was > 0:
            refine(was - STEP, was, True)
            was -= STEP
    return [done[i] for i in sorted(done)]


def assign(docs: DataFrame, p: Params = Params(), keys: DataFrame | None = None) -> DataFrame:
    """Adds shard and slot to ``docs``. ``keys``: a table of its sort_hash, doc_id and size, if it is at hand."""
    made = ["shard", "slot", "sort_hash", "size", "text_crc32"]
    if keys is None:
        docs = keyed(docs.drop(*made), p)
        keys = written(docs.select("sort_hash", "doc_id", "size"), "shard-keys")
    spark = docs.sparkSession
    parts = max(p.least_parts, -(-keys.count() // (p.shards * p.parts_rows)))
    cuts = splitters(keys, p.shards * parts, p.tolerance, parts, p.group_share)
    edges = [Splitter(0, 0, 0, 0), *cuts]
    # For each value of the leading hash bits: the ranges before it, and the splitters inside it.
    width = 63 - HEAD
    inside: dict[int, list[tuple[int, int]]] = {}
    for c in cuts:
        inside.setdefault(min(c.hash >> width, (1 << HEAD) - 1), []).append((c.hash if c.hash < 1 << 63 else (1 << 63) - 1, c.doc + LEAST if c.hash < 1 << 63 else -LEAST - 1))
    heads, n = [], 0
    for value in range(1 << HEAD):
        heads.append((value, n, inside.get(value, [])))
        n += len(heads[-1][2])
    longer = "_" * max(map(len, docs.columns))  # names that no column of docs has
    head, before, ends, own, part, first = (longer + x for x in ("head", "before", "ends", "own", "part", "first"))
    heads = spark.createDataFrame(heads, f"{head} int, {before} int, {ends} array<struct<h:long,d:long>>")
    starts = spark.createDataFrame([(i, i // parts, e.rows - edges[i // parts * parts].rows) for i, e in enumerate(edges)], f"{part} int, shard int, {first} long")
    rows = docs.withColumn(head, F.shiftright("sort_hash", width).cast("int")).join(F.broadcast(heads), head)
    rows = rows.withColumn(own, F.struct(F.col("sort_hash").alias("h"), _doc(docs).alias("d")))
    rows = rows.withColumn(part, F.col(before) + F.size(F.filter(ends, lambda c: c <= F.col(own))))
    rows = rows.join(F.broadcast(starts), part)
    nth = F.row_number().over(Window.partitionBy(part).orderBy(own, "doc_id"))
    return rows.withColumn("slot", F.col(first) + nth - 1).drop(head, before, ends, own, part, first)


def write_shards(docs: DataFrame, path: str, p: Params = Params()) -> None:
    """Write the documents as one folder per shard, rows with their slots."""
    assign(docs, p).drop("sort_hash").write.partitionBy("shard").parquet(path)
