"""Sharding by sampled splitters: near-equal bytes, equal texts side by side.

A row's key is (hash of its text, doc_id, a number of its own), its size the UTF-8 bytes of its text plus 1. Keys are drawn
with probability proportional to size; quantiles of the draw are the splitters of ranges of about RANGE_ROWS rows, from
LEAST_RANGES to MOST_RANGES of them. The records are partitioned by these ranges and each range's exact bytes counted; a
range over SLACK times its due is subdivided by a draw of its own, until there is none (a range of which one row is over
half stays). Ranges in key order fill the shards: shard k is due the bytes from k / shards to (k + 1) / shards of all. A
range that fits into its shard goes there whole. One that would overfill it is subdivided once more, at the record whose
middle byte is the first beyond the shard's due; so shards differ by about one record.

The driver holds the splitters, the draws (DRAWS for each range) and a row for each range; no task holds more than a range.

Defined results: a null text has size 1 and hashes as empty; a null doc_id sorts first; repeated rows keep a row each, the
number of their own being the place in the input; ties of hash and doc_id are in that order, which the result does not
show; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import stored

RANGE_ROWS, LEAST_RANGES, MOST_RANGES = 1_000_000, 128, 8192
DRAWS, SLACK = 32, 2.0
NULL_ID = -(1 << 63)


def records(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, h, d, r): what placing needs of each document; texts stay where they are. The key is
    (h, d, r)."""
    text = F.coalesce("text", F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(
        doc_id.alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"), F.coalesce(doc_id, F.lit(NULL_ID)).alias("d"), F.monotonically_increasing_id().alias("r"),
    )


def _draw(rows: DataFrame, n_bytes: int, draws: int, seed: int) -> list[tuple]:
    """(key, times) in order of the key: about `draws` of them, each row as often as its share of n_bytes."""
    luck = F.pmod(F.xxhash64("h", "d", "r", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    times = F.floor(F.col("size") * (draws / max(1, n_bytes)) + luck)
    got = rows.select("h", "d", "r", times.alias("times")).filter("times > 0").collect()  # bounded by draws
    return sorted(((x.h, x.d, x.r), x.times) for x in got)


def _quantiles(drawn: list[tuple], parts: int) -> list[tuple]:
    total, out, seen = sum(t for _, t in drawn), [], 0
    for key, times in drawn:
        if seen * parts // max(1, total) < (seen + times) * parts // max(1, total) and seen:
            out.append(key)
        seen += times
    return sorted(set(out))


def _range_of(splitters: list[tuple]) -> Column:
    """How many splitters are at or below a row's key: a search in two steps, so a row meets few of them."""
    if not splitters:
        return F.lit(0)
    key = F.struct(F.col("h").alias("h"), F.col("d").alias("d"), F.col("r").alias("r"))
    lit = lambda xs: F.from_json(F.lit("[" + ",".join(f'{{"h":{h},"d":{d},"r":{r}}}' for h, d, r in xs) + "]"), "array<struct<h:long,d:long,r:long>>")
    wide = max(1, int(len(splitters) ** 0.5))
    count = lambda xs: F.size(F.filter(xs, lambda b: b <= key))
    low = F.greatest(F.lit(0), (count(lit(splitters[::wide])) - 1) * wide)
    return F.transform(F.array(low), lambda at: at + count(F.slice(lit(splitters), at + 1, F.lit(wide))))[0]


def split(rows: DataFrame, n_rows: int, n_bytes: int, seed: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """rows with `range`, and (bytes, rows) of each range in order."""
    ranges = max(LEAST_RANGES, min(MOST_RANGES, n_rows // RANGE_ROWS))
    splitters = _quantiles(_draw(rows, n_bytes, DRAWS * ranges, seed), ranges)
    due = n_bytes / ranges
    while True:
        ranged = rows.withColumn("range", _range_of(splitters))
        found = {r.range: r for r in ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.max("size").alias("most")).collect()}
        over = [r for r in found.values() if r.bytes > SLACK * due and r.bytes > 2 * r.most]
        if not over:
            return ranged, [(found[k].bytes, found[k].n) if k in found else (0, 0) for k in range(len(splitters) + 1)]
        n_over = sum(r.bytes for r in over)
        seed += 1
        parts = 2 * len(over) + int(2 * n_over / due)
        more = _quantiles(_draw(ranged.filter(F.col("range").isin([r.range for r in over])), n_over, DRAWS * parts, seed), parts)
        splitters = sorted({*splitters, *more})


def sharded(docs: DataFrame, shards: int = 16, seed: int = 42) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot)."""
    spark = docs.sparkSession
    rows = stored(records(docs), "records")
    total = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).first()
    n_bytes = total.bytes or 0
    ranged, sums = split(rows, total.n, n_bytes, seed)
    # The shard of a byte's place; a range goes whole to a shard if its first and last byte do.
    shard_at = lambda place: min(shards - 1, int(place * shards // max(1, n_bytes)))
    plan, at = [], 0
    for k, (size, _) in enumerate(sums):
        first, last = shard_at(at), shard_at(max(at, at + size - 1))
        plan.append((k, at, first if first == last else None))
        at += size
    ranges = spark.createDataFrame(plan, "range int, ahead long, whole int")
    order = Window.partitionBy("range").orderBy("h", "d", "r")
    placed = ranged.join(F.broadcast(ranges), "range")  # a row for each range, at most 2 * MOST_RANGES or so
    start = F.col("ahead") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = placed.select("doc_id", "size", "text_crc32", "range", "whole", F.row_number().over(order).alias("nth"), start.alias("start"))
    # Twice the middle of a row's bytes, in whole numbers.
    middle = (2 * F.col("start") + F.col("size")).cast("decimal(38,0)") * shards
    cut = F.least(F.lit(shards - 1), F.floor(middle / F.lit(max(1, 2 * n_bytes)).cast("decimal(38,0)"))).cast("int")
    placed = stored(placed.select("doc_id", "size", "text_crc32", "range", "nth", F.coalesce("whole", cut).alias("shard")), "placed")
    # Slots: the rows of the shard in ranges before, then the place in this one.
    base, filled, slots = {}, {}, []
    for r in sorted(placed.groupBy("range", "shard").agg(F.count("*").alias("n")).collect()):
        slots.append((r.range, r.shard, filled.get(r.shard, 0) - base.get(r.range, 0) - 1))
        filled[r.shard] = filled.get(r.shard, 0) + r.n
        base[r.range] = base.get(r.range, 0) + r.n
    ahead = spark.createDataFrame(slots, "range int, shard int, shift long")
    return placed.join(F.broadcast(ahead), ["range", "shard"]).select("doc_id", "size", "text_crc32", "shard", (F.col("nth") + F.col("shift")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, seed: int = 42) -> None:
    """docs (doc_ids not null and distinct) with shard and slot, a folder for each shard. Files are ranges of slots, written
    by as many tasks as the session has shuffle partitions, whatever the number of shards."""
    placed = sharded(docs, shards, seed).select(F.col("doc_id").alias("_placed_id"), F.col("shard").alias("_placed_shard"), F.col("slot").alias("_placed_slot"))
    rows = docs.join(placed, docs["doc_id"] == placed["_placed_id"])
    rows = rows.select(*[docs[c] for c in docs.columns if c not in ("shard", "slot")], F.col("_placed_shard").alias("shard"), F.col("_placed_slot").alias("slot"))
    parts = max(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows.repartitionByRange(parts, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
