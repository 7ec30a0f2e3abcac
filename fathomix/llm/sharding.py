"""Operator 1: shards by longest-processing-time scheduling.

Law ``bytes``: groups of equal texts stay together; groups, largest first, go to
the least-loaded shard through a heap.

The heap runs on the driver over a bounded number of units. A group of at least
1 / (shards * FINE) of all bytes is a unit of its own, so there are at most
shards * FINE of those; the lighter groups are first poured by hash into SAND
units. Loads differ by at most one unit: the last one scheduled is a light one,
so shards end within a fraction of a percent of each other unless a single group
exceeds a shard's share.

Slots are numbered without a global sort: rows fall into cells within a shard by
hash, cells are numbered through prefix sums, and rows within their cell; rows equal in
id and text go through as one with a count.

Defined results: a null text has no bytes, size 1 and crc32 0, and belongs to the
group of empty texts; a null id is numbered like another; ties between groups go
by hash, and repeated rows get a slot each; an empty table gives no rows. Columns
of the input other than doc_id and text are not carried.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window as W, functions as F

from fathomix.llm.common import MAX_BUCKETS, materialize

#: A group of at least this part of a shard's share is scheduled by itself.
FINE = 1024
#: Units that the lighter groups are poured into.
SAND = 16_384
#: Equal rows that one task spells out at once, at most.
TIMES = 65_536
#: Rows of a shard that are sorted together to number them, about.
CELL_ROWS = 2_048


def lpt(sizes: list[tuple[int, object]], shards: int) -> dict[object, int]:
    """Longest processing time first: (size, unit) pairs to the least-loaded shard."""
    heap = [(0, shard) for shard in range(shards)]
    out = {}
    for size, unit in sorted(sizes, key=lambda x: (-x[0], x[1])):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        out[unit] = shard
    return out


def assign_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("key"),
        ),
        "shard-rows",
    )
    totals = base.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("*").alias("rows")).first()
    floor = max(1, totals["bytes"] // (shards * FINE))
    groups = base.groupBy("key").agg(F.sum("size").alias("bytes"))
    heavy = F.col("bytes") >= floor
    units = (
        groups.groupBy(heavy.alias("heavy"), F.when(heavy, F.col("key")).otherwise(F.pmod("key", F.lit(SAND))).alias("unit"))
        .agg(F.sum("bytes").alias("bytes"))
        .collect()  # at most shards * FINE heavy ones, as each has that part of all bytes, and SAND others
    )
    shard_of = lpt([(u["bytes"], (not u["heavy"], u["unit"])) for u in units], shards)
    sand = F.split(F.lit(",".join(str(shard_of.get((True, k), 0)) for k in range(SAND))), ",").cast("array<int>")
    alone = spark.createDataFrame([(unit, shard) for (light, unit), shard in shard_of.items() if not light], "key long, own_shard int")
    shard = F.coalesce("own_shard", F.get(sand, F.pmod("key", F.lit(SAND)).cast("int")))
    cells = max(1, min(MAX_BUCKETS, totals["rows"] // (shards * CELL_ROWS)))
    # Rows equal in id and text are one row with a count, so that none of them meet in a cell.
    once = base.groupBy("key", "doc_id", "size", "text_crc32").agg(F.count("*").alias("times"))
    dealt = once.join(F.broadcast(alone), "key", "left").select(
        "doc_id", "size", "text_crc32", "times", shard.alias("shard"), F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(cells)).alias("cell")
    )
    before = W.partitionBy("shard").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    firsts = dealt.groupBy("shard", "cell").agg(F.sum("times").alias("n")).select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = W.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size").rowsBetween(W.unboundedPreceding, -1)
    numbered = dealt.withColumn("ahead", F.coalesce(F.sum("times").over(within), F.lit(0))).join(firsts, ["shard", "cell"]).withColumn("slot", F.col("first") + F.col("ahead"))
    return spelled_out(numbered).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def spelled_out(numbered: DataFrame) -> DataFrame:
    """Each row times times, with its slot and those behind it; what repeats often is shared out in runs of TIMES rows."""
    few = numbered.where(F.col("times") <= TIMES)
    many = numbered.where(F.col("times") > TIMES).withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("times") - 1) / TIMES)))).repartition("shard", "slot", "run")
    many = many.select("doc_id", "size", "text_crc32", "shard", (F.col("slot") + F.col("run") * TIMES).alias("slot"), F.least(F.lit(TIMES), F.col("times") - F.col("run") * TIMES).alias("left"))
    few = few.withColumn("left", F.col("times"))
    every = few.select("doc_id", "size", "text_crc32", "shard", "slot", "left").unionByName(many.select("doc_id", "size", "text_crc32", "shard", "slot", "left"))
    return every.withColumn("slot", F.explode(F.sequence(F.col("slot"), F.col("slot") + F.col("left") - 1)))
