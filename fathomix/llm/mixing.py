"""Operator 6: mixing sources to target weights by Efraimidis-Spirakis sampling.

A source takes its target in complete epochs over all its documents first. What
is left is sampled without replacement: each document draws the key -ln(u) / w
with u from a hash of the document and w its quality weight, documents go in
ascending order of their keys, and the prefix sum of their sizes runs up to the
rest (a document at the edge is taken if more than half of it lies within).

No source is sorted as a whole: keys fall into cells, sizes are summed by source and
cell, and only the one cell in which a source's budget ends is ordered row by row. A
cell is 1 / CELLS of an octave of the key, so whatever the weights are, it holds
less than 0.37 * ln 2 / CELLS of a source's rows, about one in 16,000. Targets are
found on a row a source, numbered through written ranges, and a row a distinct ratio
of cap and weight. Everything is DataFrame operations.

Defined results: a null text has size 0; null sources form one source, ranked
last; null ids draw from their text; rows equal in id and text share a key and are
told apart by size alone, so they are interchangeable; an empty table gives no
rows. mix() carries doc_id and source alone, take_mix() all
columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fathomix.llm.common import join_counted, materialize, nested

#: A word, the weights that sources repeat, and the most epochs.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MOST_EPOCHS = 3
#: Sources up to which the plan, a row each, is broadcast; beyond, rows meet it in a join that splits heavy sources.
BROADCAST_SOURCES = 100_000
#: Sources that are ordered together to number them, about.
RANGE_SOURCES = 100_000
#: Cells of an octave of the sampling key.
CELLS = 4_096
#: Cells that are summed together first, so that a source's prefix sums run over some hundred rows.
COARSE = 64


def text_quality(text: Column, size: Column) -> Column:
    """A quality weight from 0.01 to 1: low for texts of repeated words, of marks and digits, or of capitals.

    The product of the share of distinct words (among at most 4 sqrt(n) of n words, as
    long texts must repeat some), the share of letters between a half and 0.8, and the
    share of letters that are no capitals.
    """
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    distinct = F.least(F.lit(1.0), F.size(F.array_distinct(words)) / F.greatest(F.lit(1.0), F.least(size.cast("double"), 4 * F.sqrt(size.cast("double")))))
    letters, capitals = F.length(F.regexp_replace(text, r"\P{L}+", "")), F.length(F.regexp_replace(text, r"\P{Lu}+", ""))
    share = letters / F.greatest(F.length(text), F.lit(1))
    return F.greatest(F.lit(0.01), distinct * F.least(F.lit(1.0), F.greatest(F.lit(0.01), (share - 0.5) / 0.3)) * (1 - capitals / F.greatest(letters, F.lit(1))))


def numbered(sources: DataFrame) -> DataFrame:
    """Adds rank from 1, by source in the order of code points, null last."""
    order = F.col("source").asc_nulls_last()
    # Ranges are written, so their numbers and counts cannot change between readers.
    ranges = max(1, -(-sources.count() // RANGE_SOURCES))
    kept = materialize(sources.repartitionByRange(ranges, order).withColumn("part", F.spark_partition_id()), "mix-sources")
    before = F.coalesce(F.sum("n_part").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = kept.groupBy("part").agg(F.count("*").alias("n_part")).select("part", before.alias("before"))  # a row a range
    place = F.row_number().over(W.partitionBy("part").orderBy(order))
    return kept.withColumn("place", place).join(F.broadcast(parts), "part").withColumn("rank", F.col("before") + F.col("place")).drop("part", "place", "before")


def source_targets(sizes: DataFrame) -> DataFrame:
    """Adds target to (source, source_size, ...): a share by weight, capped at MOST_EPOCHS sizes.

    Capping and resharing ends where every uncapped source gets the same level
    times its weight. Sources reach their caps in the order of cap / weight, so the level
    is found in one pass over the distinct values of that ratio.
    """
    weighted = numbered(sizes).withColumn("weight", F.get(F.array(*map(F.lit, WEIGHTS)), ((F.col("rank") - 1) % len(WEIGHTS)).cast("int")))
    capped = weighted.withColumn("cap", MOST_EPOCHS * F.col("source_size").cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    steps = capped.groupBy("ratio").agg(F.sum("cap").alias("cap"), F.sum("weight").alias("weight"), F.sum("source_size").alias("size"))
    up = W.orderBy("ratio")
    filled = F.coalesce(F.sum("cap").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(W.orderBy(F.desc("ratio")).rowsBetween(W.unboundedPreceding, 0))
    total = F.sum("size").over(W.partitionBy()).cast("double")
    levels = steps.select("ratio", F.greatest(F.lit(0.0), (total - filled) / open_weight).alias("level"))
    found = levels.agg(F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).alias("at"))
    target = F.least("cap", F.coalesce(F.col("at.level") * F.col("weight"), F.col("cap")))
    return capped.crossJoin(F.broadcast(found)).withColumn("target", target).drop("at", "weight", "cap", "ratio", "rank")  # one row


def draws(doc_id: Column, text: Column, source: Column, seed: int, quality) -> dict[str, Column]:
    """Our own columns of a row, each from the row alone: s (the source as a key without nulls), source, size, key and cell."""
    text = text.cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    uniform = (F.pmod(F.xxhash64(F.lit(seed), doc_id.cast("long"), F.xxhash64(text)), F.lit(2**52)) + 0.5) / float(2**52)
    key = -F.log(uniform) / F.greatest(F.coalesce(quality(text, size), F.lit(1.0)), F.lit(1e-6))
    source = source.cast("string")
    return {"s": F.coalesce(F.concat(F.lit("+"), source), F.lit("-")), "source": source, "size": size, "key": key}


def with_cells(rows: DataFrame) -> DataFrame:
    return rows.withColumn("cell", F.floor(F.log2("key") * CELLS).cast("int"))


def first_beyond(cells: DataFrame, cell: str) -> DataFrame:
    """(s, cell, before, rest): of each source the first cell by which the sizes, from start on, exceed the rest, and their sum before it."""
    upto = W.partitionBy("s").orderBy(cell).rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = cells.withColumn("upto", F.col("start") + F.sum("size").over(upto)).where(F.col("upto") > F.col("rest"))
    found = summed.groupBy("s").agg(F.min(F.struct(cell, (F.col("upto") - F.col("size")).alias("before"), "rest")).alias("e"))
    return found.select("s", f"e.{cell}", "e.before", "e.rest")


def budget_plan(rows: DataFrame) -> DataFrame:
    """One row a source: (s, n, source_size, target, epochs, rest, edge, before).

    edge is the cell of the key in which the rest of the budget ends, before the
    sizes in the cells ahead of it.
    """
    cells = rows.groupBy("s", "cell").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.first("source").alias("source"))
    targets = source_targets(cells.groupBy("s").agg(F.sum("size").alias("source_size"), F.sum("n").alias("n"), F.first("source").alias("source")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    budgets = targets.withColumn("epochs", F.least(epochs, F.lit(MOST_EPOCHS))).withColumn(
        "rest", F.when(F.col("epochs") == MOST_EPOCHS, 0.0).otherwise(F.col("target") - F.col("epochs") * F.col("source_size"))
    )
    budgets = materialize(budgets, "mix-budgets")
    cells = cells.select("s", "cell", "size", F.floor(F.col("cell") / COARSE).cast("int").alias("coarse"))
    wide = cells.groupBy("s", "coarse").agg(F.sum("size").alias("size"))
    wide_edges = first_beyond(wide.join(budgets.select("s", "rest"), "s").withColumn("start", F.lit(0)), "coarse")
    within = cells.join(wide_edges.withColumnRenamed("before", "start"), ["s", "coarse"])
    edges = first_beyond(within, "cell").select("s", F.col("cell").alias("edge"), "before")
    return budgets.join(edges, "s", "left").select("s", "n", "source_size", "target", "epochs", "rest", "edge", "before")


def decided(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds the plan of a row's source, and copies, to rows with our own columns and doc_id as id."""
    plan = materialize(plan, "mix-plan")
    n_sources, n_rows = plan.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    rows = rows.join(F.broadcast(plan), "s") if n_sources <= BROADCAST_SOURCES else join_counted(rows, plan, ["s"], "n", n_rows)
    at_edge = F.coalesce(F.col("cell") == F.col("edge"), F.lit(False))
    ahead = W.partitionBy("s").orderBy("key", "id", "size").rowsBetween(W.unboundedPreceding, -1)
    middle = F.col("before") + F.coalesce(F.sum("size").over(ahead), F.lit(0)) + F.col("size") / 2
    edge_rows = rows.where(at_edge).withColumn("middle", middle).withColumn("more", (F.col("middle") <= F.col("rest")) & (F.col("epochs") < MOST_EPOCHS)).drop("middle")
    other = rows.where(~at_edge).withColumn("more", F.coalesce(F.col("cell") < F.col("edge"), F.lit(True)) & (F.col("rest") > 0))
    return other.unionByName(edge_rows).withColumn("copies", F.col("epochs") + F.col("more").cast("int"))


def mix(docs: DataFrame, seed: int = 42, quality=text_quality) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, copies) of every row."""
    drawn = draws(F.col("doc_id"), F.col("text"), F.col("source"), seed, quality)
    rows = materialize(docs.select(F.col("doc_id").cast("long").alias("id"), *(c.alias(k) for k, c in drawn.items())), "mix-rows")
    rows = with_cells(rows)
    return decided(rows, budget_plan(rows)).select(
        F.col("id").alias("doc_id"), "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


def take_mix(docs: DataFrame, seed: int = 42, quality=text_quality) -> DataFrame:
    """The rows of docs as often as the mix takes them, with all columns."""
    drawn = draws(F.col("doc_id"), F.col("text"), F.col("source"), seed, quality)
    rows = with_cells(nested(docs, id=F.col("doc_id").cast("long"), **drawn))
    sizes = materialize(rows.select("s", "source", "size", "cell"), "mix-rows")
    taken = decided(rows, budget_plan(sizes))
    return taken.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("row.*")
