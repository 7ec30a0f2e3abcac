"""Keyed writes on plain tables: upserts, latest values, dense ids, cascading deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fathomix.work import written

#: Rows of a range of dense_ids(), about, and ranges at most: a plan holds a bound for each.
RANGE_ROWS, MOST_RANGES = 100_000, 4_096


def latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The last row of each key by order."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(*(o.desc() for o in order)))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def upsert(old: DataFrame, new: DataFrame, key: str, overwritten: list[str], kept: list[str]) -> DataFrame:
    """All rows of both by key: new values overwrite (nulls too), kept columns stay if they were there."""
    o, n = old.select(F.lit(True).alias("_old"), *old.columns).alias("o"), new.select(F.lit(True).alias("_new"), *new.columns).alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    is_new = F.col("n._new").isNotNull()
    return joined.select(
        F.coalesce(f"n.{key}", f"o.{key}").alias(key),
        *(F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in overwritten),
        *(F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in kept),
    )


def changed(scan: DataFrame, files: DataFrame) -> DataFrame:
    """Scanned rows whose path is unknown or whose size or time differ: an anti join."""
    o = files.select(F.col("path").alias("_path"), F.col("size_bytes").alias("_size"), F.col("mtime_ns").alias("_mtime"))
    same = (F.col("path") == F.col("_path")) & F.col("size_bytes").eqNullSafe(F.col("_size")) & F.col("mtime_ns").eqNullSafe(F.col("_mtime"))
    return scan.join(o, same, "left_anti")


def dense_ids(df: DataFrame, name: str, start: int, *order: str) -> DataFrame:
    """Adds start, start + 1, ... in order, without sorting all rows in one task.

    Rows are written once, so that all that follows sees the same ones. Quantiles of a
    sample cut them into ranges by fixed bounds, which makes a row's range a function
    of the row alone; ranges are counted, and a row's id is the count before its range
    plus its place within it. Rows equal in order are told apart by a hash, so many of
    them still fall into several ranges.
    """
    for new in ("_tie", "_range", "_place"):
        if new in df.columns:
            raise ValueError(f"a column may not be named {new}")
    hashable = [f.name for f in df.schema if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    rows = written(df.withColumn("_tie", F.xxhash64(*hashable)), "ids")
    key = F.struct(*order, "_tie")
    n = rows.count()
    ranges = min(MOST_RANGES, n // RANGE_ROWS + 1)
    place = F.row_number().over(W.partitionBy("_range").orderBy(*order, "_tie")) - 1
    if ranges == 1:
        return rows.withColumn("_range", F.lit(0)).withColumn("_place", place).withColumn(name, F.lit(start) + F.col("_place")).drop("_tie", "_range", "_place")
    some = rows.select(key.alias("k")).sample(min(1.0, 64 * ranges / n), seed=5).agg(F.array_sort(F.collect_list("k")).alias("ks"))  # some 64 rows a range
    cut = F.transform(F.sequence(F.lit(1), F.lit(ranges - 1)), lambda i: F.get("ks", F.floor(i * F.size("ks") / ranges).cast("int")))
    bounds = some.select(F.to_json(cut).alias("cut")).first()["cut"]
    table = F.from_json(F.lit(bounds), f"array<{rows.select(key.alias('k')).schema['k'].dataType.simpleString()}>")
    steps = F.array(*(F.lit(2**k) for k in reversed(range(ranges.bit_length()))))
    at = F.aggregate(steps, F.lit(0), lambda found, step: F.when(F.get(table, found + step - 1) < key, found + step).otherwise(found))
    ranged = rows.withColumn("_range", at)
    counts = {r["_range"]: r["count"] for r in ranged.groupBy("_range").count().collect()}  # a row a range
    before = [start]
    for k in range(ranges):
        before.append(before[-1] + counts.get(k, 0))
    offset = F.get(F.split(F.lit(",".join(map(str, before))), ",").cast("array<bigint>"), F.col("_range"))
    return ranged.withColumn("_place", place).withColumn(name, offset + F.col("_place")).drop("_tie", "_range", "_place")


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return df.join(gone.select(key).distinct(), key, "left_anti")


def virtual_files(files: DataFrame, archive: Column) -> DataFrame:
    """Files that stand for members of archives: another path, the archive as real path."""
    return files.where((F.col("real_path") == archive) & (F.col("path") != archive))


def state_value(state: DataFrame, key: str, default: str | None = None) -> DataFrame:
    """One row (key, value): the value as JSON text, as raw text where it is none, else the default."""
    found = state.where(F.col("key") == key).agg(F.max("value").alias("v"))
    parsed = F.to_json(F.try_parse_json("v"))
    return found.select(F.lit(key).alias("key"), F.coalesce(parsed, "v", F.lit(default)).alias("value"))
