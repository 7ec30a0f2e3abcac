"""Shared plumbing: the work folder, materialised tables and range buckets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fathomix.work import new_folder

#: Ranges of one table never exceed this many, so their bounds stay a small literal.
MAX_BUCKETS = 65_536
#: Keys that can be heavy at once, at most.
HEAVY_KEYS = 10_000
#: Rows a range that are sampled to place the bounds, about.
SAMPLED = 128
#: Stands for a null id in orderings: before every other id.
NULL_ID = -(2**63)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def new_path(spark: SparkSession, label: str) -> str:
    return new_folder(spark, label)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again.

    Cuts lineage so that a lost executor costs no recomputation of what lies
    before, and keeps columnar pruning for the readers.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def range_bounds(df: DataFrame, column: str, target_rows: int) -> list[int]:
    """Ascending upper bounds that cut a long column into ranges of near-equal row counts.

    Ranges hold about target_rows rows (more, once MAX_BUCKETS ranges are
    reached). n bounds make n + 1 ranges; nulls belong to the first. The bounds are
    quantiles of a sample of about SAMPLED rows a range, so no task gathers more than
    that; a value that holds several ranges' rows is a bound as often.
    """
    rows = df.count()
    n = max(1, min(MAX_BUCKETS, math.ceil(rows / target_rows)))
    if n == 1:
        return []
    some = df if rows <= SAMPLED * n else df.sample(SAMPLED * n / rows, seed=11)
    cuts = some.select(F.percentile_approx(column, [i / n for i in range(1, n)], 20 * n).alias("c")).first()["c"]
    return sorted(cuts or [])


def range_bucket(column: Column, bounds: list[int], tie: Column | None = None) -> Column:
    """The number of bounds below the value, by binary search in a literal array.

    Where several bounds equal the value its rows are spread over their ranges, in
    the order of tie, a 64-bit hash.
    """
    if not bounds:
        return F.lit(0)
    table = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = [2**k for k in reversed(range(len(bounds).bit_length()))]

    def passed(is_below) -> Column:
        found = F.aggregate(
            F.array(*map(F.lit, steps)),
            F.lit(0),
            lambda at, step: F.when(is_below(F.get(table, at + step - 1)), at + step).otherwise(at),
        )
        return F.coalesce(found, F.lit(0))

    below = passed(lambda bound: bound < column)
    if tie is None or len(set(bounds)) == len(bounds):
        return below
    same = passed(lambda bound: bound <= column) - below
    spread = F.floor((tie / float(2**64) + 0.5) * same).cast("int")
    return F.when(same > 1, below + F.least(spread, same - 1)).otherwise(below)


def nested(df: DataFrame, **own: Column) -> DataFrame:
    """All columns of df in one struct, row, beside columns of our own, so that names cannot clash; select("row.*") undoes it."""
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]
    return df.select(F.struct(*quoted).alias("row"), *(c.alias(name) for name, c in own.items()))


def heavy_from(total: int) -> int:
    """Rows from which a key counts as heavy; of total rows less than HEAVY_KEYS keys can have more."""
    return max(200, total // HEAVY_KEYS)


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], n: str, total: int, heavy: DataFrame | None = None) -> DataFrame:
    """left.join(right, keys), where right has one row a key and n of left's rows for it.

    Heavy keys meet a broadcast of theirs, at most HEAVY_KEYS rows, so their rows are
    never dealt to one task by key. total: left's rows. heavy: all heavy keys of left,
    if right lacks some of them.
    """
    least = heavy_from(total)
    many = F.broadcast(right.where(F.col(n) > least))  # less than HEAVY_KEYS rows, as their n add up to total at most
    gone = many.select(*keys) if heavy is None else F.broadcast(heavy.select(*keys))
    rest = left.join(gone, keys, "left_anti").join(right.where(F.col(n) <= least), keys)
    return left.join(many, keys).unionByName(rest)


def placed(df: DataFrame, partitions: int, bucket: str) -> DataFrame:
    """Bucket number k goes to task k modulo the count of tasks."""
    return df.repartitionById(partitions, F.col(bucket).cast("int"))
