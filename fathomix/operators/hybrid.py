"""Fusion of vector and lexical recall, post-filters and reranking."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Window as W, functions as F

from fathomix.functions.paths import glob_pattern, parse_since
from fathomix.functions.text import shortened


def file_scores(text_hits: DataFrame, image_hits: DataFrame, chunks: DataFrame, frames: DataFrame) -> DataFrame:
    """(file_id, vec_score, vec_snippet, timestamp_ms, sources): the best of a file's hits.

    Hits are (vector_id, sim), at most k rows; chunks and frames are looked up by
    vector id and orphans fall away. Scores are at least 0. The snippet and time are
    those of the best hit, text before image.
    """
    text = F.broadcast(text_hits).join(chunks, "vector_id").select("file_id", "sim", F.lit(0).alias("kind"), "vector_id", F.coalesce("snippet", F.lit("")).alias("snippet"), F.col("start_time_ms").cast("long").alias("at_ms"))
    image = F.broadcast(image_hits).join(frames, "vector_id").select("file_id", "sim", F.lit(1).alias("kind"), "vector_id", F.lit("").alias("snippet"), F.col("timestamp_ms").cast("long").alias("at_ms"))
    return merge_hits(text.unionByName(image))


def merge_hits(hits: DataFrame) -> DataFrame:
    """Groups (file_id, sim, kind, vector_id, snippet, at_ms) by file."""
    first = F.min_by(F.struct("snippet", "at_ms"), F.struct("kind", -F.col("sim"), "vector_id"))
    named = F.when(F.col("kind") == 0, "vector:text").otherwise("vector:image")
    return (
        hits.groupBy("file_id")
        .agg(F.greatest(F.lit(0.0), F.max("sim")).alias("vec_score"), first.alias("first"), F.collect_set(named).alias("vec_sources"))
        .select("file_id", "vec_score", F.col("first.snippet").alias("vec_snippet"), F.col("first.at_ms").alias("timestamp_ms"), "vec_sources")
    )


def fuse(vec: DataFrame, fts: DataFrame, files: DataFrame, w_vec: float = 0.7, w_fts: float = 0.3) -> DataFrame:
    """Candidates of either recall with their files: a missing score is 0.

    vec: file_scores(); fts: (file_id, fts_score, fts_snippet); files: (file_id,
    path, type, mtime_ns). A few dozen candidates meet the files in a broadcast.
    """
    both = vec.join(fts, "file_id", "full_outer")
    own = F.when(F.col("fts_score").isNotNull(), F.array(F.lit("fts"))).otherwise(F.array().cast("array<string>"))
    sources = F.array_sort(F.array_union(F.coalesce("vec_sources", F.array().cast("array<string>")), own))
    scored = both.select(
        "file_id",
        (w_vec * F.coalesce("vec_score", F.lit(0.0)) + w_fts * F.coalesce("fts_score", F.lit(0.0))).alias("score"),
        F.coalesce(F.nullif("vec_snippet", F.lit("")), "fts_snippet", F.lit("")).alias("snippet"),
        "timestamp_ms",
        sources.alias("sources"),
    )
    return files.join(F.broadcast(scored), "file_id")


def filtered(results: DataFrame, type_filter: str | None = None, path_glob: str | None = None, since: str | None = None) -> DataFrame:
    """Filters after recall: a narrow filter can leave fewer than top rows."""
    if type_filter:
        results = results.where(F.col("type") == type_filter)
    if path_glob:
        results = results.where(F.col("path").rlike(glob_pattern(os.path.expanduser(path_glob))))
    since_ns = parse_since(since)
    if since_ns is not None:
        results = results.where(F.col("mtime_ns") >= since_ns)
    return results


def best(results: DataFrame, top: int) -> DataFrame:
    return results.orderBy(F.desc("score"), "file_id").limit(max(0, top))


def rerank(results: DataFrame, order: DataFrame, max_items: int = 30) -> DataFrame:
    """Moves the first max_items of results (with pos from 0) into a given order.

    order: one row (order array<int>, explanations map<string,string>). Positions out
    of range or repeated are ignored, the rest follow in their old order, and items
    beyond max_items stay where they are. Adds new_pos and explanation.
    """
    limit = results.where(F.col("pos") < max_items).agg(F.count("*").alias("_n"))
    listed = order.select(F.posexplode("order").alias("_at", "pos"), "explanations")
    valid = listed.crossJoin(F.broadcast(limit)).where((F.col("pos") >= 0) & (F.col("pos") < F.col("_n")))  # one row
    chosen = valid.groupBy("pos").agg(F.min("_at").alias("_at"), F.first("explanations").alias("_why"))
    joined = results.join(F.broadcast(chosen), "pos", "left")
    key = F.when(F.col("_at").isNotNull(), F.struct(F.lit(0).alias("g"), F.col("_at").alias("p"))).when(
        F.col("pos") < max_items, F.struct(F.lit(1).alias("g"), F.col("pos").cast("int").alias("p"))
    ).otherwise(F.struct(F.lit(2).alias("g"), F.col("pos").cast("int").alias("p")))
    why = F.trim(F.try_element_at("_why", F.col("pos").cast("string")))
    return (
        joined.withColumn("new_pos", F.row_number().over(W.orderBy(key)).cast("long") - 1)
        .withColumn("explanation", F.when(why != "", why))
        .drop("_at", "_why")
    )


def as_lines(results: DataFrame) -> DataFrame:
    """(file_id, line, json): how results are printed."""
    stamp = F.when(F.col("timestamp_ms").isNotNull(), F.format_string(" @%dms", "timestamp_ms")).otherwise("")
    line = F.concat(F.format_string("%6.3f", "score"), F.lit(" ["), "type", F.lit("] "), "path", stamp, F.lit(" ("), F.array_join("sources", ","), F.lit(")"))
    told = ["path", "type", "score", "snippet", "timestamp_ms", "sources", *(["explanation"] if "explanation" in results.columns else [])]
    return results.select("file_id", line.alias("line"), shortened(F.col("snippet"), 140).alias("shown"), F.to_json(F.struct(*told)).alias("json"))
