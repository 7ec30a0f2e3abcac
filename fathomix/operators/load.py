"""Load shedding over a series of samples, as gaps and islands."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F


def high_reason(mem_gb: Column, cpu: Column, load1: Column, cores: Column, mem_min: float = 2.0, cpu_max: float = 70.0, factor: float = 0.8) -> Column:
    """Why a sample is high, the first of memory, CPU, load; null for a low one or a missing load."""
    return (
        F.when(mem_gb < mem_min, F.lit(f"mem_available_gb<{mem_min:.2f}"))
        .when(cpu > cpu_max, F.lit(f"cpu>{cpu_max:.0f}%"))
        .when(load1 > cores * factor, F.concat(F.lit("load1>"), F.format_string("%.2f", cores * factor)))
    )


def debounced(samples: DataFrame, key: str, at: str, high: str, pause_after_s: float = 10.0, resume_after_s: float = 30.0) -> DataFrame:
    """Adds paused: on once high for pause_after_s without a break, off once low for resume_after_s.

    at is seconds as a double; rows of a key are ordered by (at, event_id).
    """
    order = W.partitionBy(key).orderBy(at, "event_id")
    first = F.coalesce(F.lag(high).over(order) != F.col(high), F.lit(True))
    islands = samples.withColumn("_island", F.sum(F.when(first, 1).otherwise(0)).over(order))
    held = F.col(at) - F.min(at).over(W.partitionBy(key, "_island"))
    event = F.when(F.col(high) & (held >= pause_after_s), F.lit(True)).when(~F.col(high) & (held >= resume_after_s), F.lit(False))
    told = islands.withColumn("_event", event)
    return told.withColumn("paused", F.coalesce(F.last("_event", ignorenulls=True).over(order), F.lit(False))).drop("_island", "_event")


def throttled(events: DataFrame, key: str, at_ms: str, gap_ms: int = 300) -> DataFrame:
    """(key, at_ms, event_id) of the events that a throttled heartbeat writes; the others are dropped.

    A key's first event is written, and each later one that comes gap_ms or more after
    the last one written. What is written depends on what was, so a key's events are
    read in order (by time, then event_id), a batch at a time: the last time written
    is all that is held.
    """
    narrow = events.select(F.col(key).alias("k"), F.col(at_ms).cast("long").alias("at"), F.col("event_id").alias("id"))

    def beats(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, last = None, None
        for frame in frames:
            keys, times, chosen = frame["k"].to_numpy(), frame["at"].to_numpy(), []
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if current is None or keys[lo] != current:
                    current, last = keys[lo], None
                at = lo if last is None else lo + int(np.searchsorted(times[lo:hi], last + gap_ms))
                while at < hi:
                    chosen.append(at)
                    last = int(times[at])
                    at += int(np.searchsorted(times[at:hi], last + gap_ms))
            yield frame.iloc[chosen]

    ordered = narrow.where("k is not null and at is not null").repartition("k").sortWithinPartitions("k", "at", "id")
    return ordered.mapInPandas(beats, narrow.schema).select(F.col("k").alias(key), F.col("at").alias(at_ms), F.col("id").alias("event_id"))
