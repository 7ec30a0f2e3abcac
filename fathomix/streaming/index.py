"""Incremental indexing and load shedding as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from fathomix.functions.paths import file_type
from fathomix.operators.indexing import text_chunks
from fathomix.plans.views import _PATH
from fathomix.work import new_folder


def run_stream(source: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, every_s: float | None = None):
    """Starts a stream of batches: all that is there now, or a rescan every so many seconds."""
    writer = source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if every_s is None else writer.trigger(processingTime=f"{every_s} seconds")).start()


def table_stream(spark: SparkSession, table: str, files_a_batch: int = 64) -> DataFrame:
    """A Parquet table as a stream of its files."""
    schema = spark.read.parquet(table).schema
    # A single-file table is read through its folder and name.
    is_folder = any(f.rsplit("/", 2)[-2].endswith(".parquet") for f in spark.read.parquet(table).inputFiles()[:1])
    parent, name = (table, "*.parquet") if is_folder else table.rsplit("/", 1)
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files_a_batch).parquet(parent)


def drained(stream: DataFrame) -> DataFrame:
    """The rows of a stream that ends with what is there, written batch by batch and reread.

    A batch writes below a folder of its own number, replacing it, so a batch that is
    run again after a failure leaves no rows twice.
    """
    spark, schema = stream.sparkSession, stream.schema
    folder = new_folder(spark, "stream")

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    run_stream(stream, each, f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(StructType([*schema, StructField("batch", IntegerType())])).parquet(f"{folder}/rows").drop("batch")


def index_available(spark: SparkSession, table: str) -> DataFrame:
    """Chunks per text file of a table, indexed as a stream of files that ends with what is there."""
    source = table_stream(spark, table)
    files = source.select(F.col("doc_id").alias("file_id"), F.expr(_PATH).alias("path"), "text").withColumn("type", file_type(F.col("path"))).where("type = 'text'")
    chunks = text_chunks(files.select("file_id", "text")).select("file_id", "chunk_no", F.lit("text").alias("type"))
    return drained(chunks).groupBy("file_id", "type").agg(F.count("chunk_no").alias("n_chunks"))


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """State of processors lives in RocksDB while the block runs."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def debounced_stream(samples: DataFrame, pause_after_s: float, resume_after_s: float) -> DataFrame:
    """(key, event_id, at_s, paused) of a stream (key, event_id, at_s, high): the state machine of load shedding.

    State of a key: paused, and since when the present run lasts.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Debounce(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("debounce", "paused boolean, high boolean, since double")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
            paused, high, since = self.state.get() if self.state.exists() else (False, None, 0.0)
            every = pd.concat(list(rows)).sort_values(["at_s", "event_id"], kind="stable")
            told = []
            for at, now in zip(every["at_s"], every["high"]):
                if now != high:
                    high, since = bool(now), float(at)
                if high and at - since >= pause_after_s:
                    paused = True
                elif not high and at - since >= resume_after_s:
                    paused = False
                told.append(paused)
            self.state.update((paused, high, since))
            yield pd.DataFrame({"key": key[0], "event_id": every["event_id"].to_numpy(), "at_s": every["at_s"].to_numpy(), "paused": told})

        def close(self) -> None:
            pass

    return samples.groupBy("key").transformWithStateInPandas(Debounce(), "key long, event_id long, at_s double, paused boolean", "append", "None")


def distinct_paths(stream: DataFrame, within: str = "30 seconds") -> DataFrame:
    """Paths of a stream (path, at) that are not already under way."""
    return stream.withWatermark("at", within).dropDuplicatesWithinWatermark(["path"])
