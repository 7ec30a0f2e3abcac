"""A corpus pipeline of five stages over documents, each written before the next reads it.

toxicity      documents that the classifier rejects go
near_copies   of each group of near duplicates one document stays
secrets       secrets in texts are replaced by a mask
mix           sources are taken to their target weights; copies of a document repeat
encode        texts become token ids

All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fathomix import work
from fathomix.llm import bpe, mixing, ngram_join, secrets, toxicity
from fathomix.llm.common import materialize, read_table


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python workers in batches of BATCH_ROWS, unless the session asks for a number of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return toxicity.keep_clean(docs, read_table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), decode=False, cache_half=BPE_CACHE_HALF)
    return coded.select("doc_id", "n_tokens", "ids")


#: Rows of a batch: texts are long, and several stages' workers and their batches share an executor's memory.
BATCH_ROWS = 1_000
#: Chunks in the BPE stage's caches: the workers that run it hold the caches of the other stages, too.
BPE_CACHE_HALF = 50_000

STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("secrets", mask_secrets),
    ("mix", mix_sources),
    ("encode", encode),
]

#: No SQL expresses a trained classifier, MinHash, a random field or BPE; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each stage's rows are written as Parquet and reread.

    Once they are, what the stage and those before it left in the work folder goes.
    """
    docs, ours = read_table(spark, sf_dir, "documents"), set(work.named())
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        *used, _ = (path for path in work.named() if path not in ours)
        work.release(used)
    return docs
