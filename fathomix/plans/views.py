"""The engine's tables as views over the test tables, for Spark and, as CTEs, for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

ROOT = "/corpus"

_PATH = """concat('/corpus/', source, '/',
    case when doc_id % 17 = 0 then '.ssh/' when doc_id % 19 = 0 then 'foo.key/' else '' end,
    lang, '/doc_', cast(doc_id as varchar(20)),
    case doc_id % 8 when 0 then '.txt' when 1 then '.md' when 2 then '.pdf' when 3 then '.PNG'
      when 4 then '.mp3' when 5 then '.mov' when 6 then '.tar.gz' else '.xyz' end)"""

FILES_SQL = f"""files_v AS (SELECT doc_id AS file_id, {_PATH} AS path, n_chars AS size_bytes,
    (1704067200 + doc_id * 3600) * 1000000000 AS mtime_ns FROM documents)"""
TYPED_SQL = (
    FILES_SQL
    + """, typed_v AS (SELECT *, CASE WHEN path LIKE '%.txt' OR path LIKE '%.md' THEN 'text' WHEN path LIKE '%.pdf' THEN 'pdf'
    WHEN path LIKE '%.PNG' THEN 'image' WHEN path LIKE '%.mp3' THEN 'audio' WHEN path LIKE '%.mov' THEN 'video'
    WHEN path LIKE '%.tar.gz' THEN 'archive' END AS type FROM files_v)"""
)
VEC_SQL = """vec_v AS (SELECT vec_id AS vector_id, CASE WHEN label % 2 = 0 THEN 'text' ELSE 'image' END AS space,
    vec_id % 100 AS file_id, embedding FROM embeddings)"""
CHUNK_ROWS_SQL = """chunk_rows AS (SELECT v.vector_id, v.file_id, substr(d.text, 1, 512) AS snippet, CAST(NULL AS BIGINT) AS start_time_ms
    FROM vec_v v JOIN documents d ON d.doc_id = v.file_id WHERE v.space = 'text' AND v.vector_id % 7 <> 0),
  frame_rows AS (SELECT vector_id, file_id, vector_id * 1000 AS timestamp_ms FROM vec_v WHERE space = 'image' AND vector_id % 11 <> 0)"""
LOAD_SQL = "load_v AS (SELECT event_id, user_id, ts, value AS cpu_percent, value > 70 AS high FROM events)"
ARCH_SQL = """arch_v AS (SELECT l_orderkey AS file_id, concat('dir', l_suppkey, '/part_', l_partkey, '_', l_linenumber, '.txt') AS inner_path,
    CAST(l_quantity * 1024 AS BIGINT) AS size_bytes, l_linenumber FROM lineitem)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("file_id"), F.expr(_PATH).alias("path"), F.col("n_chars").alias("size_bytes"), F.expr("(1704067200 + doc_id * 3600) * 1000000000").alias("mtime_ns")
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("vector_id"), F.when(F.col("label") % 2 == 0, "text").otherwise("image").alias("space"), (F.col("vec_id") % 100).alias("file_id"), "embedding"
    )


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    """The vector a query text stands for here: one row of embeddings."""
    row = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select(F.col("embedding").cast("array<double>")).first()
    return list(row[0])


def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = vectors(spark, sf_dir).where("space = 'text' and vector_id % 7 <> 0").select("vector_id", "file_id")
    docs = texts(spark, sf_dir).select("file_id", F.substring("text", 1, 512).alias("snippet"))
    return own.join(docs, "file_id").select("vector_id", "file_id", "snippet", F.lit(None).cast("long").alias("start_time_ms"))


def frame_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).where("space = 'image' and vector_id % 11 <> 0").select("vector_id", "file_id", (F.col("vector_id") * 1000).alias("timestamp_ms"))


def load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.col("value").alias("cpu_percent"), (F.col("value") > 70).alias("high"))


def archive_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = F.concat(F.lit("dir"), "l_suppkey", F.lit("/part_"), "l_partkey", F.lit("_"), "l_linenumber", F.lit(".txt"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), inner.alias("inner_path"), (F.col("l_quantity") * 1024).cast("long").alias("size_bytes"), "l_linenumber")
