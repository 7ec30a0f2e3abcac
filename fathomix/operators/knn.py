"""Nearest neighbours by cosine: exact for one query or many, or through LSH."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from fathomix.functions.vectors import cosine_to, doubles, normalized

#: Queries and vectors that meet in one task, about.
QUERY_BLOCK, DATA_BLOCK = 8_192, 16_384


def checked(vectors: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """vectors, failing on one of another dimension."""
    return vectors.where(F.assert_true(F.size(column) == dim, F.lit(f"a vector has not {dim} components")).isNull())


def knn(vectors: DataFrame, query: list[float], k: int, space: str | None = None) -> DataFrame:
    """The k rows nearest to query: all columns but the vector, and sim. k below 1: none."""
    if space is not None:
        vectors = vectors.where(F.col("space") == space)
    scored = vectors.withColumn("sim", cosine_to(doubles(F.col("embedding")), query)).drop("embedding")
    return scored.orderBy(F.desc("sim"), "vector_id").limit(max(0, k))


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vector_id, sim) of each query (query_id, embedding) against all vectors.

    Both sides are dealt into blocks; each pair of blocks is a task's work, one matrix
    product, and passes on only the k best a query.
    """
    asked = queries.select("query_id", F.col("embedding").alias("v"))
    data = vectors.select(F.col("vector_id").cast("long").alias("vector_id"), F.col("embedding").alias("v"))
    n_queries, n_data = asked.count(), data.count()
    q_blocks = max(1, -(-n_queries // QUERY_BLOCK))
    # Few vectors are still spread over the cores there are.
    d_blocks = max(1, -(-n_data // DATA_BLOCK), min(vectors.sparkSession.sparkContext.defaultParallelism, n_data // 1_024))

    def dealt(df: DataFrame, key: str, own: str, own_n: int, other: str, other_n: int) -> DataFrame:
        mine = df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(own_n)).cast("int"))
        return mine.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(other_n - 1)))).repartition(min(4_096, q_blocks * d_blocks), "qb", "db")

    def unit(rows: pd.Series) -> np.ndarray:
        matrix = np.stack(rows.to_numpy()).astype(float)
        return matrix / (np.sqrt((matrix**2).sum(axis=1, keepdims=True)) + 1e-12)

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vector_id": [], "sim": []}).astype({"query_id": "int64", "vector_id": "int64", "sim": float})
        other, own = unit(b["v"]), b["vector_id"].to_numpy()
        ids, found, best = [], [], []
        for at in range(0, len(a), 256):
            part = a.iloc[at : at + 256]
            sims = unit(part["v"]) @ other.T
            order = np.lexsort((np.broadcast_to(own, sims.shape), -sims), axis=1)[:, :k]
            ids.append(np.repeat(part["query_id"].to_numpy(), order.shape[1]))
            found.append(own[order].ravel())
            best.append(np.take_along_axis(sims, order, 1).ravel())
        return pd.DataFrame({"query_id": np.concatenate(ids), "vector_id": np.concatenate(found), "sim": np.concatenate(best)})

    left, right = dealt(asked, "query_id", "qb", q_blocks, "db", d_blocks), dealt(data, "vector_id", "db", d_blocks, "qb", q_blocks)
    out = left.groupBy("qb", "db").cogroup(right.groupBy("qb", "db")).applyInPandas(nearest, "query_id long, vector_id long, sim double")
    order = W.partitionBy("query_id").orderBy(F.desc("sim"), "vector_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vector_id", "sim")


def knn_lsh(vectors: DataFrame, query: list[float], k: int, space: str | None = None, bucket: float = 0.5, tables: int = 8, seed: int = 7) -> DataFrame:
    """About the k nearest, by bucketed random projections of unit vectors: (vector_id, sim)."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    if space is not None:
        vectors = vectors.where(F.col("space") == space)
    unit = vectors.select("vector_id", array_to_vector(normalized(doubles(F.col("embedding")))).alias("v"))
    length = sum(x * x for x in query) ** 0.5 + 1e-12
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=bucket, numHashTables=tables, seed=seed).fit(unit)
    found = model.approxNearestNeighbors(unit, Vectors.dense([x / length for x in query]), k, distCol="distance")
    return found.select("vector_id", (1 - F.col("distance") * F.col("distance") / 2).alias("sim"))
