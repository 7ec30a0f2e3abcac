"""Rows of the index from extracted content: chunks, pages, segments, frames, statuses, vectors."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fathomix.functions.text import stripped, with_chunks
from fathomix.functions.vectors import doubles, normalized

SNIPPET = 512


def text_chunks(docs: DataFrame, chars: int = 2000, overlap: int = 200) -> DataFrame:
    """(file_id, chunk_no, start_offset, end_offset, snippet) of (file_id, text)."""
    return with_chunks(docs, "text", chars, overlap).select("file_id", "chunk_no", "start_offset", "end_offset", F.substring("chunk_text", 1, SNIPPET).alias("snippet"))


def page_chunks(docs: DataFrame, chars: int = 2000, overlap: int = 200) -> DataFrame:
    """Chunks of (file_id, pages array<string>); both offsets hold the page's number, from 0."""
    pages = docs.select("file_id", F.posexplode("pages").alias("page_no", "text"))
    return with_chunks(pages, "text", chars, overlap).select(
        "file_id", F.col("page_no").cast("long").alias("page_no"), "chunk_no", F.substring("chunk_text", 1, SNIPPET).alias("snippet")
    )


def segment_chunks(segments: DataFrame) -> DataFrame:
    """Segments (file_id, start_s, end_s, text): whole milliseconds, stripped text, no empty ones."""
    return segments.select(
        "file_id", (F.col("start_s") * 1000).cast("long").alias("start_time_ms"), (F.col("end_s") * 1000).cast("long").alias("end_time_ms"), stripped(F.col("text")).alias("text")
    ).where("text <> ''")


def sampled_frames(samples: DataFrame, every_s: float = 2.0, most: int = 2000) -> DataFrame:
    """One frame a file and interval, at most so many; its time goes by its number.

    samples: (file_id, at_s double, sample_id).
    """
    every_s = max(0.1, every_s)
    slot = F.floor(F.col("at_s") / every_s)
    first = samples.groupBy("file_id", slot.alias("slot")).agg(F.min_by("sample_id", F.struct("at_s", "sample_id")).alias("sample_id"))
    number = F.row_number().over(W.partitionBy("file_id").orderBy("slot")) - 1
    frames = first.withColumn("frame_no", number.cast("long")).where(F.col("frame_no") < most)
    return frames.select("file_id", "frame_no", "sample_id", F.floor(F.col("frame_no") * every_s * 1000).cast("long").alias("timestamp_ms"))


def outcome(kind: Column, size: Column, has_transcriber: bool, threshold: int, error: Column) -> Column:
    """struct(status, error_message) of a file: errors are values, so none ends a task."""
    skipped = F.when((kind == "audio") & F.lit(not has_transcriber), "no transcriber")
    status = F.when(error.isNotNull(), "error").when(skipped.isNotNull(), "skipped").otherwise("indexed")
    return F.struct(status.alias("status"), F.coalesce(error, skipped).alias("error_message"))


class Embedder(Protocol):
    """What the engine asks of an embedder; a worker builds its own from the factory."""

    name: str
    dim: int

    def embed_texts(self, texts: list[str]) -> np.ndarray: ...

    def embed_images(self, images: list[bytes]) -> np.ndarray: ...


def _hash64(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")


def md5_32(data: bytes) -> int:
    return int.from_bytes(hashlib.md5(data, usedforsecurity=False).digest()[:4], "big")


class HashEmbedder:
    """Embeds by hashed tokens; needs no model."""

    name = "hash"

    def __init__(self, dim: int = 384, hashed: Callable[[bytes], int] = _hash64) -> None:
        self.dim, self.hashed = dim, hashed
        self._buckets: dict[str, int] = {}

    def _bucket(self, token: str) -> int:
        if len(self._buckets) > 500_000:
            self._buckets.clear()
        if (b := self._buckets.get(token)) is None:
            b = self._buckets[token] = self.hashed(token.encode()) % self.dim
        return b

    def _weights(self, text: str, row: np.ndarray) -> None:
        counts = Counter(re.findall("[A-Za-z0-9_]+", text.lower()))
        for token, n in counts.items():
            row[self._bucket(token)] += n
        if counts:
            np.log1p(row, out=row)
        else:
            row[self.hashed(text.encode("utf-8", "ignore")) % self.dim] = 1

    def embed_texts(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, text in zip(out, texts):
            self._weights(text, row)
        return out / (np.linalg.norm(out, axis=1, keepdims=True) + 1e-12)

    def sparse(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of a text and their weights, as doubles."""
        row = np.zeros(self.dim)
        self._weights(text, row)
        at = np.flatnonzero(row)
        return at, row[at] / (np.linalg.norm(row) + 1e-12)

    def embed_images(self, images: list[bytes]) -> np.ndarray:
        """Images as their RGB bytes: each of the hash's eight bytes counts in a bucket."""
        out = np.zeros((len(images), self.dim), np.float32)
        for row, image in zip(out, images):
            for b in self.hashed(image).to_bytes(8, "little"):
                row[b % self.dim] += 1
        return out / (np.linalg.norm(out, axis=1, keepdims=True) + 1e-12)


def sparse_hash_embedding(docs: DataFrame, dim: int = 384) -> DataFrame:
    """(file_id, bucket, weight) of (file_id, text): log1p of term counts by MD5 bucket, length 1.

    A text without a token has its whole in one bucket. A row's tokens never leave its
    batch, so nothing is shuffled.
    """

    def embed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = HashEmbedder(dim, md5_32)
        for frame in frames:
            for at in range(0, len(frame), 256):
                part = frame.iloc[at : at + 256]
                told = [own.sparse(t) for t in part["text"]]
                sizes = [len(b) for b, _ in told]
                yield pd.DataFrame({"file_id": part["file_id"].repeat(sizes), "bucket": np.concatenate([b for b, _ in told]), "weight": np.concatenate([w for _, w in told])})

    known = docs.where(F.col("text").isNotNull()).select("file_id", "text")
    return known.mapInPandas(embed, f"file_id {docs.schema['file_id'].dataType.simpleString()}, bucket long, weight double")


def embedded(df: DataFrame, factory: Callable[[], Embedder], column: str, images: bool = False) -> DataFrame:
    """Adds embedding array<float>; a worker builds one embedder and keeps it for all its batches."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = factory()
        for batch in batches:
            values = list(batch)
            yield pd.Series(list(own.embed_images(values) if images else own.embed_texts([v or "" for v in values])), dtype=object)

    return df.withColumn("embedding", embed(F.col(column)))


def mean_pooled(tokens: DataFrame, key: str) -> DataFrame:
    """(key, pos, value): masked mean of token vectors (key, mask 0/1, embedding), then length 1.

    Vectors are summed as wholes, the mask as a further component: a row a key and task is shuffled.
    """
    mask = F.col("mask").cast("double")
    masked = F.concat(F.transform(doubles(F.col("embedding")), lambda x: x * mask), F.array(mask))
    sums = tokens.groupBy(key).agg(vector_to_array(Summarizer.sum(array_to_vector(masked))).alias("s"))
    means = sums.select(key, F.transform(F.slice("s", F.lit(1), F.size("s") - 1), lambda x: x / F.greatest(F.element_at("s", -1), F.lit(1e-9))).alias("m"))
    return means.select(key, F.posexplode(normalized(F.col("m"))).alias("pos", "value")).withColumn("pos", F.col("pos").cast("long"))
