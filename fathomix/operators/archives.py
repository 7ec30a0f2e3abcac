"""Archives: routing by size, listing, members as virtual files."""

from __future__ import annotations

import io
import tarfile
import time
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fathomix.functions.paths import safe_member

SEPARATOR = "::"
LISTED = 5000


def is_large(size: Column, threshold: int = 1 << 30) -> Column:
    return size > threshold


def virtual_path(archive: Column, inner: Column) -> Column:
    return F.concat(archive, F.lit(SEPARATOR), inner)


def listed_paths(entries: DataFrame, key: str = "file_id", order: str = "inner_path", most: int = LISTED) -> DataFrame:
    """(key, n_entries, inner_paths): the first paths of each archive, one a line, folder by folder.

    Paths are ordered by their components. Members are ranked before they are gathered, so no row ever holds more than the
    most that are listed.
    """
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.split(order, "/"), "inner_path"))
    first = entries.select(key, *dict.fromkeys((order, "inner_path"))).withColumn("n", rank).where(F.col("n") <= most)
    gathered = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "inner_path"))).alias("some"))
    listed = gathered.select(key, F.array_join(F.transform("some", lambda x: x["inner_path"]), "\n").alias("inner_paths"))
    return entries.groupBy(key).agg(F.count("*").alias("n_entries")).join(listed, key)


def guarded(entries: DataFrame) -> DataFrame:
    """entries, failing on a member that would leave its folder."""
    return entries.where(F.assert_true(safe_member(F.col("inner_path")), F.lit("an archive member leaves its folder")).isNull())


def members(name: str, content: bytes, with_content: bool) -> Iterator[tuple[str, int, int | None, bytes | None]]:
    lower = name.lower()
    if lower.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for info in z.infolist():
                if info.is_dir():
                    continue
                try:
                    at = int(time.mktime((*info.date_time, 0, 0, -1))) * 1_000_000_000
                except (ValueError, OverflowError):
                    at = None
                yield info.filename, info.file_size, at, z.read(info) if with_content else None
    elif lower.endswith((".tar", ".tgz", ".tar.gz")):
        with tarfile.open(fileobj=io.BytesIO(content), mode="r:gz" if lower.endswith(("gz",)) else "r:") as t:
            for info in t:
                if info.isfile():
                    yield info.name, info.size, int(info.mtime) * 1_000_000_000 or None, t.extractfile(info).read() if with_content else None
    elif lower.endswith(".7z"):
        import py7zr  # optional

        with py7zr.SevenZipFile(io.BytesIO(content)) as z:
            members = [m for m in z.list() if not m.is_directory]
            bodies = z.readall() if with_content else {}
        for m in members:
            at = int(m.creationtime.timestamp()) * 1_000_000_000 if m.creationtime else None
            yield m.filename, m.uncompressed or 0, at, bodies[m.filename].read() if with_content else None
    else:
        raise ValueError(f"no reader for {name}")


def read_members(files: DataFrame, with_content: bool) -> DataFrame:
    """Members of (path, content): (path, inner_path, size_bytes, mtime_ns, content, error).

    A damaged archive gives one row with its error and no member.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    rows = [(path, *m, None) for m in members(path, content, with_content)]
                except Exception as e:  # noqa: BLE001  the error is the row's value
                    rows = [(path, None, None, None, None, f"{type(e).__name__}: {e}")]
                out = pd.DataFrame(rows, columns=["path", "inner_path", "size_bytes", "mtime_ns", "content", "error"], dtype=object)
                yield out.astype({"size_bytes": "Int64", "mtime_ns": "Int64"})

    return files.select("path", "content").mapInPandas(read, "path string, inner_path string, size_bytes long, mtime_ns long, content binary, error string")
