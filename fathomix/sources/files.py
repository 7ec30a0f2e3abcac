"""Sources: folders of files as rows, and the bytes and text of those files."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from fathomix.functions.paths import allowed, file_type, pruned

#: Folders to share out at least, if there are so many, and folders that are opened for it at most, about.
ENOUGH, MOST_OPENED = 64, 512
SCAN = "path string, size_bytes long, mtime_ns long, ctime_ns long"


class FolderScan(DataSource):
    """spark.read.format("fathomix_folder"): a row a file, with times in nanoseconds.

    Options: roots (newline-separated), followSymlinks. Folders below a root are
    partitions of their own, so a wide tree is walked by many tasks. The roots must be
    mounted on all executors; other stores go through binary_files().
    """

    @classmethod
    def name(cls) -> str:
        return "fathomix_folder"

    def schema(self) -> str:
        return SCAN

    def reader(self, schema: StructType) -> FolderReader:
        return FolderReader(self.options)


class FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.roots = [os.path.abspath(os.path.expanduser(r)) for r in options.get("roots", "").split("\n") if r]
        self.follow = options.get("followSymlinks", "false").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        """Folders are opened level by level until there are enough to share out; what is not opened is walked whole by its task."""
        shallow = [r for r in self.roots if os.path.isfile(r)]
        whole = [r for r in self.roots if os.path.isdir(r)]
        while whole and len(whole) < ENOUGH and len(shallow) < MOST_OPENED:
            below = [e.path for folder in whole for e in sorted(os.scandir(folder), key=lambda e: e.name) if e.is_dir(follow_symlinks=self.follow)]
            shallow, whole = shallow + whole, below
        return [InputPartition((p, False)) for p in shallow] + [InputPartition((p, True)) for p in whole] or [InputPartition(("", False))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path, whole = partition.value
        if os.path.isfile(path):
            yield self._row(path)
            return
        for folder, _, names in os.walk(path, followlinks=self.follow) if path else ():
            for name in sorted(names):
                full = os.path.join(folder, name)
                if (self.follow or not os.path.islink(full)) and os.path.isfile(full):
                    yield self._row(full)
            if not whole:
                break

    @staticmethod
    def _row(path: str) -> tuple:
        s = os.stat(path)
        return path, s.st_size, s.st_mtime_ns, s.st_ctime_ns


def is_remote(root: str) -> bool:
    """Whether a root is a URI: such are listed by Spark, others walked by tasks."""
    return "://" in root


def scan_folders(spark: SparkSession, roots: list[str], allow_roots: list[str], ignore: list[str], follow_symlinks: bool = False) -> DataFrame:
    """Files of known type below roots that the filters let through: SCAN and type. Roots are folders, files, or URIs of any store Spark reads."""
    spark.dataSource.register(FolderScan)
    walked = [r for r in roots if not is_remote(r)]
    rows = spark.read.format("fathomix_folder").option("roots", "\n".join(walked)).option("followSymlinks", str(follow_symlinks)).load()
    for root in filter(is_remote, roots):
        listed = binary_files(spark, root).select("path", "size_bytes", "mtime_ns", F.col("mtime_ns").alias("ctime_ns"))
        rows = rows.unionByName(listed)
    return candidates(rows, roots, allow_roots, ignore)


def candidates(rows: DataFrame, roots: list[str], allow_roots: list[str], ignore: list[str]) -> DataFrame:
    path = F.col("path")
    out = rows.withColumn("type", file_type(path)).where(F.col("type").isNotNull() & allowed(path, allow_roots, ignore))
    for root in roots:
        root = root.removeprefix("file://")
        if is_remote(root):
            continue  # a store has no walk to prune: the globs look at whole paths there
        root = os.path.abspath(os.path.expanduser(root))
        below = path.startswith(root.rstrip("/") + "/")
        out = out.where(~below | ~pruned(path, root, ignore))
    return out.dropDuplicates(["path"])


def binary_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, size_bytes, mtime_ns, content) of any store Spark reads; content is pruned where unused."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return raw.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("length").alias("size_bytes"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), "content")


def decoded(content: Column, max_bytes: int = 20 * 1024 * 1024) -> Column:
    """UTF-8 text of the first max_bytes; bytes that are no UTF-8 are left out."""

    @F.pandas_udf("string")
    def decode(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: None if b is None else b.decode("utf-8", "ignore"))

    return decode(F.substring(content, 1, max_bytes))
