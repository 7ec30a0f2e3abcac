"""The folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; unset, a local session's own folder or, on a cluster, one in the warehouse."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.fathomix.work", None)
    if not base:
        master = spark.sparkContext.master
        local = master.startswith("local") and not master.startswith("local-cluster")
        base = f"file://{tempfile.mkdtemp(prefix='fathomix-')}" if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/fathomix-work"
        spark.conf.set("spark.fathomix.work", base)
    return (base if ":/" in base else f"file://{base}").rstrip("/")


#: Folders that this process has named in work folders and not released yet.
_NAMED: list[str] = []


def new_folder(spark: SparkSession, label: str) -> str:
    path = f"{work_dir(spark)}/fathomix-{label}-{uuid.uuid4().hex}"
    _NAMED.append(path)
    return path


def named() -> list[str]:
    return list(_NAMED)


def release(paths: list[str]) -> None:
    """Deletes folders that nothing will read again."""
    for path in paths:
        fs, inner = pafs.FileSystem.from_uri(path.replace("file:/", "file:///") if path.startswith("file:/") and not path.startswith("file://") else path)
        try:
            fs.delete_dir(inner)
        except FileNotFoundError:
            pass
        if path in _NAMED:
            _NAMED.remove(path)


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the work folder: rows that stay the same however often they are read."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
