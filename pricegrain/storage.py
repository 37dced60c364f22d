"""Folders that driver and executors share, and paths in them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own, but only on a local master: a cluster's machines wouldn't see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="pricegrain-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def files(spark: SparkSession, path: str):
    """(Path class, the path's file system)."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return at, at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = files(spark, path)
    return fs.exists(at(path))


def remove(spark: SparkSession, path: str) -> None:
    at, fs = files(spark, path)
    fs.delete(at(path), True)


def written(rows: DataFrame, name: str) -> DataFrame:
    """rows, run once and read from what was written; stored_at is where."""
    path = new_path(rows.sparkSession, name)
    rows.write.parquet(path)
    out = rows.sparkSession.read.schema(rows.schema).parquet(path)
    out.stored_at = path  # type: ignore[attr-defined]
    return out
