"""Writes as set expressions, and their safe application to Parquet tables.

Each function returns what the table becomes; commit() writes it. Without commit=True nothing is written (dry run).
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _once(rows: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """One row of each key: the last in the order column; of equals, or without order, the one with the smallest hash, so that reruns agree."""
    best = [*([F.desc(order)] if order else []), F.xxhash64(*rows.columns)]
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*best))).where(F.col("_r") == 1).drop("_r")


def append(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new, allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """New rows replace old ones of their key; columns that new rows lack keep the old values."""
    new = _once(new, keys, order)
    new = new.select(*[c for c in new.columns if c in old.columns])
    missing = [c for c in old.columns if c not in new.columns]
    kept = old.join(new.select(*keys), keys, "left_anti")
    if missing:
        new = new.join(old.select(*keys, *missing), keys, "left")
    return kept.unionByName(new.select(*old.columns))


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(table, inserted): new rows whose key the table doesn't have."""
    inserted = _once(new, keys, order).join(old.select(*keys), keys, "left_anti")
    return old.unionByName(inserted.select(*old.columns)), inserted


def update(old: DataFrame, changes: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows with a key of changes take its other columns; of a key's repeated changes the last by order counts, as in upsert."""
    cols = [c for c in changes.columns if c not in keys and c in old.columns]
    new = _once(changes, keys, order).select(*keys, *[F.col(c).alias(f"_{c}") for c in cols], F.lit(True).alias("_hit"))
    joined = old.join(new, keys, "left")
    return joined.select(*[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in old.columns])


def delete(old: DataFrame, where: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, deleted); rows for which the predicate is null stay."""
    gone = F.coalesce(where, F.lit(False))
    return old.where(~gone), old.where(gone)


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of each key that new has become new's rows; keys without new rows stay as they are."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.select(*old.columns))


def guard(rows: DataFrame, required: list[str], keys: list[str]) -> DataFrame:
    """rows; fails if a required column is empty or a key repeats."""
    empty = reduce(lambda a, b: a | b, [F.coalesce(F.col(c).cast("string"), F.lit("")) == "" for c in required])
    n = rows.where(empty).count()
    twice = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").count()
    if n or twice:
        raise ValueError(f"{n} rows lack one of {required}; {twice} keys {keys} repeat")
    return rows


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path
    return at, at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def restore(spark: SparkSession, path: str) -> bool:
    """Puts back the table that a commit had moved aside when it broke off; whether there was one to put back."""
    at, fs = _files(spark, path)
    aside = sorted(str(x.getPath()) for x in fs.globStatus(at(f"{path}.old-*")) or [])
    if fs.exists(at(path)) or not aside:
        return False
    return fs.rename(at(aside[-1]), at(path))


def commit(table: DataFrame, path: str, commit: bool = False) -> int | None:
    """Writes what a table becomes beside the old one, then puts it in its place; returns its rows. Dry run: None.

    A commit that breaks off between the two renames leaves the old table aside; restore() puts it back.
    """
    if not commit:
        return None
    spark = table.sparkSession
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    table.write.parquet(new)
    at, fs = _files(spark, path)
    if fs.exists(at(path)) and not fs.rename(at(path), at(old)):
        raise OSError(f"{path} cannot be moved aside; what was written is in {new}")
    if not fs.rename(at(new), at(path)):
        restore(spark, path)
        raise OSError(f"{new} cannot be put in the place of {path}")
    fs.delete(at(old), True)
    return spark.read.parquet(path).count()


def write_json(rows: DataFrame, path: str, commit: bool = False) -> None:
    if commit:
        rows.write.mode("overwrite").json(path)


def exact_count(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(path).count()
