"""Tables in hash buckets of their key, so that a merge reads and writes only the buckets of the keys it brings.

A table is a folder with data/<commit>/bucket=<k> and versions/<n>: a line of JSON that names the key, the schema and, for each bucket
that has rows, the folder that holds it. A commit writes the buckets it changes in a folder of its own and then the next version, in
one file that must not exist yet: readers see the old table or the new one, never half of it, and of two commits on one version
the second fails. Folders that no kept version names are left for vacuum().
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import storage
from . import sinks

BUCKETS = 64


class Conflict(RuntimeError):
    """Another commit came first."""


@dataclass(frozen=True)
class Version:
    number: int
    keys: tuple[str, ...]
    buckets: int
    schema: StructType
    folders: dict[int, str]
    batch: int | None


class Table:
    """A bucketed table at a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # -------------------------------------------------------------------------------------------- versions

    def _numbers(self) -> list[int]:
        at, fs = storage.files(self.spark, self.path)
        folder = at(f"{self.path}/versions")
        return sorted(int(x.getPath().getName()) for x in fs.listStatus(folder) if x.getPath().getName().isdigit()) if fs.exists(folder) else []

    def version(self, number: int | None = None) -> Version:
        """The newest version, or an older one that is kept."""
        if number is None:
            numbers = self._numbers()
            if not numbers:
                raise ValueError(f"no table at {self.path}")
            number = numbers[-1]
        at, fs = storage.files(self.spark, self.path)
        stream = fs.open(at(f"{self.path}/versions/{number}"))
        try:
            d = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        return Version(number, tuple(d["keys"]), d["buckets"], StructType.fromJson(d["schema"]), {int(k): v for k, v in d["folders"].items()}, d["batch"])

    def _publish(self, v: Version) -> None:
        """Writes a version whose number must be free."""
        text = json.dumps({"keys": v.keys, "buckets": v.buckets, "schema": v.schema.jsonValue(), "folders": v.folders, "batch": v.batch})
        at, fs = storage.files(self.spark, self.path)
        draft, final = at(f"{self.path}/versions/draft-{uuid.uuid4().hex}"), at(f"{self.path}/versions/{v.number}")
        stream = fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        # a rename doesn't replace a file that is there
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise Conflict(f"version {v.number} of {self.path} is there already")

    # -------------------------------------------------------------------------------------------- rows

    def _bucket(self, keys: tuple[str, ...], n: int) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(n)).cast("int")

    def _rows(self, v: Version, only: list[int] | None = None) -> DataFrame:
        paths = [f for k, f in sorted(v.folders.items()) if only is None or k in only]
        if not paths:
            return self.spark.createDataFrame([], v.schema)
        return self.spark.read.schema(v.schema).parquet(*[f"{self.path}/{p}" for p in paths])

    def read(self, number: int | None = None) -> DataFrame:
        return self._rows(self.version(number))

    def _write(self, rows: DataFrame, keys: tuple[str, ...], n: int) -> dict[int, str]:
        """Writes rows by bucket; the folder of each bucket that has rows."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.withColumn("bucket", self._bucket(keys, n)).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        at, fs = storage.files(self.spark, self.path)
        names = [x.getPath().getName() for x in fs.listStatus(at(f"{self.path}/{folder}"))]
        return {int(x.partition("=")[2]): f"{folder}/{x}" for x in names if x.startswith("bucket=")}

    def create(self, rows: DataFrame, keys: list[str], buckets: int = BUCKETS) -> Table:
        """Makes the table of rows; keys and the number of buckets stay as they are."""
        self._publish(Version(0, tuple(keys), buckets, rows.schema, self._write(rows, tuple(keys), buckets), None))
        return self

    def merge(self, new: DataFrame, become: Callable[[DataFrame, DataFrame], DataFrame], batch: int | None = None) -> Version:
        """Commits what become(old rows, new rows) makes of the buckets that hold a key of new.

        become must keep rows of other keys as they are. With batch a commit of that batch or a later one isn't made again, so
        a batch that is tried again has no second effect.
        """
        v = self.version()
        if batch is not None and v.batch is not None and batch <= v.batch:
            return v
        # new is read twice; a written copy gives both the same rows
        copy = storage.written(new, "merge")
        touched = sorted(r["b"] for r in copy.select(self._bucket(v.keys, v.buckets).alias("b")).distinct().collect())  # at most all buckets
        folders = dict(v.folders)
        if touched:
            after = become(self._rows(v, touched), copy).select(*v.schema.names)
            wrote = self._write(after, v.keys, v.buckets)
            strange = set(wrote) - set(touched)
            if strange:
                raise ValueError(f"the merge made rows of buckets {sorted(strange)}, whose keys it wasn't given")
            folders = {k: f for k, f in folders.items() if k not in touched} | wrote
        done = Version(v.number + 1, v.keys, v.buckets, v.schema, folders, v.batch if batch is None else batch)
        self._publish(done)
        storage.remove(self.spark, copy.stored_at)  # type: ignore[attr-defined]
        return done

    def upsert(self, new: DataFrame, order: str | None = None, batch: int | None = None) -> Version:
        """New rows replace old ones of their key (of repeated keys the last by order); columns that new rows lack stay."""
        keys = list(self.version().keys)
        return self.merge(new, lambda old, rows: sinks.upsert(old, rows, keys, order), batch)

    def update(self, changes: DataFrame, order: str | None = None, batch: int | None = None) -> Version:
        """Rows with a key of changes take its other columns; keys that the table lacks change nothing."""
        keys = list(self.version().keys)
        return self.merge(changes, lambda old, rows: sinks.update(old, rows, keys, order), batch)

    def insert_if_absent(self, new: DataFrame, order: str | None = None, batch: int | None = None) -> Version:
        keys = list(self.version().keys)
        return self.merge(new, lambda old, rows: sinks.insert_if_absent(old, rows, keys, order)[0], batch)

    def replace(self, new: DataFrame, batch: int | None = None) -> Version:
        """All rows of each key that new has become new's rows."""
        keys = list(self.version().keys)
        return self.merge(new, lambda old, rows: sinks.replace_by_key(old, rows, keys), batch)

    def remove(self, keys: DataFrame, batch: int | None = None) -> Version:
        """Rows of the given keys go."""
        names = list(self.version().keys)
        return self.merge(keys.select(*names), lambda old, rows: old.join(rows, names, "left_anti"), batch)

    def vacuum(self, keep: int = 2) -> int:
        """Deletes versions but the last so many, and folders that none of these names; how many folders went."""
        numbers = self._numbers()
        kept = {f.split("/")[1] for n in numbers[-keep:] for f in self.version(n).folders.values()}
        at, fs = storage.files(self.spark, self.path)
        for n in numbers[:-keep]:
            fs.delete(at(f"{self.path}/versions/{n}"), False)
        gone = [x.getPath() for x in fs.listStatus(at(f"{self.path}/data")) if x.getPath().getName() not in kept]
        for p in gone:
            fs.delete(p, True)
        return len(gone)
