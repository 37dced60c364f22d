"""What the corpus operators share: tables cut from their lineage, words of texts as numpy arrays, components of a graph."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import shared_folder

#: White space of all contracts: space and \t \n \v \f \r.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
CHUNK_BYTES = 1 << 20
#: Rows a file of tables of a few numbers a row.
NARROW = 250_000

# ---------------------------------------------------------------------------------------------- tables


def ready(spark: SparkSession, rows: int = 1000) -> None:
    """Readies a session for tasks on texts: the package goes to the workers, and Arrow batches get fewer rows (with long texts the default of 10,000 takes much memory)."""
    from pricegrain import ship

    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs no more than the running step."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
        self.n, self.paths = 0, set()
        ready(spark)

    def table(self, df: DataFrame, rows_a_file: int = 0, differ: bool = False) -> DataFrame:
        """Runs df once, as Parquet in the shared folder, and returns what was written.

        With rows_a_file the rows are cached and counted first and then written in as few files as that asks for: narrow
        tables else become hundreds of tiny files. differ: most values are hashes, for which Parquet would only fill
        dictionaries that it gives up.
        """
        self.n += 1
        path = f"{self.folder}/{self.n}"
        schema = df.schema
        options = {"parquet.enable.dictionary": "false"} if differ else {}
        if rows_a_file:
            cached = df.persist()
            cached.coalesce(cached.count() // rows_a_file + 1).write.options(**options).parquet(path)
            cached.unpersist()
        else:
            df.write.options(**options).parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out.scratch_path = path  # type: ignore[attr-defined]
        self.paths.add(path)
        return out

    def keep(self, *tables: DataFrame) -> None:
        """Deletes all tables made here but these."""
        for path in self.paths - {t.scratch_path for t in tables}:  # type: ignore[attr-defined]
            self._delete(path)

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that no later step reads."""
        self._delete(df.scratch_path)  # type: ignore[attr-defined]

    def _delete(self, path: str) -> None:
        self.paths.discard(path)
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# ---------------------------------------------------------------------------------------------- columns


def remainder(doc_id: str, mod: int):
    """crc32 of the id as text, modulo mod."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod


def word_count(text):
    """Number of words `[^\\x20\\x09-\\x0D]+`; 0 for null."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, SPACE))).cast("long")


def numbered(docs: DataFrame, scratch: Scratch) -> DataFrame | None:
    """Where an id has several rows: doc_id, text, copies (its rows) and number of each text of each id once; numbers keep the order of ids, then of texts. Else None."""
    known = docs.where("doc_id is not null").select("doc_id", "text")
    if not known.groupBy("doc_id").count().where("count > 1").limit(1).count():
        return None
    return scratch.table(known.groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("copies")).repartitionByRange("doc_id", "text").sortWithinPartitions("doc_id", "text").withColumn("number", F.monotonically_increasing_id()))


def places(scratch: Scratch, rows: DataFrame, order: list) -> DataFrame:
    """rows with place (1, 2, 3 ... in the whole order): rows are dealt in ranges, sorted range by range, and each range starts where the rows of those before it end.

    Rows should be a written table, as dealing them in ranges reads them twice. Only one number a range meets in one task.
    """
    dealt = scratch.table(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), 0)
    part = F.shiftright("_at", 33)
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    row = F.col("_at") - F.shiftleft(F.col("_part"), 33)
    return dealt.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("place", F.col("_before") + row + 1).drop("_part", "_at", "_before")


# ---------------------------------------------------------------------------------------------- words in numpy

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE2 = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R, _RINV = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_COEF = _rng.integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(0, dtype=np.uint64)] * 2


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(CHUNK_BYTES * 2, 1 << (n - 1).bit_length())
        for k, base in enumerate((_R, _RINV)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


class Words:
    """The words of a run of texts: h (a 64-bit hash of each word), first (index of each text's first word, and the end), start and end (bytes)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, second: bool = False):
        self.data, self.offsets = data, offsets
        n = len(data)
        if lower:
            data = _LOWER[data]
        solid = ~_WHITE[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets[:-1]] = True
        edge[n] = True
        begins = solid.copy()
        begins[1:] &= ~solid[:-1] | edge[1:n]
        ends = np.append(~solid[1:], True) | edge[1:] if n else np.zeros(0, dtype=bool)
        ends &= solid
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        up, down = _power(n + 1)

        def hashed(table: np.ndarray) -> np.ndarray:
            total = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(table[data] * up[:n], out=total[1:])
            return mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64) * _COEF[0])

        self.h = hashed(_BYTE)
        self.h2 = hashed(_BYTE2) if second else None

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def windows(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of each k consecutive word hashes (also across texts; see inside())."""
    n = max(0, len(h) - k + 1)
    out = np.full(n, (salt + 1) * int(_COEF[k % 4096]) % 2**64, dtype=np.uint64)
    for i in range(k):
        out += h[i : i + n] * _COEF[i + 1]
    return mix(out)


def inside(first: np.ndarray, k: int, n_words: int) -> np.ndarray:
    """Which windows of k words lie in one text."""
    ok = np.ones(max(0, n_words - k + 1), dtype=bool)
    for i in range(1, k):
        cut = first[1:-1] - i
        ok[cut[(cut >= 0) & (cut < len(ok))]] = False
    return ok


def text_runs(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows of about limit bytes of text with these bytes and the texts' offsets; a null text is empty."""
    for batch in batches:
        text = batch.column(batch.schema.get_field_index(column))
        if text.null_count:
            text = text.fill_null("")
        size = np.dtype(np.int64 if pa.types.is_large_string(text.type) else np.int32)
        offsets = np.frombuffer(text.buffers()[1], dtype=size)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        raw = text.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
        at = 0
        while at < len(text):
            to = int(np.searchsorted(offsets, offsets[at] + limit, side="left"))
            to = min(len(text), max(at + 1, to))
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


# ---------------------------------------------------------------------------------------------- components


def components(scratch: Scratch, links: DataFrame, most: int = 60) -> DataFrame:
    """(id, component) of every id in links (a, b): component is the smallest id that links reach.

    Each round takes for each id the smallest label among its neighbours and itself, then the label of that label, so
    paths halve. Minima are combined before the shuffle; no group is collected. A round that changes nothing is the last; more
    than most rounds, which no graph of fewer than 2^most ids should need, are an error, not a wrong result.
    """
    both = links.select("a", "b").where("a <> b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct()
    edges = scratch.table(both, NARROW)
    labels = scratch.table(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("l")).withColumnRenamed("a", "id"), NARROW)
    for _ in range(most):
        # hook the larger label of an edge's ends to the smaller, then follow labels twice
        ends = edges.join(labels.withColumnsRenamed({"id": "a", "l": "la"}), "a").join(labels.withColumnsRenamed({"id": "b", "l": "lb"}), "b")
        hooks = ends.where("la > lb").groupBy(F.col("la").alias("id")).agg(F.min("lb").alias("to")).persist()
        jumped = labels.join(hooks.withColumnsRenamed({"id": "l", "to": "t1"}), "l", "left").select("id", F.coalesce("t1", "l").alias("l")).persist()
        new = scratch.table(jumped.join(jumped.select(F.col("id").alias("l"), F.col("l").alias("t2")), "l", "left").select("id", F.least(F.col("l"), F.coalesce("t2", "l")).alias("l")), NARROW)
        done = hooks.isEmpty() and new.join(labels.withColumnRenamed("l", "was"), "id").where("l <> was").isEmpty()
        hooks.unpersist(), jumped.unpersist()
        scratch.drop(labels)
        labels = new
        if done:
            break
    else:
        raise RuntimeError("components: the rounds did not suffice")
    scratch.drop(edges)
    return labels.withColumnRenamed("l", "component")
