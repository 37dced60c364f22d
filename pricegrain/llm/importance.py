"""Importance resampling towards a target distribution over hashed runs of words, long texts in overlapping chunks.

A document's features are all its runs of one to LONGEST words. Each falls in one of BUCKETS by its crc32. A bucket's gain is the
log of its share in the target over its share in the corpus (add-one), a document's weight the sum of its features' gains, and
Gumbel noise from the id turns the highest weights into a draw without replacement.

Texts of more than CHUNK bytes are split at word boundaries; a chunk owns the words that start in it and carries the next
LONGEST - 1, so each run of words is counted by one chunk. Chunks of such texts are dealt over all tasks, and their counts and
weights summed by document; a text of one chunk is read where it lies. Corpus counts are one vector of BUCKETS a task, added in
Spark. Ranks come from ranges of the scores, so no task sorts all documents.

Defined cases: a null or empty text has no words, no features and weight 0 and is never drawn; a null doc_id draws its noise from
the word null and is the last among ties; rows that repeat a doc_id are documents of their own (with equal scores: the one with
fewer features, then the smaller weight first); an empty target leaves the corpus' own shares to decide; an empty table gives an
empty result; a single word longer than a chunk stays whole; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NARROW, Scratch, places, read, text_runs

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
CHUNK = 1 << 18

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

# ---------------------------------------------------------------------------------------------- checksums of joined words


def _byte_table() -> np.ndarray:
    """What one byte does to a crc32 register."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


_TABLE = _byte_table()
#: Words up to this many bytes are hashed in numpy; zlib hashes the longer ones.
_SHORT = 48


def _one_more(reg: np.ndarray) -> np.ndarray:
    return _TABLE[reg & np.uint32(255)] ^ (reg >> np.uint32(8))


def _shift_tables() -> np.ndarray:
    """Row n: what n bytes of zeros make of each byte of a register."""
    rows = [np.concatenate([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])]
    for _ in range(_SHORT):
        rows.append(_one_more(rows[-1]))
    return np.stack(rows)


_SHIFT = _shift_tables()
_FLAT = _SHIFT.reshape(-1)


def _doubled(t: np.ndarray) -> np.ndarray:
    """The table for twice as many bytes."""
    return t[t & 255] ^ t[256 + (t >> np.uint32(8) & 255)] ^ t[512 + (t >> np.uint32(16) & 255)] ^ t[768 + (t >> np.uint32(24))]


def _apply(at: np.ndarray | int, flat: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return flat[at + (crc & 255)] ^ flat[at + 256 + (crc >> np.uint32(8) & 255)] ^ flat[at + 512 + (crc >> np.uint32(16) & 255)] ^ flat[at + 768 + (crc >> np.uint32(24))]


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The part that crc has in the checksum of its text and n more bytes: crc32(a + b) = shifted(crc32(a), len(b)) ^ crc32(b)."""
    out = _apply(np.minimum(n, _SHORT) * 1024, _FLAT, crc)
    long = np.flatnonzero(n > _SHORT)
    if len(long):
        left, value, table = n[long] - _SHORT, out[long], _SHIFT[1]
        while left.any():
            value = np.where(left & 1, _apply(0, table, value), value)
            left, table = left >> 1, _doubled(table)
        out[long] = value
    return out


def checksums(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of each word of lower-case bytes."""
    order = np.argsort(-np.minimum(size, _SHORT + 1), kind="stable")
    n_long = int((size > _SHORT).sum())
    out = np.zeros(len(start), dtype=np.uint32)
    for i in order[:n_long]:
        out[i] = zlib.crc32(data[start[i] : start[i] + size[i]])
    short = order[n_long:]
    at, left = start[short], size[short]
    reg = np.full(len(short), 0xFFFFFFFF, dtype=np.uint32)
    ends = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), side="left")
    for k, n in enumerate(ends):
        reg[:n] = _one_more(reg[:n] ^ data[at[:n] + k])
    out[short] = reg ^ np.uint32(0xFFFFFFFF)
    return out


_SPACE_CRC = np.uint32(zlib.crc32(b" "))


class Runs:
    """The features of a run of texts: n_words of each, and for 1 to LONGEST words the text and the bucket of each feature.

    own: how many words of each text start features of its own (negative: all).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, own: np.ndarray):
        n, k = len(data), len(offsets) - 1
        solid = _LETTER[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        begins = solid.copy()
        begins[1:] &= ~solid[:-1] | edge[1:n]
        ends = (np.append(~solid[1:], True) | edge[1:]) & solid if n else solid
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        size, first = end - start, np.searchsorted(start, offsets)
        held = np.diff(first)
        self.n_words = np.where(own < 0, held, np.minimum(own, held))
        text = np.repeat(np.arange(k), held)
        place = np.arange(len(start)) - first[:-1][text]
        mine = place < self.n_words[text]
        word = checksums(_LOWER[data], start, size)
        self.features, crc = [], word
        for m in range(LONGEST):
            fits = mine[: len(crc)] & (place[: len(crc)] + m < held[text[: len(crc)]])
            self.features.append((text[: len(crc)][fits], crc[fits] % BUCKETS))
            if m + 1 < LONGEST:
                if len(crc) < 2:
                    break
                joined = shifted(crc[:-1], np.ones(len(crc) - 1, dtype=np.int64)) ^ _SPACE_CRC
                crc = shifted(joined, size[m + 1 :]) ^ word[m + 1 :]


# ---------------------------------------------------------------------------------------------- chunks


def _chunk(raw: np.ndarray, a: int, size: int) -> tuple[int, int, int]:
    """(words that start in the size bytes from a, where the first starts, where the last carried word ends)."""
    low, high = max(a - 1, 0), a + 2 * size
    while True:  # as far as the carried words reach
        solid = _LETTER[raw[low:high]]
        over = high >= len(raw)
        starts = np.flatnonzero(solid & ~np.append(a > 0, solid[:-1])) + low
        own = int(np.searchsorted(starts, a + size))
        if not own:
            return 0, a, a
        ends = np.flatnonzero(solid & ~np.append(solid[1:], not over)) + low + 1
        ends = ends[ends > starts[0]]
        if over or len(ends) >= own + LONGEST - 1:
            return own, int(starts[0]), int(ends[min(own + LONGEST - 1, len(ends)) - 1])
        high += high - low


def chunks(docs: DataFrame, size: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(texts of one chunk, chunks of the longer ones), both with row, doc_id, own, text; the chunks dealt over all tasks."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, _ in text_runs(batches, limit=1):  # text by text
            for k, a in enumerate(range(0, len(raw), size)):
                own, start, end = _chunk(raw, a, size)
                if own or not k:
                    text = raw[start:end].tobytes().decode()
                    yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array([k], pa.int32()), pa.array([own], pa.int64()), pa.array([text], pa.string())], ["row", "doc_id", "chunk", "own", "text"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    length = F.octet_length("text")
    short = rows.where(length <= size).select("row", "doc_id", F.lit(-1).cast("long").alias("own"), "text")
    long = rows.where(length > size).mapInArrow(split, "row long, doc_id long, chunk int, own long, text string")
    return short, long.repartition("row", "chunk").drop("chunk")


def _own(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("own").to_numpy(zero_copy_only=False)


def bucket_counts(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """bucket, n: how many features of all texts fall in each bucket that has any."""

    def count(batches):
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch, data, offsets in text_runs(batches):
            for _, bucket in Runs(data, offsets, _own(batch)).features:
                total += np.bincount(bucket, minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    short, long = chunks(docs, chunk)
    return short.unionByName(long).select("own", "text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of each bucket, a vector of BUCKETS whole numbers."""
    spark = corpus.sparkSession
    both = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    both = both.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    x = np.zeros((2, BUCKETS), dtype=np.int64)
    for r in both.collect():  # BUCKETS rows
        x[:, r["bucket"]] = r["s"], r["t"]
    s, t = x.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row."""

    def score(batches):
        for batch, data, offsets in text_runs(batches):
            runs = Runs(data, offsets, _own(batch))
            n, weight = np.zeros(len(batch), dtype=np.int64), np.zeros(len(batch), dtype=np.int64)
            for text, bucket in runs.features:
                n += np.bincount(text, minlength=len(batch))
                weight += np.rint(np.bincount(text, weights=gain[bucket], minlength=len(batch))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(runs.n_words, pa.int64()), pa.array(n), pa.array(weight)], ["row", "doc_id", "n_words", "n_features", "weight"])

    schema, sums = "row long, doc_id long, n_words long, n_features long, weight long", ("n_words", "n_features", "weight")
    short, long = chunks(docs, chunk)
    whole = short.mapInArrow(score, schema).select("doc_id", *sums)
    summed = long.mapInArrow(score, schema).groupBy("row", "doc_id").agg(*[F.sum(c).alias(c) for c in sums]).select("doc_id", *sums)
    return whole.unionByName(summed)


def noise(doc_id: str = "doc_id", seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the id alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resampled(docs: DataFrame, target: DataFrame, scratch: Scratch, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is null for those not drawn.

    Of the documents with at least least_words words, percent in a hundred are drawn: those with the highest scores.
    """
    gain = gains(bucket_counts(docs, chunk), bucket_counts(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), chunk))
    rows = scratch.table(weighted(docs, gain, chunk).withColumn("score", F.col("weight") + noise(seed=seed)), NARROW)
    able = rows.where(F.col("n_words") >= least_words)
    take = able.count() * percent // 100
    placed = places(scratch, able, [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")])
    ranked = placed.withColumn("rank", F.when(F.col("place") <= take, F.col("place"))).drop("place")
    out = ranked.unionByName(rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op13_importance(spark, sf_dir: str) -> DataFrame:
    """Every document with its weight towards benchmark, and the rank of those drawn."""
    return resampled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), Scratch(spark))


#: crc32 byte by byte, from a table made by its rule.
SQL = r"""
WITH poly AS (SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b::BIGINT, [0::BIGINT for _ in range(8)]), lambda a, _x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(b))),
d AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
df AS (SELECT doc_id, array_to_string(list_slice(w, i, i + m), ' ') AS f FROM d, range(0, 3) x(m), LATERAL (SELECT unnest(range(1, len(w) - m + 1)) AS i)),
bf AS (SELECT array_to_string(list_slice(w, i, i + m), ' ') AS f FROM b, range(0, 3) x(m), LATERAL (SELECT unnest(range(1, len(w) - m + 1)) AS i)),
u AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM df UNION SELECT f FROM bf)),
k AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda a, c: xor(t[(xor(a, c) & 255) + 1], a >> 8)), 4294967295) % 10000 AS bucket FROM u, poly),
dk AS (SELECT doc_id, bucket FROM df JOIN k USING (f)), bk AS (SELECT bucket FROM bf JOIN k USING (f)),
s AS (SELECT bucket, count(*) AS s FROM dk GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM bk GROUP BY 1),
g AS (SELECT s.bucket, CAST(floor(1000::DOUBLE * ln((COALESCE(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dk) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT count(*) FROM bk) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t ON t.bucket = s.bucket),
p AS (SELECT doc_id, count(*) AS n, sum(gain) AS weight FROM dk JOIN g USING (bucket) GROUP BY 1),
r AS (SELECT d.doc_id, len(w) AS words, COALESCE(n, 0) AS n_features, CAST(COALESCE(weight, 0) AS BIGINT) AS weight,
  CAST(COALESCE(weight, 0) + floor(-1000::DOUBLE * ln(-ln((('0x' || substr(sha256('42:' || COALESCE(CAST(d.doc_id AS VARCHAR), 'null')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN p ON p.doc_id = d.doc_id),
o AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS place FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND place <= (SELECT 5 * count(*) // 100 FROM r WHERE words >= 20) THEN place END AS rank FROM o
"""
