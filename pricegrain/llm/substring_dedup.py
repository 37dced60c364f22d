"""Substring dedup by level-wise doubling: windows of words that repeat at one length alone are extended to twice that length.

Levels are 5, 10 and 20 words (for another window length n: n / 4, n / 2, n). At level 5 not every window is counted: of
each n-word window the 5-word piece with the smallest hash (its anchor) stands for it. Equal n-word windows have equal
anchors at equal places, so a window whose anchor occurs once in the corpus cannot repeat. About 2 of n - 4 pieces are
anchors. Anchors that repeat are extended to the two 10-word windows that start or end with them; an n-word window
contains one of the two. Only windows whose anchor and 10-word window both repeat are hashed at full length (128 bits)
and compared over the corpus. No candidate survives the last level unless it repeats, so the levels end there.

Counts and minima are combined before the shuffle, and joins are plain equi-joins which Spark may split by rows, so a
passage that very many documents share is never in one task. Texts are shuffled once, by doc_id, to hash full windows.
Exact copies of a text are found first: all words of a later copy of at least n words are removed, and only the first
copy's windows are compared.

Defined cases: words are `[^\\x20\\x09-\\x0D]+`, unchanged; null and empty texts have none; texts shorter than a window
lose nothing, copies or not; rows that repeat a doc_id and its text are one document, other texts of a doc_id are documents
of their own, in byte order; rows with a null doc_id are rows of their own, lose nothing and make no other lose words; an empty table gives an empty result;
columns besides doc_id and text are not read.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NARROW, Scratch, Words, inside, numbered, read, text_runs, windows

WINDOW = 20


def anchor_places(h5: np.ndarray, ok: np.ndarray, span: int) -> np.ndarray:
    """For each run of span consecutive pieces the place of the one with the smallest hash, the leftmost of equals."""
    place = np.arange(len(h5))
    best, width = np.where(ok, h5, np.iinfo(np.uint64).max), 1
    while width < span:  # minima of 2, 4, 8 ... pieces, then of span
        step = min(width, span - width)
        later = best[step:] < best[:-step]
        place = np.where(later, place[step:], place[:-step])
        best = np.where(later, best[step:], best[:-step])
        width += step
    return place


def _each_window(words: Words, n: int):
    """Anchor of each n-word window, whether the window lies in one text, and the hashes of pieces."""
    piece = n // 4
    if len(words.h) < n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool), np.zeros(0, dtype=np.uint64)
    h5 = windows(words.h, piece)
    return anchor_places(h5, inside(words.first, piece, len(words.h)), n - piece + 1), inside(words.first, n, len(words.h)), h5


def anchors(docs: DataFrame, n: int = WINDOW) -> DataFrame:
    """doc_id, place (word index) and hash of each anchor, with the hashes of the half-length windows that end and start there (null: beyond the text)."""

    def run(batches):
        piece, half = n // 4, n // 2
        for batch, data, offsets in text_runs(batches):
            words = Words(data, offsets)
            place, ok, h5 = _each_window(words, n)
            use = np.unique(place[ok])
            own = np.searchsorted(words.first, use, side="right") - 1
            h10 = windows(words.h, half) if len(words.h) >= half else np.zeros(1, dtype=np.uint64)
            left, right = use + piece - half, use
            no_left, no_right = left < words.first[own], right + half > words.first[own + 1]
            ids = batch.column("doc_id").cast(pa.int64()).take(pa.array(own))
            cut = lambda at: np.clip(at, 0, len(h10) - 1)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array((use - words.first[own]).astype(np.int32)), pa.array(h5[use].view(np.int64)), pa.array(h10[cut(left)].view(np.int64), mask=no_left), pa.array(h10[cut(right)].view(np.int64), mask=no_right)],
                ["doc_id", "place", "h", "left", "right"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, place int, h long, left long, right long")


def full_windows(texts: DataFrame, n: int = WINDOW) -> DataFrame:
    """doc_id, start and 128-bit hash of each window whose anchor and half-length window repeat; places: the anchors' places, 2 * place + side."""

    def run(batches):
        piece = n // 4
        for batch, data, offsets in text_runs(batches):
            words = Words(data, offsets, second=True)
            place, ok, _ = _each_window(words, n)
            if not len(place):
                continue
            start = np.arange(len(place))
            own = np.searchsorted(words.first, start, side="right") - 1
            listed = batch.column("places")
            flat, at = listed.values.to_numpy(zero_copy_only=False), np.asarray(listed.offsets)
            flat = flat[at[0] : at[-1]]
            base = np.repeat(words.first[:-1], np.diff(at))
            good = np.zeros((len(words.h) + 1, 2), dtype=bool)
            good[base + flat // 2, flat % 2] = True
            # the half-length window that ends with the anchor, if it lies in the window, else the one that starts there
            side = np.where(place - start >= n // 2 - piece, 0, 1)
            use = np.flatnonzero(ok & good[place, side])
            a, b = windows(words.h, n), windows(words.h2, n, salt=5)
            ids = batch.column("doc_id").cast(pa.int64()).take(pa.array(own[use]))
            yield pa.RecordBatch.from_arrays([ids, pa.array((use - words.first[own[use]]).astype(np.int32)), pa.array(a[use].view(np.int64)), pa.array(b[use].view(np.int64))], ["doc_id", "start", "a", "b"])

    return texts.select("doc_id", "text", "places").mapInArrow(run, "doc_id long, start int, a long, b long")


def repeated(docs: DataFrame, scratch: Scratch, n: int = WINDOW) -> DataFrame:
    """doc_id, starts: sorted word indexes of the windows whose word sequence also starts earlier; for documents that have such windows and are no later copy."""
    rows = scratch.table(anchors(docs, n))
    often = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    level5 = scratch.table(rows.join(often, "h").select("doc_id", "place", "left", "right"))
    scratch.drop(rows)
    sides = level5.select("doc_id", "place", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("left").alias("h")), F.struct(F.lit(1).alias("side"), F.col("right").alias("h")))).alias("x"))
    sides = sides.select("doc_id", (F.col("place") * 2 + F.col("x.side")).alias("place2"), F.col("x.h").alias("h")).where("h is not null")
    twice = sides.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    level10 = sides.join(twice, "h").groupBy("doc_id").agg(F.collect_list("place2").alias("places"))
    level10 = scratch.table(level10)
    scratch.drop(level5)
    full = scratch.table(full_windows(docs.select("doc_id", "text").join(level10, "doc_id"), n))
    scratch.drop(level10)
    earliest = full.groupBy("a", "b").agg(F.min(F.struct("doc_id", "start")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "b", "f")
    later = full.join(earliest, ["a", "b"]).where("doc_id <> f.doc_id or start <> f.start")
    out = scratch.table(later.groupBy("doc_id").agg(F.sort_array(F.collect_list("start")).alias("starts")))
    scratch.drop(full)
    return out


def copies(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, first: the smallest doc_id with the same text."""
    named = scratch.table(docs.where("text is not null").select("doc_id", F.md5("text").alias("m")), NARROW)
    classes = named.groupBy("m").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("m", "first")
    return scratch.table(named.join(classes, "m").where("doc_id <> first").select("doc_id", "first").distinct(), NARROW)


def remove_repeats(docs: DataFrame, scratch: Scratch, n: int = WINDOW, held: tuple[DataFrame, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the kept words, joined by one space) of each document."""
    docs = docs.select("doc_id", "text")
    listed = numbered(docs, scratch)
    if listed is not None:  # texts of one id are documents of their own
        out = remove_repeats(listed.select(F.col("number").alias("doc_id"), "text"), scratch, n, (listed,)).withColumnRenamed("doc_id", "number")
        out = out.join(listed.select("doc_id", "number"), "number").select("doc_id", "n_words", "n_removed", "kept")
        alone = docs.where("doc_id is null")
        return out if alone.isEmpty() else (out := scratch.table(out)).union(remove_repeats(alone, scratch, n, (out,)))
    later = copies(docs, scratch)
    first = docs.where("doc_id is not null").join(later, "doc_id", "left_anti")
    marks = repeated(first, scratch, n)
    scratch.keep(later, marks, *held)
    marks = marks.select("doc_id", "starts", F.lit(False).alias("copy")).union(later.select("doc_id", F.lit(None).cast("array<int>").alias("starts"), F.lit(True).alias("copy")))

    def run(batches):
        for batch, data, offsets in text_runs(batches):
            words = Words(data, offsets)
            n_words, raw = words.counts(), data.tobytes()
            starts, copy = batch.column("starts"), batch.column("copy").to_pylist()
            removed, kept = [], []
            for k, (w, first) in enumerate(zip(n_words, words.first[:-1], strict=True)):
                gone = np.zeros(w + 1, dtype=np.int32)
                if copy[k] and w >= n:
                    gone[0] = 1
                elif starts[k].is_valid:
                    at = starts[k].values.to_numpy()
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + n, -1)
                stay = np.flatnonzero(np.cumsum(gone)[:w] == 0) + first
                removed.append(w - len(stay))
                # runs of kept words; between words of a run one space
                kept.append(b" ".join([raw[a:b] for a, b in zip(words.start[stay].tolist(), words.end[stay].tolist(), strict=True)]).decode("utf-8"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return docs.join(marks, "doc_id", "left").select("doc_id", "text", "starts", "copy").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents"), Scratch(spark))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM p),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM h),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM r WHERE k > 1),
g AS (SELECT doc_id, list(j) AS gone FROM c GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(COALESCE(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN g ON w.doc_id = g.doc_id
"""
