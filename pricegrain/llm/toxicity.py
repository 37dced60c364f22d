"""Toxicity by compression distance: which of two zstandard dictionaries shortens a text's windows more.

Both dictionaries end in the same BASE_BYTES trained (zstandard.train_dictionary) on whole ordinary texts of a bounded sample of
labelled rows, so what all texts have costs the same under both. The toxic one begins with OWN_BYTES trained on passages of the
sample's toxic texts: those runs of bytes whose pieces (PIECE bytes, anywhere in the whole texts) are in surely more of the toxic
texts than of the ordinary ones, whatever they are. Trained on all of the toxic text, these bytes would hold what is frequent in
any text, and gains would drown in what happens to be in one dictionary only. Where no passage tells, both have OWN_BYTES trained on
whole texts of their label. Each window of WINDOW bytes is compressed with both, with equal parameters, and the gain is what the
toxic dictionary saves. The gains of a document's windows, counted against thresholds (LEVELS), go to a logistic model calibrated
on labelled documents that the dictionaries have not seen; it gives the score.

Defined cases: a null or empty text has no window and gets the score of gains 0; texts are lower-cased (A-Z) bytes, so any
characters do; repeated rows get equal scores; with no labels of one class the score is the share of label 1 (0.5 with no
labels at all); labels of a null doc_id, or null, are not learnt from, and a null doc_id is in the held-out part of no split;
columns besides doc_id and text are not read. Whole texts are scored; no task holds more than one batch.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, mix, read, remainder, text_runs
from .labelled import Logistic, counts, sampled

#: Bound of the training sample, for each label.
MOST_ROWS = 3000
WINDOW, STEP = 256, 240
#: Bytes of a dictionary's own part and of the part that both share, and words of a sample to train on.
OWN_BYTES, BASE_BYTES = 5120, 32_000
SAMPLE_WORDS = 8
LEVELS = (1, 2, 3, 4, 6, 9)
#: Bytes of a piece, counters of pieces (they may share one), by how many standard deviations and how many times a piece that tells
#: is in more toxic texts than its share, and bytes of a segment of the dictionary that is trained on what tells.
PIECE, SLOTS, SURE, TIMES, SEGMENT = 6, 1 << 23, 6.0, 2.0, 16


class Compressors:
    """The two compressors, made anew in each worker from the dictionaries' bytes."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        # the window holds either dictionary whole; with windows of their own the compressors would differ in more than these
        log = max(13, (max(len(toxic), len(ordinary)) + WINDOW).bit_length())
        self.toxic, self.ordinary = self._made(toxic, log), self._made(ordinary, log)

    @staticmethod
    def _made(content: bytes, log: int):
        import zstandard as z

        how = z.ZstdCompressionParameters(window_log=log, hash_log=min(17, log), chain_log=min(17, log), search_log=5, min_match=4, target_length=64, strategy=z.STRATEGY_BTULTRA, write_content_size=False, write_checksum=False, write_dict_id=False, format=z.FORMAT_ZSTD1_MAGICLESS)
        d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=how)
        return z.ZstdCompressor(compression_params=how, dict_data=d).compress

    def gains(self, text: bytes) -> np.ndarray:
        """Bytes by which each window is shorter with the toxic dictionary."""
        parts = [text[i : i + WINDOW] for i in range(0, max(1, len(text) - (WINDOW - STEP)), STEP)] if text else []
        return np.array([len(self.ordinary(p)) - len(self.toxic(p)) for p in parts], dtype=np.float64)


def features(gains: np.ndarray) -> list[float]:
    if not len(gains):
        gains = np.zeros(1)
    s = np.sort(gains)[::-1]
    base = [s[0], s[:2].mean(), np.maximum(gains - 1, 0).sum(), *[(gains >= t).sum() for t in LEVELS]]
    return [*base, *[min(x, 5.0) for x in base], gains.mean(), math.log(len(gains)), (gains >= 3).mean()]


def _samples(texts: list[bytes]) -> list[bytes]:
    out = []
    for words in map(bytes.split, texts):
        out += [b" " + b" ".join(words[i : i + SAMPLE_WORDS]) for i in range(0, len(words), SAMPLE_WORDS)]
    return out


def _trained(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    """A dictionary's content of size bytes at most, of the segments that most of the samples share."""
    import zstandard as z

    try:
        return z.train_dictionary(size, samples, k=k, d=d).as_bytes()
    except z.ZstdError:  # too little text to train on: the text itself
        return b"".join(samples)[-size:]


def _pieces(text: bytes) -> np.ndarray:
    """The counter of the piece at each place of a text."""
    a = np.frombuffer(text, dtype=np.uint8).astype(np.uint64)
    h = np.zeros(max(0, len(a) - PIECE + 1), dtype=np.uint64)
    for i in range(PIECE):
        h = h << np.uint64(8) | a[i : i + len(h)]
    return (mix(h) % np.uint64(SLOTS)).astype(np.int64)


def _telling(toxic: list[bytes], ordinary: list[bytes]) -> np.ndarray:
    """Which counters are of pieces that tell; copies of a text count once."""
    held = []
    for texts in (set(toxic), set(ordinary)):
        n = np.zeros(SLOTS, dtype=np.int32)
        for t in texts:
            n[np.unique(_pieces(t))] += 1
        held.append((len(texts), n))
    (all_a, a), (all_b, b) = held
    some = np.flatnonzero(a)
    a, b, share = a[some], b[some], all_a / (all_a + all_b)
    due = (a + b) * share
    sure = (a - due) / np.sqrt(due * (1 - share) + 0.25) >= SURE
    out = np.zeros(SLOTS, dtype=bool)
    out[some[sure & ((a + 0.5) * (all_b + 1) >= TIMES * (b + 0.5) * (all_a + 1))]] = True
    return out


def _passages(text: bytes, telling: np.ndarray) -> list[bytes]:
    """The runs of a text that pieces that tell cover."""
    at = np.flatnonzero(telling[_pieces(text)])
    if not len(at):
        return []
    new = np.flatnonzero(np.diff(at) > PIECE) + 1
    return [text[i : j + PIECE] for i, j in zip(at[np.r_[0, new]], at[np.r_[new - 1, len(at) - 1]], strict=True)]


def dictionaries(rows: list[tuple[int, bytes, int]]) -> tuple[bytes, bytes]:
    """Contents of the toxic and the ordinary dictionary, of (doc_id, text, label) rows."""
    toxic, ordinary = ([t for _, t, y in rows if y == label] for label in (1, 0))
    base = _trained(_samples(ordinary[0::2]), BASE_BYTES, 64, 8)
    telling = _telling(toxic, ordinary)
    passages = [p for t in toxic for p in _passages(t, telling)]
    if passages:
        return _trained(passages, OWN_BYTES, SEGMENT, PIECE) + base, base
    return _trained(_samples(toxic), OWN_BYTES, 24, 6) + base, _trained(_samples(ordinary[1::2]), OWN_BYTES, 24, 6) + base


def _lower(text: bytes) -> bytes:
    return _LOWER[np.frombuffer(text, dtype=np.uint8)].tobytes()


class Model:
    """Dictionaries and calibration; what workers get is about 0.4 MB, whatever the input."""

    def __init__(self, rows: list[tuple[int, bytes, int]], weights: dict[int, float] | None = None):
        """weights: how many labelled rows a sampled row of each label stands for."""
        rows = [(d, _lower(t), y) for d, t, y in rows]
        share = float(np.mean([y for *_, y in rows])) if rows else 0.5
        self.constant: float | None = None
        if share in (0.0, 1.0) or not rows:
            self.constant = share
            return
        x, y = np.zeros((len(rows), len(features(np.zeros(1))))), np.array([y for *_, y in rows], dtype=np.float64)
        # each half is measured with the dictionaries of the other, so calibration sees texts as new as those scored later
        halves = np.zeros(len(rows), dtype=int)
        for label in (0, 1):
            own = np.flatnonzero(y == label)
            halves[own] = np.arange(len(own)) % 2
        if min(y.sum(), len(y) - y.sum()) < 2:
            halves[:] = -1
        for half in np.unique(halves):
            fit = [r for r, h in zip(rows, halves, strict=True) if h != half or half < 0]
            c = Compressors(*dictionaries(fit))
            for k in np.flatnonzero(halves == half):
                x[k] = features(c.gains(rows[k][1]))
        self.toxic, self.ordinary = dictionaries(rows)
        self.logistic = Logistic(x, y, np.array([(weights or {}).get(int(k), 1.0) for k in y]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each row."""

    def run(batches):
        c = None if model.constant is not None else Compressors(model.toxic, model.ordinary)
        for batch, data, offsets in text_runs(batches):
            if c is None:
                scores = np.full(batch.num_rows, model.constant)
            else:
                raw = _LOWER[data].tobytes()
                scores = model.logistic.predict(np.array([features(c.gains(raw[a:b])) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS, mod: int | None = None, held: int = 0) -> Model:
    """The model, fitted in one task on the bounded sample; the driver gets about 0.4 MB."""
    every = counts(labels, "toxic", mod, held)

    def run(batches):
        rows = sorted({tuple(r[c] for c in ("part", "doc_id", "text", "y")) for batch in batches for r in batch.to_pylist()})
        rows = [(d, t.encode(), y) for _, d, t, y in rows]
        weights = {y: every[y] / n for y in every if (n := sum(1 for r in rows if r[2] == y))}
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Model(rows, weights))], pa.binary())], ["model"])

    made = sampled(docs, labels, "toxic", most, mod, held).repartition(1).mapInArrow(run, "model binary").collect() if every else []
    return pickle.loads(made[0]["model"]) if made else Model([])


def reject(docs: DataFrame, model: Model, at: float = 0.5) -> DataFrame:
    """The documents whose score is below at, with all their columns; judged row by row, in one pass.

    Without a fitted model (no labels, or of one class only) nothing tells documents apart, and all are kept.
    """
    if model.constant is not None:
        return docs

    def run(batches):
        c = Compressors(model.toxic, model.ordinary)
        for batch, data, offsets in text_runs(batches):
            raw = _LOWER[data].tobytes()
            keep = model.logistic.predict(np.array([features(c.gains(raw[a:b])) for a, b in zip(offsets[:-1], offsets[1:], strict=True)])) < at
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, read(spark, sf_dir, "labels"), mod=5, held=0))
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
