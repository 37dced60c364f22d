"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from the bytes and words of whole texts (shares of character classes, repeated words, pairs and lines,
lengths). A bounded labelled sample of them trains the trees on the driver: columns are binned at quantiles, each level's
splits come from histograms of gradients, and every tree is a full binary tree stored in three arrays. Scoring walks all
rows of a batch down all trees with numpy indexing.

Defined cases: a null or empty text has statistics 0 and is scored like any other; repeated rows get equal scores; with
labels of one class only the score is the share of label 1 (0.5 without labels); columns besides doc_id and text are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, mix, read, remainder, text_runs
from .labelled import counts, sampled

#: Bound of the training sample, for each label.
MOST_ROWS = 6000
TREES, DEPTH, BINS, RATE, RIDGE, LEAST = 80, 4, 64, 0.15, 1.0, 5.0

_CLASS = {
    "upper": np.arange(65, 91),
    "lower": np.arange(97, 123),
    "digit": np.arange(48, 58),
    "stop": np.array([46, 44, 59, 58]),
    "shout": np.array([33, 63]),
    "mark": np.array([i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in ".,;:!?"]),
    "high": np.arange(128, 256),
    "line": np.array([10]),
}
NAMES = (*_CLASS, "log_bytes", "log_words", "word_bytes", "distinct", "same_next", "distinct_pairs", "top_word", "end_marked", "log_line_words", "distinct_lines", "long_words")
_TABLES = np.zeros((len(_CLASS), 256), dtype=np.uint8)
for _k, _v in enumerate(_CLASS.values()):
    _TABLES[_k, _v] = 1
_CODE = np.full(256, len(_CLASS), dtype=np.int64)
for _k, _v in enumerate(_CLASS.values()):
    _CODE[_v] = _k
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of NAMES for each text of the run."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(np.float64)
    own = np.repeat(np.arange(n), np.diff(offsets))
    by_class = np.bincount(own * (len(_CLASS) + 1) + _CODE[data], minlength=n * (len(_CLASS) + 1)).reshape(n, -1)[:, : len(_CLASS)]
    words = Words(data, offsets, lower=True)
    count = words.counts().astype(np.float64)
    of = np.repeat(np.arange(n), words.counts())
    length = words.end - words.start
    one, many = np.maximum(size, 1), np.maximum(count, 1)
    same = np.zeros(len(words.h), dtype=bool)
    same[1:] = (words.h[1:] == words.h[:-1]) & (of[1:] == of[:-1])
    pair = mix(words.h[1:] * np.uint64(3) + words.h[:-1]) if len(words.h) else words.h
    distinct, pairs, top, lines, d_lines = (np.zeros(n) for _ in range(5))
    raw = data.tobytes()
    for k in range(n):
        a, b = words.first[k], words.first[k + 1]
        if b > a:
            s = np.sort(words.h[a:b])
            edge = np.flatnonzero(np.append(s[1:] != s[:-1], True))
            distinct[k] = len(edge)
            top[k] = np.diff(edge, prepend=-1).max()
            pairs[k] = len(np.unique(pair[a : b - 1])) if b - a > 1 else 1
        listed = raw[offsets[k] : offsets[k + 1]].split(b"\n")
        lines[k], d_lines[k] = len(listed), len(set(listed))
    last = data[words.end - 1] if len(words.h) else np.zeros(0, dtype=np.uint8)
    tail = np.bincount(of, weights=~_ALNUM[last], minlength=n)
    return np.column_stack(
        [by_class / one[:, None], np.log1p(size), np.log1p(count), np.bincount(of, weights=length, minlength=n) / many, distinct / many, np.bincount(of, weights=same, minlength=n) / many, pairs / many, top / many, tail / many, np.log1p(count / np.maximum(lines, 1)), d_lines / np.maximum(lines, 1), np.bincount(of, weights=length > 20, minlength=n) / many]
    )


class Trees:
    """Boosted trees of depth DEPTH. split[t, node] is a column, cut[t, node] its threshold (right if above), leaf[t] the values."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None):
        """weight: how many labelled rows each sampled row stands for, up to a common factor."""
        v = np.ones(len(y)) if weight is None else weight / weight.mean()
        share = float(np.clip(np.average(y, weights=v), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        self.start = np.log(share / (1 - share))
        inner = 2**DEPTH - 1
        self.split = np.zeros((TREES, inner), dtype=np.int64)
        self.cut = np.full((TREES, inner), np.inf)
        self.leaf = np.zeros((TREES, 2**DEPTH))
        if len(y) == 0 or y.min() == y.max():
            return
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
        columns = x.shape[1]
        flat = binned + np.arange(columns) * BINS
        f = np.full(len(y), self.start)
        for t in range(TREES):
            p = 1 / (1 + np.exp(-f))
            grad, curve = v * (y - p), v * p * (1 - p)
            node = np.zeros(len(y), dtype=np.int64)
            for level in range(DEPTH):
                width = 2**level
                at = (node - (width - 1))[:, None] * (columns * BINS) + flat
                size = width * columns * BINS
                g = np.bincount(at.ravel(), weights=np.repeat(grad, columns), minlength=size).reshape(width, columns, BINS).cumsum(axis=2)
                h = np.bincount(at.ravel(), weights=np.repeat(curve, columns), minlength=size).reshape(width, columns, BINS).cumsum(axis=2)
                gt, ht = g[:, :, -1:], h[:, :, -1:]
                gain = g**2 / (h + RIDGE) + (gt - g) ** 2 / (ht - h + RIDGE) - gt**2 / (ht + RIDGE)
                gain[(h < LEAST / 4) | (ht - h < LEAST / 4)] = 0
                best = gain.reshape(width, -1).argmax(axis=1)
                for k in range(width):
                    c, b = divmod(int(best[k]), BINS)
                    if gain[k, c, b] > 1e-6 and b < len(edges[c]):
                        self.split[t, width - 1 + k], self.cut[t, width - 1 + k] = c, edges[c][b]
                node = 2 * node + 1 + (x[np.arange(len(y)), self.split[t, node]] > self.cut[t, node])
            k = node - inner
            self.leaf[t] = RATE * np.bincount(k, weights=grad, minlength=2**DEPTH) / (np.bincount(k, weights=curve, minlength=2**DEPTH) + RIDGE)
            f = f + self.leaf[t][k]

    def predict(self, x: np.ndarray) -> np.ndarray:
        f, row = np.full(len(x), self.start), np.arange(len(x))
        for split, cut, leaf in zip(self.split, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[row, split[node]] > cut[node])
            f += leaf[node - len(split)]
        return 1 / (1 + np.exp(-f))


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS, mod: int | None = None, held: int = 0) -> Trees:
    """Statistics are made where the texts are; the driver gets len(NAMES) numbers for each sampled row.

    A thinned label's rows weigh more, so the share of label 1 that the model learns doesn't depend on the bound.
    """

    def run(batches):
        for batch, data, offsets in text_runs(batches):
            x = statistics(data, offsets)
            listed = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("doc_id"), batch.column("y"), listed], ["part", "doc_id", "y", "x"])

    rows = sampled(docs, labels, "quality", most, mod, held).selectExpr("part", "cast(doc_id as long) doc_id", "y", "text")
    got = sorted(map(tuple, rows.mapInArrow(run, "part long, doc_id long, y int, x array<double>").collect()))
    y = np.array([r[2] for r in got], dtype=np.float64)
    stands = {k: n / max(1, (y == k).sum()) for k, n in counts(labels, "quality", mod, held).items()} if got else {}
    return Trees(np.array([r[3] for r in got]).reshape(len(got), len(NAMES)), y, np.array([stands[int(k)] for k in y]) if got else None)


def score(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id and score of each row."""

    def run(batches):
        for batch, data, offsets in text_runs(batches):
            s = trees.predict(statistics(data, offsets))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(s, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, read(spark, sf_dir, "labels"), mod=3, held=1))
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
