"""Bounded samples of labelled documents for the classifiers, and the logistic model both may use."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _marks(labels: DataFrame, target: str, mod: int | None, held: int) -> DataFrame:
    """doc_id, y of the rows to learn from."""
    marks = labels.where(f"{target} in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max(target).alias("y"))
    return marks if mod is None else marks.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod != held)


def sampled(docs: DataFrame, labels: DataFrame, target: str, most: int, mod: int | None, held: int, seed: int = 1) -> DataFrame:
    """part (a hash of the id), doc_id, text, y (label) of about `most` rows of each label at most.

    Rows whose crc32(doc_id as text) mod `mod` is `held` are left out (mod None: none are). Labels that are null or of
    ids without a document are left out; of an id's repeated labels the larger counts. A class of more than `most` rows
    is thinned by the hash to about `most`; this bound is what keeps the driver's memory fixed.
    """
    marks = _marks(labels, target, mod, held)
    part = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000))
    keep = F.lit(False)
    for y, n in counts(labels, target, mod, held).items():
        keep = keep | ((F.col("y") == y) & (part < int(1_000_000 * min(1.0, most / n)) + 1))
    return docs.select("doc_id", "text").join(F.broadcast(marks.where(keep)), "doc_id").select(part.alias("part"), "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("y").cast("int"))


def counts(labels: DataFrame, target: str, mod: int | None, held: int) -> dict[int, int]:
    """How many rows of each label there are to learn from."""
    return {int(r["y"]): r["count"] for r in _marks(labels, target, mod, held).groupBy("y").count().collect()}


class Logistic:
    """Ridge-penalised logistic regression on standardised columns, fitted by Newton's method."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, penalty: float = 1e-2):
        v = np.ones(len(y)) if weight is None else weight / weight.mean()
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = self._design(x)
        self.w = np.zeros(z.shape[1])
        for _ in range(40):
            p = self._sigmoid(z @ self.w)
            slope = z.T @ (v * (y - p)) - penalty * self.w
            curve = (z * (v * p * (1 - p))[:, None]).T @ z + penalty * np.eye(len(self.w))
            step = np.linalg.solve(curve, slope)
            self.w += step
            if np.abs(step).max() < 1e-8:
                break

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.ones((len(x), 1)), (x - self.mean) / self.scale], axis=1)

    @staticmethod
    def _sigmoid(v: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(v, -40, 40)))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self._sigmoid(self._design(x) @ self.w)
