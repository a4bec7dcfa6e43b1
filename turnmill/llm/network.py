"""Small numpy classifiers, and labelled rows to fit them on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


def training_fold(doc_id: Column) -> Column:
    """Rows whose labels may be learned: crc32 of the id's text modulo 4 is not 2."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2


def labelled_sample(labels: DataFrame, name: str, most: int) -> DataFrame:
    """At most ``most`` (doc_id, label) of the training fold, by hash of the id.

    Null ids and labels other than 0 and 1 are left out; a repeated id has its
    least label. The bound is what lets the sample be broadcast.
    """
    kept = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(name).cast("int").alias("label"))
    kept = kept.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & training_fold(F.col("doc_id")))
    kept = kept.groupBy("doc_id").agg(F.min("label").alias("label"))
    return kept.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


class TwoLayers:
    """Standardised inputs, one tanh layer, one logit; fitted with Adam."""

    def __init__(self, hidden: int = 32, seed: int = 7):
        self.hidden, self.seed = hidden, seed
        self.temperature = 1.0

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 256, rate: float = 3e-3, decay: float = 1e-4) -> "TwoLayers":
        rng = np.random.default_rng(self.seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = (x - self.mean) / self.scale
        n = z.shape[1]
        self.weights = [
            rng.normal(0, n**-0.5, (n, self.hidden)), np.zeros(self.hidden),
            rng.normal(0, self.hidden**-0.5, self.hidden), np.zeros(()),
        ]
        first, second = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(z))
            for at in range(0, len(z), batch):
                own = order[at : at + batch]
                a, b, c, d = self.weights
                h = np.tanh(z[own] @ a + b)
                gap = (sigmoid(h @ c + d) - y[own]) / len(own)
                back = np.outer(gap, c) * (1 - h * h)
                slopes = [z[own].T @ back + decay * a, back.sum(0), h.T @ gap + decay * c, gap.sum()]
                step += 1
                for k, g in enumerate(slopes):
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                    self.weights[k] = self.weights[k] - rate * move
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.tanh(np.clip((x - self.mean) / self.scale, -20, 20) @ a + b) @ c + d

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> "TwoLayers":
        """The temperature of least log loss on rows that were not fitted."""
        logits = self.logits(x)
        grid = np.geomspace(0.25, 8.0, 61)
        loss = [-np.mean(np.log(np.where(y == 1, p, 1 - p) + 1e-12)) for p in (sigmoid(logits / t) for t in grid)]
        self.temperature = float(grid[int(np.argmin(loss))])
        return self

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.temperature)
