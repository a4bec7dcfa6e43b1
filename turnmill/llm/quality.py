"""Quality classifier on random-indexing word vectors.

Every word has a fixed sparse random index vector, drawn from its hash. A word's
vector is the sum of its neighbours' index vectors over all documents; words
share 2**15 buckets, so the table has a fixed size whatever the corpus holds.
A document is the pooled vectors of its words: their mean, their spread and the
mean product of neighbours. A two-layer network on these is fitted on a bounded
sample of labelled documents, its temperature on the part of the sample that was
held back.

Two passes over the texts (vectors, scores) and one over the labelled ones. The
tasks' tables are added up slice by slice; only the sum, 4 MB, reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from turnmill.llm.columns import byte_rows, mix, slices, texts_of
from turnmill.llm.network import TwoLayers, labelled_sample
from turnmill.llm.tables import Shipped

WORDS, DIMS = 1 << 15, 32
_NEAR, _SIGNS, _SLICES, _RUN = 2, 4, 16, 1 << 20
#: Bytes of words (letters, digits and all beyond ASCII), of white space, of signs.
_KIND = np.array([1 if chr(c).isalnum() or c >= 128 else 0 if c in (9, 10, 11, 12, 13, 32) else 2 for c in range(256)], np.int8)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def tokens(data: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and runs of signs of all rows, and n + 1 limits."""
    rows = len(limits) - 1
    kind = _KIND[data]
    new = np.ones(len(data), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[limits[:-1][limits[:-1] < len(data)]] = True
    starts = np.flatnonzero(new & (kind > 0))
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(rows + 1, np.int64)
    where = np.flatnonzero(kind > 0)
    first = np.searchsorted(where, starts)
    place = np.arange(len(where)) - np.repeat(first, np.diff(np.append(first, len(where))))
    power = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(int(place.max()), _STEP | np.uint64(1), np.uint64))))
    hashes = mix(np.add.reduceat(_BYTE[data[where]] * power[place], first))
    return (hashes >> np.uint64(49)).astype(np.int64), np.searchsorted(starts, limits)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """The few dimensions of every bucket's index vector, and their signs."""
    drawn = mix(np.arange(WORDS * _SIGNS, dtype=np.uint64) + np.uint64(1 << 40)).reshape(WORDS, _SIGNS)
    return (drawn % np.uint64(DIMS)).astype(np.int64), np.where(drawn >> np.uint64(63), 1, -1)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each task: the sums of neighbours' index vectors, in slices."""
    dims, signs = index_vectors()
    table = np.zeros(WORDS * DIMS)
    for batch in batches:
        data, limits = byte_rows(batch.column(1))
        for i, j in slices(limits, _RUN):
            words, ends = tokens(data[limits[i] : limits[j]], limits[i : j + 1] - limits[i])
            row = np.repeat(np.arange(j - i), np.diff(ends))
            for away in range(1, _NEAR + 1):
                same = row[away:] == row[:-away]
                left, right = words[:-away][same], words[away:][same]
                for own, other in ((left, right), (right, left)):
                    for k in range(_SIGNS):
                        table += np.bincount(own * DIMS + dims[other, k], signs[other, k], WORDS * DIMS)
    parts = table.astype(np.float32).reshape(_SLICES, -1)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(_SLICES)), pa.array([p.tobytes() for p in parts], pa.binary())], ["slice", "sums"]
    )


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            part = np.frombuffer(blob.as_buffer(), np.float32)
            sums[k] = sums[k] + part if k in sums else part.astype(np.float64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int64()), pa.array([s.astype(np.float32).tobytes() for s in sums.values()], pa.binary())],
        ["slice", "sums"],
    )


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit vectors of all buckets from every text of ``docs``."""
    parts = texts_of(docs).mapInArrow(_contexts, "slice long, sums binary").repartition(_SLICES, "slice")
    table = np.zeros((_SLICES, WORDS * DIMS // _SLICES), np.float32)
    for k, blob in parts.mapInArrow(_added, "slice long, sums binary").collect():
        table[k] = np.frombuffer(blob, np.float32)
    table = table.reshape(WORDS, DIMS)
    table -= table.mean(0)
    return table / (np.sqrt((table * table).sum(1, keepdims=True)) + 1e-6)


def pooled(data: np.ndarray, limits: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """A row for each text: pooled word vectors. Without words, zeros."""
    rows = len(limits) - 1
    words, ends = tokens(data, limits)
    out = np.zeros((rows, 3 * DIMS))
    n = np.diff(ends)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    drawn = vectors[words]
    at = ends[:-1][full]
    mean = np.add.reduceat(drawn, at, dtype=np.float64) / n[full, None]
    out[full, :DIMS] = mean
    out[full, DIMS : 2 * DIMS] = np.sqrt(np.maximum(0, np.add.reduceat(drawn * drawn, at, dtype=np.float64) / n[full, None] - mean**2))
    after = np.roll(drawn, -1, axis=0)
    after[ends[1:][full] - 1] = 0
    out[full, 2 * DIMS :] = np.add.reduceat(drawn * after, at, dtype=np.float64) / n[full, None]
    return out


def _features(shared) -> Callable:
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, limits = byte_rows(batch.column(1))
            for i, j in slices(limits, _RUN):
                x = pooled(data[limits[i] : limits[j]], limits[i : j + 1] - limits[i], shared.value)
                rows = [r.tobytes() for r in x]
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(i, j - i), pa.array(rows, pa.binary())], ["label", "x"])

    return features


def _scorer(shared) -> Callable:
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, model = shared.value
        for batch in batches:
            data, limits = byte_rows(batch.column(1))
            for i, j in slices(limits, _RUN):
                score = model.scores(pooled(data[limits[i] : limits[j]], limits[i : j + 1] - limits[i], vectors))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(score)], ["doc_id", "score"])

    return scored


class QualityModel:
    """Word vectors and the fitted network; scores any documents."""

    def __init__(self, vectors: np.ndarray, network: TwoLayers):
        self.vectors, self.network = vectors, network

    def scores(self, docs: DataFrame) -> DataFrame:
        """doc_id and score (0 to 1, higher: label 1 likelier) of every row."""
        shared = Shipped(docs.sparkSession, (self.vectors, self.network))
        return texts_of(docs).mapInArrow(_scorer(shared), "doc_id long, score double")

    def kept(self, docs: DataFrame, least: float) -> DataFrame:
        """The rows of ``docs`` that score at least ``least``, unchanged."""
        shared = Shipped(docs.sparkSession, (self.vectors, self.network))
        names = docs.columns
        text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
        whole = docs.select(F.struct(*names).alias("row"), text.alias("text"))

        def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vectors, model = shared.value
            for batch in batches:
                data, limits = byte_rows(batch.column(1))
                for i, j in slices(limits, _RUN):
                    score = model.scores(pooled(data[limits[i] : limits[j]], limits[i : j + 1] - limits[i], vectors))
                    rows = batch.column(0).slice(i, j - i).filter(pa.array(score >= least))
                    yield pa.RecordBatch.from_arrays([rows], ["row"])

        return whole.mapInArrow(passed, whole.select("row").schema).select("row.*")


class Constant:
    """Scores everything alike; stands in where there is nothing to tell apart."""

    def __init__(self, score: float):
        self.score = score

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.score)


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 20_000) -> QualityModel:
    """Fits the classifier. Word vectors come from every document, labels from at
    most ``most`` labelled documents of the training fold (see labelled_sample).

    Null text is empty; empty texts are scored like any other, by pooled zeros.
    Null and repeated doc_ids are scored row by row. Where all learned labels are
    equal or there are none, every score is 1 - or 0, if all labels are 0.
    Columns other than doc_id and text play no part.
    """
    vectors = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    sample = F.broadcast(labelled_sample(labels, label, most))
    rows = texts_of(docs).join(sample, "doc_id").mapInArrow(_features(shared), "label int, x binary").collect()
    y = np.array([r[0] for r in rows], float)
    if len(set(y)) < 2:
        return QualityModel(vectors, Constant(float(y[0]) if len(y) else 1.0))
    x = np.array([np.frombuffer(r[1]) for r in rows])
    order = np.lexsort((*x.T[:4], y))  # the same rows in the same order, whatever task came first
    x, y = x[order], y[order]
    back = np.arange(len(y)) % 5 == 0
    network = TwoLayers().fit(x[~back], y[~back])
    return QualityModel(vectors, network.calibrate(x[back], y[back]))
