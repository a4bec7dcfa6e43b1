"""Toxicity by non-negative learning from positive and unlabelled texts.

Only confirmed toxic documents count as labelled; all documents, whatever they
are marked, are the unlabelled text and may hide toxic ones. The risk estimator
takes the class prior's share of the positives' loss out of the unlabelled loss
and, where that drives the negative risk below zero, steps back instead (Kiryo
and others, 2017).

The classifiers are linear in the distinct words of a text and their beginnings
of four to six bytes, hashed. Every run of some thousand documents trains one
against the same confirmed texts, where it is read; their mean over all documents
is the model. Training reads the documents twice, to count the features of
confirmed texts in them and to train; scoring reads them once. What tasks send is
one sum for each feature that weighs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from turnmill.llm.columns import byte_rows, mix, slices, texts_of
from turnmill.llm.network import labelled_sample, sigmoid
from turnmill.llm.tables import Shipped

_RUN = 1 << 22
_DOCUMENTS = 8192  # that train one classifier
_STARTS = (4, 5, 6)
_WORD = np.array([48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_STEP = np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)


def _hashed(data: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of every word: its row, its hash, where it begins among ``values``, and its
    length; and the summands of the bytes of all words."""
    inside = _WORD[data]
    new = inside.copy()
    new[1:] &= ~inside[:-1]
    edges = limits[:-1][limits[:-1] < len(data)]
    new[edges] |= inside[edges]
    starts = np.flatnonzero(new)
    where = np.flatnonzero(inside)
    first = np.searchsorted(where, starts)
    sizes = np.diff(np.append(first, len(where)))
    if not len(starts):
        return starts.astype(np.uint64), starts.astype(np.uint64), first, sizes, np.zeros(0, np.uint64)
    place = np.arange(len(where)) - np.repeat(first, sizes)
    power = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(int(place.max()), _STEP, np.uint64))))
    values = _BYTE[_LOWER[data[where]]] * power[place]
    row = (np.searchsorted(limits, starts, "right") - 1).astype(np.uint64)
    return row, mix(np.add.reduceat(values, first)), first, sizes, values


def _beginnings(which: np.ndarray, first: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of ``which`` that are longer than so many bytes, and the hash of
    their beginning, for each number of bytes."""
    for n in _STARTS:
        longer = which[sizes[which] > n]
        part = values[first[longer]].copy()
        for k in range(1, n):
            part += values[first[longer] + k]
        yield longer, mix(part + np.uint64(n))


def _distinct(found: list[tuple[np.ndarray, np.ndarray]], rows: int) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(np.concatenate([(r << np.uint64(32)) | (h >> np.uint64(32)) for r, h in found]))
    return key.astype(np.uint32), np.searchsorted(key >> np.uint64(32), np.arange(rows + 1))


def features(data: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of every row, ascending, and n + 1 limits."""
    row, whole, first, sizes, values = _hashed(data, limits)
    _, once = np.unique((row << np.uint64(40)) | (whole >> np.uint64(24)), return_index=True)
    found = [(row[once], whole[once])]
    found += [(row[longer], start) for longer, start in _beginnings(once, first, sizes, values)]
    return _distinct(found, len(limits) - 1)


class Known:
    """Features that are looked for, ascending; a bitmap keeps most others out
    before they are sorted."""

    def __init__(self, cells: np.ndarray):
        self.cells = cells
        self.bits = np.zeros(1 << 20, bool)
        self.bits[cells & np.uint32((1 << 20) - 1)] = True

    def _may_be(self, hashes: np.ndarray) -> np.ndarray:
        return self.bits[((hashes >> np.uint64(32)) & np.uint64((1 << 20) - 1)).astype(np.int64)]

    def places(self, data: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``features``, but only those known, by their places."""
        row, whole, first, sizes, values = _hashed(data, limits)
        hit = self._may_be(whole)
        found = [(row[hit], whole[hit])]
        for longer, start in _beginnings(np.arange(len(row)), first, sizes, values):
            hit = self._may_be(start)
            found.append((row[longer[hit]], start[hit]))
        cells, ends = _distinct(found, len(limits) - 1)
        at = _places(self.cells, cells)
        sure = at < len(self.cells)
        return at[sure], np.concatenate(([0], np.cumsum(sure)))[ends]


def _places(known: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Where features are among the known ones; of others, the place after the last."""
    at = np.searchsorted(known, cells)
    found = np.zeros(len(cells), bool)
    inner = at < len(known)
    found[inner] = known[at[inner]] == cells[inner]
    return np.where(found, at, len(known))


def _sums(weights: np.ndarray, cells: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Of each row, the sum of its features' weights."""
    total = np.concatenate(([0.0], np.cumsum(weights[cells])))
    return total[limits[1:]] - total[limits[:-1]]


class ToxicityModel:
    """Averaged linear classifiers; scores any documents. ``known``: the features
    that weigh, ascending."""

    def __init__(self, known: np.ndarray, weights: np.ndarray, bias: float):
        self.known, self.weights, self.bias = known, weights, bias

    def scores(self, docs: DataFrame) -> DataFrame:
        """doc_id and score (0 to 1, higher: toxic likelier) of every row."""
        shared = Shipped(docs.sparkSession, self)

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = shared.value
            known = Known(model.known)
            for batch in batches:
                data, limits = byte_rows(batch.column(1))
                for i, j in slices(limits, _RUN):
                    cells, ends = known.places(data[limits[i] : limits[j]], limits[i : j + 1] - limits[i])
                    score = sigmoid(_sums(model.weights, cells, ends) + model.bias)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(score)], ["doc_id", "score"])

        return texts_of(docs).mapInArrow(scored, "doc_id long, score double")


def _collected(rows: DataFrame) -> tuple[np.ndarray, list[np.ndarray]]:
    """Labels and features of a bounded sample."""
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, limits = byte_rows(batch.column(1))
            for i, j in slices(limits, _RUN):
                cells, ends = features(data[limits[i] : limits[j]], limits[i : j + 1] - limits[i])
                blobs = [cells[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(i, j - i), pa.array(blobs, pa.binary())], ["label", "cells"])

    got = rows.mapInArrow(extract, "label int, cells binary").collect()
    # The same rows in the same order, whatever task came first.
    got = sorted((r[0], bytes(r[1])) for r in got)
    return np.array([r[0] for r in got]), [np.frombuffer(r[1], np.uint32) for r in got]


def _without_copies(rows: list[np.ndarray]) -> list[int]:
    """One row of those that share their least uncommon feature; copies would
    pass off their own words as telling."""
    if not rows:
        return []
    every, times = np.unique(np.concatenate(rows), return_counts=True)
    common = every[times > max(2, 0.01 * len(rows))]
    seen: set[int] = set()
    out = []
    for k in range(len(rows) - 1, -1, -1):
        rare = rows[k][_places(common, rows[k]) == len(common)]
        least = int(rare[0]) if len(rare) else -1 - k
        if least not in seen:
            seen.add(least)
            out.append(k)
    return out


def _patterns(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different rows, one after the other: cells, limits and how often each is."""
    times: dict[bytes, int] = {}
    for row in rows:
        key = row.astype(np.int64).tobytes()
        times[key] = times.get(key, 0) + 1
    own = [np.frombuffer(key, np.int64) for key in times]
    limits = np.concatenate(([0], np.cumsum([len(r) for r in own], dtype=np.int64)))
    return np.concatenate(own) if own else np.zeros(0, np.int64), limits, np.array(list(times.values()), float)


def fit_nnpu(
    positive: list[np.ndarray], unlabelled: list[np.ndarray], features: int, prior: float,
    steps: int = 200, rate: float = 0.05, shrink: float = 0.15,
) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with logistic loss.
    Rows are the features they have; equal rows are one with a weight, so every
    step is over all of them. ``shrink`` pulls weights towards 0, the less the more
    positives there are."""
    decay = shrink / max(1, len(positive))
    sides = [_patterns(rows) for rows in (positive, unlabelled)]
    shares = [times / times.sum() for _, _, times in sides]
    w, first, second = (np.zeros(features + 1) for _ in range(3))
    w[-1] = np.log(prior / (1 - prior))
    for step in range(1, steps + 1):
        zp, zu = (_sums(w, cells, limits) + w[-1] for cells, limits, _ in sides)
        p, u = shares
        # Loss of a positive log(1 + e^-z), of a negative log(1 + e^z).
        negative = (u * np.logaddexp(0, zu)).sum() - prior * (p * np.logaddexp(0, zp)).sum()
        if negative >= 0:
            pull = (-prior * p * (sigmoid(-zp) + sigmoid(zp)), u * sigmoid(zu))
        else:
            pull = (prior * p * sigmoid(zp), -u * sigmoid(zu))
        slope = np.append(decay * w[:-1], 0.0)
        for (cells, limits, _), g in zip(sides, pull, strict=True):
            slope[:-1] += np.bincount(cells, np.repeat(g, np.diff(limits)), features)
            slope[-1] += g.sum()
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope * slope
        w = w - rate * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-6)
    return w[:-1], float(w[-1])


def _fitted(docs: DataFrame, known: np.ndarray, positive: list[np.ndarray], prior: float) -> tuple[np.ndarray, float]:
    """The mean, over all documents, of the classifiers of their runs."""
    shared = docs.sparkSession.sparkContext.broadcast((known, *_patterns(positive), prior))

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, cells, limits, times, prior = shared.value
        sought = Known(known)
        confirmed = [cells[a:b] for a, b, n in zip(limits[:-1], limits[1:], times, strict=True) for _ in range(int(n))]
        total, n = np.zeros(len(known) + 1), 0
        held: list[np.ndarray] = []

        def fit() -> None:
            nonlocal total, n
            w, bias = fit_nnpu(confirmed, held, len(known), prior)
            total += len(held) * np.append(w, bias)
            n += len(held)
            held.clear()

        for batch in batches:
            data, limits = byte_rows(batch.column(1))
            for i, j in slices(limits, _RUN):
                own, ends = sought.places(data[limits[i] : limits[j]], limits[i : j + 1] - limits[i])
                held += np.split(own, ends[1:-1])
                if len(held) >= _DOCUMENTS:
                    fit()
        if held:
            fit()
        place = np.arange(len(known) + 2)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(np.append(total, float(n)))], ["place", "total"])

    sums = texts_of(docs).mapInArrow(fitted, "place long, total double").groupBy("place").agg(F.sum("total").alias("total")).collect()
    out = np.zeros(len(known) + 2)
    for place, total in sums:
        out[place] = total
    return out[:-2] / out[-1], float(out[-2] / out[-1])


def _counts(docs: DataFrame, known: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of all documents, and how many of them have each known feature."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        sought = Known(own)
        total = np.zeros(len(own) + 1, np.int64)
        n = 0
        for batch in batches:
            data, limits = byte_rows(batch.column(1))
            n += batch.num_rows
            for i, j in slices(limits, _RUN):
                cells, _ = sought.places(data[limits[i] : limits[j]], limits[i : j + 1] - limits[i])
                total += np.bincount(cells, minlength=len(own) + 1)
        total[-1] = n
        which = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(total[which])], ["place", "n"])

    got = texts_of(docs).mapInArrow(counted, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(known) + 1, np.int64)
    for place, n in got:
        out[place] = n
    return int(out[-1]), out[:-1]


def train_toxicity(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = 20_000, positives: int = 4_000, least: int = 3
) -> ToxicityModel:
    """Fits the classifiers.

    Confirmed examples are at most ``positives`` of at most ``most`` labelled
    documents of the training fold; their share of these is the class prior.
    Unlabelled text is that of every document. Only features weigh that at least
    ``least`` confirmed texts have, however many these are (copies count once), and
    confirmed texts at least half as much oftener than all documents as the prior
    lets features of toxic texts be.

    Null text is empty; empty texts score by the bias alone. Null and repeated
    doc_ids are scored row by row. Without confirmed examples or documents every
    score is the prior (0 without labels). Columns other than doc_id and text play
    no part.
    """
    sample = labelled_sample(labels, label, most)
    total, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not toxic:
        return ToxicityModel(np.zeros(0, np.uint32), np.zeros(0), -40.0)
    prior = min(max(toxic / total, 1e-4), 0.9)
    confirmed = sample.where("label = 1").orderBy(F.xxhash64("doc_id")).limit(positives)
    rows = texts_of(docs).join(F.broadcast(confirmed), "doc_id").select("doc_id", "text", "label")
    _, one = _collected(rows)
    if not one:
        return ToxicityModel(np.zeros(0, np.uint32), np.zeros(0), float(np.log(prior / (1 - prior))))
    single = [one[k] for k in _without_copies(one)]
    known, times = np.unique(np.concatenate(single), return_counts=True)
    known, in_one = known[times >= least], times[times >= least]
    total_docs, in_all = _counts(docs, known)
    # What only toxic texts have is 1 / prior times as frequent in confirmed ones.
    known = known[in_one * total_docs * prior > 0.5 * (in_all + 1) * len(single)]
    one = [p[p < len(known)] for p in (_places(known, c) for c in one)]
    weights, bias = _fitted(docs, known, one, prior)
    return ToxicityModel(known, weights, bias)
