"""Ranked lexical search over hashed max-sketches.

Every document is folded into a sketch: its terms are hashed by several mappings
into cells, and a cell keeps the largest count of the terms that fall into it. As
a term's impact on a document rises with its count, the least of a term's cells
bounds its impact from above, and the weighted sum of these bounds the score. The
width of a sketch follows the number of distinct terms, so long and short texts
are bounded alike.

Queries are looked up in batches, a batch of them in all sketches of a task as one
matrix product. A first look-up picks, for every query, the documents of the
highest expected score, in which a cell counts by the chance that its term is
truly there (how many documents hold it, against how full the sketch is); their
exact scores give a threshold that the last result cannot fall below. A second look-up returns
each document whose bound reaches the threshold; these texts are read again, and
scored exactly from the highest bound down until the bounds are below the best
scores met. No document is left out unless its bound excludes it.

Nothing is collected but the terms of one batch of queries, whose number is
bounded, and three numbers on the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from turnmill.llm.columns import byte_rows, mix, ranges, slices, texts_of
from turnmill.llm.tables import stored
from turnmill.llm.words import TERM, hashed_words, term_counts
from turnmill.session import broadcast_if_small

_SLICE = 1 << 22
MAPPINGS, CELLS_A_TERM = 4, 2  # of each mapping; widths are powers of two
_BATCH = 1 << 14  # terms of the queries that are looked up at once
_ITEM = 32  # an item counts as so many terms besides its own
_SMALL = 32 << 20  # bytes of candidates that are broadcast
_FULL = 255  # a cell that holds this many or more
_MOST = 1_000_000  # no impact is larger
SKETCH = "doc_id long, n long, cells binary, terms binary, holders binary"


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What ``tf`` occurrences count in documents of length factor ``m``."""
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def cell_of(terms: np.ndarray, mapping: int, width: np.ndarray | int) -> np.ndarray:
    """Where a mapping puts terms in sketches of a power of two of cells."""
    spread = mix(terms + np.uint64(0x9E37 * (mapping + 1)))
    return (spread & (np.asarray(width, np.uint64) - np.uint64(1))).astype(np.int64)


def fold(rows: np.ndarray, terms: np.ndarray, counts: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells of all sketches, one after the other, and n + 1 limits."""
    distinct = np.bincount(rows, minlength=n_rows)
    width = 1 << np.ceil(np.log2(np.maximum(8, CELLS_A_TERM * distinct))).astype(np.int64)
    limits = np.concatenate(([0], np.cumsum(MAPPINGS * width)))
    cells = np.zeros(limits[-1], np.uint8)
    # Ascending counts, so that the largest of a cell is written last.
    order = np.argsort(counts, kind="stable")
    own, terms = rows[order], terms[order]
    value = np.minimum(counts[order], _FULL).astype(np.uint8)
    for j in range(MAPPINGS):
        cells[limits[own] + j * width[own] + cell_of(terms, j, width[own])] = value
    return cells, limits


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, and one for the terms of each run of documents
    with how many of these hold them."""
    names = [x.split()[0] for x in SKETCH.split(", ")]
    for batch in batches:
        data, limits = byte_rows(batch.column(1))
        for i, j in slices(limits, _SLICE):
            words, rows = hashed_words(data[limits[i] : limits[j]], limits[i : j + 1] - limits[i], TERM)
            row, term, count = term_counts(words, rows)
            cells, ends = fold(row, term, count, j - i)
            flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(cells)])
            none = pa.nulls(j - i, pa.binary())
            n = pa.array(np.bincount(rows, minlength=j - i).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), n, flat.cast(pa.binary()), none, none], names)
            held, holders = np.unique(term, return_counts=True)
            both = [pa.array([x.tobytes()], pa.binary()) for x in (held, holders.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.binary())), *both], names)


def _holders_of(shared) -> Callable:
    """Rows (terms, holders) to (term, n) of the terms sought."""
    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sought = shared.value
        total = np.zeros(len(sought), np.int64)
        for batch in batches:
            for terms, counts in zip(batch.column(0), batch.column(1), strict=True):
                held = np.frombuffer(terms.as_buffer(), np.uint64)
                if len(held):
                    at = np.minimum(np.searchsorted(held, sought), len(held) - 1)
                    total += np.where(held[at] == sought, np.frombuffer(counts.as_buffer(), np.int64)[at], 0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(sought[some].view(np.int64)), pa.array(total[some])], ["term", "n"])

    return holders


@dataclass(frozen=True)
class Index:
    """Sketches of a corpus, and its numbers of documents with terms and of terms."""

    sketches: DataFrame
    documents: int
    words: int


def build_index(docs: DataFrame) -> Index:
    """Sketches of all documents, written once. Texts are read once for it."""
    sketches = stored(texts_of(docs).mapInArrow(_sketches, SKETCH), "sketches")
    row = sketches.where("cells is not null").agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    return Index(sketches, row[0], row[1])


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, limits = byte_rows(batch.column(1))
        for i, j in slices(limits, _SLICE):
            words, rows = hashed_words(data[limits[i] : limits[j]], limits[i : j + 1] - limits[i], TERM)
            row, term, _ = term_counts(words, rows)
            ids = batch.column(0).take(pa.array(row + i))
            yield pa.RecordBatch.from_arrays([ids, pa.array(term.view(np.int64))], ["item_id", "term"])


class Lookup:
    """A batch of queries: its terms ascending, how many documents hold each,
    their weights, and of every query the places of its terms. Lengths of
    documents are weighed by the corpus."""

    def __init__(self, terms: np.ndarray, holders: np.ndarray, owners: np.ndarray, places: np.ndarray, documents: int, words: int):
        self.terms, self.documents, self.words = terms, documents, words
        self.weights = np.floor(1000 * np.log((2 * documents + 2) / (2 * holders + 1))).astype(np.int64)
        self.share = (holders + 0.5) / (documents + 1)
        order = np.argsort(owners, kind="stable")
        self.places = places[order]
        self.limits = np.searchsorted(owners[order], np.arange(owners.max() + 2))
        self.items = len(self.limits) - 1

    def factors(self, n: np.ndarray) -> np.ndarray:
        return 100 - 50 + 50 * n * self.documents // max(1, self.words)

    def matrix(self) -> np.ndarray:
        out = np.zeros((len(self.terms), self.items), np.float32)
        out[self.places, np.repeat(np.arange(self.items), np.diff(self.limits))] = self.weights[self.places]
        return out

    def sums(self, data: np.ndarray, limits: np.ndarray, n: np.ndarray, expected: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of runs of sketches: their rows, and a bound of every query's score, or
        else the score ``expected``."""
        matrix = self.matrix()
        # Sums of single precision, held above the true ones.
        margin = np.float32(1 + 2.0**-22 * (2 + np.diff(self.limits).max()))
        sizes = np.diff(limits) // MAPPINGS
        m = self.factors(n)
        step = max(1, (1 << 22) // len(self.terms))
        for width in np.unique(sizes):
            at = [cell_of(self.terms, j, int(width)) + j * int(width) for j in range(MAPPINGS)]
            same = np.flatnonzero(sizes == width)
            most = max(1, min(step, (1 << 25) // (MAPPINGS * int(width))))
            for first in range(0, len(same), most):
                rows = same[first : first + most]
                cells = data[limits[rows][:, None] + np.arange(MAPPINGS * int(width))]
                least = np.take(cells, at[0], axis=1)
                for own in at[1:]:
                    np.minimum(least, np.take(cells, own, axis=1), out=least)
                x, y = np.nonzero(least)
                tf = least[x, y].astype(np.int64)
                held = np.zeros(least.shape, np.float32)
                impact = np.where(tf == _FULL, _MOST, impacts(tf, m[rows][x]))
                if expected:
                    filled = (cells.reshape(len(rows), MAPPINGS, -1) > 0).mean(2).prod(1)[x]
                    impact = impact * (self.share[y] / (self.share[y] + (1 - self.share[y]) * filled))
                held[x, y] = impact
                yield rows, held @ matrix * margin

    def scores(self, texts: tuple[np.ndarray, np.ndarray], rows: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Exact scores of pairs of a text (ascending) and a query."""
        words, owner = hashed_words(*texts, TERM)
        n = np.bincount(owner, minlength=len(texts[1]) - 1)
        row, term, count = term_counts(words, owner)
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        hit = self.terms[at] == term
        row, at, count = row[hit], at[hit], count[hit]
        # Sums of integers below 2^53 are exact in doubles.
        part = (impacts(count, self.factors(n)[row]) * self.weights[at]).astype(np.float64)
        out = np.zeros(len(rows))
        held = np.zeros((max(1, (1 << 22) // len(self.terms)), len(self.terms)))
        for first in range(0, len(texts[1]) - 1, len(held)):
            last = first + len(held)
            held[:] = 0
            own = slice(*np.searchsorted(row, (first, last)))
            held[row[own] - first, at[own]] = part[own]
            pairs = np.arange(*np.searchsorted(rows, (first, last)))
            for item in np.unique(items[pairs]):
                mine = pairs[items[pairs] == item]
                places = self.places[self.limits[item] : self.limits[item + 1]]
                out[mine] = held[(rows[mine] - first)[:, None], places].sum(1)
        return out.astype(np.int64)


def _lookup(parts: tuple) -> Lookup:
    return Lookup(*parts)


def _seeds(shared, most: int) -> Callable:
    """Of a task's sketches and every query, the likeliest documents."""
    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _lookup(shared.value)
        best: list[list] = [[] for _ in range(lookup.items)]

        def cut(item: int) -> None:
            guess, doc, known = (np.concatenate(x) for x in zip(*best[item], strict=True))
            top = np.argsort(-guess, kind="stable")[:most]
            best[item] = [(guess[top], doc[top], known[top])]

        for batch in batches:
            doc, known = batch.column(0).fill_null(0).to_numpy(), ~np.asarray(batch.column(0).is_null())
            for rows, guess in lookup.sums(*byte_rows(batch.column(2)), batch.column(1).to_numpy(), expected=True):
                some = min(most, len(rows))
                top = np.argpartition(-guess, some - 1, axis=0)[:some]
                for item in range(lookup.items):
                    own = top[:, item][guess[top[:, item], item] > 0]
                    if len(own):
                        best[item].append((guess[own, item], doc[rows[own]], known[rows[own]]))
                        if len(best[item]) > 8:
                            cut(item)
        for item in range(lookup.items):
            if best[item]:
                cut(item)
                guess, doc, known = best[item][0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(doc), item, np.int32)), pa.array(doc, mask=~known), pa.array(guess.astype(np.float64))], ["item", "doc_id", "bound"]
                )

    return seeds


def _reaching(shared, least: np.ndarray) -> Callable:
    """The documents whose bound reaches the threshold of a query."""
    def reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _lookup(shared.value)
        for batch in batches:
            doc = batch.column(0)
            for rows, bound in lookup.sums(*byte_rows(batch.column(2)), batch.column(1).to_numpy()):
                x, item = np.nonzero(bound >= least[None, :])
                out = [pa.array(item.astype(np.int32)), doc.take(pa.array(rows[x])), pa.array(bound[x, item].astype(np.float64))]
                yield pa.RecordBatch.from_arrays(out, ["item", "doc_id", "bound"])

    return reaching


def _rescored(shared, least: np.ndarray, k: int) -> Callable:
    """Rows (doc_id, text, pairs of item and bound) to a task's best k of a query.

    Within an Arrow batch texts come from the highest bound down, measured by
    what they must beat; a text is not read once all its bounds fall short."""
    def rescored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _lookup(shared.value)
        floor = np.maximum(least, 1).astype(np.int64)
        best: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in range(lookup.items)]
        for batch in batches:
            docs, texts, pairs = (batch.column(c) for c in range(3))
            doc, known = docs.fill_null(0).to_numpy(), ~np.asarray(docs.is_null())
            ends = pairs.offsets.to_numpy() - pairs.offsets[0].as_py()
            flat = pairs.flatten()
            item, bound = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            size = np.diff(ends)
            owner = np.repeat(np.arange(len(doc)), size)
            lead = np.zeros(len(doc))
            np.maximum.at(lead, owner, bound / floor[item])
            order = np.argsort(-lead, kind="stable")
            data, limits = byte_rows(texts)
            for first in range(0, len(order), 256):
                rows = order[first : first + 256]
                which = ranges(ends[rows], size[rows])
                local = np.repeat(np.arange(len(rows)), size[rows])
                open_ = bound[which] >= floor[item[which]]
                which, local = which[open_], local[open_]
                read, local = np.unique(local, return_inverse=True)
                if not len(read):
                    continue
                own = limits[rows[read] + 1] - limits[rows[read]]
                part = data[ranges(limits[rows[read]], own)], np.concatenate(([0], np.cumsum(own)))
                score = lookup.scores(part, local, item[which])
                for i in np.unique(item[which]):
                    mine = (item[which] == i) & (score >= floor[i])
                    if mine.any():
                        at = rows[read[local[mine]]]
                        s, d, z = (np.concatenate(x) for x in zip(best[i], (score[mine], doc[at], ~known[at]), strict=True))
                        top = np.lexsort((d, z, -s))[:k]
                        best[i] = s[top], d[top], z[top]
                        if len(top) == k:
                            floor[i] = max(floor[i], s[top[-1]])
        for i, (s, d, z) in enumerate(best):
            if len(s):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), i, np.int32)), pa.array(d, mask=z), pa.array(s)], ["item", "doc_id", "score"])

    return rescored


def _exact(docs: DataFrame, pairs: DataFrame, shared, least: np.ndarray, k: int) -> DataFrame:
    """(item, doc_id, score): the best k of every query among the pairs."""
    once = pairs.groupBy("doc_id", "item").agg(F.max("bound").alias("bound"))
    by_doc = once.groupBy("doc_id").agg(F.collect_list(F.struct("item", "bound")).alias("pairs"))
    wanted = broadcast_if_small(by_doc.withColumnRenamed("doc_id", "_wanted"), _SMALL)
    rows = texts_of(docs).join(wanted, F.col("doc_id").eqNullSafe(F.col("_wanted"))).select("doc_id", "text", "pairs")
    found = rows.mapInArrow(_rescored(shared, least, k), "item int, doc_id long, score long")
    place = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def search(docs: DataFrame, index: Index, lookup: tuple, k: int, seeds: int) -> DataFrame:
    """(item, rank, doc_id, score) of one batch of queries."""
    shared = docs.sparkSession.sparkContext.broadcast(lookup)
    sketches = index.sketches.where("cells is not null").select("doc_id", "n", "cells")
    schema = "item int, doc_id long, bound double"
    items = _lookup(lookup).items
    least = np.ones(items)
    guessed = sketches.mapInArrow(_seeds(shared, k), schema)
    place = Window.partitionBy("item").orderBy(F.desc("bound"), "doc_id")
    likely = guessed.withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= seeds).drop("_place")
    # Every one of these is scored, whatever its guess.
    likely = likely.withColumn("bound", F.lit(float("inf")))
    for row in _exact(docs, likely, shared, least, k).where(F.col("rank") == k).select("item", "score").collect():
        least[row.item] = max(1, row.score)
    reached = sketches.mapInArrow(_reaching(shared, least), schema)
    return _exact(docs, reached, shared, least, k)


def rank_documents(docs: DataFrame, queries: DataFrame, k: int = 50, seeds: int | None = None) -> DataFrame:
    """The ``k`` documents of the highest score for each query: item_id, rank
    (from 1), doc_id, score.

    ``docs`` has doc_id and text, ``queries`` item_id and text. Terms are the runs
    of ASCII letters, digits and bytes of other scripts, A-Z lower-cased. N
    documents hold at least one term, L terms in all; a term that df documents
    hold weighs w = floor(1000 ln((2 N + 2) / (2 df + 1))), a document of n terms
    has m = 50 + 50 n N div L, and the score is the sum, over the query's
    different terms, of w (10^9 tf div (1000 tf + 20 m)). Documents of score 0 are
    not returned. Equal scores go by doc_id, null last.

    ``seeds``: how many likely documents of each query are scored first, to find
    its threshold (default 4 k); the result does not depend on it.

    Null or empty texts hold no term: such a document is never returned, such a
    query has no rows. Rows with the same doc_id are documents of their own, as
    are those with a null one; rows with the same item_id (null as well) are one
    query with the terms of all. An empty table on either side gives no rows.
    Other columns are ignored.
    """
    if k < 1:
        raise ValueError("k must be positive")
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    asked = queries.select(F.col("item_id").cast("long").alias("item_id"), text.alias("text"))
    terms = stored(asked.mapInArrow(_query_terms, "item_id long, term long").distinct(), "query-terms")
    total = terms.groupBy("item_id").count().agg(F.coalesce(F.sum(F.col("count") + _ITEM), F.lit(0))).first()[0]
    index = build_index(docs) if total else None
    parts = [spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")]
    batches = -(-total // _BATCH)
    for batch in range(batches):
        mine = terms.where(F.pmod(F.xxhash64(F.col("item_id")), F.lit(batches)) == batch).collect()
        if not mine:
            continue
        ids = sorted({r.item_id for r in mine}, key=lambda i: (i is None, i))
        number = {i: at for at, i in enumerate(ids)}
        hashes = np.array([r.term for r in mine], np.int64).view(np.uint64)
        sought, places = np.unique(hashes, return_inverse=True)
        counts = index.sketches.where("terms is not null").select("terms", "holders")
        counts = counts.mapInArrow(_holders_of(spark.sparkContext.broadcast(sought)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        holders = np.zeros(len(sought), np.int64)
        for r in counts.collect():
            holders[np.searchsorted(sought, np.array([r.term], np.int64).view(np.uint64)[0])] = r.n
        owners = np.array([number[r.item_id] for r in mine])
        found = search(docs, index, (sought, holders, owners, places, index.documents, index.words), k, seeds or 4 * k)
        names = F.broadcast(spark.createDataFrame(list(enumerate(ids)), "item int, item_id long"))  # of one batch
        parts.append(found.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    out = parts.pop(0)
    for part in parts:
        out = out.unionByName(part)
    return out
