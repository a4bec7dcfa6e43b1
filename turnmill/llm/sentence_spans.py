"""Removal of repeated runs of sentences and of words.

Every run of a few consecutive sentences is hashed; equal runs meet in a shuffle,
and the sentences of all but the first are removed. Runs leave a task once each
(repeats within it are settled there), so a run that a third of the documents
hold is a row per task. Only texts that may lose something are shuffled.

Runs of a fixed number of words, wherever sentences begin and end, are found as
suffix_dedup finds strings, with the hashes of words in the place of bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from turnmill.llm.columns import byte_rows, mix, ranges, slices
from turnmill.llm.suffix_dedup import (
    Columns,
    _HELD,
    _MARKS,
    _OPEN,
    _PACKED,
    _PLACES,
    _bitmap,
    _bucket_of,
    _by_document,
    _first_of_equals,
    _joined,
    _named,
    _packed,
    _powers,
    _ranges_joined,
    _segments,
    _settle,
    _sorted_bucket,
    _suffixes,
    _unpacked,
    keyed,
    places_of,
)
from turnmill.llm.tables import stored

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOP = np.zeros(256, bool)
_STOP[[33, 46, 63]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_STEPS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_RUNS = 3  # kind of packed rows: runs of sentences
#: Characters of scripts that put no space between words (first, last).
_UNSPACED = ((0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
_STOPS = "։؟۔।॥။።។៕。．｡！？‼⁇⁈⁉"
_RESULT = "doc_id long, text_bytes binary, n_sentences long, n_removed long"


def _code_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of the UTF-8 characters that begin at ``at``; texts are sound UTF-8."""
    lead = data[at].astype(np.int64)
    more = [data[np.minimum(at + k, len(data) - 1)].astype(np.int64) & 63 for k in (1, 2, 3)]
    two, three = (lead & 31) << 6 | more[0], (lead & 15) << 12 | more[0] << 6 | more[1]
    four = (lead & 7) << 18 | more[0] << 12 | more[1] << 6 | more[2]
    return np.where(lead < 0xC0, lead, np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, four)))


def words_of(data: np.ndarray, limits: np.ndarray, scripts: bool = False) -> tuple[np.ndarray, ...]:
    """Begins, last bytes, hashes and rows of all words, and where sentences begin
    among them.

    Words are parted by white space, A-Z count as lower case. A sentence ends
    with a word that ends in ``.``, ``!`` or ``?``, and with its line. With
    ``scripts``, a character of a script without spaces is a word, and the stops
    of other scripts end sentences.
    """
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[limits] = True
    new = inside & (np.concatenate(([True], ~inside[:-1])) | edge[:-1]) if len(data) else np.zeros(0, bool)
    wide = np.flatnonzero(data >= 0xC0) if scripts else np.zeros(0, np.int64)
    codes = _code_points(data, wide)
    if len(wide):
        alone = np.zeros(len(wide), bool)
        for a, z in _UNSPACED:
            alone |= (codes >= a) & (codes <= z)
        new[wide[alone]] = True
        size = 2 + (data[wide] >= 0xE0) + (data[wide] >= 0xF0).astype(np.int64)
        after = (wide + size)[alone]
        after = after[after < len(data)]
        new[after] |= inside[after]
    starts = np.flatnonzero(new)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), none, none
    where = np.flatnonzero(inside)
    first = np.searchsorted(where, starts)
    last = where[np.append(first[1:], len(where)) - 1]
    place = np.arange(len(where)) - np.repeat(first, np.diff(np.append(first, len(where))))
    power = _powers(_STEPS[0], int(place.max()) + 1)
    words = mix(np.add.reduceat(_BYTE[_LOWER[data[where]]] * power[place], first))
    row = np.searchsorted(limits, starts, "right") - 1
    feeds = np.concatenate(([0], np.cumsum(data == 10)))
    stop = _STOP[data[last]]
    if len(wide):
        ends = (wide + size - 1)[np.isin(codes, [ord(c) for c in _STOPS])]
        marked = np.zeros(len(data), bool)
        marked[ends] = True
        stop |= marked[last]
    new = np.ones(len(starts), bool)
    new[1:] = stop[:-1] | (row[1:] != row[:-1]) | (feeds[starts[1:]] > feeds[last[:-1]])
    return starts, last, words, row, np.flatnonzero(new)


def _hashed(words: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Hashes of the sentences that begin at the words ``begin``."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    size = np.diff(np.append(begin, len(words)))
    turn = _powers(_STEPS[1], int(size.max()))[np.arange(len(words)) - np.repeat(begin, size)]
    return mix(np.add.reduceat(words * turn, begin))


def _word_hashes(text: bytes) -> np.ndarray:
    data = np.frombuffer(text, np.uint8)
    return words_of(data, np.array([0, len(data)]), True)[2]


def _spans(span: int, words: int | None, buckets: int) -> Callable:
    """Runs of sentences of all texts and, with ``words``, sample places of their
    words; packed, and what the task itself settles. Marks are word ranges
    [lo, hi + reach), reach being ``words`` or 1."""
    reach = words or 1

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Columns] = []
        places: list[Columns] = []

        def sent() -> Iterator[pa.RecordBatch]:
            found = []
            if held:
                marks, firsts = _first_of_equals(_joined(held))
                found.append(marks)
                yield _packed(firsts, _bucket_of(firsts["c0"], buckets), _RUNS)
            if places:
                marks, firsts, _ = _settle(_joined(places))
                found.append({k: marks[k] for k in ("doc", "copy", "lo", "hi")})
                yield _packed(firsts, _bucket_of(firsts["c0"], buckets), _PLACES)
            held.clear(), places.clear()
            marks = _ranges_joined(_joined(found))
            if len(marks["lo"]):
                yield _packed(marks, _bucket_of(marks["doc"], buckets), _MARKS)

        for batch in batches:
            docs, copies = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            data, limits = byte_rows(batch.column(1))
            for i, j in slices(limits, 1 << 20):
                _, _, values, row, begin = words_of(data[limits[i] : limits[j]], limits[i : j + 1] - limits[i], words is not None)
                hashes, ends = _hashed(values, begin), np.searchsorted(row[begin], np.arange(j - i + 1))
                edges = np.searchsorted(row, np.arange(j - i + 1))
                until = np.append(begin[1:], len(values))
                n = np.diff(ends)
                length = np.minimum(n, span)
                runs = np.where(n > 0, n - length + 1, 0)
                own = np.repeat(np.arange(j - i), runs)
                at = ends[own] + ranges(np.zeros(j - i, np.int64), runs)
                keys = []
                for step in _STEPS:
                    value = length[own].astype(np.uint64)
                    turn = _powers(step, span + 1)
                    for k in range(span):
                        live = length[own] > k
                        value[live] += hashes[at[live] + k] * turn[k + 1]
                    keys.append(mix(value))
                if len(own):
                    lo, hi = begin[at] - edges[own], until[at + length[own] - 1] - edges[own] - reach
                    held.append({"c0": keys[0], "c1": keys[1], "doc": docs[i:j][own], "copy": copies[i:j][own], "lo": lo, "hi": hi})
                for rows, begins, stops in _segments(edges, words) if words else ():
                    at = ranges(begins, stops - begins)
                    own, lo, hi, rank, context = places_of(values[at], np.concatenate(([0], np.cumsum(stops - begins))), words)
                    if len(own):
                        shift = (begins - edges[rows])[own]
                        own = i + rows[own]
                        places.append({"c0": rank, "c1": context, "doc": docs[own], "copy": copies[own], "lo": lo + shift, "hi": hi + shift})
                if sum(len(h["lo"]) for h in held + places) > _HELD:
                    yield from sent()
        if held or places:
            yield from sent()

    return spans


def _met(buckets: int) -> Callable:
    """Runs and places that meet, to word ranges to remove and places to sort;
    both packed by document."""
    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: dict[int, list[Columns]] = {_RUNS: [], _PLACES: [], _MARKS: []}
        for batch in batches:
            for kind, rows in kinds.items():
                rows += _unpacked(batch, kind)
        found = kinds[_MARKS]
        if kinds[_RUNS]:
            found.append(_first_of_equals(_joined(kinds.pop(_RUNS)))[0])
        if kinds[_PLACES]:
            marks, _, several = _settle(_joined(kinds.pop(_PLACES)))
            found.append({k: marks[k] for k in ("doc", "copy", "lo", "hi")})
            if len(several["lo"]):
                yield _packed(several, _bucket_of(several["doc"], buckets), _OPEN)
        if found:
            marks = _ranges_joined(_joined([{k: f[k] for k in ("doc", "copy", "lo", "hi")} for f in found]))
            if len(marks["lo"]):
                yield _packed(marks, _bucket_of(marks["doc"], buckets), _MARKS)

    return met


def _cut(words: int | None) -> Callable:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, weight = [], 0

        def rows() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64())
            columns = zip(*out, strict=True) if out else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "text_bytes", "n_sentences", "n_removed"])

        for doc, _, text, marks in _by_document(batches, _MARKS):
            data = np.frombuffer(text, np.uint8)
            starts, _, _, _, begin = words_of(data, np.array([0, len(data)]), words is not None)
            depth = np.zeros(len(starts) + 1, np.int32)
            np.add.at(depth, marks["lo"], 1)
            np.add.at(depth, marks["hi"] + (words or 1), -1)
            gone = np.cumsum(depth)[:-1] > 0
            keep = np.repeat(np.concatenate(([True], ~gone)), np.diff(np.concatenate(([0], starts, [len(data)]))))
            whole = np.logical_and.reduceat(gone, begin) if len(begin) else gone
            out.append((doc, data[keep].tobytes(), len(begin), int(whole.sum())))
            weight += len(data)
            if weight > 1 << 24:
                yield rows()
                out, weight = [], 0
        yield rows()

    return cut


def remove_repeated_spans(docs: DataFrame, span: int = 3, block: int = 12 << 20, words: int | None = None) -> DataFrame:
    """Every text without the sentences of runs of ``span`` sentences that occur
    before: in a document of smaller doc_id, or earlier in their own; with
    ``words``, also without the words of every run of so many that occurs before,
    wherever in a sentence it begins and ends.

    Columns: doc_id, text_bytes (UTF-8), n_sentences, n_removed (sentences of
    which nothing is left). What is removed takes the white space up to the next
    word with it. A text of fewer sentences than ``span`` is one run. Runs are
    judged on the input and may overlap; case of A-Z and kind of white space do
    not matter. With ``words``, characters of scripts without spaces count as
    words, and sentences also end at the stops of other scripts.

    Null text counts as empty and has no sentences. Null and repeated doc_ids and
    other columns: as in suffix_dedup.remove_repeats.
    """
    if words is not None and not 16 <= words <= 4000:
        raise ValueError("words from 16 to 4000")
    rows, whole, total = keyed(docs)
    buckets = 1 + total // block
    packed = rows.mapInArrow(_spans(span, words, buckets), _PACKED).repartition(buckets, "bucket")
    settled = stored(packed.mapInArrow(_met(buckets), _PACKED), "spans")
    marks = settled.where(F.col("kind") == _MARKS)
    if words:
        open_ = settled.where(F.col("kind") == _OPEN)
        texts = rows.mapInArrow(_named(_bitmap(open_), buckets, True), _PACKED)
        met = open_.unionByName(texts).repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind")
        by_rank = met.mapInArrow(_suffixes(words, buckets, _word_hashes), _PACKED).repartition(buckets, "bucket")
        marks = marks.unionByName(stored(by_rank.mapInArrow(_sorted_bucket(buckets), _PACKED), "suffixes"))
    bits = _bitmap(marks)
    texts = rows.mapInArrow(_named(bits, buckets, True), _PACKED)
    met = marks.unionByName(texts).repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind")
    cut = met.mapInArrow(_cut(words), _RESULT)
    clean = rows.mapInArrow(_named(bits, buckets, False), "doc_id long, text binary, copy int").select("doc_id", F.col("text").alias("text_bytes"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, limits = byte_rows(batch.column(1))
            parts = []
            for i, j in slices(limits, 1 << 20):
                _, _, _, row, begin = words_of(data[limits[i] : limits[j]], limits[i : j + 1] - limits[i], words is not None)
                parts.append(np.bincount(row[begin], minlength=j - i))
            n = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), pa.array(np.zeros(len(n), np.int64))], ["doc_id", "text_bytes", "n_sentences", "n_removed"])

    return cut.unionByName(clean.unionByName(whole).mapInArrow(counted, _RESULT))
