"""Removal of repeated byte strings by content-chosen hashing.

Whether a string of ``length`` bytes occurs before is a question about equal
prefixes of suffixes. There is no suffix order and no difference cover here:
places chosen by content gather the suffixes that may be equal, and hashes settle
which are. Two things follow from the size of the corpus:

- The sample of places is chosen by content: of every ``length`` bytes, the place
  whose first half-length string has the least hash. Equal strings hold equal
  sample places at equal offsets, which is what a cover is for, but one place in
  26 is enough for 100 bytes where an arithmetic cover takes one in six.
- A suffix belongs to the bucket of its sample place. All suffixes of one place
  that reach over the same bytes (its context) are equal or not together, so the
  place's hashes, of the half-length string and of the context, settle
  them all at once. Only the first place of every context in a bucket that has
  several contexts is sorted suffix by suffix, each suffix by its offset and the
  hash of its ``length`` bytes.

Hashes stand for strings: 96 bits or more wherever equality decides.

Places leave a task packed by bucket and once per context (further ones of the
task are removed there), so a hot passage is a row per task. Texts are shuffled
only if they may hold something to settle or to remove, judged by a bitmap of
fixed size; a full bitmap sends more texts and changes no result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window

from turnmill.llm.columns import byte_rows, mix, ranges, texts_of
from turnmill.llm.tables import stored

_SEGMENT = 1 << 20  # windows looked at together; long texts are cut here
_HELD = 400_000  # places a task holds before it sends them
_BITS = 1 << 22
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_PACKED = "bucket long, kind int, c0 binary, c1 binary, doc binary, copy binary, lo binary, hi binary"
_NAMES = [x.split()[0] for x in _PACKED.split(", ")]
_PLACES, _MARKS, _OPEN = 0, 1, 2
_TYPES = {"c0": "<u8", "c1": "<u8", "doc": "<i8", "copy": "<i4", "lo": "<i8", "hi": "<i8"}
Columns = dict[str, np.ndarray]


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(max(0, n - 1), base, np.uint64))))


class Hashes:
    """Hashes of any substring of some bytes, or of some words given by 64-bit
    hashes, from running sums."""

    def __init__(self, data: np.ndarray):
        if getattr(Hashes, "size", 0) < len(data) + 1:
            Hashes.size = len(data) + 1
            Hashes.up, Hashes.down = _powers(_BASE, Hashes.size), _powers(_INVERSE, Hashes.size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        values = data if data.dtype == np.uint64 else _BYTE[data]
        np.cumsum(values * Hashes.up[: len(data)], out=self.sums[1:])

    def at(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * Hashes.down[starts])

    def all(self, n: int) -> np.ndarray:
        """Of the n bytes from every place on."""
        return mix((self.sums[n:] - self.sums[:-n]) * Hashes.down[: len(self.sums) - n])


def places_of(data: np.ndarray, limits: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Sample places of rows of bytes: row, first and last start of the strings
    that choose the place (from the row's begin), rank of the place, context."""
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    if len(data) < length:
        return none
    assert len(data) <= 8 * _SEGMENT
    half = length // 2
    hashes = Hashes(data)
    grams = hashes.all(half)
    low = np.uint64(8 * _SEGMENT - 1)  # the place goes where the hash's last bits are
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    width, have = length - half + 1, 1
    while 2 * have <= width:  # the least of 2, 4, 8 … neighbours, the first of equals
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    chosen = (least & low).astype(np.int64)
    sizes = np.diff(limits)
    count = np.maximum(0, sizes - length + 1)
    starts = ranges(limits[:-1], count)  # of strings within one row
    if not len(starts):
        return none
    chosen = chosen[starts]
    row = np.repeat(np.arange(len(sizes)), count)
    first = np.flatnonzero(np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1]))))
    last = np.append(first[1:], len(starts)) - 1
    a, b, place, row = starts[first], starts[last], chosen[first], row[first]
    shape = ((place - a) * 4096 + (b - a)).astype(np.uint64)
    context = mix(hashes.at(a, b + length) ^ mix(shape + np.uint64(1)))
    return row, a - limits[row], b - limits[row], grams[place], context


def _segments(limits: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows cut into runs of about _SEGMENT bytes: row numbers, and begin and end
    of each piece. Pieces of a long row overlap by length - 1 bytes, so that each
    string lies in exactly one."""
    rows, begins, ends, total = [], [], [], 0
    for row in range(len(limits) - 1):
        at, stop = int(limits[row]), int(limits[row + 1])
        while True:
            end = min(stop, at + _SEGMENT + length - 1)
            rows.append(row), begins.append(at), ends.append(end)
            total += end - at
            if total >= _SEGMENT:
                yield np.array(rows), np.array(begins), np.array(ends)
                rows, begins, ends, total = [], [], [], 0
            if end == stop:
                break
            at += _SEGMENT
    if rows:
        yield np.array(rows), np.array(begins), np.array(ends)


def _joined(parts: list[Columns]) -> Columns:
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def _take(columns: Columns, which: np.ndarray) -> Columns:
    return {k: v[which] for k, v in columns.items()}


def _settle(rows: Columns) -> tuple[Columns, Columns, Columns]:
    """Of places: those not alone in their bucket and not the first of their
    context (to be removed); the first ones of contexts; of these, those in
    buckets with several contexts."""
    order = np.argsort(rows["c0"], kind="stable")
    rank = rows["c0"][order]
    same = rank[1:] == rank[:-1]
    shared = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    many = _take(rows, order[shared])
    many = _take(many, np.lexsort((many["lo"], many["copy"], many["doc"], many["c1"], many["c0"])))
    new = np.ones(len(many["c0"]), bool)
    new[1:] = (many["c0"][1:] != many["c0"][:-1]) | (many["c1"][1:] != many["c1"][:-1])
    firsts = _take(many, new)
    same = firsts["c0"][1:] == firsts["c0"][:-1]
    several = np.concatenate(([False], same)) | np.concatenate((same, [False])) if len(firsts["c0"]) else new
    alone = _take(rows, order[~shared])
    return _take(many, ~new), _joined([alone, firsts]), _take(firsts, several)


def _ranges_joined(marks: Columns) -> Columns:
    """Ranges of starts of the same document that follow on each other, as one."""
    marks = _take(marks, np.lexsort((marks["lo"], marks["copy"], marks["doc"])))
    if not len(marks["lo"]):
        return marks
    new = np.ones(len(marks["lo"]), bool)
    new[1:] = (
        (marks["doc"][1:] != marks["doc"][:-1]) | (marks["copy"][1:] != marks["copy"][:-1]) | (marks["lo"][1:] > marks["hi"][:-1] + 1)
    )
    first = np.flatnonzero(new)
    out = _take(marks, first)
    out["hi"] = np.maximum.reduceat(marks["hi"], first)
    return out


def _packed(rows: Columns, bucket: np.ndarray, kind: int) -> pa.RecordBatch:
    """One row for each bucket, with its part of every column as bytes."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    edges = np.append(np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))), len(bucket))
    columns: list[pa.Array] = [pa.array(bucket[edges[:-1]]), pa.array(np.full(len(edges) - 1, kind, np.int32))]
    for name, form in _TYPES.items():
        if name not in rows:
            columns.append(pa.nulls(len(edges) - 1, pa.binary()))
            continue
        values = rows[name][order].astype(form)
        columns.append(pa.array([values[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays(columns, _NAMES)


def _unpacked(batch: pa.RecordBatch, kind: int) -> list[Columns]:
    out = []
    kinds = batch.column("kind").to_numpy(zero_copy_only=False)
    for i in np.flatnonzero(kinds == kind):
        cells = {k: batch.column(k)[int(i)] for k in _TYPES}
        out.append({k: np.frombuffer(c.as_buffer(), _TYPES[k]) for k, c in cells.items() if c.is_valid})
    return out


def _bucket_of(values: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(values.view(np.uint64) ^ _BASE) % np.uint64(buckets)).astype(np.int64)


def _sample(length: int, buckets: int) -> Callable:
    """Places of all texts, packed by rank, and what the task itself settles."""
    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Columns] = []

        def sent() -> Iterator[pa.RecordBatch]:
            marks, firsts, _ = _settle(_joined(held))
            held.clear()
            marks = _ranges_joined({k: marks[k] for k in ("doc", "copy", "lo", "hi")})
            if len(marks["lo"]):
                yield _packed(marks, _bucket_of(marks["doc"], buckets), _MARKS)
            yield _packed(firsts, _bucket_of(firsts["c0"], buckets), _PLACES)

        for batch in batches:
            docs, copies = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            data, limits = byte_rows(batch.column(1))
            for rows, begins, ends in _segments(limits, length):
                at = ranges(begins, ends - begins)
                part = data[begins[0] : ends[-1]] if len(at) == ends[-1] - begins[0] else data[at]
                own, lo, hi, rank, context = places_of(part, np.concatenate(([0], np.cumsum(ends - begins))), length)
                if not len(own):
                    continue
                shift = (begins - limits[rows])[own]
                own = rows[own]
                held.append({"c0": rank, "c1": context, "doc": docs[own], "copy": copies[own], "lo": lo + shift, "hi": hi + shift})
                if sum(len(h["lo"]) for h in held) > _HELD:
                    yield from sent()
        if held:
            yield from sent()

    return sample


def _ranked(buckets: int) -> Callable:
    """Places of some ranks to ranges of starts to remove and places to sort;
    both packed by document."""
    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: list[Columns] = []
        found: list[Columns] = []
        for batch in batches:
            places += _unpacked(batch, _PLACES)
            found += _unpacked(batch, _MARKS)
        if places:
            marks, _, several = _settle(_joined(places))
            found.append({k: marks[k] for k in ("doc", "copy", "lo", "hi")})
            if len(several["lo"]):
                yield _packed(several, _bucket_of(several["doc"], buckets), _OPEN)
        if found:
            marks = _ranges_joined(_joined(found))
            if len(marks["lo"]):
                yield _packed(marks, _bucket_of(marks["doc"], buckets), _MARKS)

    return ranked


def _by_document(batches: Iterator[pa.RecordBatch], kind: int) -> Iterator[tuple[int, int, bytes, Columns]]:
    """Documents with their rows of ``kind``; a bucket's rows come before its texts."""
    bucket, rows = None, None
    pending: list[Columns] = []
    for batch in batches:
        buckets, kinds = batch.column("bucket").to_pylist(), batch.column("kind").to_pylist()
        for i, (b, k) in enumerate(zip(buckets, kinds, strict=True)):
            if b != bucket:
                bucket, rows, pending = b, None, []
            if k == kind:
                pending += _unpacked(batch.slice(i, 1), kind)
                continue
            if rows is None:
                rows = _joined(pending) if pending else {x: np.zeros(0, t) for x, t in _TYPES.items()}
                rows = _take(rows, np.lexsort((rows["lo"], rows["copy"], rows["doc"])))
            doc, copy = (np.frombuffer(batch.column(c)[i].as_buffer(), _TYPES[c])[0] for c in ("doc", "copy"))
            a, z = np.searchsorted(rows["doc"], [doc, doc + 1]) if doc < np.iinfo(np.int64).max else (np.searchsorted(rows["doc"], doc), len(rows["doc"]))
            own = _take(rows, np.arange(a, z)[rows["copy"][a:z] == copy])
            yield int(doc), int(copy), batch.column("c0")[i].as_buffer(), own


def _bytes_of(text: bytes) -> np.ndarray:
    return np.frombuffer(text, np.uint8)


def _suffixes(length: int, buckets: int, symbols: Callable[[bytes], np.ndarray] = _bytes_of) -> Callable:
    """The suffixes of places that are to be sorted, packed by bucket."""
    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Columns] = []
        count = 0

        def sent() -> Iterator[pa.RecordBatch]:
            marks, firsts = _first_of_equals(_joined(held))
            held.clear()
            if len(marks["lo"]):
                yield _packed(marks, _bucket_of(marks["doc"], buckets), _MARKS)
            yield _packed(firsts, _bucket_of(firsts["c0"], buckets), _OPEN)

        for doc, copy, text, places in _by_document(batches, _OPEN):
            if not len(places["lo"]):
                continue
            data = symbols(text)
            # Only the stretches that the places reach over are hashed.
            begin, end = places["lo"], places["hi"] + length
            apart = np.concatenate(([True], begin[1:] > np.maximum.accumulate(end)[:-1]))
            group = np.flatnonzero(apart)
            reach = np.maximum.reduceat(end, group)
            for a, z, k, m in zip(begin[group], reach, group, np.append(group[1:], len(begin)), strict=True):
                hashes = Hashes(data[a:z])
                n = places["hi"][k:m] - begin[k:m] + 1
                starts = ranges(begin[k:m], n)
                own = np.repeat(places["c0"][k:m], n)
                held.append({
                    "c0": own,
                    "c1": hashes.at(starts - a, starts - a + length),
                    "doc": np.full(len(starts), doc), "copy": np.full(len(starts), copy, np.int32), "lo": starts, "hi": starts,
                })
                count += len(starts)
            if count > 2 * _HELD:
                count = 0
                yield from sent()
        if held:
            yield from sent()

    return suffixes


def _first_of_equals(rows: Columns) -> tuple[Columns, Columns]:
    """Suffixes that equal an earlier one, as joined ranges; the first ones."""
    rows = _take(rows, np.lexsort((rows["lo"], rows["copy"], rows["doc"], rows["c1"], rows["c0"])))
    new = np.ones(len(rows["c0"]), bool)
    new[1:] = (rows["c0"][1:] != rows["c0"][:-1]) | (rows["c1"][1:] != rows["c1"][:-1])
    marks = _take(rows, ~new)
    return _ranges_joined({k: marks[k] for k in ("doc", "copy", "lo", "hi")}), _take(rows, new)


def _sorted_bucket(buckets: int) -> Callable:
    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[Columns] = []
        found: list[Columns] = []
        for batch in batches:
            open_ += _unpacked(batch, _OPEN)
            found += _unpacked(batch, _MARKS)
        if open_:
            found.append(_first_of_equals(_joined(open_))[0])
        if found:
            marks = _ranges_joined(_joined(found))
            if len(marks["lo"]):
                yield _packed(marks, _bucket_of(marks["doc"], buckets), _MARKS)

    return bucket


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmap of the documents that packed rows speak of."""
    bits = np.zeros(_BITS, bool)
    for batch in batches:
        for cell in batch.column(0):
            bits[_bucket_of(np.frombuffer(cell.as_buffer(), "<i8"), _BITS)] = True
    yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])


def _bitmap(packed: DataFrame):
    parts = packed.select("doc").coalesce(16).mapInArrow(_bits, "bits binary").collect()
    bits = np.zeros(_BITS // 8, np.uint8)
    for r in parts:
        bits |= np.frombuffer(r[0], np.uint8)
    return packed.sparkSession.sparkContext.broadcast(np.unpackbits(bits).astype(bool))


def _named(shared, buckets: int, want: bool) -> Callable:
    """Texts of documents in the bitmap, packed like the rows they are to meet;
    or the texts of all others as they are."""
    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            docs = batch.column(0).to_numpy()
            which = np.flatnonzero(bits[_bucket_of(docs, _BITS)] == want)
            if not want:
                yield batch.take(pa.array(which))
                continue
            n = len(which)
            cells = [pa.array([x[i : i + 1].astype(t).tobytes() for i in which], pa.binary()) for x, t in ((docs, "<i8"), (batch.column(2).to_numpy(), "<i4"))]
            empty = pa.nulls(n, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(_bucket_of(docs[which], buckets)), pa.array(np.full(n, 9, np.int32)), batch.column(1).take(pa.array(which)), empty, *cells, empty, empty],
                _NAMES,
            )

    return named


_RESULT = "doc_id long, copy int, kept binary, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>"


def _result_rows(rows: list[tuple]) -> pa.RecordBatch:
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.list_(span)]
    columns = zip(*rows, strict=True) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "copy", "kept", "n_bytes", "n_removed", "spans"])


def _cut(length: int, whole: bool) -> Callable:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, weight = [], 0
        for doc, copy, text, marks in _by_document(batches, _MARKS):
            data = np.frombuffer(text, np.uint8)
            depth = np.zeros(len(data) + 1, np.int32)
            np.add.at(depth, marks["lo"], 1)
            np.add.at(depth, marks["hi"] + length, -1)
            gone = np.cumsum(depth)[:-1] > 0
            if whole and gone.any():  # a character goes if all its bytes do
                first = np.flatnonzero((data & 0xC0) != 0x80)
                gone = np.repeat(np.logical_and.reduceat(gone, first), np.diff(np.append(first, len(data))))
            sides = np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))
            spans = [{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(sides == 1), np.flatnonzero(sides == -1), strict=True)]
            kept = data[~gone].tobytes()
            out.append((doc, copy, kept, len(data), int(gone.sum()), spans))
            weight += len(kept)
            if weight > 1 << 24 or len(out) > 2000:
                yield _result_rows(out)
                out, weight = [], 0
        yield _result_rows(out)

    return cut


def keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Rows (doc_id, text, copy) to compare, rows (doc_id, text_bytes) without
    doc_id, and the bytes of all texts. ``copy`` orders different texts of one
    doc_id, equal ones are one; it is 0 everywhere where ids are unique."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0]
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    again = ids.dropna().groupBy("doc_id").count().where("count > 1").limit(1).count()
    rows = texts_of(docs)
    whole = rows.where("doc_id is null").select("doc_id", F.col("text").alias("text_bytes"))
    rows = rows.where("doc_id is not null")
    if not again:
        return rows.withColumn("copy", F.lit(0)), whole, total
    rows = rows.withColumn("sha", F.sha2("text", 256)).dropDuplicates(["doc_id", "sha"])
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id").orderBy("sha"))).drop("sha")
    return stored(rows, "texts"), whole, total


def remove_repeats(
    docs: DataFrame, length: int = 100, block: int = 12 << 20, whole_characters: bool = False
) -> DataFrame:
    """Every text without the bytes covered by a string of ``length`` bytes that
    also starts earlier: in a document of smaller doc_id, or earlier in its own.

    Columns: doc_id, text_bytes (what is left, as binary: it may break a
    character), n_bytes, n_removed, spans (maximal removed stretches as byte
    offsets). Strings are judged on the input, occurrences may overlap.

    Null text counts as empty. Rows with null doc_id take no part and stay
    whole. Of rows with one doc_id, equal texts are one document, returned once,
    and different ones count in the order of their SHA-256. Texts below
    ``length`` bytes stay whole. Empty input: no rows. Other columns are ignored.
    ``block``: bytes of text to each bucket. ``whole_characters``: a character
    stays unless all of its bytes are covered, so that what is left is text.
    """
    if length < 16 or length > 4000:
        raise ValueError("length from 16 to 4000")
    rows, whole, total = keyed(docs)
    buckets = 1 + total // block

    places = rows.mapInArrow(_sample(length, buckets), _PACKED).repartition(buckets, "bucket")
    settled = stored(places.mapInArrow(_ranked(buckets), _PACKED), "places")
    marks, open_ = settled.where(F.col("kind") == _MARKS), settled.where(F.col("kind") == _OPEN)

    texts = rows.mapInArrow(_named(_bitmap(open_), buckets, True), _PACKED)
    met = open_.unionByName(texts).repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind")
    by_rank = met.mapInArrow(_suffixes(length, buckets), _PACKED).repartition(buckets, "bucket")
    more = stored(by_rank.mapInArrow(_sorted_bucket(buckets), _PACKED), "suffixes")

    marks = marks.unionByName(more)
    bits = _bitmap(marks)
    texts = rows.mapInArrow(_named(bits, buckets, True), _PACKED)
    met = marks.unionByName(texts).repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind")
    cut = met.mapInArrow(_cut(length, whole_characters), _RESULT).select("doc_id", F.col("kept").alias("text_bytes"), "n_bytes", "n_removed", "spans")
    clean = rows.mapInArrow(_named(bits, buckets, False), "doc_id long, text binary, copy int")
    whole = whole.unionByName(clean.select("doc_id", F.col("text").alias("text_bytes")))
    nothing = F.array().cast("array<struct<start: long, end: long>>")
    return cut.unionByName(
        whole.withColumns({"n_bytes": F.octet_length("text_bytes").cast("long"), "n_removed": F.lit(0).cast("long"), "spans": nothing})
    )
