"""Similarity join on word n-grams with count-vector R-trees.

Shingles are hashed and dealt into groups; a document's shingles per group are a
point. The overlap of two documents is at most the sum over the groups of the
smaller count, and that of a document with an R-tree box at most the same sum
with the box's upper corner. Pairs whose bound reaches the overlap that the
similarity needs are verified on the sets themselves.

Which documents share a tree is settled exactly beforehand. Of every set the
least hashes (two fifths) are sent to meet others; two similar sets must share a
known number of these. Documents with fewer shared hashes drop out; of the rest,
the rarest shared hashes (all but that number, plus one) meet again, of which two
similar sets must share one. Chains of documents that do, broken where sizes
alone exclude all links, form the groups: every link lies within a group, and a
passage that many texts share brings no strangers together. All counts are
exact, no table is broadcast but a bitmap of fixed size.

Texts travel only if a bitmap of fixed size says that they may be in a group.

Copies are one point. A group beyond ``tile`` shingles is cut into runs by size
and every pair of runs gets a tree of its own. Texts of a tree most of whose
shingles no other text of it has are left out, again and again; a text is looked
up among those only that share one of its rarest shingles with it, so texts that
common lines brought together are not held against each other. Pairs that are
connected already are not looked at again: the result is the links that span
the components, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from turnmill.llm.columns import byte_rows, mix, ranges, slices, texts_of
from turnmill.llm.graph import components, local_components
from turnmill.llm.tables import repeats_an_id, stored, with_own_ids
from turnmill.operators.ranks import grouped_offsets

GROUPS = 256
_SLICE = 1 << 19
_FEW = 32  # sets that are verified at once, at first
_POSTING = np.dtype([("token", "<u4"), ("text", "<i8"), ("n", "<u4")])
_SHARED = np.dtype([("key", "<u8"), ("times", "<u4"), ("text", "<i8"), ("n", "<u4")])
_BITS = 1 << 22  # of the bitmap of documents that are to meet
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = _STEP | np.uint64(1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_CODE = np.where(_SPACE, np.uint64(0), _BYTE[_LOWER])


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out, out=out)


def shingles(data: np.ndarray, limits: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every row, ascending, and n + 1 limits.

    Words are runs of bytes that are not white space, A-Z lower-cased; a row of
    fewer than ``size`` words, but not none, has its whole sequence as the one
    shingle.
    """
    rows = len(limits) - 1
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = limits[:-1][limits[:-1] < limits[1:]]
    begins[firsts] = inside[firsts]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    # Bytes count by the power of their place in the data; the inverse power of a
    # word's first place makes that the place in the word.
    codes = _CODE[data]
    codes *= _powers(_BASE, len(data))
    words = np.add.reduceat(codes, starts)
    del codes
    words = mix(words * _powers(_INVERSE, len(data))[starts])
    begin = np.searchsorted(starts, limits)
    counts = np.diff(begin)
    n = np.where(counts > 0, np.maximum(counts - size, 0) + 1, 0)
    factor = _powers(np.uint64(0xD6E8FEB86659FD93), size + 1)
    window = np.full(len(words), size, np.uint64)
    for k in range(min(size, len(words))):
        window[: len(words) - k] += words[k:] * factor[k + 1]
    value = window[ranges(begin[:-1], n)]
    ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(n)))
    few = np.flatnonzero((counts > 0) & (counts < size))
    if len(few):
        whole = counts[few].astype(np.uint64)
        for k in range(size - 1):
            live = counts[few] > k
            whole[live] += words[begin[few[live]] + k] * factor[k + 1]
        value[ends[few]] = whole
    value = mix(value)
    several = np.flatnonzero(n > 1)
    for i, j in zip(ends[several].tolist(), ends[several + 1].tolist(), strict=True):
        value[i:j].sort()
    keep = np.ones(len(value), bool)
    keep[1:] = value[1:] != value[:-1]
    keep[ends[:-1][n > 0]] = True
    return value[keep], np.concatenate((np.zeros(1, np.int64), np.cumsum(keep)))[ends]


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """First column, hashes and limits of runs of rows (doc_id, text)."""
    for batch in batches:
        data, limits = byte_rows(batch.column(1))
        for i, j in slices(limits, _SLICE):
            yield batch.column(0).slice(i, j - i), *shingles(data[limits[i] : limits[j]], limits[i : j + 1] - limits[i], size)


def _signatures(hashes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """One number for each set; equal sets have equal ones."""
    n = np.diff(limits)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ _STEP), dtype=np.uint64)))
    return mix(total[limits[1:]] - total[limits[:-1]] + n.astype(np.uint64)).view(np.int64)


def _profiles(size: int) -> Callable:
    """Number of shingles and signature of each document."""
    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, hashes, limits in _sets(batches, size):
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(limits)), pa.array(_signatures(hashes, limits))], ["doc_id", "n", "sig"])

    return profile


def _met(shared) -> Callable:
    """Rows (doc_id, …) whose id may be in the bitmap."""
    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            yield batch.filter(pa.array(bits[_bit_of(batch.column(0).to_numpy())]))

    return met


def _bit_of(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.view(np.uint64)) % np.uint64(_BITS)).astype(np.int64)


def _bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(_BITS, bool)
    for batch in batches:
        bits[_bit_of(batch.column(0).to_numpy())] = True
    yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])


def _sent(n: np.ndarray, percent: int) -> np.ndarray:
    """Hashes of a set of n that are sent: two fifths, and one more than similar
    sets can lack."""
    return np.minimum(n, np.maximum((2 * n + 4) // 5, n - (percent * n + 99) // 100 + 1))


def _shared_at_least(n: np.ndarray, percent: int) -> np.ndarray:
    """Sent hashes that a set of n shares with any similar one, at least.

    Two sets of sizes a, b have t (a + b) / (1 + t) elements in common; at most
    a - sent(a) of these, or b - sent(b), are beyond the last sent hash that both
    reach. The least over all b from t a to a / t.
    """
    t, f = percent / 100, 0.4
    least = min(f - (1 - t), t / (1 + t) - max(0.0, 1 / (1 + t) - f) / t)
    return np.maximum(1, np.floor(least * n + 1e-9).astype(np.int64))


def _packed(bucket: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """One row of bytes for each bucket."""
    few = np.uint16 if len(bucket) and bucket.max() < 1 << 16 else bucket.dtype  # sorted by counting
    order = np.argsort(bucket.astype(few), kind="stable")
    bucket, rows = bucket[order], rows[order]
    edges = np.append(np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))), len(bucket))
    blobs = [rows[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]]), pa.array(blobs, pa.binary())], ["bucket", "rows"])


def _unpacked(batches: Iterator[pa.RecordBatch], form: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All rows of a task and the bucket of each."""
    parts, buckets = [], []
    for batch in batches:
        for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            parts.append(np.frombuffer(blob.as_buffer(), form))
            buckets.append(np.full(len(parts[-1]), bucket))
    if not parts:
        return np.zeros(0, form), np.zeros(0, np.int64)
    return np.concatenate(parts), np.concatenate(buckets)


def _postings(size: int, percent: int, buckets: int) -> Callable:
    """The least hashes of every set, packed by hash."""
    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0
        for _, hashes, limits in _sets(batches, size):
            n = np.diff(limits)
            sigs = _signatures(hashes, limits)
            # A copy within the run brings nothing new.
            single = np.zeros(len(n), bool)
            single[np.unique(sigs, return_index=True)[1]] = True
            take = np.where(single, _sent(n, percent), 0)
            owner = np.repeat(np.arange(len(n)), take)
            own = hashes[ranges(limits[:-1], take)]
            rows = np.zeros(len(own), _POSTING)
            rows["token"], rows["text"], rows["n"] = own.astype(np.uint32), sigs[owner], n[owner]
            held.append(((mix(own) % np.uint64(buckets)).astype(np.int64), rows))
            count += len(own)
            if count > 1_000_000:
                yield _packed(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, count = [], 0
        if count:
            yield _packed(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return postings


def _runs(rows: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows whose hash several texts have, sorted by hash, size and text, without
    repeats; keys; run lengths by row."""
    key = (bucket.astype(np.uint64) << np.uint64(32)) | rows["token"]
    order = np.argsort(key)
    same = key[order]
    same = same[1:] == same[:-1]
    order = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
    rows, key = rows[order], key[order]
    order = np.lexsort((rows["text"], rows["n"], key))
    rows, key = rows[order], key[order]
    new = np.ones(len(rows), bool)
    new[1:] = (key[1:] != key[:-1]) | (rows["text"][1:] != rows["text"][:-1])
    rows, key = rows[new], key[new]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    length = np.diff(np.append(first, len(key)))
    length = np.repeat(length, length)
    several = length > 1
    return rows[several], key[several], length[several]


def _shared(buckets: int) -> Callable:
    """Hashes that several texts sent, packed by text, with how many did."""
    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, bucket = _unpacked(batches, _POSTING)
        if not len(rows):
            return
        rows, key, length = _runs(rows, bucket)
        out = np.zeros(len(rows), _SHARED)
        out["key"], out["times"] = key, length
        out["text"], out["n"] = rows["text"], rows["n"]
        if len(out):
            yield _packed((mix(out["text"].view(np.uint64)) % np.uint64(buckets)).astype(np.int64), out)

    return shared


def _rarest(percent: int) -> Callable:
    """Of texts with enough shared hashes, the rarest ones, packed by hash again."""
    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, _ = _unpacked(batches, _SHARED)
        if not len(rows):
            return
        rows = rows[np.lexsort((rows["key"], rows["times"], rows["text"]))]
        first = np.flatnonzero(np.concatenate(([True], rows["text"][1:] != rows["text"][:-1])))
        length = np.diff(np.append(first, len(rows)))
        take = np.maximum(0, length - _shared_at_least(rows["n"][first].astype(np.int64), percent) + 1)
        rows = rows[ranges(first, take)]
        out = np.zeros(len(rows), _POSTING)
        out["token"], out["text"], out["n"] = rows["key"].astype(np.uint32), rows["text"], rows["n"]
        if len(out):
            yield _packed((rows["key"] >> np.uint64(32)).astype(np.int64), out)

    return rarest


def _chains(percent: int) -> Callable:
    """Texts that share a hash, chained by size; a chain breaks where even the
    two neighbours' sizes exclude a link, for then they exclude all across. What
    a task chains it also connects, so few edges leave it."""
    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, bucket = _unpacked(batches, _POSTING)
        if not len(rows):
            return
        rows, key, _ = _runs(rows, bucket)
        n, text = rows["n"].astype(np.int64), rows["text"]
        link = (key[1:] == key[:-1]) & (100 * n[:-1] >= percent * n[1:])
        if link.any():
            nodes, roots = local_components(text[:-1][link], text[1:][link])
            away = nodes != roots
            yield pa.RecordBatch.from_arrays([pa.array(nodes[away]), pa.array(roots[away])], ["a", "b"])

    return chain


class CountTree:
    """A packed R-tree over points of group counts, in the order given."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, fan: int = 16):
        self.sizes, self.fan = sizes, fan
        self.levels = [(points, sizes, sizes)]  # upper corners, least and largest size below
        while len(self.levels[-1][0]) > fan:
            corner, low, high = self.levels[-1]
            at = np.arange(0, len(corner), fan)
            self.levels.append(tuple(f.reduceat(x, at, axis=0) for f, x in ((np.maximum, corner), (np.minimum, low), (np.maximum, high))))

    def search(self, point: np.ndarray, size: int, percent: int, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the points ``among`` (ascending) that may reach the similarity with
        ``point``, and their bounds. Branches without any of them are not entered."""
        held, ups = [among], []
        # A box is worth a look if it stands for several of its points.
        while len(held) < len(self.levels) and len(held[-1]) > self.fan:
            box = held[-1] // self.fan
            new = np.concatenate(([True], box[1:] != box[:-1]))
            if 4 * np.count_nonzero(new) > len(box):
                break
            held.append(box[new])
            ups.append(np.cumsum(new) - 1)
        inside = np.ones(len(held[-1]), bool)
        for depth in range(len(held) - 1, -1, -1):
            at = held[depth][inside]
            corner, low, high = (x[at] for x in self.levels[depth])
            bound = np.minimum(corner, point).sum(axis=1, dtype=np.int64)
            # overlap >= t / (1 + t) (size + other) and both sizes within a factor t
            fits = (bound * (100 + percent) >= percent * (size + low)) & (100 * high >= percent * size) & (percent * low <= 100 * size)
            if depth:
                inside[inside] = fits
                inside = inside[ups[depth - 1]]
        return at[fits], bound[fits]


def group_points(hashes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Shingles per group of every set."""
    rows = len(limits) - 1
    points = np.zeros((rows, GROUPS), np.int32)
    for i in range(0, rows, 4096):
        j = min(i + 4096, rows)
        owner = np.repeat(np.arange(j - i), np.diff(limits[i : j + 1]))
        cell = owner * GROUPS + (hashes[limits[i] : limits[j]] % np.uint64(GROUPS)).astype(np.int64)
        points[i:j] = np.bincount(cell, minlength=(j - i) * GROUPS).reshape(j - i, GROUPS)
    return points


class _Sets:
    """Sets that may be similar to another one, by size: of every set the hashes
    that another one has, the rarest first.

    Similar sets share t of the larger one. A set of which too few hashes occur in
    others is left out, and then what only it has in common with others no longer
    counts for these; and so on while many go.
    """

    def __init__(self, ids: np.ndarray, side: np.ndarray | None, hashes: np.ndarray, limits: np.ndarray, percent: int):
        sizes = np.diff(limits)
        order = np.lexsort((ids, sizes))
        n = len(order)
        names, token = np.unique(hashes, return_inverse=True)
        owner = np.repeat(np.argsort(order), sizes)
        ids, sizes, side = ids[order], sizes[order], None if side is None else side[order]
        need = np.maximum(1, (percent * sizes + 99) // 100)
        left = n
        while True:
            if side is None:
                kept = np.bincount(token, minlength=len(names))[token] > 1
            else:
                other = np.bincount(2 * token + side[owner], minlength=2 * len(names))
                kept = other[2 * token + 1 - side[owner]] > 0
            stays = np.bincount(owner[kept], minlength=n) >= need
            kept &= stays[owner]
            token, owner = token[kept], owner[kept]
            before, left = left, np.count_nonzero(stays)
            if 50 * (before - left) <= before:
                break
        place = np.cumsum(stays) - 1
        self.ids, self.sizes, self.side = ids[stays], sizes[stays], None if side is None else side[stays]
        self.limits = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n)[stays])))
        # Tokens by how many sets have them, then sorted within their set.
        times = np.bincount(token, minlength=len(names))
        rank = np.argsort(np.argsort(times, kind="stable"))
        pairs = np.sort(place[owner].astype(np.int64) << 32 | rank[token])
        self.tokens = pairs & 0xFFFFFFFF
        self.names = names[np.argsort(times, kind="stable")]
        # A smaller set shares 2 t / (1 + t) of itself with a larger one that is similar.
        shared = np.diff(self.limits)
        probe = shared - need[stays] + 1
        smaller = np.maximum(0, shared - (2 * percent * self.sizes + 99 + percent) // (100 + percent) + 1)
        posted = self.tokens[ranges(self.limits[:-1], smaller)] << 32 | np.repeat(np.arange(left), smaller)
        posted.sort()
        self._posted = posted & 0xFFFFFFFF
        asked = self.tokens[ranges(self.limits[:-1], probe)] << 32
        by = np.repeat(np.arange(left), probe)
        self.first = np.searchsorted(100 * self.sizes, percent * self.sizes)  # of like size
        self._from = np.searchsorted(posted, asked | self.first[by])
        self._length = np.searchsorted(posted, asked | by) - self._from
        self._asked = np.concatenate(([0], np.cumsum(probe)))
        self.met = np.bincount(by, self._length, left).astype(np.int64)  # with repeats, of smaller sets

    def sharing(self, i: int, most: int | None = None) -> np.ndarray:
        """Smaller sets that share one of the rarest hashes with set i, as every
        similar one does; ``most``: of about so many hits."""
        a, b = self._asked[i], self._asked[i + 1]
        start, length = self._from[a:b], self._length[a:b]
        if most is not None:
            length = np.minimum(length, np.maximum(0, most - np.cumsum(length) + length))
        return np.unique(self._posted[ranges(start, length)])

    def overlaps(self, i: int, others: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Hashes that set i shares with each of ``others``; ``mark``: all False."""
        own = self.tokens[self.limits[i] : self.limits[i + 1]]
        length = self.limits[others + 1] - self.limits[others]
        mark[own] = True
        found = mark[self.tokens[ranges(self.limits[others], length)]]
        mark[own] = False
        return np.add.reduceat(found, np.cumsum(length) - length, dtype=np.int64)


def spanning_links(ids: np.ndarray, run: np.ndarray, hashes: np.ndarray, limits: np.ndarray, percent: int) -> list[tuple]:
    """Verified links (id, id, overlap, union) that connect all that is similar.
    ``run``: rows of the same run are compared only if there is one run.

    A set is looked up in the tree among the smaller ones that share one of its
    rarest hashes, and only if there are any.
    """
    if len(ids) < 2:
        return []
    side = (run != run.min()).astype(np.int64) if run.min() != run.max() else None
    sets = _Sets(ids, side, hashes, limits, percent)
    busy = np.flatnonzero(sets.met)
    if not len(busy):
        return []
    sizes, names = sets.sizes, sets.ids.tolist()
    points = group_points(sets.names[sets.tokens], sets.limits)
    tree = CountTree(points, sizes)
    mark = np.zeros(len(sets.names), bool)
    label = np.arange(len(sizes))
    members: dict[int, list[int]] = {}
    out = []

    def apart(i: int, others: np.ndarray) -> np.ndarray:
        open_ = label[others] != label[i]
        if side is not None:
            open_ &= sets.side[others] != sets.side[i]
        return others[open_]

    def verify(i: int, others: np.ndarray) -> None:
        shared = sets.overlaps(i, others, mark)
        union = sizes[i] + sizes[others] - shared
        hit = 100 * shared >= percent * union
        for j, o, u in zip(others[hit].tolist(), shared[hit].tolist(), union[hit].tolist(), strict=True):
            x, y = int(label[i]), int(label[j])
            if x != y:
                out.append((min(names[i], names[j]), max(names[i], names[j]), o, u))
                x, y = sorted((x, y), key=lambda k: len(members.get(k, (k,))))
                gone = members.pop(x, [x])
                label[gone] = y
                members.setdefault(y, [y]).extend(gone)

    for i in busy.tolist():
        window = i - sets.first[i]
        if sets.met[i] > _FEW:
            # In a large group the first ones mostly link it with almost all others.
            some = apart(i, sets.sharing(i, _FEW))
            if len(some):
                verify(i, some)
        if sets.met[i] > 4 * window:
            others = np.arange(sets.first[i], i)
        else:
            others = sets.sharing(i)
        others = apart(i, others)
        if not len(others):
            continue
        near, bound = tree.search(points[i], int(sizes[i]), percent, others)
        near = near[np.argsort(-bound, kind="stable")]
        step = _FEW
        while len(near := apart(i, near)):
            verify(i, near[:step])
            near, step = near[step:], min(4 * step, 1 << 12)
    return out


def _trees(size: int, percent: int) -> Callable:
    """Rows (tile, run, doc_id, text, sig) sorted by tile to verified links."""
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def linked() -> list[tuple]:
            rows = pa.Table.from_batches(held)
            if rows.num_rows < 2:
                return []
            data, limits = byte_rows(rows.column(3))
            parts = [shingles(data[limits[i] : limits[j]], limits[i : j + 1] - limits[i], size) for i, j in slices(limits, _SLICE)]
            n = np.concatenate([np.diff(x) for _, x in parts])
            ends = np.concatenate(([0], np.cumsum(n)))
            hashes = np.concatenate([h for h, _ in parts])
            ids, run, sigs = (rows.column(c).to_numpy() for c in (2, 1, 4))
            # Of a repeated doc_id, only the text that stands for its class.
            keep = np.flatnonzero(_signatures(hashes, ends) == sigs)
            at = ranges(ends[keep], n[keep])
            return spanning_links(ids[keep], run[keep], hashes[at], np.concatenate(([0], np.cumsum(n[keep]))), percent)

        out: list[tuple] = []
        for batch in batches:
            tiles = batch.column(0).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.concatenate(([True], tiles[1:] != tiles[:-1]))) if len(tiles) else []
            for a, b in zip(edges, [*edges[1:], len(tiles)], strict=True):
                if tiles[a] != key:
                    out += linked() if held else []
                    key, held = tiles[a], []
                held.append(batch.slice(a, b - a))
            if len(out) > 10_000:
                yield _link_rows(out)
                out = []
        out += linked() if held else []
        yield _link_rows(out)

    return join


def _link_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in columns], ["a", "b", "overlap", "union_size"])


def similarity_join(docs: DataFrame, size: int = 5, percent: int = 75, tile: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """Members and links of the documents whose ``size``-word shingle sets have
    a Jaccard similarity of at least ``percent`` / 100.

    Members: doc_id, n_shingles (distinct), class_id (smallest doc_id with the
    very same set), component_id (smallest doc_id reachable by links). Links:
    a < b (class ids), overlap, union_size; as many as connect every component.

    A text of fewer words than ``size`` is one shingle, its whole sequence. Null
    or blank text: no shingles, linked with nothing, its own component. A null
    doc_id is returned with null class and component. A repeated doc_id is
    judged by each row's text. Empty input: empty results. Other columns are
    ignored.
    """
    if not 65 <= percent <= 100:
        raise ValueError("percent from 65 to 100")
    spark = docs.sparkSession
    rows = texts_of(docs)
    profiles = stored(rows.mapInArrow(_profiles(size), "doc_id long, n long, sig long"), "profiles")
    classes = profiles.where("doc_id is not null and n > 0").groupBy("sig", "n").agg(F.min("doc_id").alias("class_id"))

    total = profiles.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = 1 + total * 2 // 5 // 600_000
    packed = "bucket long, rows binary"
    sent = rows.where("doc_id is not null").mapInArrow(_postings(size, percent, buckets), packed).repartition(buckets, "bucket")
    shared = sent.mapInArrow(_shared(buckets), packed).repartition(buckets, "bucket")
    rare = shared.mapInArrow(_rarest(percent), packed).repartition(buckets, "bucket")
    groups = components(rare.mapInArrow(_chains(percent), "a long, b long"))

    # Sets of like size are neighbours in a group; by their hash, no window holds a large
    # group. A group has some hundred sizes of 256 slots each at most.
    like = F.floor(F.log(F.col("n").cast("double")) * 10).cast("long")
    slot = like * 256 + F.shiftright("sig", 56) + 128
    members = groups.join(classes, groups["node"] == classes["sig"]).select("component", "sig", "n", "class_id", slot.alias("slot"))
    members = stored(members.withColumn("place", F.struct("slot", "sig", "n")), "members")
    members = grouped_offsets(members, "n", ["component"], "place", F.col("slot"))
    members = members.select("component", "sig", "n", "class_id", F.floor(F.col("before") / tile).alias("run"))
    runs = members.groupBy("component").agg(F.max("run").alias("last"))
    tiles = members.join(runs, "component").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    tiles = tiles.select(
        F.xxhash64("component", F.least("run", "other"), F.greatest("run", "other")).alias("tile"),
        "run",
        F.col("class_id").alias("doc_id"),
        "sig",
    )
    # A class is read from the row of its smallest doc_id.
    tiles = stored(tiles, "tiles")
    bits = np.zeros(_BITS // 8, np.uint8)
    for r in tiles.select("doc_id").coalesce(16).mapInArrow(_bitmap, "bits binary").collect():
        bits |= np.frombuffer(r[0], np.uint8)
    near = _met(spark.sparkContext.broadcast(np.unpackbits(bits).astype(bool)))
    texts = rows.where("doc_id is not null").mapInArrow(near, "doc_id long, text binary")
    texts = texts.join(tiles, "doc_id").select("tile", "run", "doc_id", "text", "sig")
    by_tile = texts.repartition("tile").sortWithinPartitions("tile", "doc_id")
    links = stored(by_tile.mapInArrow(_trees(size, percent), "a long, b long, overlap long, union_size long"), "links")

    found = components(links.select("a", "b"))
    labels = classes.join(found, classes["class_id"] == found["node"], "left").select(
        "sig", "n", "class_id", F.coalesce("component", "class_id").alias("component")
    )
    known = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    linked = profiles.where(known).join(labels, ["sig", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "class_id", F.col("component").alias("component_id"))
    alone = profiles.where(~known).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone), links


def without_near_copies(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` but one of each group of near copies: that of the
    smallest doc_id. Columns unchanged. Rows that repeat a doc_id are documents of
    their own, judged by their texts; of similar ones, that with the least SHA-256
    of the text stays. Rows with null doc_id and texts without words stay."""
    if repeats_an_id(docs):
        kept = _without_near_copies(with_own_ids(docs), size, percent).select("row.*")
        return kept.unionByName(docs.where(F.col("doc_id").cast("long").isNull()))
    return _without_near_copies(docs, size, percent)


def _without_near_copies(docs: DataFrame, size: int, percent: int) -> DataFrame:
    members, _ = similarity_join(docs, size, percent)
    gone = members.where("doc_id != component_id").select(F.col("doc_id").alias("gone_id"))
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone_id"], "left_anti")
