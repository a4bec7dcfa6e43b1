"""MinHash near-duplicates by an inverted join of signature coordinates.

A set of word shingles has a signature of 64 coordinates, each the least value of
one hash over the set. Two sets agree in a coordinate with a probability that is
their similarity; pairs that agree in fewer coordinates than the match threshold
are dropped, the others are confirmed on the full sets.

Sets are posted under their coordinate-value pairs. A pair that nobody else has
brings no collision; a set with fewer shared pairs than the threshold has no
match. Of the others, only the rarest shared pairs are posted again, all but the
threshold and one more: two sets that match must meet under one of these. Sets
that meet, directly or over others, are a group, and every match lies in a group.

In a group, collisions are counted set by set. A set merges its shortest lists,
again all but the threshold and one more, and only looks up in the longer lists
what these gave; sets that are connected to it already are skipped in all lists,
so a group of copies costs no more than its links.

Large groups are cut into runs. First every run is joined within itself and with
one set of the group that all runs get; then runs are cut anew by what is
connected, and two runs meet only if they hold sets that are not, of sizes that
can match. Equal sets are one from the start.

The threshold of 38 of 64 misses a pair at a similarity of 0.85 with a probability
of 2 in 10^7, and a more similar one with less.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from turnmill.llm.bitmap import possible
from turnmill.llm.columns import byte_rows, mix, slices, texts_of
from turnmill.llm.graph import components
from turnmill.llm.jaccard_join import shingles
from turnmill.llm.tables import stored
from turnmill.operators.ranks import grouped_offsets

COORDINATES, MATCHES = 64, 38
_SLICE = 1 << 19  # bytes of text; its arrays take some forty times that
_MULTIPLY = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)
_ADD = mix(np.arange(5001, COORDINATES + 5001, dtype=np.uint64))


def signatures(hashes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The coordinates of every set, 32 bits each; 0 for empty sets."""
    out = np.zeros((len(limits) - 1, COORDINATES), np.uint32)
    some = np.flatnonzero(limits[1:] > limits[:-1])
    if len(some):
        first = limits[:-1][some]
        for k in range(COORDINATES):
            least = np.minimum.reduceat(hashes * _MULTIPLY[k] + _ADD[k], first)
            out[some, k] = (least >> np.uint64(32)).astype(np.uint32)
    return out


def set_ids(hashes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """One number for each set; equal sets have equal ones."""
    n = np.diff(limits).astype(np.uint64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes), dtype=np.uint64)))
    return mix(total[limits[1:]] - total[limits[:-1]] + n).view(np.int64)


def _each(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """First column, shingle hashes and limits of runs of rows (doc_id, text)."""
    for batch in batches:
        data, limits = byte_rows(batch.column(1))
        for i, j in slices(limits, _SLICE):
            yield batch.column(0).slice(i, j - i), *shingles(data[limits[i] : limits[j]], limits[i : j + 1] - limits[i], size)


def _profiles(size: int) -> Callable:
    def profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, hashes, limits in _each(batches, size):
            signed = [x.tobytes() for x in signatures(hashes, limits)]
            columns = [ids, pa.array(np.diff(limits)), pa.array(set_ids(hashes, limits)), pa.array(signed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "set_id", "signature"])

    return profiles


def _matrix(column: pa.Array) -> np.ndarray:
    data, _ = byte_rows(column)
    return data.view(np.uint32).reshape(-1, COORDINATES)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (set_id, signature) to one row for each coordinate-value pair."""
    coordinate = np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)
    for batch in batches:
        if batch.num_rows:
            pairs = mix(_matrix(batch.column(1)) + coordinate).ravel().view(np.int64)
            ids = np.repeat(batch.column(0).to_numpy(), COORDINATES)
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(ids)], ["pair", "set_id"])


def _sets(size: int) -> Callable:
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, hashes, limits in _each(batches, size):
            own = [hashes[a:b].tobytes() for a, b in zip(limits[:-1], limits[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(set_ids(hashes, limits)), pa.array(own, pa.binary())], ["doc_id", "set_id", "shingles"])

    return sets


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def matching_links(signed: np.ndarray, sets: list[np.ndarray], label: np.ndarray, side: np.ndarray, percent: int, matches: int) -> list[tuple]:
    """Confirmed links (i, j, overlap, union) that connect all that is similar.

    Sets of one ``label`` are connected already. Where there are several
    ``side``s, only sets of different ones are compared."""
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    sizes, signed = sizes[order], signed[order]
    label, side = np.unique(label[order], return_inverse=True)[1], side[order]
    across = len(np.unique(side)) > 1
    rows = len(order)
    # Of every coordinate, the sets by value, and where the list of a set lies.
    # A tile of small sets has many of them: 64 coordinates, 12 bytes for each.
    listed = np.empty((COORDINATES, rows), np.int32)
    begin, length = np.empty((2, rows, COORDINATES), np.int32)
    for k in range(COORDINATES):
        listed[k] = np.argsort(signed[:, k], kind="stable")
        ordered = signed[listed[k], k]
        edges = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1], [True])))
        lengths = np.diff(edges)
        begin[listed[k], k] = np.repeat(edges[:-1], lengths)
        length[listed[k], k] = np.repeat(lengths, lengths)
    prefix = COORDINATES - matches + 1
    out = []
    for i in range(rows):
        by_length = np.argsort(length[i], kind="stable")
        short, long = by_length[:prefix], by_length[prefix:]
        short = short[length[i, short] > 1]
        if not len(short):
            continue
        met = np.concatenate([listed[k, begin[i, k] : begin[i, k] + length[i, k]] for k in short])
        met = met[(met < i) & (label[met] != label[i])]
        if across:
            met = met[side[met] != side[i]]
        met, count = np.unique(met, return_counts=True)
        fits = 100 * sizes[met] >= percent * sizes[i]
        met, count = met[fits], count[fits]
        count = count + (signed[met][:, long] == signed[i, long]).sum(1)
        enough = count >= matches
        met, count = met[enough], count[enough]
        for j in met[np.argsort(-count, kind="stable")]:
            if label[j] == label[i]:
                continue
            a, b = sets[order[i]], sets[order[j]]
            common = _common(a, b)
            union = len(a) + len(b) - common
            if 100 * common >= percent * union:
                out.append((int(order[j]), int(order[i]), common, union))
                low, high = sorted((label[i], label[j]))
                label[label == high] = low
    return out


def _tiles(percent: int, matches: int) -> Callable:
    """Rows (tile, set_id, signature, shingles, label, side), by tile, to links."""
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, []

        def linked() -> list[tuple]:
            rows = pa.Table.from_batches(held)
            ids, once = np.unique(rows.column(1).to_numpy(), return_index=True)
            if len(ids) < 2:
                return []
            rows = rows.take(pa.array(once)).combine_chunks()
            data, limits = byte_rows(rows.column(3))
            sets = [data[a:b].view(np.uint64) for a, b in zip(limits[:-1], limits[1:], strict=True)]
            label, side = rows.column(4).to_numpy().copy(), rows.column(5).to_numpy()
            found = matching_links(_matrix(rows.column(2).combine_chunks()), sets, label, side, percent, matches)
            return [(ids[a], ids[b], overlap, union) for a, b, overlap, union in found]

        out: list[tuple] = []
        for batch in batches:
            tiles = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.concatenate(([True], tiles[1:] != tiles[:-1]))) if len(tiles) else []
            for a, b in zip(edges, [*edges[1:], len(tiles)], strict=True):
                if tiles[a] != tile:
                    out += linked() if held else []
                    tile, held = tiles[a], []
                held.append(batch.slice(a, b - a))
            if len(out) > 10_000:
                yield _links(out)
                out = []
        out += linked() if held else []
        yield _links(out)

    return join


def _links(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in columns], ["a", "b", "overlap", "union_size"])


def _linked(tiles: DataFrame, percent: int, matches: int, name: str) -> DataFrame:
    rows = tiles.select("tile", "set_id", "signature", "shingles", "label", "side")
    dealt = rows.repartition("tile").sortWithinPartitions("tile")
    return stored(dealt.mapInArrow(_tiles(percent, matches), "a long, b long, overlap long, union_size long"), name)


def _runs(members: DataFrame, tile: int, label: str) -> DataFrame:
    """``run`` of every set of a group: about ``tile`` shingles in the order of
    (label, size, set_id). Sums of a few sets each come first, so that no task
    holds a group."""
    placed = members.withColumn("_place", F.struct(label, "n", "set_id"))
    group = F.struct(F.col(label), F.col("n"), F.shiftright("set_id", 56))
    offsets = grouped_offsets(stored(placed, "minhash-members"), "n", ["component"], "_place", group)
    return offsets.withColumn("run", F.expr(f"before div {int(tile)}").cast("long")).drop("_place", "before")


def minhash_join(docs: DataFrame, size: int = 5, percent: int = 85, matches: int = MATCHES, tile: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """Members and links of the documents whose ``size``-word shingle sets have
    a Jaccard similarity of at least ``percent`` / 100.

    Members: doc_id, n_shingles (distinct), class_id (smallest doc_id with the
    very same set), component_id (smallest doc_id reachable by links). Links: a, b
    (class ids), overlap, union_size, all confirmed on the full sets; as many as
    connect every component.

    A text of fewer words than ``size`` is one shingle, its whole sequence. Null
    or blank text: no shingles, linked with nothing, its own component. A null
    doc_id is returned with null class and component. A repeated doc_id is judged
    by each row's text. Empty input: empty results. Other columns are ignored.

    ``matches``: coordinates of 64 in which candidates agree. ``tile``: shingles
    that are joined at once.
    """
    if not 50 <= percent < 100 or not 1 <= matches <= COORDINATES or tile < 1:
        raise ValueError("percent from 50 to 99, matches from 1 to 64, a positive tile")
    rows = texts_of(docs)
    profiles = stored(rows.mapInArrow(_profiles(size), "doc_id long, n long, set_id long, signature binary"), "minhash-profiles")
    known = profiles.where("doc_id is not null and n > 0")
    classes = known.groupBy("set_id", "n").agg(F.min("doc_id").alias("class_id"))
    # Smaller sets than this are similar to none but equal ones.
    large = known.where(F.col("n") * (100 - percent) >= percent)
    signed = stored(large.groupBy("set_id", "n").agg(F.min("doc_id").alias("class_id"), F.min("signature").alias("signature")), "minhash-classes")

    posted = signed.select("set_id", "signature").mapInArrow(_postings, "pair long, set_id long")
    times = posted.groupBy("pair").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    shared = posted.join(times, "pair").groupBy("set_id").agg(F.sort_array(F.collect_list(F.struct("times", "pair"))).alias("pairs"))
    rarest = F.slice("pairs", F.lit(1), F.size("pairs") - (matches - 1))
    met = stored(shared.where(F.size("pairs") >= matches).select("set_id", F.explode(rarest).alias("p")).select("set_id", "p.pair"), "minhash-postings")
    first = met.groupBy("pair").agg(F.min("set_id").alias("first"))
    groups = components(met.join(first, "pair").where("set_id != first").select("set_id", "first").distinct())
    members = groups.withColumnRenamed("node", "set_id").join(signed, "set_id")
    members = stored(members.select("component", "set_id", "n", "class_id", "signature"), "minhash-groups")

    texts = possible(rows.where("doc_id is not null"), members.select("class_id"))
    sets = texts.mapInArrow(_sets(size), "doc_id long, set_id long, shingles binary").withColumnRenamed("doc_id", "class_id")
    sets = stored(sets.join(members.select("set_id", "class_id", "signature"), ["set_id", "class_id"]), "minhash-sets")

    runs = stored(_runs(members.select("component", "set_id", "n", F.lit(0).cast("long").alias("label")), tile, "label"), "minhash-runs")
    last = runs.groupBy("component").agg(F.max("run").alias("last"), F.min("set_id").alias("hub"))
    others = last.where("last > 0").select("component", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("run"), F.col("hub").alias("set_id"))
    dealt = runs.select("component", "run", "set_id").unionByName(others)
    dealt = dealt.select(F.xxhash64("component", "run").alias("tile"), "set_id", F.col("set_id").alias("label"), F.lit(0).cast("long").alias("side"))
    links = _linked(sets.join(dealt, "set_id"), percent, matches, "minhash-links")

    split = runs.join(last.where("last > 0").select("component"), "component").drop("label", "run")
    if split.limit(1).count():
        links = links.unionByName(_across_runs(split, sets, links, percent, matches, tile))
    found = components(links.select("a", "b"))
    names = classes.join(found, classes["set_id"] == found["node"], "left").select("set_id", "class_id", F.coalesce("component", "set_id").alias("label"))
    names = stored(names, "minhash-names")
    least = names.groupBy("label").agg(F.min("class_id").alias("component_id"))
    names = names.join(least, "label").select("set_id", "class_id", "component_id")
    linked = known.join(names, "set_id").select("doc_id", F.col("n").alias("n_shingles"), "class_id", "component_id")
    own = F.col("doc_id")
    alone = profiles.where("doc_id is null or n = 0").select("doc_id", F.col("n").alias("n_shingles"), own.alias("class_id"), own.alias("component_id"))
    by_class = links
    for side in ("a", "b"):
        name = signed.select(F.col("set_id").alias(side), F.col("class_id").alias(f"_{side}"))
        by_class = by_class.join(name, side).drop(side).withColumnRenamed(f"_{side}", side)
    return linked.unionByName(alone), by_class.select("a", "b", "overlap", "union_size")


def _across_runs(members: DataFrame, sets: DataFrame, links: DataFrame, percent: int, matches: int, tile: int) -> DataFrame:
    """Links between sets of groups of several runs (component, set_id, n) that
    ``links`` do not connect. Runs are cut in the order of what is connected, so
    most hold one label, and two such runs of the same label need not meet."""
    found = components(links.select("a", "b"))
    labelled = members.join(found.withColumnsRenamed({"node": "set_id", "component": "_label"}), "set_id", "left")
    labelled = labelled.withColumn("label", F.coalesce("_label", "set_id")).drop("_label")
    runs = stored(_runs(labelled, tile, "label"), "minhash-runs")
    about = [F.min("n").alias("low"), F.max("n").alias("high"), F.min("label").alias("from"), F.max("label").alias("to")]
    about = runs.groupBy("component", "run").agg(*about)
    # Of each group, runs by runs: a run holds ``tile`` shingles.
    a, b = about.alias("a"), about.alias("b")
    meet = a.join(b, (F.col("a.component") == F.col("b.component")) & (F.col("a.run") <= F.col("b.run")))
    apart = F.least("a.from", "b.from") != F.greatest("a.to", "b.to")
    sized = (100 * F.col("a.high") >= percent * F.col("b.low")) & (100 * F.col("b.high") >= percent * F.col("a.low"))
    meet = meet.where(apart & sized).select(F.col("a.component").alias("component"), F.col("a.run").alias("one"), F.col("b.run").alias("other"))
    sides = F.array_distinct(F.array("one", "other"))
    meet = meet.select("component", F.xxhash64("component", "one", "other").alias("tile"), F.explode(sides).alias("run"))
    dealt = runs.join(meet, ["component", "run"]).select("tile", "set_id", "label", F.col("run").alias("side"))
    return _linked(sets.join(dealt, "set_id"), percent, matches, "minhash-links")
