"""The prefix trie of conversations by truncation peeling.

Peeling starts at the greatest depth. The nodes of a depth are the conversations
that end there, merged with the nodes that survive from the depth below: each of
these gives up its last turn and is regrouped under what is left. A merged node
is complete at once, with its members, children, leaves and saved tokens, as all
below it has been peeled; so nodes are found and aggregated in the same pass.

A conversation travels as one row, the keys of its prefixes and the lengths of
its turns (24 bytes a turn); texts do not leave the scan. Equal conversations are
one row from the start. Deep levels are peeled a band at a time: rows are dealt by
their prefix at the top of the band, and a task peels one such subtree after the
other. A subtree of more rows than fit is peeled level by level instead, as are
the levels near the root, where many rows share a prefix: there every level is
one grouping that is combined before its shuffle. Each round is written down.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from turnmill.llm.tables import stored

NEAR_ROOT = 8  # depths up to this are peeled level by level
_GROWTH = 4  # a band ends at so many times the depth of its top
SUBTREE = 200_000  # rows of a subtree that a task peels in memory
KEY = 16  # bytes of a prefix's key; the root's is empty
_STATE = "path binary, chars binary, depth long, n long, low long, kids long, leaves long, saved long, ends string"
_NODE = "key binary, parent binary, depth long, low long, n long, kids long, leaves long, saved long, ends string"
_NAMES = [x.split()[0] for x in _STATE.split(", ")]


def _key(depth: Column) -> Column:
    """The last key of a path of that depth; empty at the root."""
    at = (F.greatest(depth, F.lit(1)) * KEY - (KEY - 1)).cast("int")
    return F.when(depth > 0, F.substring(F.col("path"), at, F.lit(KEY))).otherwise(F.lit(b""))


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest of role and text, code points of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    both = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.unhex(F.md5(both.cast("binary"))).alias("digest"),
        F.length(text).cast("long").alias("chars"),
    ).where("conv_id is not null")


def with_shared_heads(turns: DataFrame, every: int, most: int) -> DataFrame:
    """``turns`` and, as ``part`` 0, those that a conversation c takes from the
    head of c - c % ``every``: its first ``skip`` turns, crc32 of the decimal c
    modulo ``most``. Own turns are ``part`` 1."""
    skip = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("skip")
    own = turns.select("conv_id", F.lit(1).alias("part"), "turn", "digest", "chars", skip)
    # Each task keeps the few first turns it has seen, so a hot conversation is no sort.
    first = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest")
    heads = turns.where(F.col("conv_id") % every == 0).withColumn("place", F.row_number().over(first)).where(F.col("place") < most)
    heads = heads.select(F.col("conv_id").alias("base"), F.col("place").cast("long").alias("place"), "digest", "chars")
    ids = turns.select("conv_id").distinct().select("conv_id", skip, (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    taken = ids.join(heads, "base").where(F.col("place") <= F.col("skip"))
    return own.unionByName(taken.select("conv_id", F.lit(0).alias("part"), F.col("place").alias("turn"), "digest", "chars", "skip"))


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, part, skip, digest, chars), in order, to one row for each
    conversation: the keys of its prefixes, each made of the one before and the
    turn, and the lengths of its turns."""
    out: list[tuple] = []
    conv, key, left, path, chars = None, b"", 0, bytearray(), bytearray()
    for batch in batches:
        for own, part, skip, digest, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own != conv:
                if conv is not None:
                    out.append((bytes(path), bytes(chars), conv))
                conv, key, left, path, chars = own, b"", skip, bytearray(), bytearray()
            if part and left:
                left -= 1
                continue
            key = hashlib.blake2b(key + digest, digest_size=KEY).digest()
            path += key
            chars += length.to_bytes(8, "big")
        if len(out) > 1000:
            yield _table(out, [pa.binary(), pa.binary(), pa.int64()], ["path", "chars", "conv_id"])
            out = []
    if conv is not None:
        out.append((bytes(path), bytes(chars), conv))
        yield _table(out, [pa.binary(), pa.binary(), pa.int64()], ["path", "chars", "conv_id"])


def _table(rows: list[tuple], types: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, conv_id), in order, to one hash of the ids of each key. A hash
    is fed id by id, so the longest list takes no more memory than the shortest."""
    out: list[tuple] = []
    key, state = None, None
    for batch in batches:
        for own, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if own != key:
                if key is not None:
                    out.append((key, state.hexdigest()))
                key, state = own, hashlib.sha256(str(conv).encode())
            else:
                state.update(f",{conv}".encode())
        if len(out) > 10_000:
            yield _table(out, [pa.binary(), pa.string()], ["key", "ends"])
            out = []
    if key is not None:
        out.append((key, state.hexdigest()))
        yield _table(out, [pa.binary(), pa.string()], ["key", "ends"])


def _merged(level: dict, key: bytes, row: list) -> None:
    """A row (path, chars, low, n, kids, leaves, saved, ends) joins its node."""
    node = level.get(key)
    if node is None:
        level[key] = row
        return
    node[2] = min(node[2], row[2])
    for k in (3, 4, 5, 6):
        node[k] += row[k]
    node[7] = node[7] or row[7]


def peel(rows: list[tuple], top: int) -> tuple[list[tuple], list[tuple]]:
    """Nodes of the depths below ``top`` (as _NODE) and what survives at ``top``
    (as _STATE) of rows that end below it."""
    ended: dict[int, list] = {}
    for path, chars, depth, n, low, kids, leaves, saved, ends in rows:
        ended.setdefault(depth, []).append([path, chars, low, n, kids, leaves, saved, ends])
    nodes, level = [], {}
    for depth in range(max(ended, default=top), top, -1):
        for row in ended.get(depth, ()):
            _merged(level, row[0][KEY * (depth - 1) : KEY * depth], row)
        above: dict[bytes, list] = {}
        for key, (path, chars, low, n, kids, leaves, saved, ends) in level.items():
            parent = path[KEY * (depth - 2) : KEY * (depth - 1)] if depth > 1 else b""
            leaves = leaves if kids else 1
            saved += (n - 1) * int.from_bytes(chars[8 * (depth - 1) : 8 * depth], "big")
            nodes.append((key, parent, depth, low, n, kids, leaves, saved, ends))
            _merged(above, parent, [path, chars, low, n, 1, leaves, saved, None])
        level = above
    left = [(p[: KEY * top], c[: 8 * top], top, n, low, kids, leaves, saved, ends) for p, c, low, n, kids, leaves, saved, ends in level.values()]
    return nodes, left


def _peeled(top: int) -> Callable:
    """State rows, those of a subtree in a run, to nodes (path null) and survivors
    (key null)."""
    node_types = [pa.binary(), pa.binary(), *[pa.int64()] * 6, pa.string()]
    state_types = [pa.binary(), pa.binary(), *[pa.int64()] * 6, pa.string()]
    names = ["path", "chars", "key", "parent", *_NAMES[2:]]

    def rows_of(nodes: list[tuple], left: list[tuple]) -> Iterator[pa.RecordBatch]:
        if nodes:
            key, parent, depth, low, n, kids, leaves, saved, ends = (pa.array(c, t) for c, t in zip(zip(*nodes, strict=True), node_types, strict=True))
            none = pa.nulls(len(nodes), pa.binary())
            yield pa.RecordBatch.from_arrays([none, none, key, parent, depth, n, low, kids, leaves, saved, ends], names)
        if left:
            path, chars, *rest = (pa.array(c, t) for c, t in zip(zip(*left, strict=True), state_types, strict=True))
            none = pa.nulls(len(left), pa.binary())
            yield pa.RecordBatch.from_arrays([path, chars, none, none, *rest], names)

    def peeled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subtree, held = None, []
        for batch in batches:
            for own, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != subtree:
                    yield from rows_of(*peel(held, top))
                    subtree, held = own, []
                held.append(tuple(row))
        yield from rows_of(*peel(held, top))

    return peeled


def _peel_level(state: DataFrame, depth: int, name: str) -> tuple[DataFrame, DataFrame]:
    """All rows end at ``depth``: its nodes, and what survives above it."""
    sums = [F.sum(c).alias(c) for c in ("n", "kids", "leaves", "saved")]
    merged = stored(state.groupBy("path", "chars").agg(*sums, F.min("low").alias("low"), F.max("ends").alias("ends")), name)
    last = F.conv(F.hex("_last"), 16, 10).cast("long") if depth else F.lit(0)
    merged = merged.withColumn("_last", F.substring("chars", 8 * depth - 7, 8)) if depth else merged
    complete = merged.select(
        "path", "chars", "n", "low", "kids", "ends",
        F.when(F.col("kids") == 0, 1).otherwise(F.col("leaves")).cast("long").alias("leaves"),
        (F.col("saved") + (F.col("n") - 1) * last).alias("saved"),
    )
    nodes = complete.select(
        _key(F.lit(depth)).alias("key"),
        (_key(F.lit(depth - 1)) if depth else F.lit(None).cast("binary")).alias("parent"),
        F.lit(depth).cast("long").alias("depth"),
        "low", "n", "kids", "leaves", "saved", "ends",
    )
    survivors = complete.select(
        F.substring("path", 1, KEY * (depth - 1)).alias("path"),
        F.substring("chars", 1, 8 * (depth - 1)).alias("chars"),
        F.lit(depth - 1).cast("long").alias("depth"),
        "n", "low", F.lit(1).cast("long").alias("kids"), "leaves", "saved", F.lit(None).cast("string").alias("ends"),
    )
    return nodes, survivors


def _peel_band(state: DataFrame, top: int, bottom: int, subtree: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """All rows end below ``top``, at ``bottom`` at most: nodes and survivors."""
    cut = F.substring("path", KEY * top + 1, KEY)
    state = stored(state.withColumn("cut", cut), "trie-band")
    large = state.groupBy("cut").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > subtree).select("cut")
    large = stored(large, "trie-large")
    fits = state.join(large, "cut", "left_anti") if large.limit(1).count() else state
    dealt = fits.select("cut", *_NAMES).repartition("cut").sortWithinPartitions("cut")
    schema = "path binary, chars binary, key binary, parent binary, depth long, n long, low long, kids long, leaves long, saved long, ends string"
    done = stored(dealt.mapInArrow(_peeled(top), schema), "trie-nodes")
    nodes = [done.where("key is not null").select([x.split()[0] for x in _NODE.split(", ")])]
    left = [done.where("key is null").select(_NAMES)]
    if fits is not state:
        rest = state.join(large, "cut", "left_semi").select(_NAMES)
        above = []
        for depth in range(bottom, top, -1):
            at = rest.where(F.col("depth") == depth)
            for part in above:
                at = at.unionByName(part.select(_NAMES))
            done_here, survivors = _peel_level(at, depth, "trie-level")
            nodes.append(done_here)
            above = [survivors]
        left += [part.select(_NAMES) for part in above]
    return nodes, left


def prefix_trie(conversations: DataFrame, every: int = 100, most: int = 6, subtree: int = SUBTREE) -> DataFrame:
    """The nodes of the prefix trie of all rebuilt conversations.

    ``conversations``: conv_id, turn, role, text. Turns are ordered by ``turn``,
    null first, turns of equal number by a digest of role and text; a null role
    or text is empty. Conversation c is rebuilt of the first h turns of
    conversation c - c % ``every`` (h: crc32 of the decimal c modulo ``most``; all
    if it has fewer, none if there is none) and its own turns after its first h.
    A node is a distinct sequence of first turns, from the root of none on.

    Columns: conv_id (smallest member), depth, parent_conv_id (that of the parent;
    null for the root), n_convs (members: conversations that start with it),
    n_children, n_leaves (childless nodes of its subtree, itself included),
    saved_tokens (over its subtree, (n_convs - 1) times the code points of a
    node's last text), ends_sha256 (of the decimal ids of the conversations that
    end at it, ascending, comma-joined).

    Repeated rows are turns of their own. Rows with null conv_id belong to no
    conversation and are left out. No conversations: no nodes, not even a root.
    Other columns are ignored. ``subtree``: rows of a deep subtree that a task
    holds at once; larger ones are peeled level by level, with the same result.
    """
    if every < 1 or most < 1 or subtree < 1:
        raise ValueError("every, most and subtree must be positive")
    rebuilt = with_shared_heads(turns_of(conversations), every, most)
    in_order = rebuilt.repartition("conv_id").sortWithinPartitions("conv_id", "part", F.asc_nulls_first("turn"), "digest")
    paths = in_order.select("conv_id", "part", "skip", "digest", "chars").mapInArrow(_paths, "path binary, chars binary, conv_id long")
    paths = stored(paths.withColumn("depth", F.expr(f"octet_length(path) div {KEY}").cast("long")).withColumn("key", _key(F.col("depth"))), "trie-paths")
    ends = paths.select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(_ends, "key binary, ends string")
    equal = paths.groupBy("path", "chars", "depth", "key").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("low"))
    none = F.lit(0).cast("long")
    start = equal.join(ends, "key").withColumns({"kids": none, "leaves": none, "saved": none}).select(_NAMES)
    start = stored(start, "trie-start")
    deepest = start.agg(F.max("depth")).first()[0]
    if deepest is None:
        deepest = -1
    tops = [NEAR_ROOT]
    while tops[-1] * _GROWTH < deepest:
        tops.append(tops[-1] * _GROWTH)
    nodes: list[DataFrame] = []
    left: list[DataFrame] = []
    bottom = deepest
    for top in reversed(tops):
        if bottom > top:
            own = start.where((F.col("depth") > top) & (F.col("depth") <= bottom))
            for part in left:
                own = own.unionByName(part)
            found, left = _peel_band(own, top, bottom, subtree)
            nodes += found
            bottom = top
    for depth in range(bottom, -1, -1):
        own = start.where(F.col("depth") == depth)
        for part in left:
            own = own.unionByName(part.select(_NAMES))
        found, survivors = _peel_level(own, depth, "trie-level")
        nodes.append(found)
        left = [survivors]
    every_node = start.sparkSession.createDataFrame([], _NODE)
    for part in nodes:
        every_node = every_node.unionByName(part)
    parents = every_node.select(F.col("key").alias("parent"), F.col("low").alias("parent_conv_id"))
    return every_node.join(parents, "parent", "left").select(
        F.col("low").alias("conv_id"),
        "depth",
        "parent_conv_id",
        F.col("n").alias("n_convs"),
        F.col("kids").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
    )
