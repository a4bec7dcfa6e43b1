"""Approximate nearest neighbours with a forest of random-projection trees.

The forest is fitted on a bounded sample; every vector is then dropped down every
tree. A query walks all trees through one priority queue, nearest side first and
the far sides by their distance from the split, until it has its leaves. Leaves
meet their queries in a shuffle; candidates are reranked by exact cosine there,
and only the best of each query leave a task.

Equal vectors are one, with its smallest ids (k + 1 of them: by the order of ties
no other copy can be among k neighbours), so a vector that a third of the rows
share is one candidate. Leaves hold n / sample times the leaf size; raise
``sample`` with the corpus.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window

from turnmill.llm.tables import Shipped, stored

_HELD = 50_000  # queries whose best a task keeps
_LEAVES = "leaf long, kind int, ids array<long>, vector array<double>"


class Tree:
    """Splits as rows: normal and threshold, children (below 0: ~leaf)."""

    def __init__(self, points: np.ndarray, leaf: int, rng: np.random.Generator):
        normals, cuts, kids = [], [], []
        self.leaves = 0

        def grow(at: np.ndarray) -> int:
            if len(at) > leaf:
                # Of some random projections, the one that spreads the points most.
                some = points[rng.choice(at, min(len(at), 256), replace=False)]
                drawn = rng.normal(size=(points.shape[1], 8))
                drawn = np.hstack((drawn, (some[rng.integers(0, len(some), 24)] - some[rng.integers(0, len(some), 24)]).T))
                drawn /= np.sqrt((drawn * drawn).sum(axis=0)) + 1e-12
                normal = drawn[:, int(np.argmax((some @ drawn).var(axis=0)))]
                side = points[at] @ normal
                cut = float(np.median(side))
                left, right = at[side <= cut], at[side > cut]
                if len(left) and len(right):
                    own = len(kids)
                    normals.append(normal), cuts.append(cut), kids.append([0, 0])
                    kids[own][0] = grow(left)
                    kids[own][1] = grow(right)
                    return own
            self.leaves += 1
            return -self.leaves

        self.root = grow(np.arange(len(points)))
        self.normals = np.array(normals).reshape(-1, points.shape[1])
        self.cuts, self.kids = np.array(cuts), np.array(kids, np.int64).reshape(-1, 2)

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        at = np.full(len(points), self.root)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            side = (points[inner] * self.normals[node]).sum(1) > self.cuts[node]
            at[inner] = self.kids[node, side.astype(np.int64)]
        return ~at


class Forest:
    def __init__(self, points: np.ndarray, trees: int, leaf: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.trees = [Tree(points, leaf, rng) for _ in range(trees)]

    def near_leaves(self, point: np.ndarray, most: int) -> list[int]:
        """Leaves of all trees, the most promising first."""
        margins = [t.normals @ point - t.cuts for t in self.trees]
        queue = [(0.0, k, t.root) for k, t in enumerate(self.trees)]
        found = []
        while queue and len(found) < most:
            far, k, node = heapq.heappop(queue)
            while node >= 0:
                margin = float(margins[k][node])
                near = int(margin > 0)
                heapq.heappush(queue, (max(far, abs(margin)), k, int(self.trees[k].kids[node, 1 - near])))
                node = int(self.trees[k].kids[node, near])
            found.append((k << 40) | ~node)
        return found


def usable(vector: str, dims: int | None = None) -> "F.Column":
    """Not null, not zero, all components finite; of ``dims`` of them, if given."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    test = v.isNotNull() & F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))
    return test & (F.size(v) == dims) if dims else test


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _collapsed(k: int) -> Callable:
    """Equal vectors of a task as one row with their k smallest ids."""
    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: dict[tuple, list[int]] = {}
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own.setdefault(tuple(v), []).append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array([sorted(set(x))[:k] for x in own.values()], pa.list_(pa.int64())), pa.array([list(v) for v in own], pa.list_(pa.float64()))],
                ["ids", "vector"],
            )

    return collapse


def _placed(shared, dims: int, queries: bool, most: int) -> Callable:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            points = _units(_matrix(batch.column(1), dims))
            if queries:
                leaves = [forest.near_leaves(p, most) for p in points]
                row = np.repeat(np.arange(len(points)), [len(x) for x in leaves])
                leaf = np.array([x for own in leaves for x in own], np.int64)
            else:
                row = np.tile(np.arange(len(points)), len(forest.trees))
                leaf = np.concatenate([(k << 40) | t.leaf_of(points) for k, t in enumerate(forest.trees)])
            for a in range(0, len(row), 20_000):
                own = pa.array(row[a : a + 20_000])
                kind = pa.array(np.full(len(own), 0 if queries else 1, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf[a : a + 20_000]), kind, batch.column(0).take(own), batch.column(1).take(own)], ["leaf", "kind", "ids", "vector"]
                )

    return place


def _reranked(dims: int, k: int) -> Callable:
    """A leaf's queries come before its vectors; the best of each query leave the
    task, once for all of its leaves while they fit in memory."""
    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, queries, best = None, [], {}  # best: of each query, by a vector's first id

        def done() -> pa.RecordBatch:
            rows = [(q, ids, s) for q, found in best.items() for s, ids in found.values()]
            best.clear()
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.list_(pa.int64())), pa.array(columns[2], pa.float64())],
                ["query_id", "ids", "score"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            leaves = batch.column(0).to_numpy()
            kinds = batch.column(1).to_numpy()
            points = _matrix(batch.column(3), dims)
            lengths = np.sqrt((points * points).sum(axis=1))
            edges = np.flatnonzero(np.concatenate(([True], (leaves[1:] != leaves[:-1]) | (kinds[1:] != kinds[:-1]))))
            for a, b in zip(edges, [*edges[1:], len(leaves)], strict=True):
                if leaves[a] != leaf:
                    if len(best) > _HELD:
                        yield done()
                    leaf, queries = leaves[a], []
                if kinds[a] == 0:
                    queries += [(ids[0], points[r], lengths[r]) for r, ids in zip(range(a, b), batch.column(2).slice(a, b - a).to_pylist(), strict=True)]
                    continue
                if not queries:
                    continue
                ids = batch.column(2).slice(a, b - a).to_pylist()
                for q, point, length in queries:
                    scores = (points[a:b] * point).sum(axis=1) / (lengths[a:b] * length)
                    # The query's own row may be among them.
                    top = np.argsort(-scores, kind="stable")
                    last = scores[top[min(k, len(top) - 1)]]
                    top = top[scores[top] >= last]
                    found = best.get(q, {}) | {ids[r][0]: (float(scores[r]), ids[r]) for r in top}
                    best[q] = dict(sorted(found.items(), key=lambda x: (-x[1][0], x[0]))[: k + 1])
        if best:
            yield done()

    return rerank


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 5, vector: str = "embedding",
    trees: int = 8, leaf: int = 256, share: float = 0.12, sample: int = 65_536,
) -> DataFrame:
    """Of each row of ``queries`` its ``k`` nearest rows of ``vectors`` that the
    forest finds, by cosine: query_id, rank (from 1), vec_id, score; nearest
    first, ties to the smaller vec_id.

    Both have vec_id and the column ``vector``; a query's own vec_id is no
    candidate of it. A query searches ``share`` of all leaves: vectors without
    structure need about half of all candidates for a recall above 0.9, others
    far less. Rows with null vec_id and
    vectors that are null, zero, of another length than most, or hold null or
    non-finite components take no part. Rows with one vec_id and one vector are
    one; with different vectors, each is a candidate. Fewer than ``k``
    candidates: all that were found. Empty tables: no rows. Other columns are
    ignored.
    """
    spark = vectors.sparkSession

    def clean(df: DataFrame, dims: int | None = None) -> DataFrame:
        rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
        return rows.where(F.col("vec_id").isNotNull() & usable("vector", dims))

    widest = clean(vectors).groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if widest is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = widest["dims"]
    local = clean(vectors, dims).mapInArrow(_collapsed(k + 1), "ids array<long>, vector array<double>")
    # At most k + 1 ids of every batch meet here.
    single = local.groupBy("vector").agg(F.flatten(F.collect_list("ids")).alias("ids"))
    single = stored(single.select(F.slice(F.array_sort(F.array_distinct("ids")), 1, k + 1).alias("ids"), "vector"), "vectors")
    chosen = single.orderBy(F.xxhash64("vector")).limit(sample).select("vector").collect()
    forest = Forest(_units(np.array([r[0] for r in chosen])), trees, leaf)
    shared = Shipped(spark, forest)
    asked = clean(queries, dims).dropDuplicates(["vec_id"]).select(F.array("vec_id").alias("ids"), "vector")
    leaves = max(2 * trees, int(share * sum(t.leaves for t in forest.trees)))
    index = single.mapInArrow(_placed(shared, dims, False, leaves), _LEAVES)
    met = asked.mapInArrow(_placed(shared, dims, True, leaves), _LEAVES).unionByName(index)
    met = met.repartition("leaf").sortWithinPartitions("leaf", "kind")
    found = met.mapInArrow(_reranked(dims, k), "query_id long, ids array<long>, score double")
    pairs = found.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id != query_id")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
