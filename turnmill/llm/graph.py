"""Connected components as shuffles and joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from turnmill.llm.tables import stored


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and, of each, the smallest node of its component."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a task to edges from every node to the smallest of its component."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if parts:
        nodes, roots = local_components(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        away = nodes != roots
        yield pa.RecordBatch.from_arrays([pa.array(nodes[away]), pa.array(roots[away])], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """Columns node and component (the smallest node reachable) of the graph
    whose edges are the two long columns of ``edges``; only nodes that have an
    edge to another node are returned.

    Every round deals the edges by their larger end and connects what meets in a
    task, then points nodes past their parents by a join, so paths halve. A hot
    node is the smaller end of most of its edges and these are dealt by the
    other; adaptive execution splits it in the join. Rounds are written down.
    """
    a, b = edges.columns
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v")
    before = None
    while True:
        met = stored(now.repartition("u").mapInArrow(_contracted, "u long, v long"), "edges")
        state = met.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if state == before:
            return met.select(F.col("u").alias("node"), F.col("v").alias("component")).union(met.select("v", "v").distinct())
        before = state
        past = met.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("w"))
        # A parent's own edge stays in the table, so nothing comes apart.
        now = met.join(past, "v", "left").select("u", F.coalesce("w", "v").alias("v"))
