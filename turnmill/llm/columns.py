"""Arrow columns as numpy arrays, and back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as long, text as UTF-8 bytes (null: empty) and the columns ``more``.

    Whatever else ``docs`` has, names that clash with inner ones included, is
    left behind here. Texts that are not strings are cast to them.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, *more)


def byte_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary or string column and its n + 1 row limits."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    n = len(column)
    limits = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[limits[0] : limits[-1]], limits - limits[0]


def slices(limits: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows [i, j) of about ``most`` bytes; a longer row is a run of its own."""
    i, n = 0, len(limits) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(limits, limits[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """Every bit of 64-bit words spread over all bits (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def lists(values: np.ndarray, limits: np.ndarray) -> pa.Array:
    """A list column from flat values and n + 1 limits."""
    return pa.ListArray.from_arrays(pa.array(limits.astype(np.int32)), pa.array(values))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1 … of every run, one after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)
