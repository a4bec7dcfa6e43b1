"""A broadcast bitmap of fixed size that keeps most of the rows out of a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from turnmill.llm.columns import mix

_BITS = 1 << 22
_READERS = 16  # tasks that mark bits, each of them sends 512 KB


def _bit_of(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.view(np.uint64)) % np.uint64(_BITS)).astype(np.int64)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(_BITS, bool)
    for batch in batches:
        bits[_bit_of(batch.column(0).to_numpy())] = True
    yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])


def _held(shared) -> Callable:
    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(shared.value, np.uint8)).astype(bool)
        for batch in batches:
            yield batch.filter(pa.array(bits[_bit_of(batch.column(0).to_numpy())]))

    return held


def possible(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose first column, a long that is not null, may be among ``ids``
    (one such column): all that are, and few others while ids are under a million."""
    bits = np.zeros(_BITS // 8, np.uint8)
    for row in ids.coalesce(_READERS).mapInArrow(_marked, "bits binary").collect():
        bits |= np.frombuffer(row[0], np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(bits.tobytes())
    return rows.mapInArrow(_held(shared), rows.schema)
