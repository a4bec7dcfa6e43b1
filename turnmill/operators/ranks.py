"""Order-derived numbers without a single-task window.

Counts per small group are summed first and numbers are then given inside each
group, so no task sees more than one group.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from turnmill.session import checkpointed, kept, ship_by_value, written

ship_by_value(__name__)


def bounded_offsets(counts: DataFrame, amount: str, order: str) -> DataFrame:
    """Add ``before``: the sum of ``amount`` over the earlier rows in ``order``.

    For tables whose row number is bounded by construction (hash buckets, tasks
    of one shuffle), as they are summed in one place.
    """
    earlier = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum(amount).over(earlier), F.lit(0)))


def grouped_offsets(
    counts: DataFrame, amount: str, within: Sequence[str], order: str, group: Column
) -> DataFrame:
    """``before`` among the rows equal in ``within``, for tables of any size.

    ``group`` must grow with ``order``. Rows are summed within (within, group)
    and group totals within ``within``, so neither window is large. ``counts``
    is read twice and should be materialised.
    """
    grouped = counts.withColumn("_group", group)
    inner = (
        Window.partitionBy(*within, "_group")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    outer = Window.partitionBy(*within).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    totals = grouped.groupBy(*within, "_group").agg(F.sum(amount).alias("_total"))
    earlier = totals.withColumn("_earlier", F.coalesce(F.sum("_total").over(outer), F.lit(0)))
    return (
        grouped.withColumn("_within", F.coalesce(F.sum(amount).over(inner), F.lit(0)))
        .join(earlier.drop("_total"), [*within, "_group"])
        .withColumn("before", F.col("_earlier") + F.col("_within"))
        .drop("_group", "_within", "_earlier")
    )


def shuffle_hash(key: Sequence[str], seed: int) -> Column:
    """A fixed pseudo-random order of rows: the hash of seed and key."""
    parts = [F.lit(str(seed)), *[F.col(k).cast("string") for k in key]]
    return F.md5(F.concat_ws("|", *parts))


def _bucket_digits(df: DataFrame) -> int:
    """Hex digits of the hash that make a bucket: enough for sixteen buckets per
    shuffle partition, so a million at most, whose counts are summed in one place."""
    wanted = 16 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(5, max(3, math.ceil(math.log(wanted, 16))))


def shuffled_rank(df: DataFrame, key: Sequence[str], seed: int = 0, name: str = "rank") -> DataFrame:
    """Add the exact 0-based rank of each row in the order (hash of key, key).

    ``key`` must identify a row. Rows are dealt once, by a prefix of the hash, so
    evenly whatever the keys are; each is numbered within its prefix and written
    down. The sizes of the prefixes are read from that table, and their sums are
    added as it is read. The input is evaluated once.
    """
    digits = _bucket_digits(df)
    hashed = df.withColumn("_hash", shuffle_hash(key, seed)).withColumn("_bucket", F.substring("_hash", 1, digits))
    place = Window.partitionBy("_bucket").orderBy("_hash", *key)
    placed = kept(hashed.withColumn("_place", F.row_number().over(place)).drop("_hash"), "ranked")
    counts = placed.groupBy("_bucket").agg(F.max("_place").alias("_n"))
    offsets = bounded_offsets(counts, "_n", "_bucket").select("_bucket", "before")
    return (
        placed.join(F.broadcast(offsets), "_bucket")  # 16 ** 5 rows at most
        .withColumn(name, F.col("before") + F.col("_place") - 1)
        .drop("_bucket", "_place", "before")
    )


def first_hashed(df: DataFrame, key: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """Add ``_first``: true for exactly the ``n`` rows that come first in the order
    (hash of key, key). ``key`` must identify a row.

    The rows are written down with their hash, so the input is evaluated once; the
    sizes of the hash prefixes and then the hashes of the one prefix that holds the
    n-th row are read from there. Rows are not shuffled: the test is a comparison
    with the n-th hash.
    """
    if n <= 0:
        return df.withColumn("_first", F.lit(False))
    digits = _bucket_digits(df)
    rows = kept(df.withColumn("_hash", shuffle_hash(key, seed)), "hashed")
    bucket = F.substring("_hash", 1, digits)
    counts = rows.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    edge = bounded_offsets(counts, "_n", "_bucket").where((F.col("before") < n) & (F.col("before") + F.col("_n") >= n)).first()
    if edge is None:
        return rows.withColumn("_first", F.lit(True)).drop("_hash")
    held = rows.where(F.col("_hash").startswith(edge["_bucket"])).select("_hash", *key)
    # One prefix is a small even share of the rows, sorted in one task.
    place = Window.partitionBy(F.substring("_hash", 1, digits)).orderBy("_hash", *key)
    last = held.withColumn("_place", F.row_number().over(place)).where(F.col("_place") == n - edge["before"]).first()
    types = {f.name: f.dataType for f in held.schema.fields}
    bound = F.struct(*[F.lit(last[c]).cast(types[c]).alias(c) for c in ("_hash", *key)])
    return rows.withColumn("_first", F.struct("_hash", *key) <= bound).drop("_hash")


def _leading_runs(n: int) -> Callable:
    """Sorted keys of a task to (key, how many), up to the run that holds the
    n-th, counted to its end. Reading stops there."""
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.ones(batch.num_rows, bool)
            new[1:] = False
            for column in batch.columns:
                here, before = column.slice(1), column.slice(0, batch.num_rows - 1)
                unequal = pc.fill_null(pc.not_equal(here, before), False)
                unequal = pc.or_(unequal, pc.xor(here.is_null(), before.is_null()))
                new[1:] |= unequal.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new)
            counts = np.diff(np.append(starts, batch.num_rows))
            if seen >= n:  # only what goes on with the last run is left
                if str(batch.slice(0, 1).to_pylist()) != last:
                    return
                starts, counts = starts[:1], counts[:1]
            keep = 1 + int(np.searchsorted(seen + np.cumsum(counts), n))
            yield _with_counts(batch, starts[:keep], counts[:keep])
            seen += int(counts[:keep].sum())
            if seen >= n and keep < int(new.sum()):
                next(batches, None)  # most inputs end here, which leaves the worker usable
                return
            last = str(batch.slice(batch.num_rows - 1, 1).to_pylist())

    return runs


def _with_counts(batch: pa.RecordBatch, starts: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    keys = batch.take(pa.array(starts))
    return pa.RecordBatch.from_arrays([*keys.columns, pa.array(counts.astype(np.int64))], [*keys.schema.names, "_n"])


def nth_place(df: DataFrame, n: int, order_by: Sequence[str]) -> Row | None:
    """Where the ``n``-th row lies in the order of ``order_by``: its key, how many
    rows have a smaller one (``before``) and how many the same (``_n``). None
    where there are fewer rows.

    The input is evaluated once, its keys only. Each task sorts its keys and sends
    the first n as (key, count), so keys that repeat are one row; what tasks send
    is added up, dealt by ranges, and summed range by range.
    """
    keys = df.select(*order_by)
    schema = StructType([*keys.schema.fields, StructField("_n", LongType())])
    runs = keys.sortWithinPartitions(*order_by).mapInArrow(_leading_runs(n), schema)
    merged = runs.groupBy(*order_by).agg(F.sum("_n").alias("_n")).orderBy(*order_by)
    earlier = Window.partitionBy("_part").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
    with written(merged.withColumn("_part", F.spark_partition_id()), "ranges") as parts:
        sums = parts.groupBy("_part").agg(F.sum("_n").alias("_sum"))
        edge = bounded_offsets(sums, "_sum", "_part").where((F.col("before") < n) & (F.col("before") + F.col("_sum") >= n))
        found = (
            parts.join(F.broadcast(edge), "_part")  # one row at most
            .withColumn("before", F.col("before") + F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
            .where((F.col("before") < n) & (F.col("before") + F.col("_n") >= n))
        )
        return found.select(*order_by, "before", "_n").first()


def first_rows(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """Exactly the first ``n`` rows in the order of ``order_by`` (null first), or
    all if there are fewer. Of rows equal to the n-th, which ones stay is open.

    The input is evaluated once to find the n-th key; the result is a plain filter
    by it, which can reach the scan. Only if more rows have that key than there is
    room for, these are read once more: each task writes down no more of them than
    there is room for, and takes as many as the tasks before it leave open.
    """
    if n <= 0:
        return df.where(F.lit(False))
    place = nth_place(df, n, order_by)
    if place is None:
        return df
    types = {f.name: f.dataType for f in df.select(*order_by).schema.fields}
    last = {c: F.lit(place[c]).cast(types[c]) for c in order_by}
    if len(order_by) == 1:
        (column,) = order_by
        less = F.col(column).isNull() | (F.col(column) < last[column])
        before = F.lit(False) if place[column] is None else less
        same = F.col(column).isNull() if place[column] is None else F.col(column) == last[column]
    else:
        key, bound = F.struct(*order_by), F.struct(*[last[c].alias(c) for c in order_by])
        before, same = key < bound, key == bound
    room = n - place["before"]
    if place["_n"] == room:
        return df.where(before | same)
    row = F.monotonically_increasing_id()  # counts the rows of a task that are left here
    index = row.bitwiseAND((1 << 33) - 1)
    ties = df.where(same).withColumns({"_task": F.shiftright(row, 33), "_index": index}).where(F.col("_index") < room)
    ties = checkpointed(ties)
    offsets = bounded_offsets(ties.groupBy("_task").agg(F.count(F.lit(1)).alias("_sum")), "_sum", "_task")
    taken = ties.join(F.broadcast(offsets.drop("_sum")), "_task")  # a row per task
    taken = taken.where(F.col("before") + F.col("_index") < room).select(df.columns)
    return df.where(before).unionByName(taken)
