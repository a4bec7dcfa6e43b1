"""Line-oriented dumps with exact line numbers.

A line is placed by its file, the split it was read in and a row id that grows
within the split. That order is enough to sort and compare lines and costs
nothing. Line numbers need the number of lines in all earlier splits of the
file: one extra counting pass, whose result has one row per split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnmill.operators.ranks import grouped_offsets
from turnmill.session import broadcast_if_small, checkpointed

# Most bytes of split offsets that are broadcast.
BROADCAST_BYTES = 64 << 20

# Splits of one file whose counts are summed in one go.
_SPLITS_PER_GROUP = 4096

_PARTITION_SHIFT = 33  # monotonically_increasing_id keeps the partition above


def scan_jsonl(
    spark: SparkSession,
    path,
    line_numbers: bool = False,
    file: str | None = None,
) -> DataFrame:
    """Lines of UTF-8 text files as (file, value) with their place.

    ``lineno`` is added on request; otherwise the columns ``split_start``,
    ``split_length`` and ``row_id`` say where the line is. ``file`` reads one of
    the files only.
    """
    files = spark.read.text(path).select("*", F.col("_metadata").alias("meta"))
    if file is not None:
        files = files.where(F.col("meta.file_path") == file)
    placed = files.select(
        F.col("meta.file_path").alias("file"),
        F.col("meta.file_block_start").alias("split_start"),
        F.col("meta.file_block_length").alias("split_length"),
        F.monotonically_increasing_id().alias("row_id"),
        "value",
    )
    return number_lines(placed) if line_numbers else placed


def number_lines(placed: DataFrame) -> DataFrame:
    """Replace the place columns by ``lineno``, 1-based, blank lines counted.

    Splits are matched by file, start, length and task, so a different split
    plan in the second pass (say, after the cluster grew) cannot give a wrong
    number: it raises, and ``spark.sql.files.minPartitionNum`` pins the plan.
    """
    split = ["file", "split_start", "split_length"]
    task = F.shiftright("row_id", _PARTITION_SHIFT)
    counts = checkpointed(
        placed.groupBy(*split, task.alias("task")).agg(
            F.count(F.lit(1)).alias("n_lines"), F.min("row_id").alias("first_row")
        )
    )
    offsets = grouped_offsets(
        counts,
        amount="n_lines",
        within=["file"],
        order="split_start",
        group=F.floor(F.col("split_start") / F.lit(_group_span(placed.sparkSession))),
    ).select(*split, "task", (F.col("before") - F.col("first_row")).alias("shift"))
    offsets = broadcast_if_small(offsets, BROADCAST_BYTES)
    matched = placed.withColumn("task", task).join(offsets, [*split, "task"], "left")
    lineno = F.coalesce(
        F.col("row_id") + F.col("shift") + 1,
        F.raise_error(
            F.lit("split plan changed while numbering lines; set spark.sql.files.minPartitionNum")
        ).cast("bigint"),
    )
    others = [c for c in placed.columns if c not in (*split, "row_id", "value")]
    return matched.select("file", lineno.alias("lineno"), *others, "value")


def _group_span(spark: SparkSession) -> int:
    """Bytes of a file that at most ``_SPLITS_PER_GROUP`` full splits cover."""
    size = spark.conf.get("spark.sql.files.maxPartitionBytes").rstrip("bB")
    units = {"k": 1024, "m": 1024**2, "g": 1024**3, "t": 1024**4, "p": 1024**5}
    last = size[-1].lower()
    size_bytes = int(size[:-1]) * units[last] if last in units else int(size)
    return size_bytes * _SPLITS_PER_GROUP
