"""Metric curves of runs that are still writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnmill.operators.metrics import CORRECT_METRIC, metric_curve
from turnmill.session import prepare
from turnmill.sources.records import METRICS_FILE, json_row, run_id_of
from turnmill.sources.tail import scan_appended_lines
from turnmill.streaming.run import land


def metric_curve_stream(
    spark: SparkSession,
    path: str,
    key: str = CORRECT_METRIC,
    scale: float = 100.0,
    run_pattern: str = METRICS_FILE,
) -> DataFrame:
    """(run_id, step, value) of new metrics files, append mode. A file counts as
    it is when it is first seen; for files that grow, see
    ``metric_curve_tail``."""
    prepare(spark)
    rows = spark.readStream.text(path).select(
        run_id_of(F.col("_metadata.file_path"), run_pattern).alias("run_id"),
        json_row("value").alias("row"),
    )
    return metric_curve(rows, key, scale)


def metric_curve_tail(
    spark: SparkSession,
    path: str,
    key: str = CORRECT_METRIC,
    scale: float = 100.0,
    run_pattern: str = METRICS_FILE,
) -> DataFrame:
    """(run_id, file, start, step, value) of metrics files that trainers append
    to, append mode: every trigger reads the lines that were finished since the
    last one, and no byte before them. ``start`` is where the line of the point
    begins in its file. A finished line that is no JSON fails the query."""
    prepare(spark)
    rows = scan_appended_lines(spark, path).where("value <> ''").select(
        run_id_of(F.col("file"), run_pattern).alias("run_id"), "file", "start", json_row("value").alias("row")
    )
    return metric_curve(rows, key, scale)


def append_curve(
    spark: SparkSession, path: str, out: str, key: str = CORRECT_METRIC, scale: float = 100.0, run_pattern: str = METRICS_FILE
) -> DataFrame:
    """Bring the curve at ``out`` (Parquet) up to what the metrics files hold now
    and return it, the columns of ``metric_curve_tail``.

    What was read is kept in the checkpoint in ``out``: a call reads the lines
    added since the last one and adds their points once, also when a call before
    failed half way. A line that is not finished waits for the next call. Run it
    again and again, by one writer at a time.
    """
    return land(metric_curve_tail(spark, path, key, scale, run_pattern), out)
