"""Step timings, path comparison and metric curves.

Rounded values are what a report prints; the unrounded ones are kept next to
them, as rounding of ties differs between engines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from turnmill.functions.chat import bound

# Names of the two compared paths and of the default metric.
FUSED, TWO_PASS = "native_1pass", "custom_2pass"
CORRECT_METRIC = "env/all/correct"


def mark_warmup(timings: DataFrame, by: Sequence[str] = ("path",)) -> DataFrame:
    """Add ``is_warmup``: the first step of each path. The first steps are one
    row per path; adaptive execution broadcasts them by their measured size, or
    splits a path that has most of the rows."""
    first = timings.groupBy(*by).agg(F.min("step").alias("_first"))
    return (
        timings.join(first, [*by])
        .withColumn("is_warmup", F.col("step") == F.col("_first"))
        .drop("_first")
    )


def step_timing_summary(
    timings: DataFrame, tokens: int | str, by: Sequence[str] = ("path",)
) -> DataFrame:
    """Mean, sample deviation and throughput of each path without its warm-up:
    the rows marked ``is_warmup`` or, where there is no such column, the first
    step. That one is looked up first and left out, not subtracted, so that an
    outlying warm-up takes no digits from the others.

    ``tokens`` is the number of tokens per step, or a column that is constant
    within a path.
    """
    per_step = F.lit(tokens) if isinstance(tokens, int) else F.max(tokens)
    marked = "is_warmup" in timings.columns
    rows = (timings if marked else mark_warmup(timings, by)).where(~F.col("is_warmup"))
    sums = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg("seconds").alias("_mean"),
        F.stddev_samp("seconds").alias("_stdev"),
        per_step.alias("_tokens"),
    )
    n, mean = F.col("_n"), F.col("_mean")
    deviation = F.when(n > 1, F.col("_stdev")).otherwise(0.0)
    return sums.select(
        *by,
        n.alias("steps"),
        mean.alias("mean_raw"),
        deviation.alias("stdev_raw"),
        (F.col("_tokens") / mean).alias("tokens_per_s_raw"),
    ).select(
        "*",
        F.round("mean_raw", 3).alias("mean_s"),
        F.round("stdev_raw", 3).alias("stdev_s"),
        F.round("tokens_per_s_raw", 1).alias("tokens_per_s"),
    )


def step_times(timings: DataFrame, by: Sequence[str] = ("path",)) -> DataFrame:
    """The timed steps, rounded, one row each; ``step`` gives their order. A
    path's steps are not collected into one list, as it may have any number."""
    return timings.where(~F.col("is_warmup")).select(
        *by, "step", F.round("seconds", 3).alias("seconds")
    )


def path_comparison(
    summary: DataFrame, fused: str = FUSED, other: str = TWO_PASS, by: Sequence[str] = ()
) -> DataFrame:
    """Step-time reduction and throughput gain of one path over the other, in
    per cent, from the rounded values."""
    def of(path: str, column: str) -> Column:
        return F.max(F.when(F.col("path") == path, F.col(column)))

    time_ratio = F.try_divide(of(fused, "mean_s"), of(other, "mean_s"))
    rate_ratio = F.try_divide(of(fused, "tokens_per_s"), of(other, "tokens_per_s"))
    return summary.where(F.col("path").isin(fused, other)).groupBy(*by).agg(
        (F.round(100 * (1 - time_ratio), 1) + 0.0).alias("step_time_reduction_pct"),
        (F.round(100 * (rate_ratio - 1), 1) + 0.0).alias("throughput_gain_pct"),
    )


def bench_record(summary: DataFrame, fused: str = FUSED, other: str = TWO_PASS, by: Sequence[str] = ()) -> DataFrame:
    """Benchmark records as columns of the two paths and ``summary``, from the
    rows of ``step_timing_summary`` (with ``path``); one per ``by``."""
    def side(path: str, name: str) -> Column:
        values = F.struct(F.col("mean_s"), F.col("stdev_s"), F.col("tokens_per_s"))
        return F.max(F.when(F.col("path") == path, values)).alias(name)

    sides = summary.groupBy(*by).agg(side(fused, FUSED), side(other, TWO_PASS))
    gains = F.struct("step_time_reduction_pct", "throughput_gain_pct").alias("summary")
    compared = path_comparison(summary, fused, other, by).select(*by, gains)
    if by:
        return sides.join(compared, [*by], "left")
    return sides.select(FUSED, TWO_PASS, F.lit(1).alias("_")).join(compared.withColumn("_", F.lit(1)), "_", "left").drop("_")


def write_bench_records(records: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """One pretty-printed record per row, in folders by ``by``."""
    body = F.to_json(F.struct(FUSED, TWO_PASS, "summary"), {"pretty": "true"}).alias("value")
    writer = records.select(*by, body).write
    (writer.partitionBy(*by) if by else writer).text(path)


def bench_tidy(records: DataFrame) -> DataFrame:
    """Benchmark records as rows for drawing: metric, what is better, position
    on the axis, path, value. Other columns travel along."""
    others = [c for c in records.columns if c not in (FUSED, TWO_PASS, "summary")]
    # The two axes, in the order of the report, and their fields.
    rows = [
        F.struct(
            F.lit(metric).alias("metric"),
            F.lit(better).alias("better"),
            F.lit(position).alias("position"),
            F.lit(path).alias("path"),
            F.col(f"{path}.{field}").cast("double").alias("value"),
        )
        for metric, better, field in (
            ("step time (s)", "lower", "mean_s"),
            ("tokens / s", "higher", "tokens_per_s"),
        )
        for position, path in enumerate((TWO_PASS, FUSED))
    ]
    return records.select(*others, F.inline(F.array(*rows)))


def metric_curve(
    metrics: DataFrame, key: str = CORRECT_METRIC, scale: float = 100.0, row: str = "row"
) -> DataFrame:
    """(step, value) of the metric rows that have ``key``; a plain projection,
    so it also works on a stream. Other columns travel along. A row that has the
    key but no whole number as step fails the job."""
    if "'" in key:
        raise ValueError("metric key must not contain a quote")
    others = [c for c in metrics.columns if c != row]
    path = f"$[\\'{key}\\']"
    point = (
        "named_struct('step', CASE WHEN try_variant_get(_row, '$.step', 'double') = "
        "floor(try_variant_get(_row, '$.step', 'double')) THEN variant_get(_row, '$.step', 'bigint') "
        f"WHEN try_variant_get(_row, '{path}', 'variant') IS NOT NULL "
        "THEN CAST(raise_error('metric row without a whole step') AS bigint) END, "
        f"'value', variant_get(_row, '{path}', 'double') * {float(scale)}D, "
        f"'present', try_variant_get(_row, '{path}', 'variant') IS NOT NULL)"
    )
    points = f"filter(array({bound(f'`{row}`', '_row', point)}), _p -> _p.present)"
    return metrics.select(*others, F.expr(f"inline({points})")).drop("present")
