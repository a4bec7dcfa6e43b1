"""Agent tasks and rollout logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from turnmill.errors import EmptyResultError
from turnmill.functions.text import MAX_OUTPUT_BYTES, truncate_output
from turnmill.operators.ranks import first_rows

# Exit codes and the message that tell how a command ended.
TIMED_OUT, NOT_RUNNABLE, FAILURE = 124, 126, 1
GONE = b"No such container"

OUTCOMES = ("ok", "failed", "timed_out", "terminated")


def filter_tasks(tasks: DataFrame, text: str | None, name: str = "task_name") -> DataFrame:
    """Tasks whose name contains ``text``, case-sensitive; all without a text."""
    return tasks.where(F.col(name).contains(F.lit(text))) if text else tasks


def limit_tasks(
    tasks: DataFrame, limit: int | None, order_by: Sequence[str] = ("task_name",)
) -> DataFrame:
    """The first ``limit`` tasks by name; all for none or 0."""
    if not limit:
        return tasks
    if limit < 0:
        raise ValueError("limit must not be negative")
    return first_rows(tasks, limit, order_by)


def require_tasks(tasks: DataFrame, source: str, text: str | None = None) -> int:
    """How many tasks there are; an error when there are none."""
    found = tasks.count()
    if not found:
        raise EmptyResultError(f"{source} has no task" + (f" with {text!r} in its name" if text else ""))
    return found


def command_outcome(exit_code: Column, stderr: Column) -> Column:
    """ok, failed, timed_out or terminated."""
    gone = F.coalesce(F.contains(stderr.cast("binary"), F.lit(GONE)), F.lit(False))
    return (
        F.when(exit_code == TIMED_OUT, "timed_out")
        .when((exit_code == NOT_RUNNABLE) | ((exit_code == FAILURE) & gone), "terminated")
        .when(exit_code == 0, "ok")
        .otherwise("failed")
    )


def label_outcomes(logs: DataFrame) -> DataFrame:
    """Add ``outcome`` to rollout logs with exit_code and stderr."""
    return logs.withColumn("outcome", command_outcome(F.col("exit_code"), F.col("stderr")))


def truncate_outputs(
    logs: DataFrame, columns: Sequence[str] = ("stdout", "stderr"), max_bytes: int = MAX_OUTPUT_BYTES
) -> DataFrame:
    """Byte-limit the captured output columns and make them text."""
    return logs.withColumns({c: F.expr(truncate_output(f"`{c}`", max_bytes)) for c in columns})


def verdict_reward(outcome: Column) -> Column:
    return F.when(outcome == "ok", 1.0).otherwise(0.0)


def reward_summary(labelled: DataFrame, by: Sequence[str] = ("task",)) -> DataFrame:
    """Rollouts, pass rate and counts by outcome for every group in ``by``."""
    counts = [F.count_if(F.col("outcome") == o).alias(f"n_{o}") for o in OUTCOMES]
    return labelled.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rollouts"),
        F.avg(verdict_reward(F.col("outcome"))).alias("pass_rate"),
        *counts,
    )
