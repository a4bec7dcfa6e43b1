"""From staged messages to a training order, and from tasks to rollouts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from turnmill.operators.shaping import batch_plan, holdout_split, rollout_plan
from turnmill.operators.tasks import filter_tasks, limit_tasks, require_tasks


def supervised_dataset(
    conversations: DataFrame,
    key: Sequence[str],
    test_size: int = 0,
    batch_size: int = 8,
    seed: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """(batched training rows, held-out rows)."""
    split = holdout_split(conversations, key, test_size, seed)
    train = split.where(F.col("split") == "train").drop("split")
    test = split.where(F.col("split") == "test").drop("split")
    return batch_plan(train, key, batch_size, seed), test


def task_rollouts(
    tasks: DataFrame,
    source: str,
    text: str | None = None,
    limit: int | None = None,
    groups_per_batch: int = 4,
    group_size: int = 4,
    seed: int = 0,
) -> DataFrame:
    """Filter, limit and require tasks, then plan their rollouts."""
    chosen = limit_tasks(filter_tasks(tasks, text), limit)
    require_tasks(chosen, source, text)
    return rollout_plan(chosen, ["task_name"], groups_per_batch, group_size, seed)
