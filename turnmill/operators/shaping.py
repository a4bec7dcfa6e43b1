"""Dataset shaping for training: splits, batches, schedules, rollout plans.

The order of conversations is the hash of (seed, key), fixed for all runs. Whole
rows pass through a table in the shared folder, so a costly input, such as an
import, is evaluated once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from turnmill.operators.ranks import first_hashed, shuffled_rank


def holdout_split(df: DataFrame, key: Sequence[str], test_size: int = 0, seed: int = 0) -> DataFrame:
    """Add ``split``: exactly ``test_size`` rows are 'test', the rest 'train'."""
    if test_size < 0:
        raise ValueError("test_size must not be negative")
    others = [c for c in df.columns if c != "split"]
    split = F.when(F.col("_first"), "test").otherwise("train").alias("split")
    return first_hashed(df.select(others), key, test_size, seed).select(*others, split)


def batch_plan(df: DataFrame, key: Sequence[str], batch_size: int = 8, seed: int = 0) -> DataFrame:
    """Add ``rank`` and ``batch`` in shuffled order; the last batch may be short."""
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    ranked = shuffled_rank(df, key, seed)
    return ranked.withColumn("batch", F.expr(f"rank DIV {int(batch_size)}"))


_STEPS_A_TASK = 4_000_000


def _every(step: Column, steps: int) -> Column:
    """After each ``steps`` finished steps; never for 0."""
    return F.pmod(step + 1, F.lit(steps)) == 0 if steps else F.lit(False)


def training_schedule(
    rows: DataFrame,
    batch_size: int = 8,
    epochs: int = 1,
    save_every: int = 20,
    eval_every: int = 0,
    max_steps: int | None = None,
) -> DataFrame:
    """One row per step: step, epoch, batch, its size, and whether to save or
    evaluate after it, for ``rows`` in batches of ``batch_size`` as ``batch_plan``
    makes them. Rows are only counted, at once: all batches are full but the last."""
    if epochs < 1 or batch_size < 1:
        raise ValueError("epochs and batch_size must be positive")
    if save_every < 0 or eval_every < 0 or (max_steps is not None and max_steps < 0):
        raise ValueError("save_every, eval_every and max_steps must not be negative")
    n_rows = rows.count()
    n_batches = -(-n_rows // batch_size)
    steps = n_batches * epochs if max_steps is None else min(n_batches * epochs, max_steps)
    # Steps come from tasks of some millions each; nothing is gathered for them.
    plan = rows.sparkSession.range(0, steps, 1, 1 + steps // _STEPS_A_TASK).withColumnRenamed("id", "step")
    plan = plan.withColumn("_n", F.lit(max(1, n_batches)).cast("bigint")).withColumn("_rows", F.lit(n_rows).cast("bigint"))
    plan = plan.withColumn("epoch", F.expr("step DIV _n")).withColumn("batch", F.expr("step % _n"))
    return plan.select(
        "step",
        "epoch",
        "batch",
        F.least(F.lit(batch_size).cast("bigint"), F.col("_rows") - F.col("batch") * batch_size).alias("size"),
        _every(F.col("step"), save_every).alias("save"),
        _every(F.col("step"), eval_every).alias("evaluate"),
    )


def rollout_plan(
    prompts: DataFrame,
    key: Sequence[str],
    batch_size: int = 64,
    group_size: int = 8,
    seed: int = 0,
) -> DataFrame:
    """Each prompt ``group_size`` times: step, group within the step, member."""
    if group_size < 1:
        raise ValueError("group_size must be positive")
    planned = batch_plan(prompts, key, batch_size, seed)
    return (
        planned.withColumn("group", F.pmod("rank", F.lit(batch_size)))
        .withColumnRenamed("batch", "step")
        .drop("rank")
        .withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(group_size - 1))))
    )


def truncate_tokens(df: DataFrame, arrays: Sequence[str], max_length: int = 2048) -> DataFrame:
    """The first ``max_length`` positions of all parallel arrays."""
    if max_length < 0:
        raise ValueError("max_length must not be negative")
    return df.withColumns({c: F.slice(c, 1, max_length) for c in arrays})
