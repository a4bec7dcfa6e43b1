"""Rollout batches: datum assembly, batch statistics and the client-side half
of a two-pass policy update."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from turnmill.functions import ratios

ROLLOUT_FAULTS = ("empty_prompt", "empty_sample", "logprobs_length")


def _fault() -> Column:
    """Why parallel arrays could not be aligned, NULL for a sound rollout."""
    return (
        F.when(F.coalesce(F.size("prompt"), F.lit(0)) <= 0, ROLLOUT_FAULTS[0])
        .when(F.coalesce(F.size("sampled"), F.lit(0)) <= 0, ROLLOUT_FAULTS[1])
        .when(
            F.coalesce(F.size("sampled_logprobs") != F.size("sampled"), F.lit(True)),
            ROLLOUT_FAULTS[2],
        )
    )


def rollout_faults(rollouts: DataFrame) -> DataFrame:
    """Rollouts that cannot become a datum, with the reason."""
    return rollouts.withColumn("fault", _fault()).where(F.col("fault").isNotNull())


def assemble_datum(rollouts: DataFrame, on_fault: str = "fail") -> DataFrame:
    """Model input and the three arrays parallel to it.

    Takes ``prompt``, ``sampled``, ``sampled_logprobs`` and ``advantage``; other
    columns travel along, and ``sampled_length`` is added. Prompt positions have
    target 0, log-probability 0 and advantage 0. ``on_fault='skip'`` leaves
    rollouts that cannot be aligned to ``rollout_faults``.
    """
    if on_fault not in ("fail", "skip"):
        raise ValueError(f"on_fault must be 'fail' or 'skip', not {on_fault!r}")
    if on_fault == "skip":
        sound = rollouts.where(_fault().isNull())
    else:
        sound = rollouts.where(
            F.when(
                _fault().isNotNull(),
                F.raise_error(F.concat(F.lit("faulty rollout: "), _fault())).cast("boolean"),
            ).otherwise(True)
        )
    inputs = ("prompt", "sampled", "sampled_logprobs", "advantage")
    observed = F.size("prompt") - 1
    n = F.size("sampled")
    zeros = F.array_repeat(F.lit(0.0), observed)
    return sound.select(
        *[c for c in rollouts.columns if c not in inputs],
        F.concat("prompt", F.slice("sampled", F.lit(1), n - 1)).alias("model_input"),
        F.concat(F.array_repeat(F.lit(0), observed), "sampled").alias("target_tokens"),
        F.concat(zeros, F.col("sampled_logprobs").cast("array<double>")).alias("logprobs"),
        F.concat(zeros, F.array_repeat(F.col("advantage").cast("double"), n)).alias("advantages"),
        n.alias("sampled_length"),
    )


def loss_mask(datums: DataFrame) -> DataFrame:
    """Add ``mask`` and ``n_trained``."""
    return datums.withColumns(
        {
            "mask": ratios.loss_mask(F.col("advantages")),
            "n_trained": ratios.trained_positions(F.col("advantages")),
        }
    )


def rollout_batch_stats(datums: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sequences, sampled lengths and total tokens of a batch (prompt and
    sampled positions both count)."""
    return datums.groupBy(*by).agg(
        F.count(F.lit(1)).alias("sequences"),
        F.min("sampled_length").alias("min_length"),
        F.avg("sampled_length").alias("mean_length"),
        F.max("sampled_length").alias("max_length"),
        F.sum(F.size("model_input")).alias("total_tokens"),
    )


def sequence_ratios(
    datums: DataFrame,
    new_logprobs: str = "new_logprobs",
    low: float = ratios.CLIP_LOW,
    high: float = ratios.CLIP_HIGH,
) -> DataFrame:
    """Add ``log_ratio``, ``ratio``, ``inside`` and ``weight`` per sequence."""
    log_ratio = ratios.sequence_log_ratio(
        F.col(new_logprobs), F.col("logprobs"), F.col("advantages")
    )
    rated = datums.withColumn("log_ratio", log_ratio).withColumn(
        "ratio", ratios.importance_ratio(F.col("log_ratio"))
    )
    return rated.withColumns(
        {
            "inside": ratios.clip_gate(F.col("ratio"), low, high),
            "weight": ratios.sequence_weight(F.col("ratio"), low, high),
        }
    )


def token_log_ratio(tokens: DataFrame, sequence: Sequence[str]) -> DataFrame:
    """``log_ratio`` for rollouts kept one row per token: columns new_logprob,
    logprob and advantage. Sums are combined before the shuffle, so one sequence
    may hold any share of the rows."""
    gap = F.col("new_logprob").cast("double") - F.col("logprob").cast("double")
    missing = F.raise_error(F.lit("token without log-probability or advantage")).cast("double")
    trained = F.coalesce(F.col("advantage") != 0, missing.cast("boolean"))
    mean = F.avg(F.when(trained, F.coalesce(gap, missing)))
    return tokens.groupBy(*sequence).agg(
        F.coalesce(mean, F.lit(float("nan"))).alias("log_ratio")
    )


def swap_logprobs(datums: DataFrame, new_pass: DataFrame, key: Sequence[str] = ("seq_id",)) -> DataFrame:
    """Datums with the log-probabilities of ``new_pass`` (same key), so that a
    ratio taken from here on starts at 1. See ``_with_pass`` for what fails."""
    joined = _with_pass(datums, new_pass, key, "_fresh")
    return joined.withColumn("logprobs", F.col("_fresh")).drop("_fresh")


def _with_pass(datums: DataFrame, new_pass: DataFrame, key: Sequence[str], name: str) -> DataFrame:
    """Every datum with its new log-probabilities. A datum without a new pass, a
    key that the new pass repeats, and arrays of another size fail the job. The
    repeats are counted in the order that the join needs anyway."""
    times = F.count(F.lit(1)).over(Window.partitionBy(*key))
    fresh = new_pass.select(*key, F.col("logprobs").alias(name), times.alias("_times"))
    sound = (F.col("_times") == 1) & (F.size(name) == F.size("logprobs"))
    fault = F.raise_error(F.concat(F.lit("no single new pass of the same length for "), F.to_json(F.struct(*key))))
    checked = F.when(F.coalesce(sound, F.lit(False)), F.col(name)).otherwise(fault.cast("array<double>"))
    return datums.join(fresh, [*key], "left").withColumn(name, checked).drop("_times")


def second_pass(
    datums: DataFrame,
    new_pass: DataFrame,
    key: Sequence[str] = ("seq_id",),
    low: float = ratios.CLIP_LOW,
    high: float = ratios.CLIP_HIGH,
) -> DataFrame:
    """Ratio, clip gate, re-weighted advantages and fresh log-probabilities in
    one join and one projection."""
    rated = sequence_ratios(_with_pass(datums, new_pass, key, "new_logprobs"), "new_logprobs", low, high)
    return rated.withColumns(
        {
            "advantages": ratios.reweight_advantages(F.col("advantages"), F.col("weight")),
            "logprobs": F.col("new_logprobs").cast("array<double>"),
        }
    ).drop("new_logprobs")


def clip_fraction(rated: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of sequences outside the clip range."""
    return rated.groupBy(*by).agg(
        F.avg(F.when(F.col("inside"), 0.0).otherwise(1.0)).alias("clip_fraction")
    )


def freeze_batch(
    datums: DataFrame, table: str, buckets: int, key: Sequence[str] = ("seq_id",)
) -> DataFrame:
    """Save datums once, bucketed and sorted by key. Every later step joins its
    new log-probabilities without moving the batch again."""
    datums.write.bucketBy(buckets, *key).sortBy(*key).saveAsTable(table)
    return datums.sparkSession.table(table)
