"""Sequence-level importance ratios over per-token arrays.

Each rollout is one row; all math stays inside the row, so nothing is exploded
or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Default clip range of the sequence ratio, ends included.
CLIP_LOW, CLIP_HIGH = 0.8, 1.2


def loss_mask(advantages: Column) -> Column:
    """Which positions are trained on."""
    return F.transform(advantages, lambda a: a != 0)


def trained_positions(advantages: Column) -> Column:
    """How many positions are trained on, one at least."""
    return F.greatest(F.size(F.filter(advantages, lambda a: a != 0)), F.lit(1))


def sequence_log_ratio(new: Column, old: Column, advantages: Column) -> Column:
    """Mean of new - old over the trained positions; NaN when there are none.
    Arrays of unequal sizes, and NULL arrays or elements, fail the job."""
    n = F.size(advantages)
    even = (F.size(new) == n) & (F.size(old) == n) & (n >= 0)
    whole = ~(F.exists(new, lambda x: x.isNull()) | F.exists(old, lambda x: x.isNull()) | F.exists(advantages, lambda x: x.isNull()))
    fault = F.raise_error(F.lit("log-probabilities and advantages differ in size or hold NULL"))
    new, old = (F.coalesce(x, fault.cast("array<double>")) for x in (new, old))
    advantages = F.when(F.coalesce(even & whole, F.lit(False)), advantages).otherwise(fault.cast("array<double>"))
    gaps = F.zip_with(new, old, lambda n, o: n.cast("double") - o.cast("double"))
    trained = F.filter(
        F.zip_with(gaps, advantages, lambda g, a: F.when(a != 0, g)), lambda g: g.isNotNull()
    )
    return F.aggregate(  # over no rows: names ``trained`` once, as it is used twice
        F.array(),
        trained,
        lambda g, _: g,
        lambda g: F.when(
            F.size(g) > 0, F.aggregate(g, F.lit(0.0), lambda s, x: s + x) / F.size(g)
        ).otherwise(F.lit(float("nan"))),
    )


def importance_ratio(log_ratio: Column) -> Column:
    return F.exp(log_ratio)


def clip_gate(ratio: Column, low: float = CLIP_LOW, high: float = CLIP_HIGH) -> Column:
    """Inside the clip range. NaN and NULL are outside."""
    return F.coalesce(ratio.between(low, high), F.lit(False))


def sequence_weight(ratio: Column, low: float = CLIP_LOW, high: float = CLIP_HIGH) -> Column:
    return F.when(clip_gate(ratio, low, high), ratio).otherwise(F.lit(0.0))


def reweight_advantages(advantages: Column, weight: Column) -> Column:
    """Every advantage times the sequence weight; the sum with 0 makes -0.0 plain."""
    return F.transform(advantages, lambda a: a.cast("double") * weight + F.lit(0.0))
