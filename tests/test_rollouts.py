"""Rollout math against a plain-Python model written from the specification."""

import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from turnmill.functions import ratios
from turnmill.operators import rollouts

ROLLOUT = "seq_id bigint, prompt array<int>, sampled array<int>, sampled_logprobs array<double>, advantage double"
DATUM = "seq_id bigint, logprobs array<double>, advantages array<double>, new_logprobs array<double>"


def test_assemble_datum(spark):
    rows = [(1, [7, 8, 9], [4, 5], [-0.5, -0.25], 1.0), (2, [7], [4], [-1.0], -1.0)]
    got = {r.seq_id: r for r in rollouts.assemble_datum(spark.createDataFrame(rows, ROLLOUT)).collect()}
    assert got[1].model_input == [7, 8, 9, 4] and got[1].target_tokens == [0, 0, 4, 5]
    assert got[1].logprobs == [0, 0, -0.5, -0.25] and got[1].advantages == [0, 0, 1, 1]
    assert got[1].sampled_length == 2
    assert got[2].model_input == [7] and got[2].target_tokens == [4] and got[2].advantages == [-1]


def test_faulty_rollouts(spark):
    rows = [(1, [], [4], [0.0], 1.0), (2, [1], [], [], 1.0), (3, [1], [4, 5], [0.0], 1.0),
            (4, [1], [4], None, 1.0), (5, None, [4], [0.0], 1.0), (6, [1], [4], [0.0], 1.0)]
    df = spark.createDataFrame(rows, ROLLOUT)
    faults = {r.seq_id: r.fault for r in rollouts.rollout_faults(df).collect()}
    assert faults == {1: "empty_prompt", 2: "empty_sample", 3: "logprobs_length",
                      4: "logprobs_length", 5: "empty_prompt"}
    assert [r.seq_id for r in rollouts.assemble_datum(df, "skip").collect()] == [6]
    with pytest.raises(PySparkException, match="faulty rollout"):
        rollouts.assemble_datum(df).collect()


def model_ratio(old, new, adv):
    gaps = [n - o for o, n, a in zip(old, new, adv) if a != 0]
    mean = sum(gaps) / len(gaps) if gaps else math.nan
    try:
        return math.exp(mean)
    except OverflowError:
        return math.inf


def some_datums():
    rng = random.Random(3)
    rows = []
    for i in range(200):
        n = rng.randint(1, 30)
        adv = [rng.choice([0.0, 1.0, -1.0, 0.5]) for _ in range(n)]
        spread = rng.choice([0.05, 0.3, 2.0])
        old = [rng.uniform(-3, 0) for _ in range(n)]
        rows.append((i, old, adv, [o + rng.uniform(-spread, spread) for o in old]))
    rows.append((900, [0.0, -1.0], [0.0, 0.0], [-1.0, -2.0]))  # nothing to train on
    rows.append((901, [0.0], [1.0], [800.0]))  # beyond exp
    rows.append((902, [math.log(1.2)], [-1.0], [2 * math.log(1.2)]))
    return rows


def test_ratio_gate_and_weights(spark):
    rows = some_datums()
    df = rollouts.sequence_ratios(spark.createDataFrame(rows, DATUM))
    df = df.withColumn("advantages", ratios.reweight_advantages(F.col("advantages"), F.col("weight")))
    got = {r.seq_id: r for r in df.collect()}
    seen = set()
    for i, old, adv, new in rows:
        want = model_ratio(old, new, adv)
        row = got[i]
        assert row.ratio == pytest.approx(want, rel=1e-9, nan_ok=True)
        inside = 0.8 <= row.ratio <= 1.2
        assert row.inside == inside
        weight = row.ratio if inside else 0.0
        assert row.advantages == pytest.approx([a * weight for a in adv])
        assert all(math.copysign(1, a) == 1 for a in row.advantages if a == 0)
        seen.add(inside)
    assert seen == {True, False}
    assert math.isnan(got[900].ratio) and not got[900].inside
    assert got[901].ratio == math.inf and not got[901].inside
    share = rollouts.clip_fraction(df).first().clip_fraction
    assert share == pytest.approx(sum(not r.inside for r in got.values()) / len(got))


def test_gate_includes_both_ends(spark):
    df = spark.createDataFrame([(0.8,), (1.2,), (0.7999999,), (1.2000001,), (None,)], "s double")
    got = [r[0] for r in df.select(ratios.clip_gate(F.col("s"))).collect()]
    assert got == [True, True, False, False, False]


def test_second_pass_equals_single_steps(spark):
    rows = some_datums()
    datums = spark.createDataFrame([(i, o, a) for i, o, a, _ in rows],
                                   "seq_id bigint, logprobs array<double>, advantages array<double>")
    fresh = spark.createDataFrame([(i, n) for i, _, _, n in rows], "seq_id bigint, logprobs array<double>")
    done = {r.seq_id: r for r in rollouts.second_pass(datums, fresh).collect()}
    swapped = {r.seq_id: r for r in rollouts.swap_logprobs(datums, fresh).collect()}
    assert len(done) == len(swapped) == len(rows)
    for i, old, adv, new in rows:
        assert done[i].logprobs == swapped[i].logprobs == new
        assert swapped[i].advantages == adv
        assert done[i].advantages == pytest.approx([a * done[i].weight for a in adv])
    again = rollouts.second_pass(rollouts.swap_logprobs(datums, fresh), fresh)
    assert again.where("isnan(ratio) or abs(ratio - 1) < 1e-12").count() == len(rows)


def test_token_rows_equal_arrays(spark):
    rows = some_datums()
    tokens = spark.createDataFrame(
        [(i, o, a, n) for i, old, adv, new in rows for o, a, n in zip(old, adv, new)],
        "seq_id bigint, logprob double, advantage double, new_logprob double")
    long = {r.seq_id: r.log_ratio for r in rollouts.token_log_ratio(tokens, ["seq_id"]).collect()}
    wide = rollouts.sequence_ratios(spark.createDataFrame(rows, DATUM)).collect()
    for r in wide:
        assert long[r.seq_id] == pytest.approx(r.log_ratio, nan_ok=True)


def test_mask_and_stats(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0, -1.0], [1, 2, 3], 2), (2, [0.0], [5], 1)],
                               "seq_id int, advantages array<double>, model_input array<int>, sampled_length int")
    rows = rollouts.loss_mask(df).orderBy("seq_id").collect()
    assert [r.mask for r in rows] == [[False, True, True], [False]]
    assert [r.n_trained for r in rows] == [2, 1]
    stats = rollouts.rollout_batch_stats(df).first()
    assert tuple(stats) == (2, 1, 1.5, 2, 4)


def test_frozen_batch_is_not_moved_again(spark):
    rows = some_datums()
    datums = spark.createDataFrame([(i, o, a) for i, o, a, _ in rows],
                                   "seq_id bigint, logprobs array<double>, advantages array<double>")
    fresh = spark.createDataFrame([(i, n) for i, _, _, n in rows], "seq_id bigint, logprobs array<double>")
    spark.sql("DROP TABLE IF EXISTS frozen")
    frozen = rollouts.freeze_batch(datums, "frozen", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        done = rollouts.second_pass(frozen, fresh)
        plan = done._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
        assert done.count() == len(rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE frozen")


@pytest.mark.parametrize("new", [[-1.0], [-1.0, -2.0, -3.0], [-1.0, None], None])
def test_uneven_or_missing_logprobs_fail(spark, new):
    rows = spark.createDataFrame([(1, [-1.0, -2.0], [1.0, 1.0], new)], "seq_id long, logprobs array<double>, advantages array<double>, new_logprobs array<double>")
    with pytest.raises(PySparkException, match="differ in size or hold NULL"):
        rollouts.sequence_ratios(rows).collect()


@pytest.mark.parametrize("passes", [[], [(2, [-1.0, -2.0])], [(1, [-1.0, -2.0])] * 2, [(1, [-1.0])]])
def test_second_pass_needs_one_whole_pass_per_sequence(spark, passes):
    old = spark.createDataFrame([(1, [-1.0, -2.0], [1.0, 1.0])], "seq_id long, logprobs array<double>, advantages array<double>")
    new = spark.createDataFrame(passes, "seq_id long, logprobs array<double>")
    for step in (rollouts.swap_logprobs, rollouts.second_pass):
        with pytest.raises(PySparkException, match="no single new pass"):
            step(old, new).collect()
