"""Splits, batches, schedules and plans against sorted lists."""

import hashlib

import pytest
from pyspark.sql import functions as F

from turnmill.operators import ranks, shaping
from turnmill.plans.datasets import supervised_dataset


def hashed_order(keys, seed):
    return sorted(keys, key=lambda k: (hashlib.md5(f"{seed}|{k}".encode()).hexdigest(), k))


@pytest.fixture
def rows(spark):
    return spark.range(500).withColumn("text", F.concat(F.lit("t"), "id"))


@pytest.mark.parametrize("n", [0, 1, 37, 499, 500, 900])
def test_holdout_is_exact(rows, n):
    split = shaping.holdout_split(rows, ["id"], n, seed=3)
    test = {r.id for r in split.where("split = 'test'").collect()}
    assert test == set(hashed_order(range(500), 3)[:n])
    assert split.count() == 500 and split.columns == ["id", "text", "split"]


def test_holdout_without_a_shuffle_of_rows(rows):
    plan = shaping.holdout_split(rows, ["id"], 37)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_input_of_split_and_batches_is_evaluated_once(spark):
    seen = spark.sparkContext.accumulator(0)
    count = F.udf(lambda x: seen.add(1) or x, "bigint")
    rows = spark.range(0, 400, 1, 4).select("id", count("id").alias("k"))
    train, test = supervised_dataset(rows, ["id"], test_size=30, seed=1)
    assert train.count() + test.count() == 400 and test.agg(F.sum("k")).first()[0] is not None
    assert seen.value == 400


def test_batches_shuffle_rows_once(rows):
    plan = shaping.batch_plan(rows, ["id"], 8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(_bucket") <= 1 and "SortMergeJoin" not in plan


def test_schedule_of_more_steps_than_an_array_holds(spark):
    plan = shaping.training_schedule(spark.range(3), 1, epochs=10**9)
    assert plan.rdd.getNumPartitions() > 500
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Range" in text and "Generate" not in text and "Exchange" not in text
    assert plan.limit(1).first().epoch == 0


@pytest.mark.parametrize("size", [1, 8, 500, 501])
def test_batches(rows, size):
    got = {r.id: (r["rank"], r.batch) for r in shaping.batch_plan(rows, ["id"], size, 5).collect()}
    assert got == {k: (i, i // size) for i, k in enumerate(hashed_order(range(500), 5))}


def test_schedule(rows):
    plan = shaping.training_schedule(rows, 64, epochs=2, save_every=5, eval_every=0, max_steps=13)
    got = [tuple(r) for r in plan.orderBy("step").collect()]
    sizes = [64] * 7 + [52]
    assert got == [(s, s // 8, s % 8, sizes[s % 8], (s + 1) % 5 == 0, False) for s in range(13)]


def test_schedule_only_counts(rows):
    plan = shaping.training_schedule(rows, 64, epochs=2)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in text and plan.count() == 16
    assert shaping.training_schedule(rows.where("id < 0"), 64).count() == 0
    for wrong in ({"epochs": 0}, {"save_every": -1}, {"eval_every": -1}):
        with pytest.raises(ValueError):
            shaping.training_schedule(rows, 64, **wrong)


def test_rollout_plan(rows):
    plan = shaping.rollout_plan(rows.select("id"), ["id"], batch_size=6, group_size=3, seed=1)
    got = sorted((r.step, r.group, r.member, r.id) for r in plan.collect())
    assert got == [(i // 6, i % 6, m, k) for i, k in enumerate(hashed_order(range(500), 1))
                   for m in range(3)]


def test_truncate_tokens(spark):
    df = spark.createDataFrame([([1, 2, 3], [0.1, 0.2, 0.3]), ([], [])], "a array<int>, b array<double>")
    got = shaping.truncate_tokens(df, ["a", "b"], 2).collect()
    assert [(r.a, r.b) for r in got] == [([1, 2], [0.1, 0.2]), ([], [])]
    assert shaping.truncate_tokens(df, ["a"], 0).first().a == []


def test_supervised_dataset(rows):
    train, test = supervised_dataset(rows, ["id"], test_size=20, batch_size=8, seed=2)
    assert test.count() == 20 and train.count() == 480
    assert train.agg(F.max("batch")).first()[0] == 59
    assert train.join(test, "id").count() == 0


@pytest.mark.parametrize("n", [1, 5, 40, 499, 500, 501])
def test_first_rows(rows, n):
    df = rows.select((F.col("id") * 7919 % 500).alias("k"), (F.col("id") % 3).alias("g")).repartition(7)
    got = {(r.g, r.k) for r in ranks.first_rows(df, n, ["g", "k"]).collect()}
    want = sorted((i % 3, i * 7919 % 500) for i in range(500))[:n]
    assert got == set(want)


@pytest.mark.parametrize("n", [1, 30, 77, 100, 101, 499, 500, 600])
def test_first_rows_with_ties(rows, n):
    """One key has a third of the rows, one is null; the batches of a task are small."""
    key = F.when(F.col("id") % 3 == 0, "b").when(F.col("id") % 5 == 0, None).otherwise(F.concat(F.lit("c"), F.col("id") % 9))
    df = rows.select("id", key.alias("k")).repartition(7)
    keys = {r.id: r.k for r in df.collect()}
    got = [r.k for r in ranks.first_rows(df, n, ["k"]).collect()]
    want = sorted(keys.values(), key=lambda k: (k is not None, k or ""))[:n]
    assert sorted(got, key=lambda k: (k is not None, k or "")) == want
    place = ranks.nth_place(df, n, ["k"])
    if n > 500:
        assert place is None
    else:
        assert place.k == want[-1] and place["_n"] == list(keys.values()).count(want[-1])
        assert place.before == sum(k != want[-1] for k in want)


def test_bound_of_a_limit_reads_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)
    count = F.udf(lambda x: seen.add(1) or x, "bigint")
    df = spark.range(0, 1000, 1, 4).select(count("id").alias("k"))
    assert ranks.nth_place(df, 10, ["k"]).k == 9
    assert seen.value <= 1000


def test_grouped_offsets(spark):
    rows = [(f, s, (s * 13 + len(f)) % 9) for f in ("a", "bb", "c") for s in range(0, 400, 4)]
    df = spark.createDataFrame(rows, "file string, start bigint, n bigint")
    got = {(r.file, r.start): r.before for r in ranks.grouped_offsets(
        df, "n", ["file"], "start", F.floor(F.col("start") / 64)).collect()}
    for f, s, _ in rows:
        assert got[f, s] == sum(n for g, t, n in rows if g == f and t < s)
