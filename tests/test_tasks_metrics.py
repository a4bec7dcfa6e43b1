"""Agent tasks, rollout logs, timings and curves."""

import statistics

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from turnmill.errors import EmptyResultError
from turnmill.operators import metrics, tasks
from turnmill.plans.datasets import task_rollouts

# Published step times of the two paths, seconds, and their summary.
FUSED = [13.243, 13.121, 12.9, 12.83, 12.529, 12.997, 12.699, 13.004]
TWO_PASS = [16.651, 16.542, 16.853, 17.139, 17.667, 16.211, 16.396, 16.707]


@pytest.fixture
def some_tasks(spark):
    names = ["grep-log", "Sort-file", "sort-lines", "a.b", "axb"]
    return spark.createDataFrame([(n,) for n in names], "task_name string")


def names(df):
    return sorted(r.task_name for r in df.collect())


def test_filter_and_limit(some_tasks):
    assert names(tasks.filter_tasks(some_tasks, "sort")) == ["sort-lines"]
    assert names(tasks.filter_tasks(some_tasks, "a.b")) == ["a.b"]
    assert names(tasks.filter_tasks(some_tasks, "")) == names(some_tasks)
    assert names(tasks.limit_tasks(some_tasks, 2)) == ["Sort-file", "a.b"]
    assert names(tasks.limit_tasks(some_tasks, 0)) == names(tasks.limit_tasks(some_tasks, None))
    with pytest.raises(ValueError):
        tasks.limit_tasks(some_tasks, -1)
    assert tasks.require_tasks(some_tasks, "set") == 5
    with pytest.raises(EmptyResultError, match="set.*'zzz'"):
        tasks.require_tasks(tasks.filter_tasks(some_tasks, "zzz"), "set", "zzz")
    plan = task_rollouts(some_tasks, "set", "-", 2, groups_per_batch=1, group_size=3)
    assert plan.count() == 6 and plan.agg(F.max("step")).first()[0] == 1


def test_truncate_output(spark):
    data = [b"", b"abc", "é".encode() * 5, "\U0001f600".encode() * 3, b"\xff\xfeab\xe2\x82", b"x" * 40]
    df = spark.createDataFrame([(bytearray(d), bytearray(d)) for d in data], "stdout binary, stderr binary")
    for limit in (0, 1, 2, 3, 5, 6, 7, 9, 11, 40):
        rows = tasks.truncate_outputs(df, max_bytes=limit).collect()
        for d, row in zip(data, rows):
            want = d[:limit].decode("utf-8", errors="replace")
            if len(d) > limit:
                want += f"\n[truncated: {len(d) - limit} bytes dropped]"
            assert row.stdout == row.stderr == want


def test_outcomes_and_rewards(spark):
    rows = [("t", 0, b""), ("t", 3, b""), ("t", 124, b""), ("t", 126, b""),
            ("t", 1, b"Error: No such container: x"), ("t", 1, b"no such container"), ("u", 0, None),
            ("u", 1, None), ("u", 2, b"No such container")]
    df = tasks.label_outcomes(spark.createDataFrame(rows, "task string, exit_code int, stderr binary"))
    assert [r.outcome for r in df.collect()] == [
        "ok", "failed", "timed_out", "terminated", "terminated", "failed", "ok", "failed", "failed"]
    got = {r.task: r for r in tasks.reward_summary(df).collect()}
    assert (got["t"].rollouts, got["t"].n_terminated, got["t"].n_timed_out) == (6, 2, 1)
    assert got["u"].pass_rate == pytest.approx(1 / 3)


@pytest.fixture
def timings(spark):
    rows = []
    for path, times in ((metrics.FUSED, FUSED), (metrics.TWO_PASS, TWO_PASS)):
        rows += [(path, i, s) for i, s in enumerate([99.0, *times])]
    rows += [("single", 0, 5.0), ("single", 1, 2.0), ("only_warmup", 4, 1.0)]
    return metrics.mark_warmup(spark.createDataFrame(rows, "path string, step int, seconds double"))


@pytest.mark.parametrize("marked", [True, False])
def test_timing_summary_on_published_numbers(timings, marked):
    given = timings if marked else timings.drop("is_warmup")
    summary = metrics.step_timing_summary(given, 7569)
    got = {r.path: r for r in summary.collect()}
    assert (got[metrics.FUSED].mean_s, got[metrics.FUSED].stdev_s) == (12.915, 0.229)
    assert (got[metrics.TWO_PASS].mean_s, got[metrics.TWO_PASS].stdev_s) == (16.771, 0.458)
    assert got[metrics.FUSED].tokens_per_s == 586.0 and got[metrics.TWO_PASS].tokens_per_s == 451.3
    assert got[metrics.FUSED].stdev_raw == pytest.approx(statistics.stdev(FUSED), rel=1e-12)
    assert (got[metrics.FUSED].steps, got["single"].steps) == (8, 1)
    assert got["single"].stdev_s == 0.0 and got["single"].mean_s == 2.0
    assert "only_warmup" not in got
    row = metrics.path_comparison(summary).first()
    assert (row.step_time_reduction_pct, row.throughput_gain_pct) == (23.0, 29.8)
    times = metrics.step_times(timings).where(F.col("path") == metrics.FUSED).orderBy("step")
    assert [r.seconds for r in times.collect()] == FUSED


def test_bench_tidy(spark):
    side = "struct<mean_s:double,tokens_per_s:double>"
    df = spark.createDataFrame([("r", (12.915, 586.0), (16.771, 451.3), None)],
                               f"run string, native_1pass {side}, custom_2pass {side}, summary struct<m:int>")
    assert [tuple(r) for r in metrics.bench_tidy(df).collect()] == [
        ("r", "step time (s)", "lower", 0, "custom_2pass", 16.771),
        ("r", "step time (s)", "lower", 1, "native_1pass", 12.915),
        ("r", "tokens / s", "higher", 0, "custom_2pass", 451.3),
        ("r", "tokens / s", "higher", 1, "native_1pass", 586.0),
    ]


def test_metric_curve(spark):
    lines = ['{"step":0,"env/all/correct":0.5}', '{"step":1,"optim/lr":1}',
             '{"step":2,"env/all/correct":1}', '{"step":3,"env":{"all":{"correct":1}}}']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "n int, line string").select(
        "n", F.parse_json("line").alias("row"))
    assert [tuple(r) for r in metrics.metric_curve(df).collect()] == [(0, 0, 50.0), (2, 2, 100.0)]
    lr = metrics.metric_curve(df, "optim/lr", 1.0).collect()
    assert [tuple(r) for r in lr] == [(1, 1, 1.0)]


def test_outlying_warmup_takes_no_digits(spark):
    rows = [("p", i, s) for i, s in enumerate([1e8, 12.91, 12.92, 12.93, 12.94, 12.95])]
    row = metrics.step_timing_summary(spark.createDataFrame(rows, "path string, step int, seconds double"), 100).first()
    assert row.steps == 5 and abs(row.stdev_raw - 0.0158113883) < 1e-9


def test_equal_task_names_are_cut_exactly(spark):
    named = spark.createDataFrame([("a",), ("a",), ("a",), ("b",)], "task_name string")
    for n in (1, 2, 3, 4, 9):
        assert tasks.limit_tasks(named, n).count() == min(n, 4)


@pytest.mark.parametrize("row", ['{"env/all/correct":1}', '{"step":1.5,"env/all/correct":1}', '{"step":null,"env/all/correct":1}'])
def test_metric_row_needs_a_whole_step(spark, row):
    rows = spark.createDataFrame([(row,)], "value string").selectExpr("parse_json(value) AS row")
    with pytest.raises(PySparkException, match="whole step"):
        metrics.metric_curve(rows).collect()
