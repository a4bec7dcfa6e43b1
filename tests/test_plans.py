"""What the plans must and must not contain, and all registered queries against
their SQL on the smallest data."""

import os
import re

import pytest

import __spark_entry__ as registered
from compare import duck_result, duck_views, spark_result
from turnmill.operators.traces import import_conversations, import_turns
from turnmill.sources.lines import scan_jsonl
from turnmill.workload import inputs
from turnmill.workload.queries import QUERIES

OWN = [name for name in registered.queries() if name in QUERIES]
SF_DIR = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("fmt, parses", [("messages", 3), ("anthropic", 2)])
def test_import_is_one_narrow_projection(spark, tmp_path, fmt, parses):
    (tmp_path / "a.jsonl").write_text("{}\n")
    for on_error in ("fail", "skip"):
        plan = plan_of(import_conversations(scan_jsonl(spark, str(tmp_path)), fmt, on_error=on_error))
        assert "Exchange" not in plan and "Python" not in plan and "Sort" not in plan
        # one parse per attempt: typed attempts and the closer look
        assert len(re.findall("from_json", plan)) == parses


@needs_data
def test_hot_keys_are_not_collected(spark):
    plan = plan_of(import_turns(inputs.turn_lines(spark, SF_DIR), ["conv_id"]))
    assert "collect_list" not in plan and "Window" not in plan


@needs_data
@pytest.mark.parametrize("name", list(OWN))
def test_query_equals_sql(spark, name):
    got = spark_result(registered.queries()[name](spark, SF_DIR))
    assert got[1], "no rows"
    assert got == duck_result(duck_views(SF_DIR), registered.oracle_sql()[name])


@needs_data
def test_entry(spark):
    assert registered.entry(spark).columns == ["lineno", "turn", "role", "text"]
