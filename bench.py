"""Timings of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line. Import queries read JSONL files that are written
beforehand, untimed, as dumps are files; all results go to the noop sink. Every
query runs once untimed, then twice; the better time counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession, functions as F  # noqa: E402

from turnmill.operators import traces  # noqa: E402
from turnmill.plans.import_traces import import_files  # noqa: E402
from turnmill.session import fresh_dir  # noqa: E402
from turnmill.sources.lines import scan_jsonl  # noqa: E402
from turnmill.streaming.run import land  # noqa: E402
from turnmill.streaming.traces import import_stream, scan_jsonl_stream  # noqa: E402
from turnmill.workload import inputs  # noqa: E402
from turnmill.workload.queries import QUERIES  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

TABLE_QUERIES = (
    "import_turns", "flatten_content", "assemble_datum", "rollout_batch_stats",
    "sequence_log_ratio", "token_log_ratio", "reweight_advantages", "second_pass",
    "clip_fraction", "holdout_split", "batch_plan", "training_schedule", "rollout_plan",
    "truncate_tokens", "task_catalog", "limit_tasks", "truncate_output", "command_outcome",
    "verdict_reward", "step_timing_summary", "step_times", "path_comparison",
)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def best(job, times: int = 2) -> float:
    job()
    taken = []
    for _ in range(times):
        start = time.perf_counter()
        job()
        taken.append(time.perf_counter() - start)
    return round(min(taken), 3)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("turnmill-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    makers = {
        "messages": inputs.messages_lines,
        "openai": inputs.openai_lines,
        "anthropic": inputs.anthropic_lines,
        "faulty": inputs.faulty_lines,
    }
    dumps, sizes = {}, {}
    for name, lines in makers.items():
        dumps[name] = fresh_dir(spark, f"bench-{name}")
        lines(spark, SF_DIR).select("value").write.text(dumps[name])
        size = F.sum(F.octet_length("value") + 1)
        row = spark.read.text(dumps[name]).agg(size.alias("b"), F.count("*").alias("n")).first()
        sizes[name] = {"mb": row.b / 1e6, "lines": row.n}

    def imported(fmt):
        return lambda: run(traces.import_conversations(scan_jsonl(spark, dumps[fmt]), fmt))

    jobs = {f"import_{fmt}": imported(fmt) for fmt in ("messages", "openai", "anthropic")}
    jobs["import_file_to_file"] = lambda: import_files(
        spark, dumps["openai"], fresh_dir(spark, "bench-out"), "openai"
    )
    jobs["import_limit_100"] = lambda: import_files(
        spark, dumps["openai"], fresh_dir(spark, "bench-out"), "openai", limit=100
    )
    jobs["import_errors"] = lambda: run(traces.import_errors(scan_jsonl(spark, dumps["faulty"])))
    jobs["line_numbers"] = lambda: run(scan_jsonl(spark, dumps["messages"], line_numbers=True))
    jobs["import_stream"] = lambda: land(
        import_stream(scan_jsonl_stream(spark, dumps["openai"]), "openai"),
        fresh_dir(spark, "bench-landed"),
    )
    for name in TABLE_QUERIES:
        jobs[name] = lambda query=QUERIES[name]: run(query(spark, SF_DIR))
    took = {name: best(job) for name, job in jobs.items()}
    rates = {
        fmt: {
            "mb_per_s": round(sizes[fmt]["mb"] / took[f"import_{fmt}"], 1),
            "conversations_per_s": round(sizes[fmt]["lines"] / took[f"import_{fmt}"]),
        }
        for fmt in ("messages", "openai", "anthropic")
    }
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(took.values()), 3),
        "unit": "sec",
        "queries": took,
        "import_rates": rates,
        "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
