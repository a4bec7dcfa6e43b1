"""Benchmark records, run metrics and task folders."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from turnmill.functions.chat import json_record
from turnmill.session import kept, prepare, ship_by_value

ship_by_value(__name__)

_PATH_SUMMARY = T.StructType(
    [
        T.StructField("mean_s", T.DoubleType()),
        T.StructField("stdev_s", T.DoubleType()),
        T.StructField("tokens_per_s", T.DoubleType()),
        T.StructField("times", T.ArrayType(T.DoubleType())),
    ]
)

# Field names of a step-time record and its two paths.
BENCH_RECORD = T.StructType(
    [
        T.StructField("native_1pass", _PATH_SUMMARY),
        T.StructField("custom_2pass", _PATH_SUMMARY),
        T.StructField(
            "summary",
            T.StructType(
                [
                    T.StructField("model", T.StringType()),
                    T.StructField("batch_seqs", T.LongType()),
                    T.StructField("total_tokens_per_step", T.LongType()),
                    T.StructField("step_time_reduction_pct", T.DoubleType()),
                    T.StructField("throughput_gain_pct", T.DoubleType()),
                ]
            ),
        ),
    ]
)

# Field names of an evaluation record.
EVAL_RECORD = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("model", T.StringType()),
        T.StructField("task", T.StringType()),
        T.StructField("hardware", T.StringType()),
        T.StructField("server", T.StringType()),
        T.StructField("train_command", T.StringType()),
        T.StructField(
            "eval",
            T.StructType(
                [
                    T.StructField("dataset", T.StringType()),
                    T.StructField("baseline_accuracy", T.DoubleType()),
                    T.StructField("step_25_accuracy", T.DoubleType()),
                ]
            ),
        ),
        T.StructField(
            "training_progress",
            T.StructType(
                [
                    T.StructField("steps_completed", T.LongType()),
                    T.StructField(
                        "train_batch_accuracy_range_at_end", T.ArrayType(T.DoubleType())
                    ),
                    T.StructField("note", T.StringType()),
                ]
            ),
        ),
        T.StructField(
            "cost",
            T.StructType(
                [
                    T.StructField("gpu_hours", T.DoubleType()),
                    T.StructField("rate_usd_per_hour", T.DoubleType()),
                    T.StructField("total_usd", T.DoubleType()),
                    T.StructField("note", T.StringType()),
                ]
            ),
        ),
    ]
)

# The files of a task folder and the columns they become.
TASK_FILES = {
    "instruction.md": "instruction",
    "tests/test.sh": "test_script",
    "environment/Dockerfile": "dockerfile",
    "task.toml": "task_toml",
}

METRICS_FILE = r"([^/]+)/metrics\.jsonl"


def scan_records(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """One row per pretty-printed record file, with its path."""
    return (
        spark.read.schema(schema).json(path, multiLine=True)
        .select(F.col("_metadata.file_path").alias("file"), "*")
    )


def scan_bench_record(spark: SparkSession, path) -> DataFrame:
    return scan_records(spark, path, BENCH_RECORD)


def scan_eval_record(spark: SparkSession, path) -> DataFrame:
    return scan_records(spark, path, EVAL_RECORD)


def run_id_of(file: Column, run_pattern: str = METRICS_FILE) -> Column:
    return F.regexp_extract(file, run_pattern, 1)


def json_row(line: str) -> Column:
    """The VARIANT of a metrics line; anything but one JSON document fails."""
    fault = f"CAST(raise_error(concat('not a metrics line: ', {line})) AS VARIANT)"
    return F.expr(f"coalesce({json_record(line)}, {fault})")


def scan_metrics_jsonl(
    spark: SparkSession, path, run_pattern: str = METRICS_FILE
) -> DataFrame:
    """Metric lines of any number of runs: run_id, file, row_id (input order
    within a file) and the VARIANT ``row``. No such file gives no rows; a line
    that is not JSON fails the job."""
    prepare(spark)
    try:
        files = spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "run_id string, file string, row_id bigint, row variant")
    file = F.col("_metadata.file_path")
    return files.select(
        run_id_of(file, run_pattern).alias("run_id"),
        file.alias("file"),
        F.monotonically_increasing_id().alias("row_id"),
        json_row("value").alias("row"),
    )


def scan_task_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of the files of all task folders below ``root``. Files of
    other names are not even opened."""
    names = ",".join(name.rsplit("/", 1)[-1] for name in TASK_FILES)
    wanted = F.lit(False)
    for name in TASK_FILES:
        wanted = wanted | F.col("path").endswith(f"/{name}")
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", f"{{{names}}}")
        .load(root)
        .where(wanted)
        .select("path", F.col("content").cast("string").alias("content"))
    )


def _outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted folders ("/" at their end) of a part to those that are in no other
    folder of the part, and the first and last of all."""
    first = root = last = None
    for batch in batches:
        own = []
        for folder in batch.column(0).to_pylist():
            first, last = first or folder, folder
            if root is None or not folder.startswith(root):
                root = folder
                own.append(folder)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.nulls(len(own), pa.string())], ["folder", "last"])
    if first is not None:
        yield pa.RecordBatch.from_arrays([pa.array([root], pa.string()), pa.array([last], pa.string())], ["folder", "last"])


def outer_folders(folders: DataFrame) -> DataFrame:
    """The folders (one column) that lie in no other of them.

    All that lies in a folder follows it in the order of paths, so each part of
    the sorted paths is scanned once for folders that do not begin with the one
    kept before. A part may begin within the last one kept in earlier parts: that
    is carried from part to part, with two paths of each.
    """
    (name,) = folders.columns
    paths = folders.select(F.concat(name, F.lit("/")).alias("folder")).distinct().orderBy("folder")
    part = F.spark_partition_id().alias("_part")
    scanned = kept(paths.mapInArrow(_outer, "folder string, last string").select("*", part), "folders")
    carried, root = [], None
    for row in sorted(scanned.where("last is not null").collect(), key=lambda r: r["_part"]):
        carried.append((row["_part"], root))
        if root is None or not row["last"].startswith(root):
            root = row["folder"]
    before = folders.sparkSession.createDataFrame(carried, "_part int, _root string")
    own = scanned.where("last is null").join(F.broadcast(before), "_part")  # a row per task
    own = own.where(F.coalesce(~F.col("folder").startswith(F.col("_root")), F.lit(True)))
    return own.select(F.expr("substring(folder, 1, char_length(folder) - 1)").alias(name))


def task_catalog(files: DataFrame) -> DataFrame:
    """One row per task folder with the text of its files, NULL for a missing
    one: dataset (the folder that the task's is in), task_name, file texts.

    A task is its folder: equal names in different datasets stay apart, and no
    text comes from another task. A folder below a task's folder is part of that
    task and none of its own; which these are is settled from the paths, before
    texts are read, so texts are shuffled once. Of a file that is listed twice,
    the greater text counts.
    """
    tails = "|".join(name.replace(".", r"\.") for name in TASK_FILES)
    pattern = rf"^(.+)/({tails})$"
    folder = F.regexp_extract("path", pattern, 1).alias("folder")
    tasks = outer_folders(files.select(folder).where("folder != ''"))
    named = files.select(folder, F.regexp_extract("path", pattern, 2).alias("name"), "content").where("name != ''")
    texts = [F.max(F.when(F.col("name") == name, F.col("content"))).alias(column) for name, column in TASK_FILES.items()]
    parts = F.split("folder", "/")
    found = named.join(tasks, "folder", "left_semi").groupBy("folder").agg(*texts)
    return found.select(F.element_at(parts, -2).alias("dataset"), F.element_at(parts, -1).alias("task_name"), *TASK_FILES.values())


def scan_task_catalog(spark: SparkSession, root: str) -> DataFrame:
    return task_catalog(scan_task_files(spark, root))
