"""Messages JSONL out, and staging of datasets."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnmill.errors import EmptyResultError
from turnmill.functions.text import is_visible


def to_messages_jsonl(conversations: DataFrame) -> DataFrame:
    """One ``{"messages": [...]}`` text line per conversation, non-ASCII text
    as it is."""
    return conversations.select(F.to_json(F.struct("messages")).alias("value"))


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it knows it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


@contextmanager
def staged(spark: SparkSession, path: str, mode: str = "errorifexists") -> Iterator[str]:
    """A folder beside ``path`` to write to; it takes the place of ``path`` when
    the block ends well and goes when it does not, so ``path`` is as before or
    whole. Between the two renames of an overwrite, readers may find nothing."""
    if mode not in ("errorifexists", "overwrite"):
        raise ValueError(f"mode must be 'errorifexists' or 'overwrite', not {mode!r}")
    fs, out = file_system(spark, path.rstrip("/"))
    if mode == "errorifexists" and fs.exists(out):
        raise FileExistsError(f"{path} is there already")
    name = uuid.uuid4().hex
    beside = spark._jvm.org.apache.hadoop.fs.Path
    fresh, old = beside(f"{out.toString()}.new-{name}"), beside(f"{out.toString()}.old-{name}")
    try:
        yield fresh.toString()
        replaced = mode == "overwrite" and fs.exists(out)
        if replaced and not fs.rename(out, old):
            raise OSError(f"cannot replace {path}")
        if not fs.rename(fresh, out):
            if replaced:
                fs.rename(old, out)
            raise OSError(f"cannot move the result to {path}")
        if replaced:
            fs.delete(old, True)
    finally:
        if fs.exists(fresh):
            fs.delete(fresh, True)


def write_messages_jsonl(conversations: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write all conversations or, if a task fails for good, none; what was at
    ``path`` before stays until then."""
    with staged(conversations.sparkSession, path, mode) as fresh:
        to_messages_jsonl(conversations).write.text(fresh)


def stage_dataset(lines: DataFrame, path: str, value: str = "value") -> DataFrame:
    """Write dataset lines to ``path`` and return them as read from there; an
    error, and nothing at ``path``, when there is nothing but white space."""
    spark: SparkSession = lines.sparkSession
    with staged(spark, path) as fresh:
        lines.select(F.col(value).alias("value")).write.text(fresh)
        if spark.read.text(fresh).where(is_visible("value")).isEmpty():
            raise EmptyResultError("the dataset to stage is empty")
    return spark.read.text(path)
