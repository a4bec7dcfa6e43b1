"""Session settings and the shared working folder."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

_LOCAL_DIRS: dict[str, str] = {}


def ship_by_value(module: str) -> None:
    """Send the functions of ``module`` to executors whole, so that a cluster needs
    no copy of this package on its workers."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def prepare(spark: SparkSession) -> SparkSession:
    """Let the last of several equal keys in a JSON object win, instead of
    failing the record. Needed by everything that parses dump lines; the setting
    stays with the session."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir`` where it is set.

    A temporary folder stands in for it on a local master only; on a cluster a
    missing setting is an error, as executors could not read each other's files.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if sc.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[sc.applicationId] = tempfile.mkdtemp(prefix="turnmill-")
    return _LOCAL_DIRS[sc.applicationId]


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/turnmill/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the reliable checkpoint folder; its lineage is cut, so
    a lost executor costs a read and not a recomputation."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


@contextmanager
def written(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``df`` as a table in the shared folder, written in one job; it is deleted
    when the block ends."""
    spark, path = df.sparkSession, fresh_dir(df.sparkSession, name)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, written in one job. The result reads
    it, so its input is evaluated once; it is deleted when the application ends."""
    spark, path = df.sparkSession, fresh_dir(df.sparkSession, name)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    df.write.parquet(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_bytes: int) -> DataFrame:
    """``df`` written out and measured, with a broadcast hint if its rows take at
    most ``max_bytes`` as text and overhead; otherwise the join it goes into
    shuffles. The results are the same."""
    written = checkpointed(df)
    row = F.octet_length(F.to_csv(F.struct("*"))) + F.lit(64)
    size = written.agg(F.coalesce(F.sum(row), F.lit(0))).first()[0]
    return F.broadcast(written) if size <= max_bytes else written
