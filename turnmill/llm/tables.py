"""Intermediate tables in the folder that all executors share, and what tasks get."""

from __future__ import annotations

import pickle

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from turnmill.session import fresh_dir


class Shipped:
    """A broadcast value that brings the classes of this package with it, so that
    executors need no copy of it. A plain broadcast names its classes only."""

    def __init__(self, spark: SparkSession, value: object):
        self._bytes = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def __getstate__(self) -> dict:
        return {"_bytes": self._bytes}

    @property
    def value(self):
        if not hasattr(self, "_value"):
            self._value = pickle.loads(self._bytes.value)
        return self._value


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet and read back: its lineage is cut and no
    stage of it runs twice. The folder goes when the application ends."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def repeats_an_id(docs: DataFrame) -> bool:
    """Whether some doc_id, null aside, has several rows."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).dropna()
    return not ids.groupBy("doc_id").count().where("count > 1").isEmpty()


def with_own_ids(docs: DataFrame) -> DataFrame:
    """The rows with a doc_id as (doc_id, text, row): numbered in the order of
    doc_id and then of the SHA-256 of text, so that each row is a document of its
    own, and the row as it was. Rows are sorted once and written down; only the
    sizes of the sorted parts meet in one place."""
    spark = docs.sparkSession
    sha = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)
    row = F.struct(*docs.columns).alias("row")
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), sha.alias("_sha"), row).where("_id is not null")
    place = F.monotonically_increasing_id()
    placed = rows.orderBy("_id", "_sha").select("row", F.shiftright(place, 33).alias("_part"), place.bitwiseAND((1 << 33) - 1).alias("_place"))
    placed = stored(placed, "in-order")
    sizes = sorted(placed.groupBy("_part").count().collect())
    before, first = [], 0
    for part, n in sizes:
        before.append((part, first))
        first += n
    offsets = F.broadcast(spark.createDataFrame(before, "_part long, _before long"))  # a row per task
    number = (F.col("_before") + F.col("_place")).alias("doc_id")
    return placed.join(offsets, "_part").select(number, F.col("row.text").alias("text"), "row")
