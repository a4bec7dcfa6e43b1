"""Run a stream over what is there now."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnmill.sources.sinks import file_system


def checkpoint_of(spark: SparkSession, out: str, checkpoint: str | None) -> str:
    """The checkpoint of the stream that writes to ``out``: by default a hidden
    folder in it. One that knows nothing is refused where ``out`` holds output,
    for its batches would replace or repeat what is there."""
    where = checkpoint or f"{out.rstrip('/')}/_checkpoint"
    fs, commits = file_system(spark, f"{where}/commits")
    _, folder = file_system(spark, out)
    known = fs.exists(commits) and len(fs.listStatus(commits)) > 0
    held = fs.exists(folder) and any(not s.getPath().getName().startswith(("_", ".")) for s in fs.listStatus(folder))
    if held and not known:
        raise ValueError(f"{out} holds output, but the checkpoint {where} knows of none")
    return where


def land(stream: DataFrame, path: str, checkpoint: str | None = None) -> DataFrame:
    """Append what is available to Parquet files at ``path`` and return them.
    Without ``checkpoint`` it is kept in ``path``, so a later call goes on."""
    spark = stream.sparkSession
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint_of(spark, path, checkpoint))
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(path)
