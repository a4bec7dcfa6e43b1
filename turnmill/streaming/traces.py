"""Import of a folder that dump files keep arriving in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from turnmill.operators.traces import import_conversations, parse_lines
from turnmill.session import prepare
from turnmill.sources.sinks import to_messages_jsonl
from turnmill.sources.tail import scan_appended_lines
from turnmill.streaming.run import checkpoint_of


def scan_jsonl_stream(spark: SparkSession, folder: str, max_files: int | None = None, places: bool = False) -> DataFrame:
    """(file, value) of new files. With ``places`` also ``start``, the byte at which
    a line begins: equal lines of a file stay apart, and lines that are added to a
    file later are read then (see ``scan_appended_lines``; its files are those
    straight in ``folder``)."""
    if places:
        return scan_appended_lines(prepare(spark), f"{folder.rstrip('/')}/*")
    reader = prepare(spark).readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(folder).select(F.col("_metadata.file_path").alias("file"), "value")


def import_stream(
    lines: DataFrame, fmt: str = "messages", min_messages: int = 2, on_error: str = "fail"
) -> DataFrame:
    """The batch import on a stream: the same projection, no state."""
    return import_conversations(lines, fmt, min_messages, on_error)


def start_import(
    lines: DataFrame,
    out: str,
    fmt: str = "messages",
    min_messages: int = 2,
    quarantine: str | None = None,
    checkpoint: str | None = None,
    available_now: bool = True,
    source: str = "main",
) -> StreamingQuery:
    """Write messages JSONL for training to pick up, below ``out`` in a folder
    for ``source`` and one for each micro-batch, so that a repeated batch
    replaces its own output and nothing else.

    Without ``quarantine`` a faulty line stops the query. With it, faulty lines
    go there as JSON with their error. Without ``checkpoint`` it is kept in
    ``out``: a later start with the same ``source`` goes on after the last batch.
    Another folder of dumps is another source and needs a name of its own.
    """
    spark = lines.sparkSession
    folder = f"{out.rstrip('/')}/source={source}"
    where = checkpoint_of(spark, folder, checkpoint or f"{out.rstrip('/')}/_checkpoint/{source}")
    if quarantine is None:
        parsed = import_conversations(lines, fmt, min_messages)
    else:
        parsed = parse_lines(lines, fmt, min_messages)

    def write(batch: DataFrame, number: int) -> None:
        if quarantine is None:
            to_messages_jsonl(batch).write.mode("overwrite").text(f"{folder}/batch={number}")
            return
        batch.persist()
        try:
            good = batch.where(F.col("error_class").isNull())
            to_messages_jsonl(good).write.mode("overwrite").text(f"{folder}/batch={number}")
            bad = batch.where(F.col("error_class").isNotNull())
            bad.drop("messages").write.mode("overwrite").json(f"{quarantine}/source={source}/batch={number}")
        finally:
            batch.unpersist()

    writer = parsed.writeStream.foreachBatch(write).option("checkpointLocation", where).outputMode("append")
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
