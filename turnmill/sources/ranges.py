"""Byte ranges of line files, for scans that read a part of them.

A range holds the lines that begin in it. Ranges are read on executors through the
file systems of pyarrow: local and mounted folders, HDFS, S3, GCS and Azure.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from turnmill.session import ship_by_value

ship_by_value(__name__)

_CHUNK = 4 << 20
_SEEK = 1 << 16
_FILES = 4096  # that the driver knows of at once
# Endings of files that Spark unpacks; they have no ranges.
PACKED = (".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate")


def file_system_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/+", "/", path)
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def line_after(source, at: int) -> int:
    """Where the first line begins whose line before ends at ``at`` or later."""
    while block := source.read_at(_SEEK, at):
        found = block.find(b"\n")
        if found >= 0:
            return at + found + 1
        at += len(block)
    return at


def line_blocks(source, begin: int, end: int, unfinished: bool) -> Iterator[tuple[int, bytes]]:
    """Runs of whole lines, and where each run begins: the lines that begin in
    [begin, end), the first of them at ``begin``. A last line without a line feed
    is one only if ``unfinished``."""
    source.seek(begin)
    rest = b""
    while begin < end:
        got = source.read(max(_SEEK, min(_CHUNK, end - begin - len(rest))))
        held = rest + got
        if not got:
            if unfinished and held:
                yield begin, held
            return
        if begin + len(held) >= end:  # up to the end of the line that holds the last byte
            cut = held.find(b"\n", end - 1 - begin) + 1
            if cut:
                yield begin, held[:cut]
                return
        cut = held.rfind(b"\n") + 1
        if cut:
            yield begin, held[:cut]
        begin, rest = begin + cut, held[cut:]


@dataclass(frozen=True)
class Span:
    """Bytes [start, end) of a file; ``file`` as scans spell it."""

    file: str
    path: str
    start: int
    end: int

    def lines(self) -> Iterator[list[bytes]]:
        """The lines that begin in the span, split as the text reader does: at
        line feeds, carriage returns or both. A byte order mark is dropped."""
        store, where = file_system_of(self.path)
        with store.open_input_file(where) as source:
            begin = line_after(source, self.start - 1) if self.start else 0
            for at, block in line_blocks(source, begin, self.end, unfinished=True):
                if at == 0 and block.startswith(b"\xef\xbb\xbf"):
                    block = block[3:]
                block = block.replace(b"\r\n", b"\n").replace(b"\r", b"\n")
                yield (block[:-1] if block.endswith(b"\n") else block).split(b"\n")


def files_in_order(spark: SparkSession, path) -> Iterator[tuple[str, str, int]]:
    """(file, path, bytes) of the input files by path, some thousands at a time."""
    files = spark.read.format("binaryFile").load(path)
    files = files.select(F.col("_metadata.file_path").alias("file"), "path", "length")
    rows = None
    while rows is None or len(rows) == _FILES:
        more = files if rows is None else files.where(F.col("file") > rows[-1].file)
        rows = more.orderBy("file").limit(_FILES).collect()
        yield from ((r.file, r.path, r.length) for r in rows)


def waves(files: Iterator[tuple[str, str, int]], spans: int, span_bytes: int = 1 << 20) -> Iterator[list[Span]]:
    """Consecutive spans of the files, in order: some at first, four times as many
    bytes in each following wave."""
    wave: list[Span] = []
    for file, path, length in files:
        at = 0
        while at < length:
            wave.append(Span(file, path, at, min(at + span_bytes, length)))
            at += span_bytes
            if len(wave) == spans:
                yield wave
                wave = []
                if span_bytes < 64 << 20:
                    span_bytes *= 4
                else:
                    spans *= 4
    if wave:
        yield wave


def scan_spans(spark: SparkSession, spans: list[Span], first: int = 0) -> DataFrame:
    """(span, row, value): lines with the number of their span, counted from
    ``first``, and their place in it, one task per span."""
    lines = spark.range(0, len(spans), 1, len(spans)).mapInArrow(_read(spans, first), "span bigint, row bigint, value binary")
    return lines.withColumn("value", F.col("value").cast("string"))


def _read(spans: list[Span], first: int) -> Callable:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                row = 0
                for lines in spans[k].lines():
                    place = [pa.array([first + k] * len(lines), pa.int64()), pa.array(range(row, row + len(lines)), pa.int64())]
                    yield pa.RecordBatch.from_arrays([*place, pa.array(lines, pa.binary())], ["span", "row", "value"])
                    row += len(lines)

    return read


def count_lines(spark: SparkSession, spans: list[Span]) -> list[int]:
    """Lines of each span."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                n = sum(len(lines) for lines in spans[k].lines())
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([n], pa.int64())], ["span", "n"])

    rows = spark.range(0, len(spans), 1, len(spans)).mapInArrow(counted, "span bigint, n bigint").collect()
    found = {r.span: r.n for r in rows}
    return [found[k] for k in range(len(spans))]
