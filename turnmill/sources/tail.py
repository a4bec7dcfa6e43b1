"""Files that writers keep appending to, as a stream of their lines.

The offset of the stream is, for every file, the number of bytes read; it is kept
in the checkpoint of the query that reads it. A trigger reads the bytes appended
since the last one and no others, whole lines only: what follows the last line
feed waits until its line is finished. Spark's own file streams take a file once,
when it is first seen.

Ranges are read on the executors, long ones in several tasks, through the file
systems of pyarrow: local and mounted folders, HDFS, S3, GCS and Azure by URI.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from turnmill.session import ship_by_value
from turnmill.sources.ranges import file_system_of, line_after, line_blocks

ship_by_value(__name__)

SCHEMA = "file string, start bigint, value binary"
_BLOCK = 1 << 16  # bytes that are read at once to find the end of the last line
RANGE_BYTES = 64 << 20


def matching_files(path: str) -> dict[str, int]:
    """The files of a glob pattern (``*`` and ``?`` stay within a folder's name)
    and their sizes, without hidden ones. Folders of the fixed part of the pattern
    are listed."""
    store, where = file_system_of(path)
    fixed = []
    for part in where.split("/")[:-1]:
        if re.search(r"[*?]", part):
            break
        fixed.append(part)
    wanted = re.compile("".join({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)) for c in where))
    below = fs.FileSelector("/".join(fixed) or "/", recursive=True, allow_not_found=True)
    found = store.get_file_info(below)
    found = [f for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]
    return {f.path: f.size for f in found if wanted.fullmatch(f.path)}


@dataclass
class Range(InputPartition):
    """Lines that begin in [start, end) of a file whose unread part begins at
    ``first``."""

    file: str
    first: int
    start: int
    end: int


class TailReader(DataSourceStreamReader):
    def __init__(self, path: str, range_bytes: int = RANGE_BYTES):
        self.path, self.range_bytes = path, range_bytes

    def opened(self, file: str) -> pa.NativeFile:
        return file_system_of(self.path)[0].open_input_file(file)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        ends = {file: self._last_line(file, size) for file, size in matching_files(self.path).items()}
        return {file: end for file, end in sorted(ends.items()) if end}

    def _last_line(self, file: str, size: int) -> int:
        """Where the last finished line ends, looked for from the end."""
        with self.opened(file) as source:
            while size:
                start = max(0, size - _BLOCK)
                at = source.read_at(size - start, start).rfind(b"\n")
                if at >= 0:
                    return start + at + 1
                size = start
        return 0

    def partitions(self, start: dict, end: dict) -> list[Range]:
        ranges = []
        for file, stop in end.items():
            first = start.get(file, 0)
            if stop < first:
                raise ValueError(f"{file} has {stop} bytes of lines, but {first} were read from it: it was replaced or cut")
            ranges += [Range(file, first, at, min(at + self.range_bytes, stop)) for at in range(first, stop, self.range_bytes)]
        return ranges

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        with self.opened(partition.file) as source:
            begin = partition.start
            if begin > partition.first:  # a line that begins before belongs to the range before
                begin = line_after(source, begin - 1)
            for at, block in line_blocks(source, begin, partition.end, unfinished=False):
                values = block[:-1].split(b"\n")
                starts = [at]
                for value in values[:-1]:
                    starts.append(starts[-1] + len(value) + 1)
                yield _lines(partition.file, starts, [v.removesuffix(b"\r") for v in values])


def _lines(file: str, starts: list[int], values: list[bytes]) -> pa.RecordBatch:
    columns = [pa.array([file] * len(values), pa.string()), pa.array(starts, pa.int64()), pa.array(values, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["file", "start", "value"])


class TailSource(DataSource):
    """``readStream.format("appended_lines")`` with the options ``path`` and
    ``rangeBytes``."""

    @classmethod
    def name(cls) -> str:
        return "appended_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], int(self.options.get("rangebytes") or self.options.get("rangeBytes") or RANGE_BYTES))


def scan_appended_lines(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A stream of (file, start, value): every finished line of the files that
    match ``path``, now or later, once; ``start`` is the byte where it begins, so
    (file, start) names a line. Bytes are taken as UTF-8 and not checked; a carriage
    return at the end is dropped.

    A file that has fewer bytes of lines than were read was replaced and stops
    the query. A file that is gone is not missed. The offset has one entry per
    file that is there.
    """
    spark.dataSource.register(TailSource)
    lines = spark.readStream.format("appended_lines").option("path", path).option("rangeBytes", str(range_bytes)).load()
    return lines.withColumn("value", F.col("value").cast("string"))
