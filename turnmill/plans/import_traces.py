"""Import chat dumps from files to messages JSONL."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from turnmill.operators.ranks import nth_place
from turnmill.operators.traces import (
    fail_loud,
    import_errors,
    parse_lines,
    parser_for,
    require_conversations,
)
from turnmill.session import fresh_dir, prepare
from turnmill.sources.lines import number_lines, scan_jsonl
from turnmill.sources.ranges import PACKED, Span, count_lines, file_system_of, files_in_order, scan_spans, waves
from turnmill.sources.sinks import file_system, staged, to_messages_jsonl

PLACE = ("file", "lineno")


@dataclass(frozen=True)
class ImportResult:
    path: str
    format: str
    conversations: int
    skipped: int = 0


def import_files(
    spark: SparkSession,
    path,
    out: str,
    fmt: str = "messages",
    min_messages: int = 2,
    limit: int | None = None,
    on_error: str = "fail",
    mode: str = "errorifexists",
    quarantine: str | None = None,
) -> ImportResult:
    """Write the usable conversations of dump files to ``out``.

    The dump is read once: conversations are written while the lines are checked,
    and line numbers are not computed. Each task notes its earliest faulty line on
    the way; if there is one, nothing is committed, and the lines of its file, and
    no others, are numbered to raise it. With ``limit``, files are read in order, in growing waves, until
    there are as many conversations; faults after the last kept line do not count.
    ``out`` is as it was before if anything fails, an empty result included.

    ``on_error='skip'`` leaves faulty lines out and counts them; ``quarantine``
    is a folder that they go to as JSON, with file, number and error, before the
    conversations take their place; for their numbers the input is read again.
    """
    parser_for(fmt)
    prepare(spark)
    if on_error not in ("fail", "skip"):
        raise ValueError(f"on_error must be 'fail' or 'skip', not {on_error!r}")
    if quarantine and on_error != "skip":
        raise ValueError("a quarantine needs on_error='skip'")
    if limit is not None:
        return _import_leading(spark, path, out, fmt, min_messages, limit, on_error, mode, quarantine)
    lines = scan_jsonl(spark, path)
    seen = Observation("import")
    parsed = parse_lines(lines, fmt, min_messages).observe(seen, *_findings())
    with staged(spark, out, mode) as fresh:
        to_messages_jsonl(parsed.where("error_class IS NULL")).write.text(fresh)
        found = seen.get
        if on_error == "fail" and found["faulty"]:
            raise_first_error(spark, path, fmt, found["first"]["file"])
        written = require_conversations(found["conversations"], min_messages)
        if quarantine:
            _put_aside(lines, fmt, mode, quarantine)
    return ImportResult(out, fmt, written, found["faulty"] if on_error == "skip" else 0)


def _findings() -> list[Column]:
    """What the writing pass learns on the way: conversations, faulty lines, and
    the place of the earliest of these."""
    faulty = F.col("error_class").isNotNull()
    first = F.min(F.when(faulty, F.struct("file", "split_start", "row_id"))).alias("first")
    return [F.count_if(~faulty).alias("conversations"), F.count_if(faulty).alias("faulty"), first]


def _put_aside(lines: DataFrame, fmt: str, mode: str, quarantine: str) -> None:
    """Write the faulty lines, with their numbers, to ``quarantine``."""
    with staged(lines.sparkSession, quarantine, mode) as fresh:
        import_errors(number_lines(lines), fmt).write.json(fresh)


def raise_first_error(spark: SparkSession, path, fmt: str, file: str) -> None:
    """Raise on the earliest faulty line of one of the files; only that file's
    lines are read and numbered."""
    fail_loud(import_errors(number_lines(scan_jsonl(spark, path, file=file)), fmt), PLACE)


@dataclass
class _Leading:
    """What a limited import has staged: rows (*order, line, error_class, detail);
    how many conversations are kept; where the last one wanted lies, its span or
    its whole place (None: all are wanted), and how many of that span are wanted;
    the spans that were read (none: files were read as a whole); how many lines up
    to the end of that span are faulty."""

    rows: DataFrame
    order: tuple[str, ...]
    kept: int
    end: tuple | None
    room: int
    spans: list[Span]
    faulty: int

    def conversations(self) -> DataFrame:
        good = self.rows.where("error_class IS NULL")
        if self.end is None:
            return good
        if len(self.end) == len(self.order):
            return good.where(F.struct(*self.order) <= self._place())
        # A span is a few MB, so its first rows are one small sort.
        last = good.where(F.col("span") == self.end[0]).orderBy("row").limit(self.room)
        return good.where(F.col("span") < self.end[0]).unionByName(last)

    def faults(self) -> DataFrame:
        bad = self.rows.where("error_class IS NOT NULL")
        if self.end is None or not self.faulty:
            return bad.limit(0) if not self.faulty else bad
        if len(self.end) < len(self.order):
            last = self.conversations().where(F.col("span") == self.end[0]).agg(F.max("row")).first()[0]
            self.end = (*self.end, last)
        return bad.where(F.struct(*self.order) < self._place())

    def _place(self) -> Column:
        return F.struct(*[F.lit(v).alias(c) for c, v in zip(self.order, self.end, strict=True)])

    def first_faulty_file(self) -> str:
        first = self.faults().agg(F.min(F.struct(*self.order)).alias("place")).first()["place"]
        return self.spans[first["span"]].file if self.spans else first["file"]

    def named_faults(self) -> DataFrame:
        """Faults with file and line number. Lines are counted in the spans of the
        files that have one."""
        if not self.spans:
            return self.faults().drop("line")
        spark = self.rows.sparkSession
        spans = {r.span for r in self.faults().select("span").distinct().collect()}
        files = {self.spans[k].file for k in spans}
        read = [k for k in range(max(spans, default=-1) + 1) if self.spans[k].file in files]
        if not read:
            return spark.createDataFrame([], "file string, lineno bigint, error_class string, detail string")
        before: dict[str, int] = {}
        names = []
        for k, n in zip(read, count_lines(spark, [self.spans[k] for k in read]), strict=True):
            file = self.spans[k].file
            names.append((k, file, before.get(file, 0)))
            before[file] = before.get(file, 0) + n
        placed = spark.createDataFrame(names, "span bigint, file string, before bigint")
        lineno = (F.col("before") + F.col("row") + 1).alias("lineno")
        return self.faults().join(placed, "span").select("file", lineno, "error_class", "detail")


def _stage(lines: DataFrame, folder: str, fmt: str, min_messages: int, order: tuple[str, ...]) -> DataFrame:
    """Usable conversations, as output lines, and faults, written down."""
    parsed = parse_lines(lines, fmt, min_messages)
    line = F.when(F.col("error_class").isNull(), F.to_json(F.struct("messages"))).alias("line")
    rows = parsed.select(*order, line, "error_class", "detail")
    rows.write.mode("append").parquet(folder)
    return lines.sparkSession.read.schema(rows.schema).parquet(folder)


def _counts() -> tuple[Column, Column]:
    return F.count_if(F.col("error_class").isNull()), F.count_if(F.col("error_class").isNotNull())


def _leading(spark: SparkSession, path, folder: str, fmt: str, min_messages: int, wanted: int) -> _Leading:
    """Read the files in order until enough conversations are found.

    Spans are read in waves, in parallel within a wave; what is read is parsed once
    and staged, conversations are counted by span, and the wave that holds the last
    one wanted is the last. Packed files, and stores that only Spark reads, have no
    spans and are read as a whole.
    """
    spans, found, faulty, rows = [], 0, 0, None
    try:
        order = ("span", "row")
        for wave in waves(_readable(files_in_order(spark, path)), spark.sparkContext.defaultParallelism):
            rows = _stage(scan_spans(spark, wave, len(spans)), f"{folder}/spans", fmt, min_messages, order)
            new = rows.where(F.col("span") >= len(spans)).groupBy("span").agg(*_counts())
            spans += wave
            for span, good, bad in sorted(new.collect()):
                faulty += bad
                if found + good >= wanted:
                    return _Leading(rows, order, wanted, (span,), wanted - found, spans, faulty)
                found += good
        if spans:
            return _Leading(rows, order, found, None, 0, spans, faulty)
    except _NoSpans:
        pass
    rows = _stage(scan_jsonl(spark, path, line_numbers=True), f"{folder}/whole", fmt, min_messages, PLACE)
    place = nth_place(rows.where("error_class IS NULL"), wanted, PLACE)
    good, bad = rows.agg(*_counts()).first()
    end = None if place is None else (place["file"], place["lineno"])
    return _Leading(rows, PLACE, min(good, wanted), end, 0, [], bad)


class _NoSpans(Exception):
    """A file that cannot be read by spans."""


def _readable(files: Iterator[tuple[str, str, int]]) -> Iterator[tuple[str, str, int]]:
    for file, path, length in files:
        try:
            file_system_of(path)
        except (ValueError, OSError, NotImplementedError) as error:
            raise _NoSpans from error
        if path.endswith(PACKED):
            raise _NoSpans
        yield file, path, length


def _import_leading(
    spark: SparkSession, path, out: str, fmt: str, min_messages: int, limit: int, on_error: str, mode: str, quarantine: str | None
) -> ImportResult:
    folder = fresh_dir(spark, "leading")
    fs, work = file_system(spark, folder)
    try:
        with staged(spark, out, mode) as fresh:
            leading = _leading(spark, path, folder, fmt, min_messages, max(limit, 1))
            skipped = 0
            if on_error == "fail" and leading.faulty and not leading.faults().isEmpty():
                raise_first_error(spark, path, fmt, leading.first_faulty_file())
            if on_error == "skip":
                skipped = leading.faults().count()
            leading.conversations().select("line").write.text(fresh)
            require_conversations(leading.kept, min_messages)
            if quarantine:
                with staged(spark, quarantine, mode) as aside:
                    leading.named_faults().write.json(aside)
    finally:
        fs.delete(work, True)
    return ImportResult(out, fmt, leading.kept, skipped)
