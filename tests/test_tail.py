"""Streams of files that grow: what is read, and that it is read once."""

import json
import random

import pytest

from turnmill.sources import ranges, tail
from turnmill.sources.tail import Range, TailReader, matching_files, scan_appended_lines
from turnmill.streaming.metrics import append_curve
from turnmill.streaming.run import land


class Counted:
    """A file that notes the bytes taken from it."""

    def __init__(self, source, log):
        self.source, self.log = source, log

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.source.close()

    def seek(self, at):
        self.source.seek(at)

    def read(self, n):
        self.log.append((self.source.tell(), len(got := self.source.read(n))))
        return got

    def read_at(self, n, at):
        self.log.append((at, len(got := self.source.read_at(n, at))))
        return got


class CountedReader(TailReader):
    def __init__(self, *args):
        super().__init__(*args)
        self.log = []

    def opened(self, file):
        return Counted(super().opened(file), self.log)


def rows(reader, start, end):
    out = []
    for part in reader.partitions(start, end):
        for batch in reader.read(part):
            file, start, value = (c.to_pylist() for c in batch.columns)
            out += list(zip(file, start, [v.decode() for v in value]))
    return out


def test_only_appended_bytes_are_read(tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "_BLOCK", 64)
    monkeypatch.setattr(ranges, "_SEEK", 64)
    file = tmp_path / "a" / "m.jsonl"
    file.parent.mkdir()
    file.write_text("".join(f"line {k}\n" for k in range(5000)) + "unfini")
    reader = CountedReader(str(tmp_path / "*" / "m.jsonl"))
    first = reader.latestOffset()
    assert [r[2] for r in rows(reader, {}, first)] == [f"line {k}" for k in range(5000)]
    with file.open("a") as sink:
        sink.write("shed\r\nénd\nopen")
    reader.log.clear()
    then = reader.latestOffset()
    assert [r[1:] for r in rows(reader, first, then)] == [(first[str(file)], "unfinished"), (first[str(file)] + 12, "énd")]
    assert min(at for at, _ in reader.log) >= first[str(file)] - 64 and sum(n for _, n in reader.log) < 200
    assert rows(reader, then, reader.latestOffset()) == []


@pytest.mark.parametrize("seed", range(6))
def test_ranges_give_every_line_once(tmp_path, monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(tail, "_BLOCK", rng.choice([1, 7, 100]))
    monkeypatch.setattr(ranges, "_CHUNK", rng.choice([3, 50, 5000]))
    monkeypatch.setattr(ranges, "_SEEK", rng.choice([1, 20, 1000]))
    lines = ["x" * rng.choice([0, 0, 1, 5, 300]) + str(k) * rng.randint(0, 1) for k in range(200)]
    file = tmp_path / "m"
    file.write_text("".join(f"{x}\n" for x in lines))
    reader = TailReader(str(file), rng.choice([1, 10, 77, 10_000]))
    cut = sum(len(x) + 1 for x in lines[:80])
    for start, want in (({}, lines), ({str(file): cut}, lines[80:])):
        got = rows(reader, start, reader.latestOffset())
        assert [r[2] for r in got] == want and len({r[1] for r in got}) == len(want)


def test_files_of_a_pattern(tmp_path):
    for name in ("r1/metrics.jsonl", "r2/metrics.jsonl", "r2/deep/metrics.jsonl", "r3/other.jsonl", "r1/.hidden", "r1/_SUCCESS"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("{}\n")
    found = matching_files(f"file://{tmp_path}/r?/metrics.jsonl")
    assert found == {str(tmp_path / r / "metrics.jsonl"): 3 for r in ("r1", "r2")}
    assert matching_files(f"{tmp_path}/none/*.jsonl") == {}
    assert list(matching_files(f"{tmp_path}/r1/*")) == [str(tmp_path / "r1/metrics.jsonl")]


def test_a_replaced_file_is_an_error(tmp_path):
    file = tmp_path / "m"
    file.write_text("a\n")
    reader = TailReader(str(file))
    with pytest.raises(ValueError, match="replaced or cut"):
        reader.partitions({str(file): 10}, reader.latestOffset())
    assert reader.partitions({"gone": 5, str(file): 0}, reader.latestOffset()) == [Range(str(file), 0, 0, 2)]


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    folder, out = tmp_path / "logs", str(tmp_path / "out")
    folder.mkdir()
    want = []
    for turn in range(3):
        for name in ("a", "b", "c")[: turn + 1]:
            text = [f"{name}{turn}.{k}" for k in range(40)]
            want += text
            with (folder / name).open("a") as sink:
                sink.write("".join(f"{x}\n" for x in text))
        got = land(scan_appended_lines(spark, str(folder / "*"), range_bytes=50), out)
        assert sorted(r.value for r in got.collect()) == sorted(want)
    assert got.select("file", "start").distinct().count() == len(want)
    offsets = (tmp_path / "out" / "_checkpoint" / "offsets" / "2").read_text().splitlines()[-1]
    assert json.loads(offsets) == {str(folder / n): (folder / n).stat().st_size for n in "abc"}


def test_a_finished_line_that_is_no_json_fails(spark, tmp_path):
    file = tmp_path / "r" / "metrics.jsonl"
    file.parent.mkdir()
    file.write_text('{"step":1,"env/all/correct":1}\n\nnot json\n')
    with pytest.raises(Exception, match="not a metrics line"):
        append_curve(spark, str(tmp_path / "*" / "metrics.jsonl"), str(tmp_path / "out"))
