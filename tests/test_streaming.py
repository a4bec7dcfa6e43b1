"""Streams give what the batch gives on the same files."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from turnmill.operators.metrics import metric_curve
from turnmill.operators.traces import import_conversations
from turnmill.sources.lines import scan_jsonl
from turnmill.sources.records import scan_metrics_jsonl
from turnmill.streaming.metrics import append_curve, metric_curve_stream
from turnmill.streaming.run import land
from turnmill.streaming.traces import import_stream, scan_jsonl_stream, start_import

GOOD = '{"messages":[{"role":"human","content":"hi %d"},{"role":"ai","content":"yo"}]}'


@pytest.fixture
def folder(tmp_path):
    path = tmp_path / "in"
    path.mkdir()
    for f in range(4):
        (path / f"{f}.jsonl").write_text("\n".join(GOOD % (10 * f + i) for i in range(5)) + "\n\n")
    return path


def texts(df):
    return sorted(r.value for r in df.collect())


def test_stream_equals_batch(spark, folder, tmp_path):
    lines = scan_jsonl_stream(spark, str(folder), max_files=1)
    streamed = land(import_stream(lines), str(tmp_path / "out"), str(tmp_path / "cp"))
    batch = import_conversations(scan_jsonl(spark, str(folder)))
    as_text = F.to_json("messages").alias("value")
    assert texts(streamed.select(as_text)) == texts(batch.select(as_text))
    (folder / "9.jsonl").write_text(GOOD % 99)
    more = land(import_stream(scan_jsonl_stream(spark, str(folder))), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert more.count() == 21


def test_stream_into_messages_jsonl(spark, folder, tmp_path):
    query = start_import(scan_jsonl_stream(spark, str(folder)), str(tmp_path / "out"),
                         checkpoint=str(tmp_path / "cp"))
    query.awaitTermination()
    out = spark.read.text(str(tmp_path / "out"))
    assert out.count() == 20
    assert import_conversations(out).count() == 20


def test_faulty_line_stops_or_is_put_aside(spark, folder, tmp_path):
    (folder / "x.jsonl").write_text("{not json\n[]\n")
    query = start_import(scan_jsonl_stream(spark, str(folder)), str(tmp_path / "out"))
    with pytest.raises(StreamingQueryException):
        query.awaitTermination()
    query = start_import(scan_jsonl_stream(spark, str(folder), max_files=2), str(tmp_path / "out2"),
                         quarantine=str(tmp_path / "bad"), checkpoint=str(tmp_path / "cp2"))
    query.awaitTermination()
    assert spark.read.text(str(tmp_path / "out2")).count() == 20
    bad = spark.read.json(str(tmp_path / "bad"))
    assert sorted(r.error_class for r in bad.collect()) == ["invalid_json", "not_object"]


def test_metric_stream_equals_batch(spark, tmp_path):
    for run in ("r1", "r2"):
        (tmp_path / "runs" / run).mkdir(parents=True)
        (tmp_path / "runs" / run / "metrics.jsonl").write_text(
            '{"step":1,"env/all/correct":0.25}\n{"step":2}\n{"step":3,"env/all/correct":1}\n')
    path = str(tmp_path / "runs" / "*" / "metrics.jsonl")
    streamed = land(metric_curve_stream(spark, path), str(tmp_path / "out"), str(tmp_path / "cp"))
    batch = metric_curve(scan_metrics_jsonl(spark, path)).select("run_id", "step", "value")
    want = [("r1", 1, 25.0), ("r1", 3, 100.0), ("r2", 1, 25.0), ("r2", 3, 100.0)]
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect())) == want


def test_import_goes_on_after_a_restart(spark, folder, tmp_path):
    for quarantine in (None, str(tmp_path / "bad")):
        out = str(tmp_path / f"out-{quarantine is None}")
        start_import(scan_jsonl_stream(spark, str(folder)), out, quarantine=quarantine).awaitTermination()
        name = f"late-{quarantine is None}.jsonl"
        (folder / name).write_text(GOOD % 77)
        start_import(scan_jsonl_stream(spark, str(folder)), out, quarantine=quarantine).awaitTermination()
        before = len(list(folder.glob("late-*")))
        assert spark.read.text(out).count() == 20 + before
        other = tmp_path / f"other-{quarantine is None}"
        other.mkdir()
        (other / "0.jsonl").write_text(GOOD % 78)
        again = start_import(scan_jsonl_stream(spark, str(other)), out, quarantine=quarantine, source="other")
        again.awaitTermination()
        assert spark.read.text(out).count() == 21 + before
        with pytest.raises(ValueError, match="knows of none"):
            start_import(scan_jsonl_stream(spark, str(folder)), out, checkpoint=str(tmp_path / "fresh"))


def test_curve_of_a_growing_file(spark, tmp_path):
    file = tmp_path / "runs" / "r1" / "metrics.jsonl"
    file.parent.mkdir(parents=True)
    path, out = str(tmp_path / "runs" / "*" / "metrics.jsonl"), str(tmp_path / "curve")
    file.write_text('{"step":1,"env/all/correct":0.5}\n{"step":2,"env/al')
    assert [(r.step, r.value) for r in append_curve(spark, path, out).collect()] == [(1, 50.0)]
    file.write_text('{"step":1,"env/all/correct":0.5}\n{"step":2,"env/all/correct":0.75}\n')
    for _ in range(2):
        assert sorted((r.step, r.value) for r in append_curve(spark, path, out).collect()) == [(1, 50.0), (2, 75.0)]


def test_equal_faulty_lines_keep_their_places(spark, tmp_path):
    folder, out, bad = tmp_path / "dump", str(tmp_path / "out"), str(tmp_path / "bad")
    folder.mkdir()
    (folder / "a.jsonl").write_bytes((GOOD % 1).encode() + b"\n[]\n\n[]\n\xff\n")
    for n_bad in (3, 4):
        start_import(scan_jsonl_stream(spark, str(folder), places=True), out, quarantine=bad).awaitTermination()
        found = spark.read.schema("file string, start bigint, error_class string").json(bad).collect()
        assert len({(r.file, r.start) for r in found}) == len(found) == n_bad
        assert spark.read.text(out).count() == 1
        with (folder / "a.jsonl").open("a") as sink:
            sink.write("[]\n" + GOOD % 2)
    first = len((GOOD % 1).encode()) + 1
    assert sorted((r.start, r.error_class) for r in found)[:3] == [(first, "not_object"), (first + 4, "not_object"), (first + 7, "invalid_utf8")]
