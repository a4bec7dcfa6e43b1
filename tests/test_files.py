"""File scans, sinks and the import job on real files."""

import json

import pytest
from pyspark.errors import PySparkException

from turnmill.errors import EmptyResultError, ImportFormatError
from turnmill.operators.traces import import_conversations, import_errors
from turnmill.plans.import_traces import import_files
from turnmill.sources import ranges
from turnmill.sources.ranges import Span, files_in_order, scan_spans, waves
from turnmill.sources.lines import number_lines, scan_jsonl
from turnmill.sources.records import (
    scan_bench_record,
    scan_eval_record,
    scan_metrics_jsonl,
    scan_task_catalog,
)
from turnmill.sources.sinks import stage_dataset, write_messages_jsonl

GOOD = '{"messages":[{"role":"human","content":"hi é"},{"role":"ai","content":"yo"}]}'
SHORT = '{"messages":[{"role":"human","content":"hi"}]}'


def lines_in(text):
    """Lines as a text-mode file gives them."""
    whole = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    return whole[:-1] if whole and whole[-1] == "" else whole


@pytest.mark.parametrize("split_bytes", [64, 1000, 128 * 1024 * 1024])
def test_exact_line_numbers(spark, tmp_path, split_bytes):
    texts = {
        "a.jsonl": "".join(f"line {i} {'x' * (i % 90)}\n" + "\n" * (i % 3) for i in range(150)),
        "b c.jsonl": "\n\nfirst\r\nsecond\rthird",
        "d.jsonl": "only",
        "e.jsonl": "\n".join("y" * (i % 7) for i in range(400)) + "\n",
    }
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    spark.conf.set("spark.sql.files.openCostInBytes", "16")
    try:
        rows = scan_jsonl(spark, str(tmp_path), line_numbers=True).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    got = {}
    for r in rows:
        got.setdefault(r.file.rsplit("/", 1)[1].replace("%20", " "), {})[r.lineno] = r.value
    for name, text in texts.items():
        want = lines_in(text)
        assert [got[name][n] for n in range(1, len(want) + 1)] == want
        assert len(got[name]) == len(want)


def test_changed_split_plan_raises(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("x\n" * 500)
    placed = scan_jsonl(spark, str(tmp_path))
    numbered = number_lines(placed)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        with pytest.raises(PySparkException, match="split plan changed"):
            numbered.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_import_file_to_file(spark, tmp_path):
    src, out = tmp_path / "dump.jsonl", tmp_path / "out"
    src.write_text(f"{GOOD}\n\n{SHORT}\n{GOOD}\n")
    result = import_files(spark, str(src), str(out))
    assert result.conversations == 2
    lines = [r.value for r in spark.read.text(str(out)).collect()]
    assert [json.loads(x) for x in lines] == [
        {"messages": [{"role": "user", "content": "hi é"}, {"role": "assistant", "content": "yo"}]}
    ] * 2
    assert "é" in lines[0]


def test_import_without_usable_conversation(spark, tmp_path):
    (tmp_path / "dump.jsonl").write_text(SHORT + "\n")
    with pytest.raises(EmptyResultError, match="every chat was dropped"):
        import_files(spark, str(tmp_path / "dump.jsonl"), str(tmp_path / "out"))


def test_import_fault_leaves_no_output(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.jsonl").write_text(f"{GOOD}\n" * 3)
    (folder / "b x.jsonl").write_text(f"{GOOD}\n\n[]\n{GOOD}\n{{cut off\n")
    (folder / "c.jsonl").write_text("{cut off\n")
    with pytest.raises(ImportFormatError, match="line 3: not_object") as raised:
        import_files(spark, str(folder), str(tmp_path / "out"))
    assert raised.value.file.endswith("b%20x.jsonl") and raised.value.lineno == 3
    assert not list((tmp_path / "out").glob("part-*"))
    skipped = import_files(spark, str(folder), str(tmp_path / "out2"), on_error="skip")
    assert skipped.conversations == 5


@pytest.mark.parametrize("limit, written", [(1, 1), (0, 1), (2, 2), (4, 4), (5, 5)])
def test_import_limit_hides_later_faults(spark, tmp_path, limit, written):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.jsonl").write_text(f"{GOOD}\n{SHORT}\n{GOOD}\n")
    (folder / "b.jsonl").write_text(f"{GOOD}\n{GOOD}\n{GOOD}\n[]\n{GOOD}\n")
    result = import_files(spark, str(folder), str(tmp_path / "out"), limit=limit)
    assert result.conversations == written
    assert spark.read.text(str(tmp_path / "out")).count() == written


def test_import_limit_fault_before_the_last(spark, tmp_path):
    src = tmp_path / "a.jsonl"
    src.write_text(f"{GOOD}\n[]\n{GOOD}\n")
    with pytest.raises(ImportFormatError, match="line 2"):
        import_files(spark, str(src), str(tmp_path / "out"), limit=2)
    assert import_files(spark, str(src), str(tmp_path / "out"), limit=1).conversations == 1


def test_import_limit_over_many_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(20):
        (folder / f"{i:02d} x.jsonl").write_text(f"{GOOD}\n" if i < 12 else "{cut off\n")
    files = list(files_in_order(spark, str(folder)))
    assert [f[0].rsplit("/", 1)[1] for f in files] == [f"{i:02d}%20x.jsonl" for i in range(20)]
    assert import_files(spark, str(folder), str(tmp_path / "o1"), limit=3).conversations == 3
    assert import_files(spark, str(folder), str(tmp_path / "o2"), limit=12).conversations == 12
    with pytest.raises(ImportFormatError, match="line 1: invalid_json.*12%20x.jsonl"):
        import_files(spark, str(folder), str(tmp_path / "o3"), limit=13)


@pytest.mark.parametrize("span", [7, 64, 1000])
def test_spans_give_every_line_once(spark, tmp_path, monkeypatch, span):
    monkeypatch.setattr(ranges, "_FILES", 2)
    monkeypatch.setattr(ranges, "_CHUNK", 50)
    monkeypatch.setattr(ranges, "_SEEK", 16)
    texts = {
        "a.jsonl": "\ufeff" + "".join(f"line {i} {'x' * (i % 90)}\n" + "\n" * (i % 3) for i in range(60)),
        "b c.jsonl": "\n\nfirst\r\nsecond\rthird",
        "d.jsonl": "",
        "e.jsonl": "only é",
    }
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    got, first = [], 0
    for wave in waves(files_in_order(spark, str(tmp_path)), 3, span):
        got += [((r.span, r.row), r.value) for r in scan_spans(spark, wave, first).collect()]
        first += len(wave)
    assert len({place for place, _ in got}) == len(got)
    want = [x for t in texts.values() if t for x in lines_in(t.removeprefix("\ufeff"))]
    assert [value for _, value in sorted(got)] == want


def test_waves_grow():
    sizes = [[sum(s.end - s.start for s in w), len(w)] for w in waves(iter([("f", "f", 500), ("g", "g", 0), ("h", "h", 10**6)]), 2, 100)]
    assert sizes[0] == [200, 2] and all(b[0] >= a[0] for a, b in zip(sizes, sizes[1:-1]))
    assert sum(n for n, _ in sizes) == 10**6 + 500


def test_limit_stops_reading(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.jsonl").write_text(f"{GOOD}\n" * 40_000)
    read = []
    monkeypatch.setattr("turnmill.plans.import_traces.scan_spans", lambda s, spans, first: read.extend(spans) or scan_spans(s, spans, first))
    assert import_files(spark, str(folder), str(tmp_path / "out"), limit=100).conversations == 100
    assert sum(s.end - s.start for s in read) < 0.6 * sum(f.stat().st_size for f in folder.iterdir())
    assert spark.read.text(str(tmp_path / "out")).count() == 100


@pytest.mark.parametrize("packed", [False, True])
def test_limit_with_quarantine(spark, tmp_path, packed):
    import gzip

    folder = tmp_path / "in"
    folder.mkdir()
    texts = {"a": f"{GOOD}\n\n[]\n{GOOD}\n", "b": f"{{cut off\n{GOOD}\n{GOOD}\n[]\n{GOOD}\n"}
    for name, text in texts.items():
        if packed:
            (folder / f"{name}.jsonl.gz").write_bytes(gzip.compress(text.encode()))
        else:
            (folder / f"{name}.jsonl").write_text(text)
    for limit, faults in ((1, []), (2, [("a", 3)]), (4, [("a", 3), ("b", 1)]), (9, [("a", 3), ("b", 1), ("b", 4)])):
        out, bad = str(tmp_path / f"out{limit}"), str(tmp_path / f"bad{limit}")
        result = import_files(spark, str(folder), out, limit=limit, on_error="skip", quarantine=bad)
        assert (result.conversations, result.skipped) == (min(limit, 5), len(faults))
        schema = "file string, lineno bigint, error_class string, detail string"
        got = sorted((r.file.rsplit("/", 1)[1][0], r.lineno) for r in spark.read.schema(schema).json(bad).collect())
        assert got == faults and spark.read.text(out).count() == min(limit, 5)


def test_stage_dataset(spark, tmp_path, lines_of):
    staged = stage_dataset(lines_of([GOOD, "", SHORT]), str(tmp_path / "staged"))
    assert sorted(r.value for r in staged.collect()) == sorted([GOOD, "", SHORT])
    with pytest.raises(EmptyResultError):
        stage_dataset(lines_of(["", " \t"]), str(tmp_path / "blank"))


def test_written_messages_are_importable(spark, tmp_path, lines_of):
    first = import_conversations(lines_of([GOOD, SHORT]), min_messages=1, on_error="skip")
    write_messages_jsonl(first, str(tmp_path / "out"))
    again = import_conversations(spark.read.text(str(tmp_path / "out")))
    assert again.collect() == first.select("messages").collect()
    assert import_errors(spark.read.text(str(tmp_path / "out"))).count() == 0


def test_records(spark, tmp_path):
    path = {"mean_s": 12.915, "stdev_s": 0.229, "tokens_per_s": 586.0, "times": [13.2, 12.6]}
    record = {
        "native_1pass": path, "custom_2pass": {**path, "mean_s": 16.771},
        "summary": {"model": "m", "batch_seqs": 16, "total_tokens_per_step": 7569,
                    "step_time_reduction_pct": 23.0, "throughput_gain_pct": 29.8},
    }
    (tmp_path / "bench.json").write_text(json.dumps(record, indent=2))
    row = scan_bench_record(spark, str(tmp_path / "bench.json")).first()
    assert row.custom_2pass.mean_s == 16.771 and row.native_1pass.times == [13.2, 12.6]
    assert row.summary.batch_seqs == 16
    evaluation = {"name": "n", "date": "2026-08-20", "eval": {"baseline_accuracy": 0.852919},
                  "training_progress": {"steps_completed": 49}, "cost": {"total_usd": 3.52}}
    (tmp_path / "eval.json").write_text(json.dumps(evaluation, indent=2))
    row = scan_eval_record(spark, str(tmp_path / "eval.json")).first()
    assert str(row.date) == "2026-08-20" and row.cost.total_usd == 3.52
    assert row.training_progress.steps_completed == 49


def test_metrics_files(spark, tmp_path):
    for run in ("r1", "r2"):
        (tmp_path / "runs" / run).mkdir(parents=True)
        (tmp_path / "runs" / run / "metrics.jsonl").write_text('{"step":1}\n{"step":2}\n')
    rows = scan_metrics_jsonl(spark, str(tmp_path / "runs/*/metrics.jsonl"))
    assert sorted((r.run_id, r.row.toPython()["step"]) for r in rows.collect()) == [
        ("r1", 1), ("r1", 2), ("r2", 1), ("r2", 2)]
    missing = scan_metrics_jsonl(spark, str(tmp_path / "none/*/metrics.jsonl"))
    assert missing.count() == 0 and missing.columns == rows.columns
    (tmp_path / "runs" / "r1" / "metrics.jsonl").write_text('{"step":1}\n{"step"\n')
    with pytest.raises(PySparkException, match="not a metrics line"):
        scan_metrics_jsonl(spark, str(tmp_path / "runs/*/metrics.jsonl")).collect()


def test_task_catalog(spark, tmp_path):
    for name, files in {
        "sort-file": ("instruction.md", "task.toml", "tests/test.sh", "environment/Dockerfile"),
        "grep-log": ("instruction.md", "tests/test.sh", "notes/readme.md"),
    }.items():
        for f in files:
            target = tmp_path / "set" / name / f
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_text(f"{name}:{f}")
    (tmp_path / "set" / "grep-log" / "solution").mkdir()
    (tmp_path / "set" / "grep-log" / "solution" / "instruction.md").write_text("not a task")
    other = tmp_path / "more" / "sort-file"
    other.mkdir(parents=True)
    (other / "instruction.md").write_text("of the other dataset")
    both = scan_task_catalog(spark, str(tmp_path)).collect()
    assert sorted((r.dataset, r.task_name) for r in both) == [("more", "sort-file"), ("set", "grep-log"), ("set", "sort-file")]
    assert next(r for r in both if r.dataset == "more").test_script is None
    rows = {r.task_name: r for r in scan_task_catalog(spark, str(tmp_path / "set")).collect()}
    assert set(rows) == {"sort-file", "grep-log"}
    assert rows["sort-file"].dockerfile == "sort-file:environment/Dockerfile"
    assert rows["grep-log"].test_script == "grep-log:tests/test.sh"
    assert rows["grep-log"].task_toml is None and rows["grep-log"].dockerfile is None


def test_output_is_as_before_after_any_failure(spark, tmp_path):
    out, dump = str(tmp_path / "out"), tmp_path / "a.jsonl"
    dump.write_text(GOOD_LINE)
    import_files(spark, str(dump), out)
    for bad, error in (("{cut off", ImportFormatError), ('{"messages":[]}', EmptyResultError)):
        dump.write_text(bad + "\n")
        with pytest.raises(error):
            import_files(spark, str(dump), out, mode="overwrite")
        assert spark.read.text(out).count() == 1
        with pytest.raises(error):
            import_files(spark, str(dump), str(tmp_path / "new"))
        assert not (tmp_path / "new").exists()
    dump.write_text(GOOD_LINE * 2 + "[]\n")
    done = import_files(spark, str(dump), out, mode="overwrite", on_error="skip", quarantine=str(tmp_path / "bad"))
    assert (done.conversations, done.skipped) == (2, 1) and spark.read.text(out).count() == 2
    assert [(r.lineno, r.error_class) for r in spark.read.json(str(tmp_path / "bad")).collect()] == [(3, "not_object")]
    with pytest.raises(EmptyResultError):
        stage_dataset(spark.createDataFrame([(" ",)], "value string"), str(tmp_path / "staged"))
    assert not (tmp_path / "staged").exists()
    assert not [p for p in tmp_path.iterdir() if ".new-" in p.name or ".old-" in p.name]


GOOD_LINE = '{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}\n'


@pytest.mark.parametrize("last", ["5", '"x"', "{}", "[7]"])
@pytest.mark.parametrize("key", ["messages", "m\\u0065ssages"])
def test_last_of_repeated_messages_counts(spark, tmp_path, last, key):
    dump = tmp_path / "a.jsonl"
    dump.write_text(GOOD_LINE.strip()[:-1] + f',"{key}":{last}}}\n')
    for fmt in ("messages", "openai", "anthropic"):
        with pytest.raises(ImportFormatError):
            import_files(spark, str(dump), str(tmp_path / f"out-{fmt}"), fmt=fmt)


def test_outer_folders(spark):
    import random

    from pyspark.sql import functions as F

    from turnmill.sources.records import outer_folders

    rng = random.Random(6)
    paths = {"/".join(["t", *(rng.choice("ab-c.") * rng.randint(1, 2) for _ in range(rng.randint(1, 6)))]) for _ in range(400)}
    paths |= {"deep", *(f"deep/{i:03d}/x/y" for i in range(300)), "deep-not", "deeper/x"}
    want = {p for p in paths if not any(p.startswith(f"{q}/") for q in paths)}
    df = spark.createDataFrame([(p,) for p in paths] * 2, "folder string").repartition(9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [r.folder for r in outer_folders(df).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(got) == sorted(want) and outer_folders(df.where(F.lit(False))).count() == 0


def test_failing_import_reads_one_file_again(spark, tmp_path, monkeypatch):
    from turnmill.plans import import_traces

    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(4):
        (folder / f"{i}.jsonl").write_text(f"{GOOD}\n" * 3 + ("[]\n" if i % 2 else ""))
    scans = []
    monkeypatch.setattr(import_traces, "scan_jsonl", lambda *a, **k: scans.append(k.get("file")) or scan_jsonl(*a, **k))
    with pytest.raises(ImportFormatError, match="line 4: not_object.*1.jsonl"):
        import_files(spark, str(folder), str(tmp_path / "out"))
    assert [f and f.rsplit("/", 1)[1] for f in scans] == [None, "1.jsonl"]
    scans.clear()
    assert import_files(spark, str(folder), str(tmp_path / "out"), on_error="skip").skipped == 2
    assert scans == [None]
