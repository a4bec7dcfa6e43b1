"""The command line on files."""

import pytest

from turnmill.__main__ import arguments, main

GOOD = '{"messages":[{"role":"human","content":"hi"},{"role":"ai","content":"yo"}]}\n'


def test_import_command(spark, tmp_path, capsys):
    (tmp_path / "a.jsonl").write_text(GOOD * 3)
    (tmp_path / "b.jsonl").write_text(GOOD)
    out = str(tmp_path / "out")
    assert main(["import", str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl"), "-o", out]) == 0
    assert "4 chats from messages input" in capsys.readouterr().err
    assert spark.read.text(out).count() == 4


def test_import_command_errors(spark, tmp_path, capsys):
    (tmp_path / "a.jsonl").write_text(GOOD + "[]\n")
    assert main(["import", str(tmp_path / "a.jsonl"), "-o", str(tmp_path / "out")]) == 1
    assert "line 2: not_object" in capsys.readouterr().err
    (tmp_path / "b.jsonl").write_text("{\"messages\":[]}\n")
    assert main(["import", str(tmp_path / "b.jsonl"), "-o", str(tmp_path / "out")]) == 1
    assert "min_messages=2" in capsys.readouterr().err
    with pytest.raises(SystemExit):
        arguments(["import", "x", "-o", "y", "-f", "csv"])
