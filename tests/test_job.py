from __future__ import annotations

import pytest

from logweft.plans.job import parser, run


def test_commands(spark, tmp_path, plain_log, jsonl_log):
    def job(*words):
        run(spark, parser().parse_args([str(word) for word in words]))

    job("analyze", plain_log, "--output", tmp_path / "a")
    with pytest.raises(RuntimeError, match="1 malformed lines"):
        job("analyze", plain_log, "--output", tmp_path / "b", "--fail-on-malformed")
    for name, log in (("1", plain_log), ("2", jsonl_log)):
        job("deliver", log, "--store", tmp_path / "store", "--output", tmp_path / f"s{name}")
    totals = [spark.read.json(str(tmp_path / f"s{n}" / "summary")).first()["total_lines"] for n in (1, 2)]
    assert totals == [5, 7]
    job("compare", plain_log, "--current", jsonl_log, "--output", tmp_path / "c")
    job("trace", plain_log, "--correlation-id", "shift-9", "--output", tmp_path / "t")
    with pytest.raises(RuntimeError, match="not found"):
        job("trace", plain_log, "--correlation-id", "x", "--output", tmp_path / "u")
    with pytest.raises(RuntimeError, match="invalid lines"):
        job("validate", plain_log, "--output", tmp_path / "v")
    job("redact", plain_log, "--output", tmp_path / "r")
    job("generate-demo", "--lines", 20, "--output", tmp_path / "d")
    assert spark.read.json(str(tmp_path / "c" / "summary")).first()["total_delta"] == -2
    assert spark.read.json(str(tmp_path / "d")).count() == 20
