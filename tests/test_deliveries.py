"""A store that grows by deliveries against one pass over all files."""

from __future__ import annotations

import os
import random
from dataclasses import fields

import pytest

from logweft.operators.trace import trace_correlation
from logweft.plans import deliveries
from logweft.plans.analyze import analyze_files
from logweft.schema import AnalyzeOptions
from logweft.sources.records import read_records

OPTIONS = AnalyzeOptions(burst_threshold=3, issue_sample_limit=4)


def write_log(path, seed: int, lines: int = 60) -> str:
    rng = random.Random(seed)
    with path.open("w") as handle:
        for _ in range(lines):
            if rng.random() < 0.1:
                handle.write(f"### {rng.randrange(100)}\n")
                continue
            handle.write(
                f"2025-03-09T{rng.randrange(8, 12):02}:{rng.randrange(60):02}:00Z {rng.choice(['ERROR', 'INFO', 'FATAL'])} "
                f"service={rng.choice('abc')} correlation_id=r{int(rng.paretovariate(1)) % 20} "
                f"{rng.choice(['pump', 'lamp'])} {rng.randrange(4)} from {rng.choice('xyz')} failed\n"
            )
    return str(path)


def rows(report) -> dict:
    return {f.name: [str(r) for r in getattr(report, f.name).collect()] for f in fields(report)}


def comparable(report) -> dict:
    """Windows and the like are ordered; equal rows of the others are, too."""
    return {name: sorted(found) for name, found in rows(report).items()}


@pytest.fixture
def logs(tmp_path):
    (tmp_path / "in").mkdir()
    names = ["a.log", "b[1].log", "c.log"]
    return [write_log(tmp_path / "in" / name, seed) for seed, name in enumerate(names)]


def test_deliveries_equal_one_pass(spark, logs, tmp_path):
    store, folder = str(tmp_path / "store"), str(tmp_path / "in")
    held = tmp_path / "held"
    held.mkdir()
    for late in logs[1:]:
        os.rename(late, held / os.path.basename(late))
    assert deliveries.add_delivery(spark, store, folder, OPTIONS, keep_events=True) == 1
    for late in logs[1:]:
        os.rename(held / os.path.basename(late), late)
        # The files that were there before are not read again.
        assert deliveries.add_delivery(spark, store, folder, OPTIONS, keep_events=True) == 1
        if late == logs[1]:
            deliveries.compact_store(spark, store)
    assert deliveries.add_delivery(spark, store, folder, OPTIONS, keep_events=True) == 0
    want = comparable(analyze_files(spark, folder, OPTIONS))
    deliveries.compact_store(spark, store)
    # Three deliveries and the first compaction.
    assert deliveries.sweep_store(spark, store) == 4
    assert deliveries.sweep_store(spark, store) == 0
    assert comparable(deliveries.analyze_store(spark, store, OPTIONS)) == want
    records = read_records(spark, folder)
    traced = deliveries.trace_store(spark, store, "r1", 7)
    assert rows(traced) == rows(trace_correlation(records, "r1", 7))
    plan = deliveries.trace_store(spark, store, "r1").events._jdf.queryExecution().toString()
    assert "EqualTo(correlation_id,r1)" in plan


def test_crash_before_the_ledger(spark, logs, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    deliveries.add_delivery(spark, store, logs[0], OPTIONS)

    def totals() -> list:
        return deliveries.analyze_store(spark, store, OPTIONS).summary.collect()

    want = totals()

    def lost(*_):
        raise OSError("executor and driver lost")

    with monkeypatch.context() as patch:
        patch.setattr(deliveries, "_enter", lost)
        with pytest.raises(OSError):
            deliveries.add_delivery(spark, store, logs[2], OPTIONS)
    assert totals() == want
    assert deliveries.sweep_store(spark, store) == 1
    assert deliveries.add_delivery(spark, store, logs[2], OPTIONS) == 1
    assert totals() == analyze_files(spark, [logs[0], logs[2]], OPTIONS).summary.collect()


def test_what_a_store_refuses(spark, logs, tmp_path):
    store = str(tmp_path / "store")
    with pytest.raises(ValueError, match="no delivery"):
        deliveries.analyze_store(spark, store)
    deliveries.add_delivery(spark, store, logs[0], OPTIONS)
    with pytest.raises(ValueError, match="other settings"):
        deliveries.add_delivery(spark, store, logs[2], AnalyzeOptions(window_minutes=7))
    with pytest.raises(ValueError, match="windows of 5 minutes"):
        deliveries.analyze_store(spark, store, AnalyzeOptions(window_minutes=7))
    with pytest.raises(ValueError, match="keeps 4 dead letters"):
        deliveries.analyze_store(spark, store)
    with pytest.raises(ValueError, match="does not keep events"):
        deliveries.trace_store(spark, store, "r1")
    with open(logs[0], "a") as log:
        log.write("one more line\n")
    with pytest.raises(ValueError, match="changed after it was read"):
        deliveries.add_delivery(spark, store, logs[0], OPTIONS)


def test_a_file_read_by_two_writers(spark, logs, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    nothing = deliveries.ledger(spark, store)
    with monkeypatch.context() as patch:
        patch.setattr(deliveries, "ledger", lambda *_: nothing)
        for _ in range(2):
            deliveries.add_delivery(spark, store, logs[0], OPTIONS)
    with pytest.raises(ValueError, match="read by two deliveries"):
        deliveries.analyze_store(spark, store, OPTIONS)


def test_empty_files(spark, tmp_path):
    store = str(tmp_path / "store")
    (tmp_path / "in").mkdir()
    for name in ("empty.csv", "empty.log"):
        (tmp_path / "in" / name).write_text("")
    assert deliveries.add_delivery(spark, store, str(tmp_path / "in")) == 2
    assert deliveries.add_delivery(spark, store, str(tmp_path / "in")) == 0
    summary = deliveries.analyze_store(spark, store).summary.first()
    assert (summary["total_lines"], summary["malformed_lines"]) == (1, 1)
