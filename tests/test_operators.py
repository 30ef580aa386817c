from __future__ import annotations

import json
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logweft.operators import caps, cells, compare, errors, quality, summary, trace
from logweft.operators.parse import events_of, issues_of
from logweft.operators.redact import redact_file
from logweft.plans.analyze import analyze, analyze_files, compare_files, write_report
from logweft.plans.demo import generate_demo
from logweft.schema import EVENT_SCHEMA, AnalyzeOptions
from logweft.session import lookup_join
from logweft.sources.records import read_records

START = datetime(2026, 1, 15, 8)


def make_events(spark, rows):
    """Rows of (timestamp, level, service, message, correlation_id), in order of arrival."""
    full = [(*row, "test", n, n, None) for n, row in enumerate(rows, start=1)]
    return spark.createDataFrame(full, EVENT_SCHEMA)


def make_records(spark, rows):
    nothing = F.lit(None).cast("string")
    return make_events(spark, rows).withColumns({"reason": nothing, "preview": nothing})


def errors_per_window(spark, counts):
    return make_records(
        spark,
        [
            (START + timedelta(minutes=5 * i, seconds=n), "ERROR", "api", f"failure {n}", None)
            for i, count in enumerate(counts)
            for n in range(count)
        ],
    )


def test_three_formats_together(spark, plain_log, jsonl_log, csv_log):
    report = analyze_files(spark, [plain_log, jsonl_log, csv_log])
    row = report.summary.first()
    assert (row["total_lines"], row["parsed_lines"], row["malformed_lines"], row["error_count"]) == (
        9, 8, 1, 4)
    assert row["error_rate"] == 0.5
    groups = report.top_errors.collect()
    assert (groups[0]["count"], groups[0]["normalized_message"]) == (3, "pressure sensor <number> silent")
    assert groups[0]["examples"] == [f"pressure sensor {k} silent" for k in (17, 18, 99)]
    assert [r["line_number"] for r in report.issue_samples.collect()] == [2]
    assert {r["gate"]: r["passed"] for r in report.gates.collect()} == {
        "parse-quality": False, "statistical-anomalies": True}
    levels = {r["level"]: r["count"] for r in report.levels.collect()}
    assert levels == {"DEBUG": 1, "CRITICAL": 2, "WARNING": 2, "ERROR": 2, "INFO": 1}


def test_bursts_and_anomalies(spark):
    options = AnalyzeOptions(burst_threshold=8, anomaly_zscore=1.5)
    report = analyze(errors_per_window(spark, [1, 2, 10, 1, 1, 1, 1]), options)
    assert [r["errors"] for r in report.bursts.collect()] == [10]
    assert report.anomalies.first()["errors"] == 10
    few = analyze(errors_per_window(spark, [1, 1, 20, 1, 1]), options)
    assert few.anomalies.isEmpty()
    flat = analyze(errors_per_window(spark, [2] * 7), options)
    assert flat.anomalies.isEmpty()


def test_caps(spark):
    rows = [(START, "ERROR", "api", f"unique word{letter}", None) for letter in "ABCDE"]
    report = analyze(make_records(spark, rows), AnalyzeOptions(max_error_groups=2))
    assert {r["normalized_message"] for r in report.top_errors.collect()} == {
        "unique worda", "unique wordb"}
    assert report.dropped.first()["dropped_error_groups"] == 3
    assert report.summary.first()["error_count"] == 5


def test_cap_against_plain_python(spark, monkeypatch):
    monkeypatch.setattr(caps, "RANGE_BITS", 3)
    rng = random.Random(3)
    keys = [f"k{int(rng.paretovariate(0.6)) % 60}" for _ in range(400)]
    counted = cells.count_cells(
        make_events(spark, [(START, "INFO", key, "m", None) for key in keys]), "service")
    for capacity in (1, 7, 59, 500):
        kept: Counter = Counter()
        for key in keys:
            if key in kept or len(kept) < capacity:
                kept[key] += 1
        found = caps.first_seen_cap(counted, "service", capacity)
        assert {r["service"]: r["n"] for r in found.collect()} == dict(kept)
        dropped = caps.dropped_count(counted, "service", capacity).first()["dropped"]
        assert dropped == len(keys) - sum(kept.values())


def test_empty_input(spark, tmp_path):
    path = tmp_path / "empty.log"
    path.write_text("")
    row = analyze_files(spark, str(path)).summary.first()
    assert (row["total_lines"], row["error_rate"], row["first_timestamp"]) == (0, 0.0, None)


def test_options_are_checked():
    for wrong in ({"window_minutes": 0}, {"top": 101}, {"anomaly_zscore": 0.0},
                  {"burst_threshold": 0}, {"issue_sample_limit": 1001}):
        with pytest.raises(ValueError):
            AnalyzeOptions(**wrong)


def test_windows_restart_every_hour(spark):
    times = [START.replace(minute=m) for m in (0, 6, 7, 55, 56, 59)]
    events = make_events(spark, [(t, "INFO", "a", "m", None) for t in times])

    def starts(minutes):
        keyed = cells.with_cube_keys(events, minutes)
        found = summary.window_stats(cells.count_cells(keyed, "bucket", "level"))
        return sorted((r["start"].hour, r["start"].minute, r["total"]) for r in found.collect())

    assert starts(7) == [(8, 0, 2), (8, 7, 1), (8, 49, 1), (8, 56, 2)]
    assert starts(90) == starts(60) == [(8, 0, 6)]


def test_ties_go_to_the_first(spark):
    rows = [(START, "ERROR", s, "m", s) for s in ("b", "a", "c", "c", "b", "a")]
    events = make_events(spark, rows)
    found = summary.errors_by_service(cells.count_cells(events, "level", "service"))
    assert [(r["service"], r["count"]) for r in found.collect()] == [("b", 2), ("a", 2), ("c", 2)]
    assert [r["correlation_id"] for r in summary.top_correlations(events, 2).collect()] == ["b", "a"]


def test_examples_are_distinct_and_in_order(spark):
    texts = ["code 1", "code 1", "code 2", "code 1", "code 3", "code 4", "other x"]
    events = make_events(spark, [(START, "ERROR", "s", text, None) for text in texts])
    found = errors.error_examples(events).orderBy("normalized_message", "example_number").collect()
    assert [r["example"] for r in found] == ["code 1", "code 2", "code 3", "other x"]


def test_compare_files(spark, plain_log, jsonl_log):
    report = compare_files(spark, plain_log, jsonl_log)
    row = report.summary.first()
    assert (row["total_delta"], row["error_delta"]) == (-2, -1)
    assert report.new_errors.isEmpty() and report.resolved_errors.isEmpty()
    assert [(r["service"], r["error_delta"]) for r in report.service_error_deltas.collect()] == [
        ("pump", -1)]
    assert report.gates.first()["passed"]


def test_compare_changes(spark):
    def log(*texts):
        return make_events(spark, [(START, "ERROR", "s", text, None) for text in texts])

    tagged = compare.tag_periods(log("a", "a", "b", "c"), log("a", "c", "c", "d"))
    found = compare.error_changes(compare.period_cells(tagged)).collect()
    assert {r["normalized_message"]: (r["delta"], r["change"]) for r in found} == {
        "a": (-1, "decreasing"), "b": (-1, "resolved"), "c": (1, "increasing"), "d": (1, "new")}


def test_trace(spark, plain_log):
    records = read_records(spark, plain_log)
    report = trace.trace_correlation(records, "shift-9")
    row = report.summary.first()
    assert row["service_chain"] == ["boiler", "alarm", "pump"]
    assert (row["matched_events"], row["truncated"], row["malformed_lines"]) == (3, False, 1)
    short = trace.trace_correlation(records, "shift-9", 2)
    assert short.summary.first()["truncated"]
    assert [r["line_number"] for r in short.events.collect()] == [1, 4]
    missing = trace.trace_correlation(records, "nobody").summary
    assert missing.first()["matched_events"] == 0
    assert not quality.trace_gate(missing).first()["passed"]
    with pytest.raises(ValueError):
        trace.trace_correlation(records, "  ")
    with pytest.raises(ValueError):
        trace.trace_correlation(records, "shift-9", 0)


def test_service_chains_against_plain_python(spark):
    """One ID holds most rows and therefore spans several pieces."""
    rng = random.Random(5)
    rows = [
        (START + timedelta(seconds=rng.randrange(200)), "INFO", rng.choice("aab"), "m",
         "hot" if rng.random() < 0.8 else f"id{rng.randrange(30)}")
        for _ in range(1500)
    ]
    chains: dict = {}
    for place, (time, _, service, _, key) in sorted(
        enumerate(rows, start=1), key=lambda item: (item[1][0], item[0])
    ):
        chain = chains.setdefault(key, [])
        if not chain or chain[-1][0] != service:
            chain.append((service, place))
    expected = {
        (key, step, service, place)
        for key, chain in chains.items()
        for step, (service, place) in enumerate(chain, start=1)
    }
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = trace.service_chains(make_events(spark, rows)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = [(r["correlation_id"], r["step"], r["service"], r["line_number"]) for r in found]
    assert len(got) == len(expected) and set(got) == expected


def test_lookup_join_without_broadcast(spark):
    rows = spark.range(5000).select(
        F.col("id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    table = spark.createDataFrame([("hot", 1), ("0", 2), ("3", 3)], "k string, v int")
    joined = lookup_join(rows, table, ["k"], F.col("id"), limit=-1)
    assert "_salt" not in joined.columns
    assert joined.count() == 5000
    assert joined.where("v = 1").count() == 3333
    assert joined.where("v is null").count() == 1665


def test_validation(spark, plain_log, jsonl_log, tmp_path):
    empty = tmp_path / "empty.log"
    empty.write_text("")
    report = quality.validate_files(spark, [plain_log, jsonl_log, str(empty)])
    totals = report.totals.first()
    assert (totals["valid_lines"], totals["invalid_lines"], totals["is_valid"]) == (6, 1, False)
    files = {r["source"].rsplit("/", 1)[1]: r for r in report.files.collect()}
    assert (files["empty.log"]["valid_lines"], files["empty.log"]["format"]) == (0, "plain")
    assert [r["preview"] for r in report.issue_samples.collect()] == ["### rotated ###"]
    gates = quality.validation_gates(report.files)
    assert gates.where("not passed").count() == 1
    with pytest.raises(RuntimeError, match="1 invalid lines"):
        quality.require(gates)


def test_issue_samples_of_each_file(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.log").write_text(f"mail {name}@example.test\n" * 30)
    issues = issues_of(read_records(spark, [str(tmp_path / "b.log"), str(tmp_path / "a.log")]))
    assert quality.samples_per_file(issues, 4).groupBy("source").count().collect()[1]["count"] == 4
    first = summary.issue_samples(issues, 31).orderBy("arrival").collect()
    assert [r["source"][-5:] for r in first] == ["b.log"] * 30 + ["a.log"]
    assert first[0]["preview"] == "mail [REDACTED_EMAIL]"


def test_preview_is_cut_before_masking(spark, tmp_path):
    path = tmp_path / "long.log"
    path.write_text("x" * 230 + " jane@example.test\n")
    issues = issues_of(read_records(spark, str(path)))
    (row,) = summary.issue_samples(issues).collect()
    assert row["preview"] == "x" * 230 + " jane@exam"


def test_redact(spark, tmp_path, plain_log):
    target = str(tmp_path / "masked.gz")
    source = tmp_path / "secret.txt"
    source.write_text("to jane@example.test\nfrom 192.0.2.1\n\nplain\n")
    assert redact_file(spark, str(source), target) == 4
    assert [r["value"] for r in spark.read.text(target).collect()] == [
        "to [REDACTED_EMAIL]", "from [REDACTED_IP]", "", "plain"]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        redact_file(spark, str(source), target)
    assert redact_file(spark, plain_log, target, overwrite=True) == 5
    with pytest.raises(ValueError):
        redact_file(spark, plain_log, plain_log)


def test_redact_keeps_its_source(spark, tmp_path):
    """Other spellings of the source, its parents and what lies in it are refused."""
    folder = tmp_path / "logs"
    folder.mkdir()
    source = folder / "a.log"
    source.write_text("to jane@example.test\n")
    names = [f"file://{source}", f"{folder}/../logs/a.log", str(folder), str(tmp_path)]
    for name in names:
        with pytest.raises(ValueError, match="must be different"):
            redact_file(spark, str(source), name, overwrite=True)
    with pytest.raises(ValueError, match="must be different"):
        redact_file(spark, str(folder), str(folder / "out"), overwrite=True)
    assert source.read_text() == "to jane@example.test\n"


@pytest.mark.parametrize("log_format, packed", [("plain", True), ("jsonl", False), ("csv", True)])
def test_demo_round_trip(spark, tmp_path, log_format, packed):
    folder = generate_demo(spark, str(tmp_path / "demo"), 300, log_format, 7, packed)
    fmt = "jsonl" if log_format == "jsonl" else None
    events = events_of(read_records(spark, folder, log_format=fmt))
    assert events.count() == 300
    first, last = (F.lit(f"2026-01-15 08:05:{s}").cast("timestamp_ntz") for s in ("00", "38"))
    burst = events.where(F.col("timestamp").between(first, last))
    assert burst.where(F.col("level").isin("ERROR", "CRITICAL")).count() == burst.count() == 20
    if log_format != "plain":  # there, a request ID inside a message counts as one of the line
        assert events.select("correlation_id").distinct().count() == 60
    with pytest.raises(ValueError):
        generate_demo(spark, folder, 0)


def test_report_tables_are_written(spark, tmp_path, plain_log):
    target = str(tmp_path / "report")
    write_report(analyze_files(spark, plain_log), target)
    (line,) = spark.read.text(f"{target}/summary").collect()
    assert json.loads(line["value"])["parsed_lines"] == 4
