from __future__ import annotations

import csv
import gzip
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from logweft.operators.parse import events_of, issues_of
from logweft.sources.detect import detect_format, sniff_heads
from logweft.sources.lines import read_lines, read_numbered_lines
from logweft.sources.records import read_records


def rows_of(df):
    return [row.asDict() for row in df.orderBy("arrival").collect()]


def test_plain_file(spark, plain_log):
    records = read_records(spark, plain_log)
    events = rows_of(events_of(records))
    assert [(e["service"], e["level"], e["correlation_id"]) for e in events] == [
        ("boiler", "DEBUG", "shift-9"),
        ("pump", "CRITICAL", "shift-9"),
        ("alarm", "WARNING", "shift-9"),
        ("pump", "ERROR", None),
    ]
    assert events[1]["message"] == "pressure sensor 17 silent"
    assert [e["line_number"] for e in events] == [1, 3, 4, 5]
    (issue,) = rows_of(issues_of(records))
    assert (issue["line_number"], issue["preview"]) == (2, "### rotated ###")


def test_jsonl_aliases_and_offsets(spark, jsonl_log):
    events = rows_of(events_of(read_records(spark, jsonl_log)))
    assert (events[0]["level"], events[0]["service"], events[0]["correlation_id"]) == (
        "ERROR", "pump", "shift-10")
    assert str(events[0]["timestamp"]) == "2025-03-09 20:46:40"
    assert (events[1]["level"], events[1]["message"]) == ("INFO", "report filed")


def test_csv_aliases(spark, csv_log):
    events = rows_of(events_of(read_records(spark, csv_log)))
    assert [e["level"] for e in events] == ["WARNING", "CRITICAL"]
    assert [e["line_number"] for e in events] == [2, 3]
    assert (events[1]["service"], events[1]["message"]) == ("office", "lights; all of them; out")


def test_gzip(spark, gzip_log):
    assert read_records(spark, gzip_log).count() == 2


def test_all_formats_keep_argument_order(spark, plain_log, jsonl_log, csv_log):
    records = read_records(spark, [csv_log, plain_log, jsonl_log])
    rows = rows_of(records)
    assert len(rows) == 9
    assert sum(row["reason"] is not None for row in rows) == 1
    assert [row["source"].rsplit(".", 1)[1] for row in rows] == ["csv"] * 2 + ["log"] * 5 + [
        "jsonl"] * 2


def test_format_detection(spark, tmp_path, plain_log, gzip_log):
    (tmp_path / "a").write_text('\n  {"timestamp": 1}\n')
    (tmp_path / "b").write_text("time;message;level\n2026-01-15T08:00:00Z;hello;INFO\n")
    (tmp_path / "c").write_text("just words\nmore words\n")
    (tmp_path / "d").write_text("")
    (tmp_path / "e.NDJSON").write_text("")
    (tmp_path / "f.csv.gz").write_bytes(gzip.compress(b"date|level|msg\n1|INFO|x\n"))
    names = ["a", "b", "c", "d", "e.NDJSON", "f.csv.gz"]
    table = detect_format(spark, [str(tmp_path / name) for name in names] + [plain_log, gzip_log])
    found = [(r["format"], r["delimiter"]) for r in table.orderBy("ordinal").collect()]
    assert found == [("jsonl", None), ("csv", ";"), ("plain", None), ("plain", None),
                     ("jsonl", None), ("csv", "|"), ("plain", None), ("jsonl", None)]


@pytest.mark.parametrize(
    ("text", "dialect", "header"),
    [
        ("a,b\n1,2\n", (",", '"', False), ["a", "b"]),
        ("a; b; c\n1; 2; 3\n", (";", '"', True), ["a", "b", "c"]),
        ('"x,y"\t"b\nc"\td\n1,5\t2,5\t3\n', ("\t", '"', False), ["x,y", "b\nc", "d"]),
        ("'a|b', 'c'\n'1', '2'\n", (",", "'", True), ["a|b", "c"]),
        ("one word\nother, words\n", (",", '"', False), ["one word"]),
        ('a|"say ""so"""|\n1|2|\n', ("|", '"', False), ["a", 'say "so"', ""]),
        ("a,b;c\n1,2;3\n4,5;6\n", (",", '"', False), ["a", "b;c"]),
        ("a,b,c;d\n" + "1;2\n" * 30, (";", '"', False), ["a,b,c", "d"]),
        ("\n\na,b\n", (",", '"', False), []),
    ],
)
def test_dialects(spark, tmp_path, text, dialect, header):
    (tmp_path / "x.csv").write_text(text)
    (tmp_path / "empty.csv").write_text("")
    (row,) = sniff_heads(read_lines(spark, str(tmp_path))).collect()
    assert (row["delimiter"], row["quote"], row["skip_space"]) == dialect
    assert row["header"] == header and row["sample"] == text[:200]


def test_many_files_in_one_look(spark, tmp_path):
    """The plan does not grow with the number of files."""
    for k in range(30):
        (tmp_path / f"n{k:02}").write_text(["{}\n", "time;msg\n1;x\n", "words\n"][k % 3] * (1 + k))
    found = detect_format(spark, str(tmp_path)).orderBy("ordinal")
    assert [r["format"] for r in found.collect()] == ["jsonl", "csv", "plain"] * 10
    assert str(found._jdf.queryExecution().optimizedPlan()).count("Relation") < 10


def test_records_of_sniffed_files(spark, tmp_path):
    (tmp_path / "a").write_text('{"timestamp": 1768464000, "level": "warn", "message": "m"}\n')
    (tmp_path / "b").write_text("time;message;level\n2026-01-15T08:00:00Z;hello;INFO\n")
    (tmp_path / "c").write_text("2026-01-15T08:00:00Z [error] boom\n")
    rows = rows_of(read_records(spark, [str(tmp_path / name) for name in "abc"]))
    assert [(r["level"], r["message"], r["reason"]) for r in rows] == [
        ("WARNING", "m", None), ("INFO", "hello", None), ("ERROR", "boom", None)]


def test_line_numbers_over_splits(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        paths = []
        for name, count in (("z.txt", 900), ("y.txt", 1), ("x.txt", 400)):
            path = tmp_path / name
            path.write_text("".join(f"{name} {n} {'x' * (n % 37)}\n" for n in range(1, count + 1)))
            paths.append(str(path))
        lines = read_numbered_lines(spark, paths)
        assert lines.count() == 1301
        wrong = lines.where(F.split("value", " ")[1].cast("long") != F.col("line_number"))
        assert wrong.isEmpty()
        ordered = [r["value"].split()[0] for r in lines.orderBy("arrival").collect()]
        assert ordered == ["z.txt"] * 900 + ["y.txt"] + ["x.txt"] * 400
        assert lines.agg(F.min("arrival"), F.max("arrival"), F.countDistinct("arrival")).first() == (
            1, 1301, 1301)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_newlines_and_bad_bytes(spark, tmp_path):
    path = tmp_path / "mixed file+1.log"
    path.write_bytes(b"one\r\ntwo\rthree\nbad \xff byte")
    rows = read_numbered_lines(spark, str(path)).orderBy("line_number").collect()
    assert [r["value"] for r in rows] == ["one", "two", "three", "bad � byte"]
    assert rows[0]["source"].endswith("/mixed file+1.log")


def test_repeated_or_missing_paths_are_refused(spark, plain_log):
    with pytest.raises(ValueError):
        read_records(spark, [plain_log, plain_log])
    with pytest.raises(ValueError):
        read_records(spark, [])
    with pytest.raises(ValueError, match="timezone"):
        read_records(spark, plain_log, default_timezone="Mars/Base")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_records(spark, plain_log + ".missing")


def test_json_dead_letters(spark, tmp_path):
    path = tmp_path / "bad.jsonl"
    good = {"timestamp": "2026-01-15T08:00:00Z", "level": "INFO", "message": "x"}
    lines = ["[]", "{}", "", "{'a': 1}", json.dumps(good) + " xx", json.dumps(good) + "]",
             json.dumps(good) + "}", json.dumps(good) + '] {"a": 1}', json.dumps(good) + ",{}",
             json.dumps(good | {"level": "NOTICE"}), json.dumps(good | {"timestamp": True}),
             json.dumps(good | {"service": "s" * 201}), json.dumps(good | {"trace_id": "t" * 501}),
             json.dumps({"timestamp": 1, "level": " "}), json.dumps({"time": 1, "level": "x"}),
             "12", json.dumps(good | {"list": [{"a": 1}]})]
    path.write_text("\n".join(lines) + "\n")
    rows = rows_of(read_records(spark, str(path)))
    assert [r["reason"] for r in rows] == [
        "JSON value must be an object", "required field is missing: timestamp", "empty line",
        "invalid JSON", "invalid JSON", "invalid JSON", "invalid JSON", "invalid JSON",
        "invalid JSON", "unsupported log level: 'NOTICE'", "unrecognized timestamp: 'true'",
        "service is longer than 200 characters", "correlation_id is longer than 500 characters",
        "required field is missing: level", "required field is missing: message",
        "JSON value must be an object", None]
    assert rows[-1]["fields"] == {"list": '[{"a":1}]'}


def test_mapping_keys(spark, tmp_path):
    path = tmp_path / "keys.jsonl"
    path.write_text(
        '{" Time ": "2026-01-15", "Log Level": "err", "message": " ", "msg": "one", "Msg": " two ",'
        ' "logger": null, "App": " web ", "Correlation-ID": " c ", "k V": 3, "n": null}\n'
        '{"date": 1768464000000, "level": "crit", "event": 12, "traceid": "  "}\n'
    )
    first, second = rows_of(events_of(read_records(spark, str(path))))
    assert (first["message"], first["service"], first["correlation_id"]) == (" two ", "web", "c")
    assert first["fields"] == {"k_v": "3", "n": None}
    assert (second["message"], second["service"], second["correlation_id"]) == (
        "12", "unknown", None)
    assert str(second["timestamp"]) == "2026-01-15 08:00:00"


def test_plain_pairs(spark, tmp_path):
    path = tmp_path / "pairs.log"
    path.write_text(
        '  [2026-01-15 08:00:00,5] [Warn]  service="my app" - started app:last\n'
        "2026/01/15 08:00:00 ERR request-id=1 trace_id='t 1' myservice=x | failed\n"
        "2026-01-15T08:00:00Z INFO service=a\n"
        '2026-01-15T08:00:00Z INFO service="" text\n'
        "2026-01-15T08:00:00Z NOTICE text\n"
        "2026/01/15T08:00:00 INFO text\n"
        "   \n"
    )
    rows = rows_of(read_records(spark, str(path)))
    assert [(r["service"], r["message"], r["correlation_id"]) for r in rows[:3]] == [
        ("last", "started", None), ("x", "my  | failed", "t 1"),
        ("a", "service=a", None)]
    assert [r["reason"] for r in rows[3:]] == [
        "service is empty", "plain line does not match '<timestamp> <level> <message>'",
        "unrecognized timestamp: '2026/01/15T08:00:00'", "empty line"]


def test_default_timezone(spark, tmp_path):
    path = tmp_path / "zone.log"
    path.write_text("2026-01-15 10:00:00 INFO a\n2026-01-15T10:00:00Z INFO b\n")
    rows = rows_of(read_records(spark, str(path), default_timezone="Europe/Berlin"))
    assert [str(r["timestamp"]) for r in rows] == ["2026-01-15 09:00:00", "2026-01-15 10:00:00"]


def python_csv(text: str, delimiter: str) -> list[tuple[int, list[str]]]:
    reader = csv.reader(io.StringIO(text, newline=""), delimiter=delimiter)
    return [(reader.line_num, row) for row in reader][1:]


@pytest.mark.parametrize("delimiter", [",", ";"])
def test_csv_cells_over_lines_and_splits(spark, tmp_path, delimiter):
    rng = random.Random(7)
    header = delimiter.join(["time", "level", "msg", "note"])
    parts = [header]
    for index in range(600):
        words = [rng.choice(["plain", 'with "quotes" in', "", "x" * rng.randrange(40)]) for _ in "ab"]
        if rng.random() < 0.2:
            words[0] = '"' + rng.choice(["a\nb", 'q ""x""\n\ny', f"a{delimiter}b", '""', "\n"]) + '"'
        if rng.random() < 0.1:
            words[1] = '"tail\nwith, lines; here"'
        parts.append(delimiter.join(["2026-01-15T08:00:00Z", "INFO", f"m{index} {words[1]}"
                                     if words[1][:1] != '"' else words[1], words[0]]))
        if rng.random() < 0.05:
            parts.append("")
    text = "\n".join(parts) + "\n"
    path = tmp_path / "cells.csv"
    path.write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = rows_of(read_records(spark, str(path)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    expected = [(n, r) for n, r in python_csv(text, delimiter) if r]
    assert [r["line_number"] for r in rows] == [n for n, _ in expected]
    assert [r["message"] for r in rows] == [r[2] for _, r in expected]
    assert [r["fields"]["note"] or "" for r in rows] == [r[3] for _, r in expected]


def test_csv_long_cells(spark, tmp_path):
    """Cells may have any length and any number of lines; one never closed ends the file."""
    path = tmp_path / "limits.csv"
    rows = ["time,level,msg", '1,INFO,"' + "x" * 131_073 + '"', "1,INFO,fine",
            '1,INFO,"a' + "\n" * 131_080 + 'b"', '1,INFO,"open', "1,INFO,inside"]
    path.write_text("\n".join(rows) + "\n")
    found = rows_of(read_records(spark, str(path)))
    assert [(r["line_number"], r["message"], r["reason"]) for r in found] == [
        (2, "x" * 131_073, None),
        (3, "fine", None),
        (131_084, found[2]["message"], None),
        (131_086, found[3]["message"], None),
    ]
    assert found[2]["message"] == "a" + "\n" * 131_080 + "b"
    assert found[3]["message"].endswith("open\n1,INFO,inside")


def test_csv_wide_header(spark, tmp_path):
    """Columns far behind the sample that tells the dialect are read."""
    extra = [f"extra_column_number_{k}" for k in range(600)]
    path = tmp_path / "wide.csv"
    path.write_text(",".join([*extra, "timestamp", "level", "message"]) + "\n" + ",".join(["v"] * 600) + ",1,INFO,late\n")
    (row,) = rows_of(read_records(spark, str(path)))
    assert (row["reason"], row["level"], row["message"]) == (None, "INFO", "late")


def test_blank_lines_before_the_first_record(spark, tmp_path):
    (tmp_path / "quiet").write_text("\n" * 9000 + '{"timestamp": 1, "level": "info", "message": "m"}\n')
    assert detect_format(spark, str(tmp_path / "quiet")).first()["format"] == "jsonl"


def test_overlapping_inputs_are_refused(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.log").write_text("2026-01-15T08:00:00Z [info] x\n")
    file = str(folder / "a.log")
    for paths in ([str(folder), file], [file, f"file://{file}"], [f"{folder}/*.log", file], [str(tmp_path), file]):
        with pytest.raises(ValueError, match="twice"):
            read_records(spark, paths)
    assert read_records(spark, [f"{folder}/*.log"]).count() == 1


def test_csv_header_missing(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "blank.csv").write_text("\ntime,level,msg\n1,INFO,x\n")
    (tmp_path / "good.csv").write_text("time,level,msg\n1,INFO,x\n1,INFO\n1,INFO,y,z\n")
    paths = [str(tmp_path / f"{name}.csv") for name in ("empty", "blank", "good")]
    rows = rows_of(read_records(spark, paths))
    assert [(r["line_number"], r["reason"], r["message"]) for r in rows] == [
        (1, "CSV header is missing", None), (1, "CSV header is missing", None), (2, None, "x"),
        (3, "required field is missing: message", None), (4, None, "y")]
    only_empty = read_records(spark, paths[0])
    assert [r["reason"] for r in only_empty.collect()] == ["CSV header is missing"]


def test_formats_share_text_not_packed_lines(spark, tmp_path, monkeypatch):
    """After the look each format reads its own files; only lines of CSV files are stored, in
    pieces that many tasks can read."""
    from logweft.sources import records as sources

    (tmp_path / "a.out").write_text("".join(f'{{"time": "2025-01-01T00:00:00Z", "level": "INFO", "msg": "m{i}"}}\n' for i in range(5)))
    (tmp_path / "b 1%.out").write_text("2025-01-01T00:00:00Z ERROR x\n")
    (tmp_path / "c.csv").write_text("time,level,text\n2025-01-01T00:00:00Z,INFO,t\n")
    (tmp_path / "d.out").write_text("")
    stored = []
    real = sources.materialize

    def spy(df, name, *more):
        stored.append((name, *more))
        return real(df, name, *more)

    monkeypatch.setattr(sources, "materialize", spy)
    folder = str(tmp_path)
    lines, heads = sources.route_files(spark, [folder], None, sources.list_files(spark, [folder]))
    counted = {name: sum(part.count() for part in parts) for name, parts in lines.items()}
    assert counted == {"jsonl": 5, "plain": 1, "csv": 2} and heads.count() == 3
    assert [name for name, *_ in stored] == ["file-heads", "csv-lines"] and stored[1][1] <= 8 << 20
    assert sources.read_records(spark, folder).where("reason IS NULL").count() == 7
