from __future__ import annotations

import hashlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logweft.functions.fields import extra_fields, extra_keys, parse_level, reversed_keys, with_reversed_keys
from logweft.functions.normalize import fingerprint_message, normalize_message
from logweft.functions.privacy import find_sensitive_types, mask_text
from logweft.functions.timestamps import parse_timestamp


def apply(spark, function, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["out"] for r in rows.select("i", function(F.col("v")).alias("out")).orderBy("i").collect()]


def test_masks(spark):
    assert apply(
        spark,
        mask_text,
        "Authorization: Bearer abcdef123456==",
        "API-KEY = 'sk_live_123' and access token:abcdef",
        "mail jane.doe+x@example.test, now",
        "from 192.0.2.44 to 300.1.1.1",
        "call +1 (555) 123-45-67 today",
        "no data",
    ) == [
        "Authorization: Bearer [REDACTED_TOKEN]",
        "API-KEY = [REDACTED_SECRET] and access token:[REDACTED_SECRET]",
        "mail [REDACTED_EMAIL], now",
        "from [REDACTED_IP] to 300.1.1.1",
        "call [REDACTED_PHONE] today",
        "no data",
    ]


def test_sensitive_types(spark):
    text = "bearer abcdefgh1 secret=abcdef a@b.co 10.0.0.1 123456789"
    (found,) = apply(spark, find_sensitive_types, text)
    assert found == ["bearer_token", "api_key", "email", "ipv4", "phone"]


def test_normalize(spark):
    a, b, c, d, e = apply(
        spark,
        normalize_message,
        "request_id=456 failed at 2026-01-15T08:00:00Z",
        "Job 123e4567-e89b-12d3-a456-42661417400a  took 4.5 s",
        " \t ",
        "commit deadbeefdeadbeef1 v1.2 port: 80",
        "Valve stuck 42",
    )
    assert a == "request_id=<id> failed at <timestamp>"
    assert b == "job <uuid> took <number> s"
    assert c == "<empty>"
    assert d == "commit <hex> v1.2 port=<id>"
    assert e == "valve stuck <number>"


def test_fingerprint(spark):
    (found,) = apply(spark, fingerprint_message, "Valve stuck 42")
    assert found == hashlib.sha256(b"valve stuck <number>").hexdigest()[:16]


def test_levels(spark):
    assert apply(spark, parse_level, " warn", "ERR", "fatal", "Information", "trace", "NOTICE") == [
        "WARNING", "ERROR", "CRITICAL", "INFO", "DEBUG", None]


EIGHT = datetime(2026, 1, 15, 8)


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2026-01-15T08:00:00Z", EIGHT),
        ("2026-01-15T10:00:00+02:00", EIGHT),
        ("2026-01-15T10:00:00+0200", EIGHT),
        ("2026-01-15 08:00:00,123", EIGHT.replace(microsecond=123000)),
        ("2026-01-15 08:00:00.1234567", EIGHT.replace(microsecond=123456)),
        ("1768464000", EIGHT),
        ("1768464000000", EIGHT),
        ("2026/01/15 08:00:00", EIGHT),
        ("15/Jan/2026:09:30:00 +0130", EIGHT),
        ("20260115T080000Z", EIGHT),
        ("20260115", EIGHT.replace(hour=0)),
        ("2026-01-15", EIGHT.replace(hour=0)),
        ("2026-W03-4", EIGHT.replace(hour=0)),
        ("2026-1-15 8:0:0", EIGHT),
        ("-1.5", datetime(1969, 12, 31, 23, 59, 58, 500000)),
        ("", None),
        ("not-a-date", None),
        ("true", None),
        ("1e30", None),
        ("2026-02-30", None),
        ("2026-W54", None),
        ("2026-01-15T24:00:01", None),
        ("0000-01-01", None),
    ],
)
def test_timestamps(spark, text, expected):
    assert apply(spark, parse_timestamp, text) == [expected]


def test_default_timezone(spark):
    def berlin(value):
        return parse_timestamp(value, "Europe/Berlin")

    assert apply(
        spark, berlin, "2026-01-15T10:00:00", "2026-07-15 10:00:00", "2026-03-29T02:30:00",
        "2026-10-25T02:30:00", "2026-01-15T10:00:00Z"
    ) == [
        datetime(2026, 1, 15, 9),
        datetime(2026, 7, 15, 8),
        datetime(2026, 3, 29, 1, 30),
        datetime(2026, 10, 25, 0, 30),
        datetime(2026, 1, 15, 10),
    ]


def test_sql_functions(spark):
    from logweft.functions.sql import register_functions

    register_functions(spark)
    text = "Mail a@b.co 'secret: abcdef99' id = 7 in 0xdeadbeefdeadbeef"
    spark.createDataFrame([(text,)], "v string").createOrReplaceTempView("texts")
    row = spark.sql(
        "SELECT mask_text(v) m, normalize_message(v) n, fingerprint_message(v) f FROM texts"
    ).first()
    assert [row["m"]] == apply(spark, mask_text, text)
    assert [row["n"]] == apply(spark, normalize_message, text)
    assert [row["f"]] == apply(spark, fingerprint_message, text)


def test_strip_and_filled(spark):
    from logweft.constants import BLANKS
    from logweft.functions.text import is_filled, strip

    texts = [None, "", " ", "a", " a", "a ", "　é b ", "é", "a　", "\x7f", "\x1ca\x7f", "a b", "~!", BLANKS, "\x00 "]
    rows = spark.createDataFrame([(x,) for x in texts], "x string")
    got = rows.select(strip(F.col("x")), is_filled(F.col("x"))).collect()
    want = [(None, None) if x is None else (x.strip(BLANKS), x.strip(BLANKS) != "") for x in texts]
    assert [tuple(row) for row in got] == want


def test_rules_are_applied_once(spark):
    """An empty message is told by the rules' result, not by applying them again."""
    rows = spark.createDataFrame([(" ",), ("Pump 7 of a@b.example",), (None,)], "m string")
    found = [row["n"] for row in rows.select(normalize_message(F.col("m")).alias("n")).collect()]
    assert found == ["<empty>", "pump <number> of [redacted_email]", "<empty>"]
    # As a branch, where the engine does not share equal parts.
    branch = rows.select(F.when(F.col("m") != "", normalize_message(F.col("m"))).alias("n"))
    assert branch._jdf.queryExecution().optimizedPlan().toString().count("[REDACTED_IP]") == 1


def test_keys_as_one_text(spark):
    keys = [
        ["Time", " Log Level ", "a"], [], None, [""], ["", ""], [" "], ["a\x01b", "C"], ["\x01"], ["\xa0Level", "B"],
        ["\t x y "], ["É Z"], ["tail\n"], ["A  B", " a_b"], ["time", "Time"], ["(x)$1", "\\y"],
    ]
    rows = spark.createDataFrame([(k,) for k in keys], "k array<string>")
    found = with_reversed_keys(rows, F.col("k"), "found").select("k", "found", reversed_keys(F.col("k")).alias("each"))
    for row in found.collect():
        assert row["found"] == row["each"], row


def test_extra_fields(spark):
    # Keys as made by ``reversed_keys``: the first of equal ones is the last of the row.
    rows = spark.createDataFrame(
        [(["b", "a", "level", "a"], ["1", None, "x", "2"]), (["msg", None], ["1", "2"]), (["z", "y"], ["1"]), (None, None)],
        "k array<string>, v array<string>",
    )
    found = rows.select(extra_fields(extra_keys(F.col("k")), F.col("k"), F.col("v")).alias("f")).collect()
    assert [row["f"] for row in found] == [{"a": None, "b": "1"}, {}, {"y": None, "z": "1"}, None]
