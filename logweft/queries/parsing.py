"""Sources, sinks and parsing, over log files written from the ``events`` table."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DEMO_ERROR_MESSAGES, DEMO_NORMAL_MESSAGES, DEMO_SERVICES
from ..functions import fields
from ..functions.privacy import issue_preview as preview_of
from ..functions.timestamps import parse_timestamp
from ..operators.parse import events_of, issues_of, json_records, plain_records
from ..operators.quality import validate_records, valid_counts
from ..operators.summary import issue_counts, issue_samples
from ..plans.demo import demo_events, write_logs
from ..session import new_path
from ..sources.detect import detect_format
from ..sources.lines import read_numbered_lines
from ..sources.records import read_records
from .common import (
    APP,
    app_events,
    app_rows,
    broken_folder,
    csv_folder,
    iso,
    json_folder,
    plain_folder,
    plain_text_line,
    query,
    rendered,
    sql_app,
    sql_mask,
    table,
    write_lines,
)

# The small function below goes to the executors as it is.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_EVENT = ["timestamp", "level", "service", "message", "correlation_id"]

# The plain lines of ``plain_text_line``, and what they parse to: a pair inside a
# message counts as a pair of the line.
_PLAIN_LINE = """
  CASE event_id % 3
    WHEN 0 THEN iso || 'Z ' || word || ' service=' || service || ' correlation_id='
      || correlation_id || ' ' || message
    WHEN 1 THEN '[' || replace(replace(iso, 'T', ' '), '.', ',') || '] [' || lower(word) || '] '
      || message || ' | component:''' || service || ''' trace_id="' || correlation_id || '"'
    ELSE ' ' || iso || '+00:00 ' || word || ' request_id=' || correlation_id || ' app=' || service
      || ' - ' || message END"""
_PLAIN_MESSAGE = (
    "CASE WHEN upstream THEN left(message, strpos(message, ' request_id=') - 1) ELSE message END"
)
_PLAIN_CORRELATION = (
    "CASE WHEN upstream AND event_id % 3 <> 1 THEN CAST(event_id AS VARCHAR) "
    "ELSE correlation_id END"
)


@query(
    "scan_text",
    sql_app(f"SELECT row_number() OVER (ORDER BY event_id) AS arrival, {_PLAIN_LINE} AS value FROM app"),
)
def scan_text(spark, sf_dir):
    return read_numbered_lines(spark, plain_folder(spark, sf_dir)).select("arrival", "value")


def _gzip_folder(spark: SparkSession, sf_dir: str) -> str:
    def write(rows: DataFrame, folder: str) -> None:
        rows.select(plain_text_line().alias("value")).write.text(folder, compression="gzip")

    return rendered(spark, sf_dir, "gzip", write)


@query(
    "scan_gzip",
    sql_app(f"SELECT row_number() OVER (ORDER BY event_id) AS arrival, {_PLAIN_LINE} AS value FROM app"),
)
def scan_gzip(spark, sf_dir):
    return read_numbered_lines(spark, _gzip_folder(spark, sf_dir)).select("arrival", "value")


@query(
    "scan_jsonl",
    sql_app('SELECT "timestamp", level, service, message, correlation_id, arrival FROM app'),
)
def scan_jsonl(spark, sf_dir):
    return events_of(read_records(spark, json_folder(spark, sf_dir), log_format="jsonl")).select(*_EVENT, "arrival")


@query(
    "scan_plain",
    sql_app(
        f'SELECT "timestamp", level, service, {_PLAIN_MESSAGE} AS message, '
        f"{_PLAIN_CORRELATION} AS correlation_id, arrival FROM app"
    ),
)
def scan_plain(spark, sf_dir):
    return events_of(read_records(spark, plain_folder(spark, sf_dir))).select(*_EVENT, "arrival")


_CSV_MESSAGE = (
    "CASE WHEN event_id % 4 = 0 THEN 'he said \"no\"' || chr(10) || message ELSE message END"
)


@query(
    "scan_csv",
    sql_app(
        f'SELECT "timestamp", level, service, {_CSV_MESSAGE} AS message, correlation_id, '
        "CAST(user_id AS VARCHAR) AS user_id FROM app"
    ),
)
def scan_csv(spark, sf_dir):
    events = events_of(read_records(spark, csv_folder(spark, sf_dir)))
    return events.select(*_EVENT, F.col("fields")["user_id"].alias("user_id"))


def _blank_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = True
    for batch in batches:
        if first:
            yield pa.RecordBatch.from_pydict({"value": [""]}, schema=batch.schema)
        first = False
        yield batch


def _sniffed_json_folder(spark: SparkSession, sf_dir: str) -> str:
    """JSON objects in files whose suffix does not tell the format."""

    def write(rows: DataFrame, folder: str) -> None:
        time = F.concat(iso(F.col("timestamp")), F.lit("Z")).alias("timestamp")
        rows.select(time, *_EVENT[1:]).write.json(folder)

    return rendered(spark, sf_dir, "json0", write)


@query(
    "csv_header_missing",
    "SELECT 'CSV header is missing' AS reason, TRUE AS one_per_file, CAST(0 AS BIGINT) AS events",
)
def csv_header_missing(spark, sf_dir):
    def write(rows: DataFrame, folder: str) -> None:
        lines = rows.select(F.concat_ws(",", iso(F.col("timestamp")), "level", "service").alias("value"))
        lines.mapInArrow(_blank_first, "value string").write.text(folder)

    folder = rendered(spark, sf_dir, "headless", write)
    records = read_records(spark, folder, log_format="csv")
    return records.groupBy(F.col("reason")).agg(
        (F.count("*") == F.countDistinct("source")).alias("one_per_file"),
        F.count("timestamp").alias("events"),
    )


def _folder_name(source: Column) -> Column:
    return F.regexp_extract(source, r"/log-([a-z]+)[0-9]*-[0-9a-f]+/", 1)


def _detected(spark, folders: list[str]) -> DataFrame:
    """Each file with what was found out about it, its lines, and its records: lines but the
    header of CSV files."""
    formats = detect_format(spark, folders)
    lines = read_numbered_lines(spark, folders).groupBy("source").agg(F.count("*").alias("lines"))
    headers = F.when(F.col("format") == "csv", 1).otherwise(0)
    return formats.join(lines, "source").withColumn("records", F.col("lines") - headers)


# Messages of CSV files have a second line in every fourth record.
_CSV_LINES = "count(*) + count(*) FILTER (event_id % 4 = 0)"


@query(
    "detect_format",
    sql_app(
        "SELECT 'plain' AS folder, 'plain' AS format, count(*) AS records FROM app "
        "UNION ALL SELECT 'json', 'jsonl', count(*) FROM app "
        "UNION ALL SELECT 'gzip', 'plain', count(*) FROM app "
        f"UNION ALL SELECT 'csv', 'csv', {_CSV_LINES} FROM app"
    ),
)
def detect(spark, sf_dir):
    """Lines of all files by the format that was found for them."""
    folders = [
        plain_folder(spark, sf_dir),
        _sniffed_json_folder(spark, sf_dir),
        csv_folder(spark, sf_dir),
        _gzip_folder(spark, sf_dir),
    ]
    found = _detected(spark, folders)
    return found.groupBy(_folder_name(F.col("source")).alias("folder"), "format").agg(F.sum("records").alias("records"))


@query(
    "sniff_delimiter",
    sql_app(
        f"SELECT written, written AS found, {_CSV_LINES} AS records "
        "FROM app, (VALUES (','), (';'), ('|'), (chr(9))) AS t(written) GROUP BY written"
    ),
)
def sniff_delimiter(spark, sf_dir):
    """Lines of CSV files by the delimiter that they were written with and the one found."""
    found = _detected(spark, [csv_folder(spark, sf_dir, delimiter) for delimiter in (",", ";", "|", "\t")])
    code = F.regexp_extract("source", r"/log-csv([0-9]+)-", 1).cast("int")
    return found.groupBy(F.chr(code).alias("written"), F.col("delimiter").alias("found")).agg(F.sum("records").alias("records"))


@query(
    "multi_file",
    sql_app(
        "SELECT * FROM (SELECT 'plain' AS folder, count(*) AS records, CAST(1 AS BIGINT) AS first, "
        "count(*) AS last FROM app UNION ALL "
        "SELECT 'json', count(*), count(*) + 1, 2 * count(*) FROM app)"
    ),
)
def multi_file(spark, sf_dir):
    paths = [plain_folder(spark, sf_dir), _sniffed_json_folder(spark, sf_dir)]
    return (
        read_records(spark, paths)
        .groupBy(_folder_name(F.col("source")).alias("folder"))
        .agg(
            F.count("*").alias("records"),
            F.min("arrival").alias("first"),
            F.max("arrival").alias("last"),
        )
    )


@query("line_number", sql_app("SELECT event_id, arrival, TRUE AS consecutive FROM app"))
def line_number(spark, sf_dir):
    def write(rows: DataFrame, folder: str) -> None:
        rows.select(F.concat_ws(" ", "event_id", "message").alias("value")).write.text(folder)

    lines = read_numbered_lines(spark, rendered(spark, sf_dir, "numbered", write))
    event = F.split("value", " ")[0].cast("bigint")
    rows = lines.select("source", event.alias("event_id"), "line_number", "arrival")
    first = rows.groupBy("source").agg(F.min("event_id").alias("first_id"))
    return rows.join(first, "source").select(
        "event_id",
        "arrival",
        (F.col("line_number") == F.col("event_id") - F.col("first_id") + 1).alias("consecutive"),
    )


@query(
    "table_adapter",
    sql_app(
        'SELECT "timestamp", level, service, message, correlation_id, arrival, '
        "CAST(user_id AS VARCHAR) AS user_id, event_type FROM app"
    ),
)
def table_adapter(spark, sf_dir):
    return app_events(spark, sf_dir).select(
        *_EVENT,
        "arrival",
        F.col("fields")["user_id"].alias("user_id"),
        F.col("fields")["event_type"].alias("event_type"),
    )


@query(
    "union_sources",
    sql_app(
        'SELECT "timestamp", level, service, correlation_id, count(*) AS copies FROM ('
        f'SELECT "timestamp", level, service, {_PLAIN_CORRELATION} AS correlation_id FROM app '
        'UNION ALL SELECT "timestamp", level, service, correlation_id FROM app '
        'UNION ALL SELECT "timestamp", level, service, correlation_id FROM app) GROUP BY ALL'
    ),
)
def union_sources(spark, sf_dir):
    paths = [folder(spark, sf_dir) for folder in (plain_folder, _sniffed_json_folder, csv_folder)]
    keys = ("timestamp", "level", "service", "correlation_id")
    return (
        events_of(read_records(spark, paths)).groupBy(*keys).agg(F.count("*").alias("copies"))
    )


# Row functions.


def _json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.text(json_folder(spark, sf_dir)).select("value")


def _plain_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.text(plain_folder(spark, sf_dir)).select("value")


@query("map_aliases", sql_app('SELECT "timestamp", level, service, message, correlation_id FROM app'))
def map_aliases(spark, sf_dir):
    return json_records(_json_lines(spark, sf_dir)).select(*_EVENT)


@query(
    "parse_plain",
    sql_app(
        f'SELECT "timestamp", level, service, {_PLAIN_MESSAGE} AS message, '
        f"{_PLAIN_CORRELATION} AS correlation_id FROM app"
    ),
)
def parse_plain(spark, sf_dir):
    return plain_records(_plain_lines(spark, sf_dir)).select(*_EVENT)


@query(
    "extract_kv",
    sql_app(
        f"SELECT event_id, service, {_PLAIN_CORRELATION} AS correlation_id, "
        "CAST(CASE WHEN upstream THEN 3 ELSE 2 END AS INTEGER) AS pairs FROM app"
    ),
)
def extract_kv(spark, sf_dir):
    rows = app_rows(spark, sf_dir).select("event_id", plain_text_line().alias("line"))
    pairs = rows.withColumn("pairs", fields.extract_pairs(F.col("line")))
    return pairs.select(
        "event_id",
        fields.last_value(F.col("pairs"), "service").alias("service"),
        fields.last_value(F.col("pairs"), "correlation_id").alias("correlation_id"),
        F.size("pairs").alias("pairs"),
    )


@query("strip_kv", sql_app(f"SELECT event_id, {_PLAIN_MESSAGE} AS message FROM app"))
def strip_kv(spark, sf_dir):
    tail = F.concat(
        F.lit("service="), "service", F.lit(" - "), "message", F.lit(" | trace_id='"),
        "correlation_id", F.lit("'"),
    )
    return app_rows(spark, sf_dir).select("event_id", fields.strip_pairs(tail).alias("message"))


@query("parse_level", sql_app("SELECT event_id, word, level FROM app"))
def parse_level(spark, sf_dir):
    return app_rows(spark, sf_dir).select(
        "event_id", F.col("level").alias("word"), fields.parse_level(F.col("level")).alias("level")
    )


@query("is_error", sql_app("SELECT event_id, is_error FROM app"))
def is_error(spark, sf_dir):
    level = fields.parse_level(F.col("level"))
    return app_rows(spark, sf_dir).select("event_id", fields.is_error(level).alias("is_error"))


@query("parse_ts_iso", 'SELECT event_id, ts AS "timestamp" FROM events')
def parse_ts_iso(spark, sf_dir):
    """Six notations of the same time, some with an offset."""
    ts, kind = F.col("ts"), F.col("event_id") % 6
    shifted = F.timestamp_add("MINUTE", F.lit(330), ts)
    text = (
        F.when(kind == 0, F.concat(iso(ts), F.lit("Z")))
        .when(kind == 1, F.concat(iso(shifted), F.lit("+05:30")))
        .when(kind == 2, F.translate(iso(ts), "T.", " ,"))
        .when(kind == 3, F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("9Z")))
        .when(kind == 4, F.concat(iso(shifted), F.lit("+0530")))
        .otherwise(F.date_format(ts, "yyyyMMdd'T'HHmmss.SSSSSS"))
    )
    events = table(spark, sf_dir, "events")
    return events.select("event_id", parse_timestamp(text).alias("timestamp"))


@query("parse_ts_formats", "SELECT event_id, date_trunc('second', ts) AS \"timestamp\" FROM events")
def parse_ts_formats(spark, sf_dir):
    ts, kind = F.col("ts"), F.col("event_id") % 3
    later = F.timestamp_add("HOUR", F.lit(2), ts)
    text = (
        F.when(kind == 0, F.date_format(ts, "yyyy/MM/dd HH:mm:ss"))
        .when(kind == 1, F.concat(F.date_format(later, "dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0200")))
        .otherwise(F.date_format(ts, "yyyy-M-d H:m:s"))
    )
    events = table(spark, sf_dir, "events")
    return events.select("event_id", parse_timestamp(text).alias("timestamp"))


@query(
    "parse_ts_epoch",
    "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN ts ELSE make_timestamp(epoch_us(ts) // 1000 * 1000) "
    'END AS "timestamp" FROM events',
)
def parse_ts_epoch(spark, sf_dir):
    """Seconds with a fraction, or whole milliseconds."""
    micros = F.timestamp_diff(
        "MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")
    )
    seconds = (micros.cast("decimal(20,0)") / 1_000_000).cast("decimal(20,6)").cast("string")
    millis = F.floor(micros / 1000).cast("string")
    text = F.when(F.col("event_id") % 2 == 0, seconds).otherwise(millis)
    events = table(spark, sf_dir, "events")
    return events.select("event_id", parse_timestamp(text).alias("timestamp"))


@query(
    "ts_default_tz",
    "SELECT event_id, ts - INTERVAL 1 HOUR AS berlin, ts + INTERVAL 5 HOUR AS new_york, "
    "ts AS with_zone FROM events",
)
def ts_default_tz(spark, sf_dir):
    text = F.col("ts").cast("string")
    return table(spark, sf_dir, "events").select(
        "event_id",
        parse_timestamp(text, "Europe/Berlin").alias("berlin"),
        parse_timestamp(text, "America/New_York").alias("new_york"),
        parse_timestamp(F.concat(text, F.lit("Z")), "Europe/Berlin").alias("with_zone"),
    )


# Dead letters of the lines of ``broken_json_line``.
_REASON = """
  CASE event_id % 50 WHEN 0 THEN 'invalid JSON' WHEN 1 THEN 'empty line'
    WHEN 2 THEN 'JSON value must be an object' WHEN 3 THEN 'required field is missing: message'
    WHEN 4 THEN 'unsupported log level: ''NOTICE'''
    WHEN 5 THEN 'unrecognized timestamp: ''yesterday'''
    WHEN 6 THEN 'service is longer than 200 characters' WHEN 7 THEN 'invalid JSON' END"""


@query("dead_letter", sql_app(f"SELECT arrival, {_REASON} AS reason FROM app"))
def dead_letter(spark, sf_dir):
    return read_records(spark, broken_folder(spark, sf_dir), log_format="jsonl").select("arrival", "reason")


def _sql_json(*pairs: tuple[str, str]) -> str:
    """A JSON object of texts that need no escapes."""
    return "'{' || " + " || ',' || ".join(f"'\"{key}\":\"' || {value} || '\"'" for key, value in pairs)


_EXTRA = """ || ',"user_id":' || user_id || ',"Event Type":"' || event_type || '"}'"""
_ZULU = "iso || 'Z'"
_LINE = "CASE event_id % 3 " + " ".join(
    f"{when} {_sql_json(*zip(keys, (_ZULU, level, 'service', 'message', 'correlation_id')))}{_EXTRA}"
    for when, level, keys in (
        ("WHEN 0 THEN", "word", ("timestamp", "level", "service", "message", "correlation_id")),
        ("WHEN 1 THEN", "word", ("@timestamp", "severity", "component", "msg", "trace_id")),
        ("ELSE", "lower(word)", (" Time ", "Log Level", "App", "Text", "Correlation-ID")),
    )
) + " END"
_BROKEN = f"""
  CASE event_id % 50 WHEN 0 THEN 'not json from u1@example.test ' || event_id WHEN 1 THEN ''
    WHEN 2 THEN '[1, 2]' WHEN 3 THEN {_sql_json(("time", _ZULU), ("level", "word"))} || '}}'
    WHEN 4 THEN {_sql_json(("time", _ZULU), ("level", "'NOTICE'"), ("service", "service"), ("message", "message"))} || '}}'
    WHEN 5 THEN {_sql_json(("time", "'yesterday'"), ("level", "word"), ("service", "service"), ("message", "message"))} || '}}'
    WHEN 6 THEN {_sql_json(("time", _ZULU), ("level", "word"), ("service", "repeat('s', 201)"), ("message", "message"))} || '}}'
    WHEN 7 THEN {_LINE} || ' trailing' END"""


@query(
    "issue_preview",
    sql_app(
        f"SELECT arrival, {sql_mask('line')} AS preview FROM "
        f"(SELECT arrival, left({_BROKEN}, 240) AS line FROM app) WHERE line IS NOT NULL"
    ),
)
def issue_preview(spark, sf_dir):
    issues = issues_of(read_records(spark, broken_folder(spark, sf_dir), log_format="jsonl"))
    return issues.select("arrival", preview_of(F.col("preview")).alias("preview"))


@query(
    "extra_fields",
    sql_app(
        "SELECT arrival, CAST(user_id AS VARCHAR) AS user_id, event_type, "
        "CAST(2 AS INTEGER) AS extras FROM app"
    ),
)
def extra_fields(spark, sf_dir):
    events = events_of(read_records(spark, json_folder(spark, sf_dir), log_format="jsonl"))
    return events.select(
        "arrival",
        F.col("fields")["user_id"].alias("user_id"),
        F.col("fields")["event_type"].alias("event_type"),
        F.size("fields").alias("extras"),
    )


@query(
    "correlation_blank",
    sql_app(
        "SELECT event_id, CASE event_id % 4 WHEN 0 THEN correlation_id WHEN 3 THEN correlation_id "
        "END AS correlation_id FROM app"
    ),
)
def correlation_blank(spark, sf_dir):
    """IDs that are blank, empty, padded or absent."""
    kind, request = F.col("event_id") % 4, F.col("correlation_id")
    given = (
        F.when(kind == 0, F.concat(F.lit("  "), request, F.lit("\t")))
        .when(kind == 1, F.lit("   "))
        .when(kind == 2, F.lit(""))
        .otherwise(request)
    )
    rows = app_rows(spark, sf_dir)
    line = F.to_json(
        F.struct("timestamp", "level", "message", given.alias("trace_id"), "event_id")
    )
    records = json_records(rows.select("event_id", line.alias("value")))
    return records.select("event_id", "correlation_id")


@query(
    "issue_counts",
    sql_app(
        "SELECT regexp_replace(reason, ': ''.*', '') AS reason, count(*) AS \"count\" "
        f"FROM (SELECT {_REASON} AS reason FROM app) WHERE reason IS NOT NULL GROUP BY 1"
    ),
)
def count_issues(spark, sf_dir):
    return issue_counts(issues_of(read_records(spark, broken_folder(spark, sf_dir), log_format="jsonl")))


@query(
    "issue_samples",
    sql_app(
        f"SELECT arrival, reason FROM (SELECT arrival, {_REASON} AS reason FROM app) "
        "WHERE reason IS NOT NULL ORDER BY arrival LIMIT 20"
    ),
)
def sample_issues(spark, sf_dir):
    issues = issues_of(read_records(spark, broken_folder(spark, sf_dir), log_format="jsonl"))
    return issue_samples(issues).select("arrival", "reason")


@query(
    "filter_events",
    sql_app(f"SELECT arrival, level FROM app WHERE ({_REASON}) IS NULL"),
)
def filter_events(spark, sf_dir):
    return events_of(read_records(spark, broken_folder(spark, sf_dir), log_format="jsonl")).select("arrival", "level")


@query(
    "validate_files",
    sql_app(
        "SELECT 'broken' AS folder, 'jsonl' AS format, "
        f"CAST(sum((({_REASON}) IS NULL)::INT) AS BIGINT) AS valid_lines, "
        f"CAST(sum((({_REASON}) IS NOT NULL)::INT) AS BIGINT) AS invalid_lines FROM app "
        "UNION ALL SELECT 'plain', 'plain', count(*), 0 FROM app"
    ),
)
def validate(spark, sf_dir):
    broken, plain = broken_folder(spark, sf_dir), plain_folder(spark, sf_dir)
    records = read_records(spark, broken, log_format="jsonl").unionByName(
        read_records(spark, plain, log_format="plain")
    )
    formats = valid_counts(records).select(
        "source",
        F.when(_folder_name(F.col("source")) == "broken", "jsonl").otherwise("plain").alias("format"),
    )
    files = validate_records(records, formats).files
    return files.groupBy(_folder_name(F.col("source")).alias("folder"), "format").agg(
        F.sum("valid_lines").alias("valid_lines"), F.sum("invalid_lines").alias("invalid_lines")
    )


# Sinks.


_DRAW = "(CAST('0x' || left(md5('42:{0}:' || event_id), 8) AS BIGINT) / 4294967296.0)"


def _listed(texts: list[str]) -> str:
    return "[" + ",".join(f"'{text}'" for text in texts) + "]"


_SERVICES, _ERRORS, _NORMAL = map(_listed, (DEMO_SERVICES, DEMO_ERROR_MESSAGES, DEMO_NORMAL_MESSAGES))
_DEMO = f"""
WITH size AS (SELECT count(*) AS n FROM events),
drawn AS (
  SELECT event_id, {_DRAW.format('error')} AS e, {_DRAW.format('level')} AS l,
    {_DRAW.format('message')} AS m,
    event_id >= n // 2 AND event_id < least(n, n // 2 + greatest(20, n // 50)) AS burst
  FROM events, size
),
demo AS (
  SELECT event_id, TIMESTAMP '2026-01-15 08:00:00' + to_seconds(2 * event_id) AS "timestamp",
    CASE WHEN burst OR e < 0.07 THEN CASE WHEN l < 0.05 THEN 'CRITICAL' ELSE 'ERROR' END
      WHEN l < 0.08 THEN 'WARNING' ELSE 'INFO' END AS level,
    {_SERVICES}[event_id % 5 + 1] AS service,
    'demo-' || lpad(CAST(event_id // 5 AS VARCHAR), 8, '0') AS correlation_id,
    CASE WHEN burst OR e < 0.07 THEN replace({_ERRORS}[CAST(floor(m * {len(DEMO_ERROR_MESSAGES)}) AS BIGINT) + 1],
        '{{id}}', CAST(100000 + event_id AS VARCHAR))
      ELSE {_NORMAL}[CAST(floor(m * {len(DEMO_NORMAL_MESSAGES)}) AS BIGINT) + 1] END AS message
  FROM drawn
)"""


def _demo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A demo event for every row of ``events``."""
    events = table(spark, sf_dir, "events")
    return demo_events(events.select(F.col("event_id").alias("index")), events.count())


@query(
    "generate_demo",
    f'{_DEMO} SELECT event_id AS "index", "timestamp", level, service, correlation_id, message FROM demo',
)
def generate_demo(spark, sf_dir):
    return _demo(spark, sf_dir)


@query(
    "write_demo",
    f'{_DEMO} SELECT "timestamp", level, service, correlation_id, CAST(2 AS BIGINT) AS copies FROM demo '
    "WHERE correlation_id LIKE 'demo-%'",
)
def write_demo(spark, sf_dir):
    """The demo events written as JSON Lines and as gzip CSV, and read back."""
    demo = _demo(spark, sf_dir)
    folders = []
    for log_format, packed in (("jsonl", False), ("csv", True)):
        folders.append(new_path(spark, f"demo-{log_format}"))
        write_logs(demo, folders[-1], log_format, packed)
    keys = ("timestamp", "level", "service", "correlation_id")
    events = events_of(read_records(spark, folders))
    return events.groupBy(*keys).agg(F.count("*").alias("copies"))
