"""Registry of queries, and the application log made from the ``events`` table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DEMO_SERVICES
from ..operators.parse import events_of
from ..session import new_path, spread
from ..sources.tables import records_from_table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

WINDOW_MINUTES = 60
BURST_THRESHOLD = 7
ZSCORE = 2.5
PERIOD_CUT = "2024-01-16 00:00:00"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL that must give the same rows."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def app_rows(spark: SparkSession, sf_dir: str, ordered: bool = False) -> DataFrame:
    """The events as an application would log them, under log-like column names.

    ``ordered`` cuts the table into ranges of event IDs, each in order, before texts are made of it.
    """
    events = table(spark, sf_dir, "events")
    if ordered:
        events = events.repartitionByRange("event_id").sortWithinPartitions("event_id")
    event, user = F.col("event_id"), F.col("user_id")
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("int")
    word = (
        F.when(kind == "error", F.when(event % 20 == 0, "FATAL").otherwise("ERR"))
        .when(kind == "purchase", "WARN")
        .when(kind == "signup", "INFO")
        .when(kind == "click", "INFORMATION")
        .when(kind == "view", "TRACE")
    )
    shares = F.array(*(F.lit(name) for name in DEMO_SERVICES))

    def text(*parts: Column | str) -> Column:
        return F.concat(
            *(F.lit(part) if isinstance(part, str) else part.cast("string") for part in parts)
        )

    message = (
        F.when(
            event % 10 == 7,
            F.when(
                F.col("ts") < F.lit(PERIOD_CUT).cast("timestamp_ntz"),
                text("cache eviction storm shard ", k),
            ).otherwise(text("disk quota exceeded volume ", k)),
        )
        .when(event % 4 == 0, text("valve ", k, " stuck open on line id=", event))
        .when(event % 4 == 1, text("gauge at 192.0.2.", k, " reads nothing"))
        .when(event % 4 == 2, text("badge of u", user, "@example.test rejected at the gate"))
        .otherwise(text("relay ", k % 4 + 500, " dropped its frame request_id=", event))
    )
    return events.select(
        "event_id",
        "user_id",
        "event_type",
        F.col("ts").alias("timestamp"),
        word.alias("level"),
        F.element_at(shares, (user % 5 + 1).cast("int")).alias("service"),
        text("req-", user).alias("correlation_id"),
        message.alias("message"),
    )


def app_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records_from_table(app_rows(spark, sf_dir), "events", F.col("event_id") + 1)


def app_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_of(app_records(spark, sf_dir))


def hop_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events with the service by event, so that requests change service."""
    rows = app_rows(spark, sf_dir)
    shares = F.array(*(F.lit(name) for name in DEMO_SERVICES))
    hop = F.element_at(shares, (F.col("event_id") % 3 + 1).cast("int"))
    return records_from_table(rows.withColumn("service", hop), "events", F.col("event_id") + 1)


def periods(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Baseline and current events, cut on the table so that the scans are pruned."""
    rows = app_rows(spark, sf_dir)
    before = F.col("timestamp") < F.lit(PERIOD_CUT).cast("timestamp_ntz")
    return tuple(
        events_of(records_from_table(part, "events", F.col("event_id") + 1))
        for part in (rows.where(before), rows.where(~before))
    )


_RENDERED: dict[tuple, str] = {}


def rendered(
    spark: SparkSession, sf_dir: str, name: str, write: Callable[[DataFrame, str], None]
) -> str:
    """Folder with the application log written as files, in event order.

    The folder is made once per session. File boundaries are ranges of event IDs.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _RENDERED:
        folder = new_path(spark, f"log-{name}")
        write(app_rows(spark, sf_dir, ordered=True), folder)
        _RENDERED[key] = folder
    return _RENDERED[key]


def iso(timestamp: Column) -> Column:
    return F.replace(timestamp.cast("string"), F.lit(" "), F.lit("T"))


def json_text(*pairs: tuple[str, Column]) -> Column:
    return F.to_json(F.struct(*(value.alias(key) for key, value in pairs)))


def json_line() -> Column:
    """One JSON object per event, with its keys spelled in three ways."""
    event = F.col("event_id")
    time, level = F.concat(iso(F.col("timestamp")), F.lit("Z")), F.col("level")
    service, message = F.col("service"), F.col("message")
    request = F.col("correlation_id")
    extra = [("user_id", F.col("user_id")), ("Event Type", F.col("event_type"))]
    first = json_text(
        ("timestamp", time), ("level", level), ("service", service), ("message", message),
        ("correlation_id", request), *extra,
    )
    second = json_text(
        ("@timestamp", time), ("severity", level), ("component", service), ("msg", message),
        ("trace_id", request), *extra,
    )
    third = json_text(
        (" Time ", time), ("Log Level", F.lower(level)), ("App", service), ("Text", message),
        ("Correlation-ID", request), *extra,
    )
    return F.when(event % 3 == 0, first).when(event % 3 == 1, second).otherwise(third)


def broken_json_line() -> Column:
    """The same, with seven kinds of malformed lines in each fifty."""
    kind = F.col("event_id") % 50
    time = F.concat(iso(F.col("timestamp")), F.lit("Z"))
    number = F.col("event_id").cast("string")

    def line(time_text: Column, level: Column, service: Column) -> Column:
        return json_text(
            ("time", time_text), ("level", level), ("service", service),
            ("message", F.col("message")),
        )

    return (
        F.when(kind == 0, F.concat(F.lit("not json from u1@example.test "), number))
        .when(kind == 1, F.lit(""))
        .when(kind == 2, F.lit("[1, 2]"))
        .when(kind == 3, json_text(("time", time), ("level", F.col("level"))))
        .when(kind == 4, line(time, F.lit("NOTICE"), F.col("service")))
        .when(kind == 5, line(F.lit("yesterday"), F.col("level"), F.col("service")))
        .when(kind == 6, line(time, F.col("level"), F.repeat(F.lit("s"), 201)))
        .when(kind == 7, F.concat(json_line(), F.lit(" trailing")))
        .otherwise(json_line())
    )


def plain_text_line() -> Column:
    """One text line per event, in three layouts."""
    event = F.col("event_id")
    time, level = iso(F.col("timestamp")), F.col("level")
    service, request, message = F.col("service"), F.col("correlation_id"), F.col("message")

    def text(*parts: Column | str) -> Column:
        return F.concat(*(F.lit(part) if isinstance(part, str) else part for part in parts))

    spaced = F.translate(time, "T.", " ,")
    return (
        F.when(
            event % 3 == 0,
            text(time, "Z ", level, " service=", service, " correlation_id=", request, " ", message),
        )
        .when(
            event % 3 == 1,
            text("[", spaced, "] [", F.lower(level), "] ", message, " | component:'", service,
                 "' trace_id=\"", request, '"'),
        )
        .otherwise(
            text(" ", time, "+00:00 ", level, " request_id=", request, " app=", service, " - ", message)
        )
    )


def write_lines(line: Column) -> Callable[[DataFrame, str], None]:
    def write(rows: DataFrame, folder: str) -> None:
        rows.select(line.alias("value")).write.text(folder)

    return write


def json_folder(spark: SparkSession, sf_dir: str) -> str:
    return rendered(spark, sf_dir, "json", write_lines(json_line()))


def broken_folder(spark: SparkSession, sf_dir: str) -> str:
    return rendered(spark, sf_dir, "broken", write_lines(broken_json_line()))


def plain_folder(spark: SparkSession, sf_dir: str) -> str:
    return rendered(spark, sf_dir, "plain", write_lines(plain_text_line()))


def csv_message() -> Column:
    """Every fourth message spans two lines and has quotes in it."""
    return F.when(
        F.col("event_id") % 4 == 0, F.concat(F.lit('he said "no"\n'), F.col("message"))
    ).otherwise(F.col("message"))


def csv_folder(spark: SparkSession, sf_dir: str, delimiter: str = ",") -> str:
    def write(rows: DataFrame, folder: str) -> None:
        cells = rows.select(
            F.concat(iso(F.col("timestamp")), F.lit("Z")).alias("time"),
            F.col("level").alias("log_level"),
            F.col("service").alias("Application"),
            F.col("correlation_id").alias("Request ID"),
            csv_message().alias("text"),
            F.col("user_id"),
        )
        cells.write.csv(folder, header=True, sep=delimiter, escape='"')

    return rendered(spark, sf_dir, f"csv{ord(delimiter)}", write)


# The application log in SQL. ``app`` is one row per event.
APP = f"""
raw AS (
  SELECT event_id, user_id, event_type, ts,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events
),
app AS (
  SELECT event_id, user_id, event_type, ts AS "timestamp",
    CASE event_type WHEN 'error' THEN CASE WHEN event_id % 20 = 0 THEN 'FATAL' ELSE 'ERR' END
      WHEN 'purchase' THEN 'WARN' WHEN 'signup' THEN 'INFO'
      WHEN 'click' THEN 'INFORMATION' WHEN 'view' THEN 'TRACE' END AS word,
    CASE event_type WHEN 'error' THEN CASE WHEN event_id % 20 = 0 THEN 'CRITICAL' ELSE 'ERROR' END
      WHEN 'purchase' THEN 'WARNING' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END AS level,
    event_type = 'error' AS is_error,
    ['boiler','pump','alarm','office','dock'][CAST(user_id % 5 + 1 AS INTEGER)]
      AS service,
    'req-' || user_id AS correlation_id,
    CASE WHEN event_id % 10 = 7 THEN CASE WHEN ts < TIMESTAMP '{PERIOD_CUT}'
        THEN 'cache eviction storm shard ' || k ELSE 'disk quota exceeded volume ' || k END
      WHEN event_id % 4 = 0 THEN 'valve ' || k || ' stuck open on line id=' || event_id
      WHEN event_id % 4 = 1 THEN 'gauge at 192.0.2.' || k || ' reads nothing'
      WHEN event_id % 4 = 2 THEN 'badge of u' || user_id || '@example.test rejected at the gate'
      ELSE 'relay ' || (500 + k % 4) || ' dropped its frame request_id=' || event_id
    END AS message,
    event_id % 10 <> 7 AND event_id % 4 = 3 AS upstream,
    replace(CAST(ts AS VARCHAR), ' ', 'T') AS iso,
    event_id + 1 AS arrival
  FROM raw
)"""

# RE2 has no lookaround: characters at the borders are matched and put back, and a
# rule is applied twice for neighbours that share one border character.
_W = r"\w\p{L}\p{N}\p{M}"


def _twice(value: str, pattern: str, replacement: str) -> str:
    once = f"regexp_replace({value}, '{pattern}', '{replacement}', 'g')"
    return f"regexp_replace({once}, '{pattern}', '{replacement}', 'g')"


_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_SQL_MASKS = {
    "bearer_token": lambda v: (
        rf"regexp_replace({v}, '(?i)\b(bearer)\s+[A-Za-z0-9._~+/=-]{{8,}}', "
        r"'\1 [REDACTED_TOKEN]', 'g')"
    ),
    "api_key": lambda v: (
        rf"regexp_replace({v}, '(?i)\b(api[-_ ]?key|access[-_ ]?token|secret)\b(\s*[:=]\s*)"
        r"[\x22'']?[A-Za-z0-9._~+/=-]{6,}[\x22'']?', '\1\2[REDACTED_SECRET]', 'g')"
    ),
    "email": lambda v: _twice(
        v,
        rf"(?i)(^|[^{_W}.+-])[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}($|[^{_W}.-])",
        r"\1[REDACTED_EMAIL]\2",
    ),
    "ipv4": lambda v: _twice(
        v, rf"(^|[^\d.]){_OCTET}(?:\.{_OCTET}){{3}}($|[^\d.])", r"\1[REDACTED_IP]\2"
    ),
    "phone": lambda v: _twice(
        v,
        rf"(^|[^{_W}])(?:\+?\d[\s\p{{Z}}().-]*){{9,15}}($|[^{_W}])",
        r"\1[REDACTED_PHONE]\2",
    ),
}


def sql_mask_rule(name: str, value: str) -> str:
    return _SQL_MASKS[name](value)


def sql_mask(value: str) -> str:
    for rule in _SQL_MASKS.values():
        value = rule(value)
    return value


def _sql_number(value: str) -> str:
    """Numbers that no letter, digit or point touches, with a minus that none touches.

    Marks beside every other character let a pattern without lookaround see both borders.
    """
    for pattern, replacement in (
        (rf"([^{_W}.])", "\x01\\1\x01"),
        ("(^|\x01)[0-9]+(?:\\.[0-9]+)?($|\x01)", "\\1\x02\\2"),
        ("\x01", ""),
        (f"(^|[^{_W}.\x02])-\x02", "\\1\x02"),
        ("\x02", "<number>"),
    ):
        value = f"regexp_replace({value}, '{pattern}', '{replacement}', 'g')"
    return value


def sql_rules(value: str) -> dict[str, str]:
    """The normalisation rules, each on its own."""
    hexa = "[0-9a-f]"
    return {
        "uuid": rf"regexp_replace({value}, '(?i)\b{hexa}{{8}}-{hexa}{{4}}-[1-5]{hexa}{{3}}-"
        rf"[89ab]{hexa}{{3}}-{hexa}{{12}}\b', '<uuid>', 'g')",
        "timestamp": rf"regexp_replace({value}, '(?i)\b\d{{4}}-\d{{2}}-\d{{2}}[T ]\d{{2}}:\d{{2}}:"
        r"\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?\b', '<timestamp>', 'g')",
        "hex": rf"regexp_replace({value}, '(?i)\b(?:0x)?{hexa}{{16,}}\b', '<hex>', 'g')",
        "keyed_id": rf"regexp_replace({value}, '(?i)\b([a-z_]*(?:id|count|code|port))\s*[=:]\s*"
        r"\d+\b', '\1=<id>', 'g')",
        "number": _sql_number(value),
    }


def sql_normalize(value: str) -> str:
    value = f"lower({sql_mask(value)})"
    for name in ("uuid", "timestamp", "hex", "keyed_id", "number"):
        value = sql_rules(value)[name]
    return rf"coalesce(nullif(trim(regexp_replace({value}, '\s+', ' ', 'g')), ''), '<empty>')"


def sql_fingerprint(normalized: str) -> str:
    return f"left(sha256({normalized}), 16)"


# Errors with their normalised message and fingerprint, and buckets of all events.
ERRORS = f"""
normalized AS (
  SELECT *, {sql_normalize("message")} AS normalized_message, {sql_mask("message")} AS masked
  FROM app WHERE is_error
),
errors AS (
  SELECT *, {sql_fingerprint("normalized_message")} AS fingerprint FROM normalized
)"""
WINDOWS = """
windows AS (
  SELECT date_trunc('hour', "timestamp") AS start, count(*) AS total,
         CAST(sum(is_error::INT) AS BIGINT) AS errors,
         round_even(sum(is_error::INT) / count(*), 6) AS error_rate
  FROM app GROUP BY 1
)"""


def sql_app(select: str, *more: str) -> str:
    return f"WITH {', '.join([APP.strip(), *(part.strip() for part in more)])} {select}"
