"""Counts, error groups, detection, comparison, traces and reports."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import caps, cells, compare, detection, errors, quality, summary, trace
from ..operators.parse import events_of
from ..plans.analyze import AnalysisReport, write_report
from ..plans.analyze import analyze as analyze_records
from ..plans.analyze import compare as compare_records
from ..plans.deliveries import add_delivery, analyze_store, compact_store, trace_store
from ..schema import AnalyzeOptions
from ..session import new_path
from ..sources.records import read_records
from .common import (
    BURST_THRESHOLD,
    ERRORS,
    PERIOD_CUT,
    WINDOW_MINUTES,
    WINDOWS,
    ZSCORE,
    app_events,
    app_records,
    app_rows,
    broken_folder,
    hop_events,
    json_line,
    periods,
    query,
    rendered,
    sql_app,
    sql_mask,
    write_lines,
)


def _cells(spark, sf_dir, *keys: str) -> DataFrame:
    """Cells of the application log by the given keys only."""
    keyed = cells.with_cube_keys(app_events(spark, sf_dir), WINDOW_MINUTES)
    return cells.count_cells(keyed, *keys)


@query("filter_errors", sql_app("SELECT arrival, level FROM app WHERE is_error"))
def filter_errors(spark, sf_dir):
    return summary.filter_errors(app_events(spark, sf_dir)).select("arrival", "level")


@query(
    "filter_correlation",
    sql_app("SELECT arrival, \"timestamp\", message FROM app WHERE correlation_id = 'req-7'"),
)
def filter_correlation(spark, sf_dir):
    found = trace.filter_correlation(app_events(spark, sf_dir), "req-7")
    return found.select("arrival", "timestamp", "message")


_SUMMARY = """
SELECT count(*) AS total_lines, count(*) AS parsed_lines, CAST(0 AS BIGINT) AS malformed_lines,
  CAST(sum(is_error::INT) AS BIGINT) AS error_count, min("timestamp") AS first_timestamp,
  max("timestamp") AS last_timestamp, round_even(sum(is_error::INT) / count(*), 6) AS error_rate
FROM app"""


@query("summary_counts", sql_app(_SUMMARY))
def summary_counts(spark, sf_dir):
    return summary.summary_counts(_cells(spark, sf_dir, "level"))


@query("levels_count", sql_app('SELECT level, count(*) AS "count" FROM app GROUP BY 1'))
def levels_count(spark, sf_dir):
    return summary.levels_count(_cells(spark, sf_dir, "level"))


@query("window_stats", sql_app("SELECT * FROM windows", WINDOWS))
def window_stats(spark, sf_dir):
    return summary.window_stats(_cells(spark, sf_dir, "bucket", "level"))


@query(
    "window_stats_7",
    sql_app(
        "SELECT start, count(*) AS total, CAST(sum(is_error::INT) AS BIGINT) AS errors, "
        "round_even(sum(is_error::INT) / count(*), 6) AS error_rate FROM (SELECT is_error, "
        "date_trunc('hour', \"timestamp\") + to_minutes(CAST(minute(\"timestamp\") AS BIGINT) // 7 * 7) "
        "AS start FROM app) GROUP BY 1"
    ),
)
def window_stats_7(spark, sf_dir):
    """Buckets of a length that does not divide the hour."""
    keyed = cells.with_cube_keys(app_events(spark, sf_dir), 7)
    return summary.window_stats(cells.count_cells(keyed, "bucket", "level"))


@query(
    "window_sort",
    sql_app("SELECT row_number() OVER (ORDER BY start) AS place, start FROM windows", WINDOWS),
)
def window_sort(spark, sf_dir):
    """Windows with their places in the sorted order."""
    windows = summary.window_stats(_cells(spark, sf_dir, "bucket", "level"))
    hours = F.timestamp_diff("HOUR", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), "start")
    # Days first: the running count then needs no single sort of all buckets.
    day = (hours / 24).cast("bigint")
    per_day = windows.groupBy(day.alias("day")).agg(F.count("*").alias("n"))
    before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_day.select("day", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    placed = windows.withColumn("day", day).withColumn(
        "rank", F.row_number().over(Window.partitionBy("day").orderBy("start"))
    )
    joined = placed.join(offsets, "day")
    return joined.select((F.col("rank") + F.col("offset")).alias("place"), "start")


@query(
    "errors_by_service",
    sql_app(
        'SELECT service, count(*) AS "count" FROM app WHERE is_error GROUP BY 1 '
        "ORDER BY 2 DESC, min(arrival) LIMIT 10"
    ),
)
def errors_by_service(spark, sf_dir):
    return summary.errors_by_service(_cells(spark, sf_dir, "level", "service"))


@query(
    "top_correlations",
    sql_app(
        'SELECT correlation_id, count(*) AS "count" FROM app GROUP BY 1 '
        "ORDER BY 2 DESC, min(arrival) LIMIT 10"
    ),
)
def top_correlations(spark, sf_dir):
    return summary.top_correlations(app_events(spark, sf_dir))


@query(
    "top_k",
    sql_app(
        'SELECT service, count(*) AS "count" FROM app GROUP BY 1 ORDER BY 2 DESC, min(arrival) LIMIT 3'
    ),
)
def top_k(spark, sf_dir):
    return summary.top_k(_cells(spark, sf_dir, "service"), "service", 3)


_GROUPS = (
    'SELECT fingerprint, normalized_message, count(*) AS "count", min("timestamp") AS first_seen, '
    'max("timestamp") AS last_seen FROM errors GROUP BY 1, 2'
)


@query("error_groups", sql_app(f"{_GROUPS} ORDER BY 3 DESC, 1 LIMIT 10", ERRORS))
def error_groups(spark, sf_dir):
    return errors.error_groups(_cells(spark, sf_dir, "level", "normalized_message"), 10)


_EXAMPLES = """
SELECT fingerprint, example_number, masked AS example FROM (
  SELECT fingerprint, masked, CAST(row_number() OVER (PARTITION BY fingerprint ORDER BY min(arrival))
    AS INTEGER) AS example_number
  FROM errors GROUP BY fingerprint, masked)
WHERE example_number <= 3"""


@query("error_examples", sql_app(_EXAMPLES, ERRORS))
def error_examples(spark, sf_dir):
    found = errors.error_examples(app_events(spark, sf_dir))
    return found.select("fingerprint", "example_number", "example")


@query(
    "services_per_group",
    sql_app(
        'SELECT fingerprint, service, count(*) AS "count", min(arrival) AS first_arrival '
        "FROM errors GROUP BY 1, 2",
        ERRORS,
    ),
)
def services_per_group(spark, sf_dir):
    found = errors.services_per_group(
        _cells(spark, sf_dir, "level", "service", "normalized_message")
    )
    return found.select("fingerprint", "service", "count", "first_arrival")


_CAPACITY = 50


@query(
    "first_seen_cap",
    sql_app(
        "SELECT correlation_id, count(*) AS n, min(arrival) AS first_arrival FROM app GROUP BY 1 "
        f"ORDER BY 3 LIMIT {_CAPACITY}"
    ),
)
def first_seen_cap(spark, sf_dir):
    counted = _cells(spark, sf_dir, "correlation_id")
    kept = caps.first_seen_cap(counted, "correlation_id", _CAPACITY)
    return kept.select("correlation_id", "n", "first_arrival")


@query(
    "dropped_counts",
    sql_app(
        "SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS dropped FROM (SELECT count(*) AS n, "
        "row_number() OVER (ORDER BY min(arrival)) AS place FROM app GROUP BY correlation_id) "
        f"WHERE place > {_CAPACITY}"
    ),
)
def dropped_counts(spark, sf_dir):
    counted = _cells(spark, sf_dir, "correlation_id")
    return caps.dropped_count(counted, "correlation_id", _CAPACITY)


@query(
    "summary_cube",
    sql_app(
        "SELECT date_trunc('hour', app.\"timestamp\") AS bucket, app.level, app.service, "
        "e.normalized_message, count(*) AS n, min(app.\"timestamp\") AS first_seen, "
        'max(app."timestamp") AS last_seen, min(app.arrival) AS first_arrival '
        "FROM app LEFT JOIN errors e USING (event_id) GROUP BY 1, 2, 3, 4",
        ERRORS,
    ),
)
def summary_cube(spark, sf_dir):
    return cells.summary_cube(app_events(spark, sf_dir), WINDOW_MINUTES)


@query(
    "detect_bursts",
    sql_app(
        "SELECT start, errors, CAST(errors AS DOUBLE) AS score, "
        f"'error count reached configured threshold ({BURST_THRESHOLD})' AS reason "
        f"FROM windows WHERE errors >= {BURST_THRESHOLD}",
        WINDOWS,
    ),
)
def detect_bursts(spark, sf_dir):
    windows = summary.window_stats(_cells(spark, sf_dir, "bucket", "level"))
    return detection.detect_bursts(windows, BURST_THRESHOLD)


_ANOMALIES = f"""
SELECT start, errors, round_even(z, 3) AS score, 'error count is ' || format('{{:.2f}}', z) ||
  ' standard deviations above the mean' AS reason
FROM (SELECT start, errors, (errors - avg(errors) OVER ()) / stddev_pop(errors) OVER () AS z
      FROM windows)
WHERE z >= {ZSCORE}"""


@query("detect_anomalies", sql_app(_ANOMALIES, WINDOWS))
def detect_anomalies(spark, sf_dir):
    windows = summary.window_stats(_cells(spark, sf_dir, "bucket", "level"))
    return detection.detect_anomalies(windows, ZSCORE)


# Comparison.

_PERIOD = f"CASE WHEN \"timestamp\" < TIMESTAMP '{PERIOD_CUT}' THEN 'baseline' ELSE 'current' END"
_TOTALS = f"""
totals AS (
  SELECT count(*) FILTER (p = 'baseline') AS baseline_total,
    count(*) FILTER (p = 'current') AS current_total,
    count(*) FILTER (p = 'baseline' AND is_error) AS baseline_errors,
    count(*) FILTER (p = 'current' AND is_error) AS current_errors
  FROM (SELECT *, {_PERIOD} AS p FROM app)
),
rates AS (
  SELECT *, round_even(baseline_errors / baseline_total, 6) AS baseline_error_rate,
    round_even(current_errors / current_total, 6) AS current_error_rate FROM totals
)"""
_PERIOD_GROUPS = f"""
groups AS (
  SELECT {_PERIOD} AS p, fingerprint, normalized_message, count(*) AS n,
    row_number() OVER (PARTITION BY {_PERIOD} ORDER BY count(*) DESC, fingerprint) AS place
  FROM errors GROUP BY 1, 2, 3
)"""


def _period_cells(spark, sf_dir, *keys: str) -> DataFrame:
    tagged = compare.tag_periods(*periods(spark, sf_dir))
    return cells.count_cells(cells.with_cube_keys(tagged), "period", *keys)


@query(
    "compare_summary",
    sql_app(
        "SELECT *, current_total - baseline_total AS total_delta, "
        "current_errors - baseline_errors AS error_delta, "
        "round_even(current_error_rate - baseline_error_rate, 6) AS error_rate_delta FROM rates",
        _TOTALS,
    ),
)
def compare_summary(spark, sf_dir):
    return compare.compare_summary(_period_cells(spark, sf_dir, "level"))


def _sql_only_in(period: str, top: int) -> str:
    return (
        f"SELECT fingerprint, normalized_message FROM groups WHERE p = '{period}' AND place <= {top} "
        f"AND fingerprint NOT IN (SELECT fingerprint FROM groups WHERE p <> '{period}' "
        f"AND place <= {top})"
    )


@query("new_errors", sql_app(_sql_only_in("current", 10), ERRORS, _PERIOD_GROUPS))
def new_errors(spark, sf_dir):
    return compare.new_errors(_period_cells(spark, sf_dir, "level", "normalized_message"))


@query("resolved_errors", sql_app(_sql_only_in("baseline", 10), ERRORS, _PERIOD_GROUPS))
def resolved_errors(spark, sf_dir):
    found = _period_cells(spark, sf_dir, "level", "normalized_message")
    return compare.resolved_errors(found)


@query(
    "service_error_deltas",
    sql_app(
        "SELECT service, CAST(count(*) FILTER (p = 'current') - count(*) FILTER (p = 'baseline') "
        f"AS BIGINT) AS error_delta FROM (SELECT *, {_PERIOD} AS p FROM app WHERE is_error) GROUP BY 1"
    ),
)
def service_error_deltas(spark, sf_dir):
    return compare.service_error_deltas(_period_cells(spark, sf_dir, "level", "service"))


@query(
    "compare_untruncated",
    sql_app(
        "SELECT fingerprint, normalized_message, b AS baseline_count, c AS current_count, "
        "c - b AS delta, CASE WHEN b = 0 THEN 'new' WHEN c = 0 THEN 'resolved' WHEN c > b THEN "
        "'increasing' WHEN c < b THEN 'decreasing' ELSE 'unchanged' END AS change FROM ("
        "SELECT fingerprint, normalized_message, CAST(coalesce(sum(n) FILTER (p = 'baseline'), 0) AS "
        "BIGINT) AS b, CAST(coalesce(sum(n) FILTER (p = 'current'), 0) AS BIGINT) AS c "
        "FROM groups GROUP BY 1, 2)",
        ERRORS,
        _PERIOD_GROUPS,
    ),
)
def compare_untruncated(spark, sf_dir):
    return compare.error_changes(_period_cells(spark, sf_dir, "level", "normalized_message"))


# Traces over events whose service changes from event to event.

_HOPS = """
hops AS (
  SELECT event_id, "timestamp", correlation_id, level, is_error,
    ['boiler','pump','alarm'][CAST(event_id % 3 + 1 AS INTEGER)] AS service, message, arrival
  FROM app
),
moves AS (
  SELECT *, row_number() OVER (PARTITION BY correlation_id ORDER BY "timestamp") AS step FROM (
    SELECT *, lag(service) OVER (PARTITION BY correlation_id ORDER BY "timestamp") AS previous
    FROM hops)
  WHERE previous IS DISTINCT FROM service
)"""


@query(
    "service_chain",
    sql_app(
        'SELECT correlation_id, step, service, "timestamp", arrival AS line_number FROM moves', _HOPS
    ),
)
def service_chain(spark, sf_dir):
    found = trace.service_chains(events_of(hop_events(spark, sf_dir)))
    return found.select(
        "correlation_id", F.col("step").cast("bigint").alias("step"), "service", "timestamp",
        "line_number",
    )


@query(
    "trace_sort",
    sql_app(
        'SELECT "timestamp", arrival AS line_number FROM app ORDER BY "timestamp", arrival LIMIT 1000'
    ),
)
def trace_sort(spark, sf_dir):
    events = app_events(spark, sf_dir)
    return events.orderBy(*trace.TRACE_ORDER).limit(1000).select("timestamp", "line_number")


_TRACED = "(SELECT * FROM hops WHERE correlation_id = 'req-7' ORDER BY \"timestamp\" LIMIT 30)"


@query(
    "trace_correlation",
    sql_app(
        "SELECT 'req-7' AS correlation_id, (SELECT count(*) FROM hops WHERE correlation_id = 'req-7') "
        "AS matched_events, (SELECT count(*) FROM t) AS returned_events, "
        "(SELECT count(*) FROM hops WHERE correlation_id = 'req-7') > 30 AS truncated, "
        "(SELECT string_agg(service, '>' ORDER BY \"timestamp\") FROM (SELECT *, lag(service) OVER "
        '(ORDER BY "timestamp") AS before FROM t) WHERE before IS DISTINCT FROM service) '
        "AS service_chain, CAST(0 AS BIGINT) AS malformed_lines",
        _HOPS,
        f"t AS {_TRACED}",
    ),
)
def trace_correlation(spark, sf_dir):
    report = trace.trace_correlation(hop_events(spark, sf_dir), "req-7", 30)
    return report.summary.withColumn("service_chain", F.array_join("service_chain", ">"))


@query(
    "trace_all",
    sql_app(
        'SELECT correlation_id, min("timestamp") AS first_seen, max("timestamp") AS last_seen, '
        'count(*) AS "events", CAST(sum(is_error::INT) AS BIGINT) AS errors, '
        "(SELECT count(*) FROM moves m WHERE m.correlation_id = hops.correlation_id) AS steps "
        "FROM hops GROUP BY 1",
        _HOPS,
    ),
)
def trace_all(spark, sf_dir):
    events = events_of(hop_events(spark, sf_dir))
    steps = trace.service_chains(events).groupBy("correlation_id").agg(F.count("*").alias("steps"))
    return trace.trace_spans(events).join(steps, "correlation_id")


# Reports.


_REPORT = sql_app(
        "SELECT 'level' AS section, level AS name, count(*) AS n FROM app GROUP BY 2 "
        "UNION ALL SELECT 'service', service, count(*) FROM app WHERE is_error GROUP BY 2 "
        "UNION ALL SELECT 'error', fingerprint, count(*) FROM errors GROUP BY 2 "
        "UNION ALL SELECT 'error service', fingerprint || ' ' || service, count(*) FROM errors "
        "GROUP BY fingerprint, service "
        f"UNION ALL SELECT 'example', fingerprint || ' ' || example, example_number FROM ({_EXAMPLES}) "
        "UNION ALL SELECT * FROM (SELECT 'correlation', correlation_id, count(*) FROM app GROUP BY 2 "
        "ORDER BY 3 DESC, min(arrival) LIMIT 10) "
        "UNION ALL SELECT 'window', CAST(start AS VARCHAR), total FROM windows "
        f"UNION ALL SELECT 'burst', CAST(start AS VARCHAR), errors FROM windows WHERE errors >= {BURST_THRESHOLD} "
        f"UNION ALL SELECT 'anomaly', CAST(start AS VARCHAR), errors FROM ({_ANOMALIES}) "
        "UNION ALL SELECT 'service of error', fingerprint || ' ' || service, count(*) FROM errors "
        "GROUP BY fingerprint, service "
        "UNION ALL SELECT 'summary', 'total_lines', count(*) FROM app "
        "UNION ALL SELECT 'summary', 'malformed_lines', 0 "
        "UNION ALL SELECT 'summary', 'error_count', count(*) FROM app WHERE is_error "
        "UNION ALL SELECT 'dropped', 'dropped_error_groups', 0 "
        "UNION ALL SELECT 'dropped', 'dropped_windows', 0 "
        "UNION ALL SELECT 'gate', 'parse-quality', 1 "
        f"UNION ALL SELECT 'gate', 'statistical-anomalies', (count(*) = 0)::BIGINT FROM ({_ANOMALIES})",
        ERRORS,
        WINDOWS,
)
_OPTIONS = AnalyzeOptions(
    window_minutes=WINDOW_MINUTES, burst_threshold=BURST_THRESHOLD, anomaly_zscore=ZSCORE
)


def report_sections(report: AnalysisReport) -> DataFrame:
    """The tables of a report in one: section, name and n."""

    def section(name: str, rows: DataFrame, key, count) -> DataFrame:
        return rows.select(
            F.lit(name).alias("section"), key.cast("string").alias("name"),
            F.col(count).cast("bigint").alias("n"),
        )

    def row_of(name: str, rows: DataFrame, *columns: str) -> DataFrame:
        return rows.select(
            F.lit(name).alias("section"),
            F.explode(F.create_map(*(x for c in columns for x in (F.lit(c), F.col(c).cast("bigint")))))
            .alias("name", "n"),
        )

    start = F.col("start")
    services = report.top_errors.select("fingerprint", F.explode("services").alias("service", "count"))
    gates = report.gates.withColumn("passed", F.col("passed").cast("int"))
    examples = report.top_errors.select(
        "fingerprint", F.posexplode("examples").alias("place", "example")
    ).withColumn("place", F.col("place") + 1)
    parts = [
        section("level", report.levels, F.col("level"), "count"),
        section("service", report.errors_by_service, F.col("service"), "count"),
        section("error", report.top_errors, F.col("fingerprint"), "count"),
        section("error service", report.top_error_services,
                F.concat_ws(" ", "fingerprint", "service"), "count"),
        section("example", examples, F.concat_ws(" ", "fingerprint", "example"), "place"),
        section("correlation", report.top_correlations, F.col("correlation_id"), "count"),
        section("window", report.windows, start, "total"),
        section("burst", report.bursts, start, "errors"),
        section("anomaly", report.anomalies, start, "errors"),
        section("service of error", services, F.concat_ws(" ", "fingerprint", "service"), "count"),
        row_of("summary", report.summary, "total_lines", "malformed_lines", "error_count"),
        row_of("dropped", report.dropped, "dropped_error_groups", "dropped_windows"),
        section("gate", gates, F.col("gate"), "passed"),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@query("analyze", _REPORT)
def analyze(spark, sf_dir):
    return report_sections(analyze_records(app_records(spark, sf_dir), _OPTIONS))


@query("write_report_json", _REPORT)
def write_report_json(spark, sf_dir):
    """All tables of the report, as read back from where they were written."""
    target = new_path(spark, "report")
    report = analyze_records(app_records(spark, sf_dir), _OPTIONS)
    write_report(report, target)
    tables = {field.name: getattr(report, field.name).schema for field in fields(report)}
    return report_sections(
        AnalysisReport(**{n: spark.read.schema(s).json(f"{target}/{n}") for n, s in tables.items()})
    )


_STORES: dict[tuple, str] = {}


def _store(spark, sf_dir) -> str:
    """The log in three deliveries, the first two merged before the third. Made once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        store = new_path(spark, "store")
        total = app_rows(spark, sf_dir).count()
        for number in range(3):

            def write(rows: DataFrame, folder: str, number: int = number) -> None:
                third = F.floor(F.col("event_id") * 3 / total)
                write_lines(json_line())(rows.where(third == number), folder)

            folder = rendered(spark, sf_dir, f"third{number}", write)
            add_delivery(spark, store, folder, _OPTIONS, "jsonl", keep_events=True)
            if number == 1:
                compact_store(spark, store)
        _STORES[key] = store
    return _STORES[key]


@query("analyze_deliveries", _REPORT)
def analyze_deliveries(spark, sf_dir):
    return report_sections(analyze_store(spark, _store(spark, sf_dir), _OPTIONS))


@query(
    "trace_deliveries",
    sql_app(
        f"SELECT \"timestamp\", service, level, {sql_mask('message')} AS message, matched_events FROM (SELECT *, "
        "row_number() OVER (ORDER BY \"timestamp\", arrival) AS place, count(*) OVER () AS matched_events "
        "FROM app WHERE correlation_id = 'req-7') WHERE place <= 30"
    ),
)
def trace_deliveries(spark, sf_dir):
    """An ID looked up in a store."""
    report = trace_store(spark, _store(spark, sf_dir), "req-7", 30)
    matched = report.summary.select("matched_events").scalar()
    return report.events.drop("source", "line_number").withColumn("matched_events", matched)


@query(
    "quality_gates",
    sql_app(
        "SELECT 'parse-quality' AS gate, FALSE AS passed, "
        "CAST(count(*) AS VARCHAR) || ' malformed lines' AS detail FROM app WHERE event_id % 50 < 8 "
        "UNION ALL SELECT 'statistical-anomalies', count(*) = 0, CASE WHEN count(*) > 0 THEN "
        f"CAST(count(*) AS VARCHAR) || ' anomalous windows' END FROM ({_ANOMALIES}) "
        "UNION ALL SELECT 'error-regression', current_errors <= baseline_errors, CASE WHEN "
        "current_errors > baseline_errors THEN 'error count increased by ' || "
        "(current_errors - baseline_errors) END FROM totals "
        "UNION ALL SELECT 'trace:req-7', TRUE, NULL "
        "UNION ALL SELECT 'trace:nobody', FALSE, 'correlation ID was not found'",
        WINDOWS,
        _TOTALS,
    ),
)
def quality_gates(spark, sf_dir):
    broken = read_records(spark, broken_folder(spark, sf_dir), log_format="jsonl")
    records = app_records(spark, sf_dir)
    windows = summary.window_stats(_cells(spark, sf_dir, "bucket", "level"))
    comparison = compare_records(*periods(spark, sf_dir))
    gates = [
        quality.parse_gate(summary.summary_counts(cells.count_cells(broken, "level"))),
        quality.anomaly_gate(detection.detect_anomalies(windows, ZSCORE)),
        comparison.gates,
        quality.trace_gate(trace.trace_correlation(records, "req-7").summary),
        quality.trace_gate(trace.trace_correlation(records, "nobody").summary),
    ]
    result = gates[0]
    for gate in gates[1:]:
        result = result.unionByName(gate)
    return result
