"""From lines and cells to records.

A record is an event (``reason`` is NULL) or a dead letter (``reason`` says why).
Each ``*_records`` function takes rows with a text column and any other columns,
which are passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    DEFAULT_SERVICE,
    MAX_CORRELATION_CHARS,
    MAX_SERVICE_CHARS,
    PLAIN_HEAD,
    PREVIEW_CHARS,
    UNICODE,
)
from ..functions.fields import (
    blanks_to_null,
    extra_fields,
    extra_keys,
    extract_pairs,
    last_value,
    parse_level,
    pick_field,
    strip_pairs,
    with_reversed_keys,
)
from ..functions.text import blank_to_null, is_filled, quoted, strip
from ..functions.timestamps import canonical_stripped, utc_from_canonical

RECORD_COLUMNS = [
    "timestamp",
    "level",
    "service",
    "message",
    "correlation_id",
    "fields",
    "reason",
    "preview",
]
_EXTRACTED = ["_time_text", "_level_text", "service", "message", "correlation_id", "fields"]


def _names(df: DataFrame, *without: str) -> list[str]:
    return [name for name in df.columns if name not in without]


def _empty_line(line: Column) -> Column:
    return F.when(~is_filled(line), F.lit("empty line"))


def _missing(text: Column, field: str) -> Column:
    return F.when(text.isNull(), F.lit(f"required field is missing: {field}"))


def finish_records(
    extracted: DataFrame, default_timezone: str, preview: Column | None = None
) -> DataFrame:
    """Read time and level, check the rules in order, and keep one reason.

    A column ``_time`` is taken as the time read already. ``preview``, in place of a column
    ``_preview_text``, is computed from the other columns for dead letters only.
    """
    keep = _names(extracted, *_EXTRACTED, "_shape_reason", "_preview_text", "_time")
    timed = extracted.withColumn("_level", parse_level(F.col("_level_text")))
    # A filter on the result must not be pushed below the parsing: it would repeat
    # the nested expressions many times over. This never-true condition depends on
    # the partition and therefore stops it.
    stop = F.when(F.spark_partition_id() < 0, F.lit(""))
    if "_time" not in extracted.columns:
        # Steps of their own, as the later ones use the earlier ones many times.
        timed = (
            timed.withColumn("_stripped", strip(F.col("_time_text")))
            .withColumn("_canonical", canonical_stripped(F.col("_stripped")))
            .withColumn("_time", utc_from_canonical(F.col("_canonical"), default_timezone))
        )
    service, correlation = F.col("service"), F.col("correlation_id")
    checked = timed.withColumn(
        "reason",
        F.coalesce(
            "_shape_reason",
            F.when(
                F.col("_time").isNull(),
                F.concat(F.lit("unrecognized timestamp: "), quoted(F.col("_time_text"))),
            ),
            F.when(
                F.col("_level").isNull(),
                F.concat(F.lit("unsupported log level: "), quoted(F.col("_level_text"))),
            ),
            F.when(service == "", F.lit("service is empty")),
            F.when(
                F.char_length(service) > MAX_SERVICE_CHARS,
                F.lit(f"service is longer than {MAX_SERVICE_CHARS} characters"),
            ),
            F.when(
                F.char_length(correlation) > MAX_CORRELATION_CHARS,
                F.lit(f"correlation_id is longer than {MAX_CORRELATION_CHARS} characters"),
            ),
            stop,
        ),
    )
    good = F.col("reason").isNull()
    preview = F.col("_preview_text") if preview is None else preview
    one_line = F.translate(preview, "\r\n", "  ")
    return checked.select(
        *keep,
        F.when(good, F.col("_time")).alias("timestamp"),
        F.when(good, F.col("_level")).alias("level"),
        F.when(good, service).alias("service"),
        F.when(good, F.col("message")).alias("message"),
        F.when(good, blank_to_null(correlation)).alias("correlation_id"),
        F.when(good, F.col("fields")).alias("fields"),
        "reason",
        F.when(~good, F.left(one_line, F.lit(PREVIEW_CHARS))).alias("preview"),
    )


def plain_records(lines: DataFrame, default_timezone: str = "UTC") -> DataFrame:
    """Lines of the form ``<timestamp> <level> <tail>`` in column ``value``."""
    keep = _names(lines, "value")
    line = F.col("value")
    head = F.regexp_extract(line, UNICODE + PLAIN_HEAD, 0)
    split = (
        lines.withColumn("_head", head)
        .withColumn("_tail", F.substr(line, F.char_length("_head") + 1))
        .withColumn("_pairs", extract_pairs(F.col("_tail")))
    )
    extracted = split.select(
        *keep,
        F.regexp_extract("_head", UNICODE + PLAIN_HEAD, 1).alias("_time_text"),
        F.regexp_extract("_head", UNICODE + PLAIN_HEAD, 2).alias("_level_text"),
        F.coalesce(last_value(F.col("_pairs"), "service"), F.lit(DEFAULT_SERVICE)).alias("service"),
        strip_pairs(F.col("_tail")).alias("message"),
        last_value(F.col("_pairs"), "correlation_id").alias("correlation_id"),
        F.lit(None).cast("map<string,string>").alias("fields"),
        F.coalesce(
            _empty_line(line),
            F.when(
                F.col("_head") == "",
                F.lit("plain line does not match '<timestamp> <level> <message>'"),
            ),
        ).alias("_shape_reason"),
        line.alias("_preview_text"),
    )
    return finish_records(extracted, default_timezone)


def mapping_records(
    rows: DataFrame, keys: Column, values: Column, preview: Column, default_timezone: str = "UTC"
) -> DataFrame:
    """Rows whose keys and values are parallel arrays, the keys as made by ``reversed_keys``.

    ``rows`` must have ``_shape_reason``. ``preview`` is the text of a dead letter.
    """
    keep = _names(rows, "_shape_reason")
    arrays = rows.withColumns({"_keys": keys, "_raw": F.reverse(values)})
    arrays = arrays.withColumns({"_values": blanks_to_null(F.col("_raw")), "_extra": extra_keys(F.col("_keys"))})
    found = arrays.select(
        *keep,
        "_shape_reason",
        *(
            pick_field(F.col("_keys"), F.col("_values"), field).alias(alias)
            for field, alias in (
                ("timestamp", "_time_text"),
                ("level", "_level_text"),
                ("message", "message"),
                ("service", "_service"),
                ("correlation_id", "_correlation"),
            )
        ),
        extra_fields(F.col("_extra"), F.col("_keys"), F.col("_raw")).alias("fields"),
    )
    extracted = found.select(
        *keep,
        "_time_text",
        "_level_text",
        "message",
        F.coalesce(strip(F.col("_service")), F.lit(DEFAULT_SERVICE)).alias("service"),
        strip(F.col("_correlation")).alias("correlation_id"),
        "fields",
        F.coalesce(
            "_shape_reason",
            _missing(F.col("_time_text"), "timestamp"),
            _missing(F.col("_level_text"), "level"),
            _missing(F.col("message"), "message"),
        ).alias("_shape_reason"),
    )
    return finish_records(extracted, default_timezone, preview)


def with_json_object(rows: DataFrame, text: Column, name: str) -> DataFrame:
    """Add the map of a text that is exactly one JSON object, else NULL.

    The reader ignores whatever follows a complete value, so the text is read as
    the only element of an array. A text that closes this array itself is read
    once more as a member of an object.
    """
    options = {"allowSingleQuotes": "false"}
    elements = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<map<string,string>>", options)
    member = F.from_json(
        F.concat(F.lit('{"r":'), text, F.lit("}")), "struct<r:map<string,string>>", options
    )
    closes_array = text.contains("]") & F.rlike(text, F.lit(r"\}\s*\]"))
    ends = text.endswith("}") | strip(text).endswith("}")
    read = F.when(ends & (~closes_array | member["r"].isNotNull()), elements)
    # A step of its own, so that the text is read once.
    found = rows.withColumn("_elements", read)
    return found.withColumn(name, F.when(F.size("_elements") == 1, F.get("_elements", F.lit(0)))).drop("_elements")


def json_records(lines: DataFrame, default_timezone: str = "UTC") -> DataFrame:
    """Lines that hold one JSON object each, in column ``value``."""
    keep = _names(lines, "value")
    line = F.col("value")
    read = with_json_object(lines, line, "_object")
    other_json = ~strip(line).startswith("{") & F.get_json_object(line, "$").isNotNull()
    rows = read.select(
        *keep,
        "value",
        "_object",
        F.coalesce(
            _empty_line(line),
            F.when(
                F.col("_object").isNull(),
                F.when(other_json, F.lit("JSON value must be an object")).otherwise(
                    F.lit("invalid JSON")
                ),
            ),
        ).alias("_shape_reason"),
    )
    named = with_reversed_keys(rows, F.map_keys("_object"), "_names")
    records = mapping_records(named, F.col("_names"), F.map_values("_object"), line, default_timezone)
    return records.drop("value", "_object", "_names")


def events_of(records: DataFrame) -> DataFrame:
    """The parsed rows."""
    return records.where(F.col("reason").isNull()).drop("reason", "preview")


def issues_of(records: DataFrame) -> DataFrame:
    """The dead letters."""
    position = [name for name in ("source", "line_number", "arrival") if name in records.columns]
    return records.where(F.col("reason").isNotNull()).select(*position, "reason", "preview")
