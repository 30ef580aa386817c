"""Recognition of timestamp text and conversion to UTC.

Every accepted notation is first brought into one shape (``canonical_timestamp``),
which is then read and moved to UTC (``utc_from_canonical``). Nothing here depends
on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import EPOCH_MILLIS_FROM
from .text import blank_to_null, let, strip

_OFFSET = r"(?:Z|[+-]\d{2}(?::?\d{2}(?::?\d{2})?)?)"
_ISO = (
    r"^(?!0000)\d{4}-\d{2}-\d{2}"
    rf"(?:.\d{{2}}(?::\d{{2}}(?::\d{{2}}(?:[.,]\d+)?)?)?(?: ?{_OFFSET})?)?$"
)
_BASIC_TIME = (
    r"\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d+)?)?)?|\d{2}(?:\d{2}(?:\d{2}(?:[.,]\d+)?)?)?"
)
_BASIC = (
    r"^(?!0000)(\d{4})(-?)(\d{2})\2(\d{2})"
    rf"(?:[^\d-]({_BASIC_TIME})({_OFFSET})?)?$"
)
_WEEK = r"^(?!0000)(\d{4})-?W(\d{2})(?:-?([1-7]))?$"
_LOOSE = (
    r"^(?!0000)(\d{4})([-/])(\d{1,2})\2(\d{1,2})\s+"
    r"(\d{1,2}:\d{1,2}:\d{1,2})((?:[.,]\d{1,6})?)$"
)
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_ACCESS = (
    r"(?i)^(\d{1,2})/(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)/(\d{4}):"
    rf"(\d{{1,2}}:\d{{1,2}}:\d{{1,2}})\s+({_OFFSET})$"
)
_NUMERIC = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"

_MIN_EPOCH = -62_135_596_800
_MAX_EPOCH = 253_402_300_800


def _group(value: Column, pattern: str, index: int) -> Column:
    return F.regexp_extract(value, pattern, index)


def _matches(value: Column, pattern: str) -> Column:
    return F.rlike(value, F.lit(pattern))


def _basic(value: Column) -> Column:
    day = F.concat_ws("-", *(_group(value, _BASIC, i) for i in (1, 3, 4)))
    digits = F.translate(F.replace(_group(value, _BASIC, 5), F.lit(":")), ",", ".")
    time = F.concat_ws(
        ":",
        F.left(digits, F.lit(2)),
        *(
            F.coalesce(blank_to_null(F.substring(digits, start, length)), F.lit("00"))
            for start, length in ((3, 2), (5, 80))
        ),
    )
    return F.when(digits == "", day).otherwise(
        F.concat(day, F.lit("T"), time, _group(value, _BASIC, 6))
    )


def _week(value: Column) -> Column:
    """ISO week date; the week must exist in its year."""
    week = _group(value, _WEEK, 2).cast("int")
    weekday = F.coalesce(blank_to_null(_group(value, _WEEK, 3)), F.lit("1")).cast("int")
    january4 = F.concat(_group(value, _WEEK, 1), F.lit("-01-04")).cast("date")
    monday = F.date_sub(january4, F.weekday(january4))
    day = F.date_add(monday, (week - 1) * 7 + weekday - 1)
    return F.when(F.weekofyear(day) == week, day.cast("string"))


def _access_log(value: Column) -> Column:
    month = (F.instr(F.lit(_MONTHS), F.lower(_group(value, _ACCESS, 2))) + 2) / 3
    day = F.concat_ws(
        "-",
        _group(value, _ACCESS, 3),
        F.lpad(month.cast("int").cast("string"), 2, "0"),
        F.lpad(_group(value, _ACCESS, 1), 2, "0"),
    )
    return F.concat(day, F.lit("T"), _group(value, _ACCESS, 4), _group(value, _ACCESS, 5))


def _loose(value: Column) -> Column:
    day = F.concat_ws(
        "-",
        _group(value, _LOOSE, 1),
        F.lpad(_group(value, _LOOSE, 3), 2, "0"),
        F.lpad(_group(value, _LOOSE, 4), 2, "0"),
    )
    fraction = F.translate(_group(value, _LOOSE, 6), ",", ".")
    usable = (_group(value, _LOOSE, 2) == "-") | (fraction == "")
    return F.when(usable, F.concat(day, F.lit("T"), _group(value, _LOOSE, 5), fraction))


def canonical_timestamp(value: Column) -> Column:
    """``YYYY-MM-DD[THH[:MM[:SS[.f]]][offset]]`` for date text, the number itself
    for epoch text, NULL for anything else."""
    return let(strip(value), canonical_stripped)


def canonical_stripped(text: Column) -> Column:
    """The same for a text without blanks at its ends, which is used many times."""
    return (
        F.when(
            _matches(text, _ISO),
            F.when(F.length(text) == 10, text).otherwise(
                F.concat(
                    F.left(text, F.lit(10)),
                    F.lit("T"),
                    F.replace(F.replace(F.substring(text, 12, 80), F.lit(","), F.lit(".")), F.lit(" ")),
                )
            ),
        )
        .when(
            _matches(text, r"^\d{8}$") & _basic(text).try_cast("timestamp_ntz").isNotNull(),
            _basic(text),
        )
        .when(_matches(text, _NUMERIC), text)
        .when(_matches(text, _BASIC), _basic(text))
        .when(_matches(text, _LOOSE), _loose(text))
        .when(_matches(text, _ACCESS), _access_log(text))
        .when(_matches(text, _WEEK), _week(text))
    )


def _offset_seconds(zone: Column) -> Column:
    digits = F.rpad(F.regexp_replace(F.substring(zone, 2, 12), ":", ""), 6, "0")
    seconds = (
        F.substring(digits, 1, 2).cast("int") * 3600
        + F.substring(digits, 3, 2).cast("int") * 60
        + F.substring(digits, 5, 2).cast("int")
    )
    return F.when(F.left(zone, F.lit(1)) == "-", -seconds).otherwise(seconds)


def instant_to_utc(instant: Column) -> Column:
    """UTC wall-clock time of a ``TIMESTAMP``, whatever the session time zone."""
    return _from_micros(F.unix_micros(instant))


def utc_to_instant(utc: Column) -> Column:
    """The ``TIMESTAMP`` of a UTC wall-clock time, whatever the session time zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, utc))


def local_to_utc(local: Column, zone: str) -> Column:
    """UTC wall-clock time of a time without zone, read in ``zone``."""
    if zone.upper() == "UTC":
        return local
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), local)


def _from_micros(micros: Column) -> Column:
    return F.timestamp_add(
        "MICROSECOND", micros, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    )


def epoch_to_utc(number: Column) -> Column:
    """Epoch seconds, or milliseconds if the number is too large for seconds."""
    scaled = F.when(F.abs(number) > EPOCH_MILLIS_FROM, number / 1000).otherwise(number)

    def from_seconds(seconds: Column) -> Column:
        whole = F.floor(seconds)
        micros = F.rint((seconds - whole) * 1_000_000).cast("bigint")
        in_range = (seconds >= _MIN_EPOCH) & (seconds < _MAX_EPOCH)
        return F.when(in_range, _from_micros(whole * F.lit(1_000_000).cast("bigint") + micros))

    return let(scaled, from_seconds)


def _in_years(utc: Column) -> Column:
    return F.when(F.year(utc).between(1, 9999), utc)


def utc_from_canonical(canonical: Column, default_timezone: str = "UTC") -> Column:
    """Read the output of ``canonical_timestamp`` as UTC wall-clock time."""
    time = F.substring(canonical, 12, 80)

    def to_utc(local: Column) -> Column:
        zone = F.regexp_extract(time, r"([+-][\d:]+)$", 1)
        offset = let(zone, lambda text: _offset_seconds(text).cast("decimal(18,6)"))
        shifted = local - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), offset)
        naive = local
        if default_timezone.upper() != "UTC":
            naive = let(local_to_utc(local, default_timezone), _in_years)
        return (
            F.when(time.endswith("Z"), local)
            .when(time.contains("+") | time.contains("-"), let(shifted, _in_years))
            .otherwise(naive)
        )

    dated = (F.substring(canonical, 5, 1) == "-") & (F.substring(canonical, 8, 1) == "-")
    return F.when(dated, let(canonical.try_cast("timestamp_ntz"), to_utc)).otherwise(
        let(canonical.try_cast("double"), epoch_to_utc)
    )


def parse_timestamp(value: Column, default_timezone: str = "UTC") -> Column:
    """UTC time of a timestamp text, NULL if it is not recognised."""
    canonical = let(strip(value), canonical_stripped)
    return let(canonical, lambda text: utc_from_canonical(text, default_timezone))
