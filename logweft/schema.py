"""Row types and parameters.

All timestamps are ``TIMESTAMP_NTZ`` holding UTC wall-clock time, so that no
result depends on the session time zone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("level", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("correlation_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("line_number", T.LongType()),
        T.StructField("arrival", T.LongType()),
        T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
    ]
)
EVENT_COLUMNS = EVENT_SCHEMA.fieldNames()
ISSUE_COLUMNS = ["source", "line_number", "arrival", "reason", "preview"]


def _within(name: str, value: float, low: float, high: float | None) -> None:
    if value < low or (high is not None and value > high):
        raise ValueError(f"{name} must be between {low} and {high}, not {value}")


@dataclass(frozen=True)
class AnalyzeOptions:
    """Parameters of an analysis.

    The ``max_*`` caps bound the number of distinct keys kept, first come first
    kept. They are off (``None``) by default: results are then exact and whole.
    """

    window_minutes: int = 5
    top: int = 10
    burst_threshold: int = 10
    anomaly_zscore: float = 3.0
    default_timezone: str = "UTC"
    issue_sample_limit: int = 20
    max_error_groups: int | None = None
    max_windows: int | None = None
    max_services: int | None = None
    max_correlations: int | None = None

    def __post_init__(self) -> None:
        _within("window_minutes", self.window_minutes, 1, 1440)
        _within("top", self.top, 1, 100)
        _within("burst_threshold", self.burst_threshold, 1, None)
        _within("anomaly_zscore", self.anomaly_zscore, 0.1, 20.0)
        _within("issue_sample_limit", self.issue_sample_limit, 0, 1000)
        for name in ("max_error_groups", "max_windows", "max_services"):
            if getattr(self, name) is not None:
                _within(name, getattr(self, name), 1, 1_000_000)
        if self.max_correlations is not None:
            _within("max_correlations", self.max_correlations, 1, 100_000)
