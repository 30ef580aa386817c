"""Log analytics on Spark: parsing, error groups, detection, comparison, traces."""

from .operators.parse import events_of, issues_of, json_records, plain_records
from .operators.quality import require, validate_files
from .operators.redact import redact, redact_file
from .operators.trace import service_chains, trace_correlation, trace_spans
from .plans.analyze import analyze, analyze_files, compare, compare_files, write_report
from .plans.deliveries import add_delivery, analyze_store, compact_store, sweep_store, trace_store
from .plans.demo import generate_demo, write_logs
from .schema import AnalyzeOptions
from .session import build_session
from .sources.detect import detect_format
from .sources.lines import read_lines, read_numbered_lines
from .sources.records import read_records
from .sources.tables import records_from_table

__all__ = [
    "AnalyzeOptions",
    "add_delivery",
    "analyze",
    "analyze_files",
    "analyze_store",
    "build_session",
    "compact_store",
    "compare",
    "compare_files",
    "detect_format",
    "events_of",
    "generate_demo",
    "issues_of",
    "json_records",
    "plain_records",
    "read_lines",
    "read_numbered_lines",
    "read_records",
    "records_from_table",
    "redact",
    "redact_file",
    "require",
    "service_chains",
    "sweep_store",
    "trace_correlation",
    "trace_spans",
    "trace_store",
    "validate_files",
    "write_logs",
    "write_report",
]
