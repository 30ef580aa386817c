"""Command for ``spark-submit``: one report or one copy per run.

    spark-submit --py-files logweft.zip job.py analyze LOGS... --output FOLDER
"""

from __future__ import annotations

import argparse

from logweft.operators.quality import (
    require,
    trace_gate,
    validate_files,
    validation_gates,
)
from logweft.operators.redact import redact_file
from logweft.operators.trace import trace_correlation
from logweft.plans.analyze import analyze_files, compare_files, write_report
from logweft.plans.deliveries import add_delivery, analyze_store
from logweft.plans.demo import generate_demo
from logweft.schema import AnalyzeOptions
from logweft.session import build_session
from logweft.sources.records import read_records


def parser() -> argparse.ArgumentParser:
    root = argparse.ArgumentParser(prog="logweft")
    commands = root.add_subparsers(dest="command", required=True)

    def command(name: str, *, inputs: bool = True, output: bool = True):
        sub = commands.add_parser(name)
        if inputs:
            sub.add_argument("paths", nargs="+")
            sub.add_argument("--default-timezone", default="UTC")
        if output:
            sub.add_argument("--output", required=True)
        return sub

    analyze = command("analyze")
    analyze.add_argument("--window-minutes", type=int, default=5)
    analyze.add_argument("--top", type=int, default=10)
    analyze.add_argument("--burst-threshold", type=int, default=10)
    analyze.add_argument("--anomaly-zscore", type=float, default=3.0)
    analyze.add_argument("--fail-on-malformed", action="store_true")
    analyze.add_argument("--fail-on-anomaly", action="store_true")
    deliver = command("deliver")
    deliver.add_argument("--store", required=True)
    deliver.add_argument("--window-minutes", type=int, default=5)
    deliver.add_argument("--keep-events", action="store_true")
    compare = command("compare")
    compare.add_argument("--current", nargs="+", required=True)
    compare.add_argument("--top", type=int, default=10)
    trace = command("trace")
    trace.add_argument("--correlation-id", required=True)
    trace.add_argument("--max-events", type=int, default=1000)
    command("validate")
    redact = command("redact", inputs=False)
    redact.add_argument("source")
    redact.add_argument("--overwrite", action="store_true")
    demo = command("generate-demo", inputs=False)
    demo.add_argument("--lines", type=int, default=1000)
    demo.add_argument("--log-format", default="jsonl")
    demo.add_argument("--seed", type=int, default=42)
    demo.add_argument("--gzip", action="store_true")
    return root


def run(spark, args: argparse.Namespace) -> None:
    if args.command == "analyze":
        options = AnalyzeOptions(
            window_minutes=args.window_minutes,
            top=args.top,
            burst_threshold=args.burst_threshold,
            anomaly_zscore=args.anomaly_zscore,
            default_timezone=args.default_timezone,
        )
        report = analyze_files(spark, args.paths, options)
        write_report(report, args.output)
        wanted = {"parse-quality": args.fail_on_malformed, "statistical-anomalies": args.fail_on_anomaly}
        chosen = [name for name, on in wanted.items() if on]
        require(report.gates.where(report.gates["gate"].isin(chosen)))
    elif args.command == "deliver":
        options = AnalyzeOptions(window_minutes=args.window_minutes, default_timezone=args.default_timezone)
        add_delivery(spark, args.store, args.paths, options, keep_events=args.keep_events)
        write_report(analyze_store(spark, args.store, options), args.output)
    elif args.command == "compare":
        report = compare_files(spark, args.paths, args.current, args.default_timezone, args.top)
        write_report(report, args.output)
    elif args.command == "trace":
        records = read_records(spark, args.paths, args.default_timezone)
        report = trace_correlation(records, args.correlation_id, args.max_events)
        write_report(report, args.output)
        require(trace_gate(report.summary))
    elif args.command == "validate":
        report = validate_files(spark, args.paths, args.default_timezone)
        write_report(report, args.output)
        require(validation_gates(report.files))
    elif args.command == "redact":
        print(redact_file(spark, args.source, args.output, args.overwrite))
    else:
        generate_demo(spark, args.output, args.lines, args.log_format, args.seed, args.gzip)


if __name__ == "__main__":
    run(build_session(), parser().parse_args())
