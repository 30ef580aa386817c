"""Headline queries at ``$BENCH_SF_DIR``; prints one JSON line.

Log files are written from the tables before the clock starts; each query is run
once to warm up and then timed over its whole result.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "analyze",
    "error_groups",
    "error_examples",
    "window_stats",
    "detect_anomalies",
    "top_correlations",
    "compare_untruncated",
    "trace_correlation",
    "trace_all",
    "map_aliases",
    "parse_plain",
    "mask_text",
    "normalize_documents",
    "sensitive_type_counts",
    "dead_letter",
    "scan_csv",
]


def main() -> None:
    from logweft.plans.analyze import analyze_files
    from logweft.queries import QUERIES
    from logweft.queries.common import json_folder, plain_folder
    from logweft.session import build_session, new_path

    spark = build_session(
        "bench",
        **{
            "spark.master": f"local[{CPUS}]",
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            # The files are small: cut them finely enough for all cores.
            "spark.sql.files.openCostInBytes": "65536",
            "spark.sql.shuffle.partitions": CPUS,
            "spark.python.sql.dataFrameDebugging.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def timed(run) -> float:
        run()
        start = time.perf_counter()
        run()
        return round(time.perf_counter() - start, 3)

    def whole(name: str):
        return lambda: QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()

    def analyze_text(name: str, folder: str | list[str]):
        def run() -> None:
            report = analyze_files(spark, folder, log_format=name)
            for part in (report.summary, report.top_errors, report.top_correlations):
                part.collect()
            report.windows.write.format("noop").mode("overwrite").save()
            report.issue_samples.collect()

        return run

    folders = {"plain": plain_folder(spark, SF_DIR), "jsonl": json_folder(spark, SF_DIR)}
    seconds = {name: timed(whole(name)) for name in HEADLINE}
    for name, folder in folders.items():
        seconds[f"analyze_files_{name}"] = timed(analyze_text(name, folder))
    # The same log ten times over, as ten inputs: the share of fixed costs shrinks.
    copies = [new_path(spark, "bench-copy") for _ in range(10)]
    for copy in copies:
        spark.read.text(folders["jsonl"]).write.text(copy)
    seconds["analyze_files_jsonl_x10"] = timed(analyze_text("jsonl", copies))
    lines = spark.read.parquet(f"{SF_DIR}/events.parquet").count()
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "lines_per_second": {
                    "plain": round(lines / seconds["analyze_files_plain"]),
                    "jsonl": round(lines / seconds["analyze_files_jsonl"]),
                    "jsonl_x10": round(10 * lines / seconds["analyze_files_jsonl_x10"]),
                },
                "lines": lines,
                "sf": Path(SF_DIR).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
