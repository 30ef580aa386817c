"""Run queries next to their SQL and report differences.

    python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "events documents embeddings pages conversations labels benchmark".split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def difference(frame, connection, sql: str) -> str | None:
    """None if the rows agree, else a description."""
    expected = connection.sql(sql)
    names = list(expected.columns)
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(names)}"
    got = bag(frame.columns, frame.collect())
    want = bag(names, expected.fetchall())
    if got == want:
        return None
    return (
        f"{sum(got.values())} rows, expected {sum(want.values())}; "
        f"only here {list((got - want).items())[:3]}; only expected {list((want - got).items())[:3]}"
    )


def main(sf_dir: str, names: list[str]) -> None:
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = database(sf_dir)
    oracles = entry.oracle_sql()
    for name, run in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            frame = run(spark, sf_dir)
            if name in oracles:
                result = difference(frame, connection, oracles[name]) or "ok"
            else:
                result = f"no SQL, {len(frame.collect())} rows"
        except Exception as error:  # noqa: BLE001
            result = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"RESULT {name} {time.time() - start:.1f}s {result}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001", sys.argv[2:])
