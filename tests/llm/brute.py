"""Fixtures and slow, plain versions of the operators for the tests."""

from __future__ import annotations

import hashlib

import pyarrow.parquet as pq

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _doc int, text_ string"


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def documents(sf_dir: str = SF_DIR) -> list[tuple[int, str]]:
    rows = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return [(row["doc_id"], row["text"]) for row in rows]


def frame(spark, rows: list[tuple]):
    """Documents with extra columns whose names an operator might use itself."""
    full = [
        (doc_id, text, ("en", None, "fr")[i % 3], ("a", "a", None)[i % 3], None, i, "x")
        for i, (doc_id, text) in enumerate(rows)
    ]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def collected(df, *columns: str) -> list[tuple]:
    return sorted((tuple(row) for row in df.select(*columns).collect()), key=repr)
