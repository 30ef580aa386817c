"""What the operators share: reading tables, document identity, spreading work."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, new_path

__all__ = ["blank", "documents", "identified", "materialize", "new_path", "partitions", "slices", "table"]

DOC = "_doc"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def partitions(spark: SparkSession) -> int:
    """Tasks of an explicit shuffle: the session's setting, sized by who runs the job."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def identified(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with a unique long ``_doc`` whose order is that of the documents.

    That is the ID itself where IDs are unique integers. Otherwise (nulls, repeated
    rows, other types) the rows are numbered once in the order of ID, then the other
    columns, nulls last, and stored, so that later scans see the same numbers. Columns
    without an order of their own come last, by a hash. A repeated row counts as a
    document of its own.
    """
    kind = dict(docs.dtypes)[id_col]
    if kind in ("bigint", "int", "smallint", "tinyint"):
        repeated = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
        if not repeated.filter((F.col("n") > 1) | F.col(id_col).isNull()).limit(1).collect():
            return docs.withColumn(DOC, F.col(id_col).cast("long"))
    rest = [c for c in docs.columns if c != id_col]
    unordered = [c for c in rest if re.search("map<|variant", dict(docs.dtypes)[c])]
    order = [F.col(c).asc_nulls_last() for c in [id_col, *(c for c in rest if c not in unordered)]]
    if unordered:
        order.append(F.xxhash64(F.to_json(F.struct(*unordered))).asc())
    ordered = docs.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    return materialize(ordered.withColumn(DOC, F.monotonically_increasing_id()), "numbered")


def blank(text: str) -> Column:
    """A text column without nulls."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def slices(
    batches: Iterator[pa.RecordBatch], characters: int = 1 << 22, text: int = 1
) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts in column ``text`` of each add up to little."""
    for batch in batches:
        sizes = batch.column(text)
        start = taken = 0
        for row in range(batch.num_rows):
            taken += len(sizes[row].as_buffer()) if sizes[row].is_valid else 0
            if taken >= characters:
                yield batch.slice(start, row + 1 - start)
                start, taken = row + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


Mapper = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
