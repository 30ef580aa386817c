"""From raw documents to packed sequences: quality rules, line dedup, near duplicates,
benchmark decontamination, packing.

Every stage takes the documents that its predecessor kept and returns them with the same
columns; the last one returns the pieces of packed sequences. Documents that fail the
quality rules go; repeated lines go from the texts (``n_chars`` follows); of each group of
near duplicates the smallest document stays; documents with benchmark passages go.

Cases: null texts count as empty, and fail the quality rules; rows without ID and repeated
rows are documents of their own; columns that the stages do not know are kept as they are,
whatever their names and types; an empty table goes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweft.llm.common import DOC, blank, documents, identified, materialize, table
from logweft.llm.contamination import find_passages
from logweft.llm.line_dedup import drop_repeated_lines
from logweft.llm.near_dups import near_duplicates
from logweft.llm.packing import packed
from logweft.llm.quality import quality


def numbered(docs: DataFrame, *used: str) -> DataFrame:
    """``_doc``, ``doc_id`` and the columns ``used``, beside ``row`` with all columns as they
    are, so that no name in the documents meets one of a stage."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    return identified(docs.select("doc_id", *used, whole))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    known = numbered(docs, "text", "lang", "source")
    kept = quality(known).filter("kept").select(DOC)
    return known.join(kept, DOC, "left_semi").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a later document keeps."""
    known = numbered(docs, "text")
    cleaned = drop_repeated_lines(known.select(DOC, "doc_id", "text")).select(DOC, F.col("text").alias("cleaned"))
    changed = {"text": F.col("cleaned"), "n_chars": F.char_length("cleaned").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return known.select(DOC, "row").join(cleaned, DOC).select(
        *(changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns)
    )


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    known = numbered(docs, "text")
    labelled = near_duplicates(known.select(DOC, blank("text").alias("text")))
    kept = labelled.filter(F.col(DOC) == F.col("label")).select(DOC)
    return known.join(kept, DOC, "left_semi").select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of a benchmark item."""
    known = numbered(docs, "text")
    found = find_passages(known.select(DOC, "text"), table(spark, sf_dir, "benchmark"))
    return known.join(found.filter("n_hit > 0").select(DOC), DOC, "left_anti").select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2,048 tokens."""
    return packed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Tokenizers cannot be expressed in SQL; ``tests/llm/test_pipeline.py`` has a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
