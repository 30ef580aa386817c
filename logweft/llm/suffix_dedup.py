"""Removal of byte strings that occur earlier, by suffix arrays over candidate texts.

A byte goes if a string of ``WIDTH`` bytes that covers it also starts earlier: in a
smaller document or earlier in the same one. Strings are judged on the input; they never
cross documents; overlaps count. ``repeats`` brings together the stretches of text in
which a repeat may begin, and ``suffix_groups`` sorts their suffixes by linear grouping,
so that equal strings become neighbours and are compared byte by byte. Copies of whole
stretches are united by a 128-bit hash before.

Cases: a null text counts as empty; texts shorter than ``WIDTH`` lose nothing; repeated
rows and rows without ID are documents of their own (see ``common.identified``); an empty
table gives no row; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import suffix_groups
from .common import DOC, blank, documents, identified, slices
from .registry import query
from .repeats import Windows, covered, keep_mask, n_runs

BYTE_WINDOWS = Windows(
    suffix_groups.WIDTH,
    suffix_groups.anchors,
    suffix_groups.payloads,
    suffix_groups.resolve,
    suffix_groups.window_hashes,
    suffix_groups.TEXT,
)


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``kept`` (the remaining bytes), ``n_bytes``, ``n_removed``, ``n_spans``."""
    chosen = identified(docs.select(F.col(id_col).alias("doc_id"), blank(text_col).alias("text")))
    spans = covered(chosen, BYTE_WINDOWS)
    kind = dict(chosen.dtypes)["doc_id"]

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kept, sizes, gone, runs = [], [], [], []
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for text, own in zip(texts, batch.column(2), strict=True):
                if own.is_valid:
                    keep = keep_mask(len(text), own)
                    rest = np.frombuffer(text, np.uint8)[keep].tobytes()
                    runs.append(n_runs(keep))
                else:
                    rest = text
                    runs.append(0)
                kept.append(rest)
                sizes.append(len(text))
                gone.append(len(text) - len(rest))
            columns = [batch.column(0), pa.array(kept, pa.binary())]
            columns += [pa.array(x, pa.int64()) for x in (sizes, gone, runs)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return (
        chosen.join(spans, DOC, "left")
        .select("doc_id", "text", "spans")
        .mapInArrow(remove, f"doc_id {kind}, kept binary, n_bytes long, n_removed long, n_spans long")
    )


@query("op2_suffix_dedup")
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated_bytes(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
