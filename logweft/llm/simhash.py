"""Near duplicates by SimHash fingerprints, searched through segment popcounts.

A fingerprint has 64 bits. Each of its 32 segments of two bits is embedded as the number of
bits set in it, written in unary: 00, 01 or 11. The Manhattan distance of two embedded
fingerprints is then the number of bits in which the embeddings differ, and never more than
the number of bits in which the fingerprints differ: a segment whose count changes by one
or two has as many changed bits at least.

The range join runs on a grid. The embedding falls into eight bytes of four segments each.
Within Manhattan distance 4 at most four bytes change, so the other four are equal: for
every choice of four bytes the embeddings that agree there share a cell, and each pair in
range meets in one of the 70 cells that both have. Pairs of a cell are kept if the
embeddings are within the distance (the lower bound) and then the fingerprints (exact).

Only distinct fingerprints take part, each for its smallest document. No cell emits all its
pairs: first every fingerprint of a shared cell is compared with one pivot of the cell, and
the links make components. Cells of three or more that still hold several components are
joined, and there only pairs of different components can meet. Cells of a single
fingerprint are left out after counting them, with counts combined before the shuffle.

Cases: null texts and texts without words have the fingerprint zero, which links like any
other; fewer words than a shingle make one shingle; words and texts may have any length, a
long text is read in pieces; repeated rows and rows without ID are documents of their own
(see ``common.identified``); an empty table gives no row; other columns do not matter.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fits_broadcast, lookup_join
from .common import DOC, blank, documents, identified, materialize, partitions, slices
from .components import components
from .registry import query

SHINGLE = 4
SEED = 42
DISTANCE = 4
BYTES = 8
#: Bytes of a text whose words are held at a time.
PIECE = 1 << 20
#: Shingles counted at a time.
COUNTED = 1 << 16
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_LOW_BITS = 0x5555555555555555
#: What a byte outside a cell's choice is filled with; no embedded byte looks like it.
_FILL = 0xAA


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, a few at a time."""
    start = 0
    while start < len(text):
        cut = _SPACE.search(text, start + PIECE)
        end = cut.end() if cut else len(text)
        yield text[start:end].split()
        start = end


def fingerprint(text: bytes) -> int:
    """Bits that more than half of the shingles' hashes have, as an unsigned number."""
    ones, n = np.zeros(64, np.int64), 0
    carried: list[bytes] = []

    def count(shingles: list[bytes]) -> None:
        nonlocal n
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(shingles))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[:] += bits.sum(axis=0, dtype=np.int64)
        n += len(shingles)

    for words in pieces(text.lower()):
        words = carried + words
        for first in range(0, len(words) - SHINGLE + 1, COUNTED):
            last = min(first + COUNTED, len(words) - SHINGLE + 1)
            count([b" ".join(words[i : i + SHINGLE]) for i in range(first, last)])
        carried = words[max(0, len(words) - SHINGLE + 1) :]
    if not n and carried:
        count([b" ".join(carried)])
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``_doc`` and ``print``, the fingerprint as a signed long."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1).cast(pa.binary())
            prints = np.array([fingerprint(text.as_py()) for text in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], [DOC, "print"])

    return docs.select(DOC, "text").mapInArrow(sign, f"{DOC} long, print long")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def embedded(prints: Column) -> Column:
    """The popcounts of the segments, each in unary."""
    other = F.shiftrightunsigned(prints, 1)
    low = F.lit(_LOW_BITS)
    any_, both = prints.bitwiseOR(other).bitwiseAND(low), prints.bitwiseAND(other).bitwiseAND(low)
    return any_.bitwiseOR(F.shiftleft(both, 1))


def cells(embedding: Column, distance: int) -> Column:
    """The grid cells of an embedding: all choices of bytes that cannot all have changed."""
    out = []
    for chosen in itertools.combinations(range(BYTES), BYTES - distance):
        mask = sum(0xFF << 8 * k for k in chosen)
        fill = sum(_FILL << 8 * k for k in range(BYTES) if k not in chosen)
        out.append(embedding.bitwiseAND(F.lit(_signed(mask))).bitwiseOR(F.lit(_signed(fill))))
    return F.array(*out)


def within(distance: int, a: str, b: str) -> Column:
    """Whether ``a`` and ``b`` are within the distance, by the lower bound and exactly."""
    near = F.bit_count(embedded(F.col(a)).bitwiseXOR(embedded(F.col(b)))) <= distance
    return near & (F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance)


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``node`` and ``label`` of the fingerprints that link with others (see ``components``).

    ``distinct`` has distinct ``print`` and the smallest document ``rep`` of each.
    """
    # A fingerprint becomes a row for each cell, so even a small table deserves all tasks.
    spread = distinct.repartition(partitions(distinct.sparkSession))
    gridded = spread.select("print", "rep", F.explode(cells(embedded(F.col("print")), distance)).alias("cell"))
    counted = gridded.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("print").alias("pivot"))
    shared = materialize(counted.filter("n > 1"), "cells")
    # With two fingerprints in a cell the pivot settles it; most of these are no links.
    settled = (F.col("n") == 2) & ~((F.col("print") != F.col("pivot")) & within(distance, "print", "pivot"))
    small = F.broadcast(shared) if fits_broadcast(shared) else shared
    rows = materialize(gridded.join(small, "cell").filter(~settled), "cell-rows")
    to_pivot = rows.filter((F.col("print") != F.col("pivot")) & within(distance, "print", "pivot"))
    owners = distinct.select(F.col("print").alias("pivot"), F.col("rep").alias("b"))
    first = lookup_join(
        to_pivot.select("rep", "pivot").distinct(), owners, ["pivot"], F.col("rep"), "inner"
    ).select(F.col("rep").alias("a"), "b")
    labels = components(first)
    own = labels.select(F.col("node").alias("rep"), "label")
    placed = rows.filter("n > 2").select("cell", "print", "rep").join(own, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    parts = placed.groupBy("cell", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy("cell").agg(
        F.max(F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("parts")
    ).filter("parts > 1").select("cell", F.col("main.label").alias("main"))
    open_ = materialize(placed.join(mixed, "cell"), "open-cells")
    # Every pair of different components has a side outside the largest one of the cell.
    minor = open_.filter(F.col("label") != F.col("main")).select(
        "cell", F.col("rep").alias("a"), F.col("print").alias("pa"), F.col("label").alias("la")
    )
    other = open_.select(
        F.col("cell").alias("cell_b"), F.col("rep").alias("b"), F.col("print").alias("pb"), F.col("label").alias("lb"), "main"
    )
    met = minor.join(
        other,
        (F.col("cell") == F.col("cell_b"))
        & (F.col("la") != F.col("lb"))
        & ((F.col("lb") == F.col("main")) | (F.col("a") < F.col("b")))
        & within(distance, "pa", "pb"),
    ).select("a", "b")
    rest = met.distinct()
    return components(rest.union(labels.select(F.col("node").alias("a"), F.col("label").alias("b"))))


def near_prints(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``_doc``, ``print`` and ``label``, the smallest document reachable over fingerprints
    that differ in at most ``distance`` bits, itself included.

    ``docs`` has ``_doc`` (see ``common.identified``) and ``text`` without nulls.
    """
    if not 0 <= distance < BYTES:
        raise ValueError(f"the grid has {BYTES} bytes; the distance must be smaller")
    signed = materialize(fingerprints(docs), "prints")
    classes = signed.groupBy("print").agg(F.min(DOC).alias("rep"), F.count(F.lit(1)).alias("n"))
    distinct = materialize(classes, "classes")
    labels = links(distinct.select("print", "rep"), distance)
    placed = distinct.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    # A fingerprint that one document has alone and that links with none needs no lookup.
    known = materialize(
        placed.filter("n > 1 OR label IS NOT NULL").select("print", F.coalesce("label", "rep").alias("label")), "labels"
    )
    found = lookup_join(signed, known, ["print"], F.col(DOC))
    return found.select(DOC, "print", F.coalesce("label", DOC).alias("label"))


def with_ids(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """Documents and components by their IDs, fingerprints in hexadecimal digits."""
    ids = docs.select(DOC, "doc_id")
    labelled = materialize(labelled, "labelled")
    heads = ids.join(labelled.filter(F.col(DOC) == F.col("label")).select(DOC), DOC).select(
        F.col(DOC).alias("label"), F.col("doc_id").alias("component_id")
    )
    return lookup_join(labelled.join(ids, DOC), heads, ["label"], F.col(DOC)).select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query("op11_simhash")
def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = identified(documents(spark, sf_dir).select("doc_id", blank("text").alias("text")))
    return with_ids(docs, near_prints(docs))
