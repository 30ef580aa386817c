"""Repeated lines: kept once, in the last document that has them.

Two Bloom filters hold the hashes seen once and seen twice. Every task makes both for its
lines; they are merged segment by segment (what two parts have each seen once has been
seen twice). Only lines that the second filter suspects are shuffled, as 128-bit digests,
to count their documents exactly and choose the document that keeps them. A false
suspicion costs a row of shuffle and changes no result.

The filters grow with the number of documents up to ``MAX_BITS`` (256 MiB each), which
bounds what a worker holds; beyond it more lines are suspected, none is lost. Workers read
the filter from the shared folder.

Cases: a null or empty text is one empty line; lines are short of ``min_chars`` code
points after stripping are never dropped; rows without ID or with a repeated ID are
documents of their own, ordered as ``common.identified`` says; other columns stay out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DOC, blank, documents, identified, materialize, new_path, slices
from .registry import query

#: Fixed: what is stripped from a line.
SPACE = b" \t\n\x0b\x0c\r"
MIN_CHARS = 40
MIN_DOCUMENTS = 5
SEGMENTS = 64
BITS_PER_DOCUMENT = 128
MIN_BITS, MAX_BITS = 1 << 20, 1 << 31
#: Keys that may be broadcast: 16 bytes and a document number each.
HOT_KEYS = 1 << 16

_FILTERS: dict[str, list[np.ndarray]] = {}


def line_keys(text: str, min_chars: int) -> list[bytes | None]:
    """Key of every line; none for a line that is too short."""
    keys: list[bytes | None] = []
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        key = line.strip(SPACE).lower()
        if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "surrogatepass")) < min_chars):
            keys.append(None)
        else:
            keys.append(key)
    return keys


def bits_for(n_documents: int) -> int:
    wanted = max(1, n_documents) * BITS_PER_DOCUMENT
    return min(MAX_BITS, max(MIN_BITS, 1 << (wanted - 1).bit_length()))


def places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment and two bits inside it for each hash."""
    mask = np.uint64(bits // SEGMENTS - 1)
    return hashes >> np.uint64(58), hashes & mask, (hashes >> np.uint64(29)) & mask


def _pack(first: np.ndarray, second: np.ndarray, bits: int) -> bytes:
    marks = np.zeros(bits // SEGMENTS, np.uint8)
    marks[first] = 1
    marks[second] = 1
    return zlib.compress(np.packbits(marks).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint8)


def twice_seen(docs: DataFrame, bits: int, min_chars: int) -> DataFrame:
    """Segments of the second filter over the lines of ``docs`` (``_doc``, ``text``)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, again = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        for batch in slices(batches):
            own: list[int] = []
            for text in batch.column(1).to_pylist():
                own += map(xxhash.xxh3_64_intdigest, {k for k in line_keys(text, min_chars) if k is not None})
            found, counts = np.unique(np.concatenate((seen, np.array(own, np.uint64))), return_counts=True)
            again = np.union1d(again, found[counts > 1])
            seen = found
        rows: dict[str, list] = {"segment": [], "once": [], "twice": []}
        parts = [places(x, bits) for x in (seen, again)]
        for segment in range(SEGMENTS if len(seen) else 0):
            packed = []
            for where, first, second in parts:
                here = where == segment
                packed.append(_pack(first[here], second[here], bits))
            rows["segment"].append(segment)
            rows["once"].append(packed[0])
            rows["twice"].append(packed[1])
        yield pa.RecordBatch.from_pydict(
            rows, schema=pa.schema([("segment", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])
        )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, once, twice = None, None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([held], pa.int32()), pa.array([zlib.compress(twice.tobytes(), 1)], pa.binary())],
                ["segment", "twice"],
            )

        for batch in batches:
            for at in range(batch.num_rows):
                segment = batch.column(0)[at].as_py()
                new_once, new_twice = (_unpack(batch.column(c)[at].as_py()) for c in (1, 2))
                if segment != held:
                    if held is not None:
                        yield row()
                    held, once, twice = segment, new_once.copy(), new_twice.copy()
                else:
                    twice |= new_twice | (once & new_once)
                    once |= new_once
        if held is not None:
            yield row()

    sketches = docs.mapInArrow(sketch, "segment int, once binary, twice binary")
    by_segment = sketches.repartition(SEGMENTS, "segment").sortWithinPartitions("segment")
    return by_segment.mapInArrow(merge, "segment int, twice binary")


def load_filter(path: str) -> list[np.ndarray]:
    """The second filter, read once by each worker from the shared folder."""
    if path not in _FILTERS:
        files, root = fs.FileSystem.from_uri(path)
        rows = ds.dataset(root, filesystem=files, format="parquet").to_table().to_pylist()
        by_segment = {row["segment"]: _unpack(row["twice"]) for row in rows}
        _FILTERS.clear()
        _FILTERS[path] = [by_segment.get(k, np.zeros(0, np.uint8)) for k in range(SEGMENTS)]
    return _FILTERS[path]


def suspected(hashes: list[int], twice: list[np.ndarray], bits: int) -> np.ndarray:
    """Which hashes the filter may have seen twice."""
    segment, first, second = places(np.array(hashes, np.uint64), bits)
    out = np.zeros(len(hashes), bool)
    for k in np.unique(segment):
        here = np.flatnonzero(segment == k)
        data = twice[int(k)]
        if len(data):
            hit = np.ones(len(here), bool)
            for bit in (first[here], second[here]):
                hit &= (data[bit >> np.uint64(3)] >> (7 - (bit & np.uint64(7)).astype(np.uint8))) & 1 == 1
            out[here] = hit
    return out


def repeats(docs: DataFrame, min_chars: int, min_documents: int) -> DataFrame:
    """``_doc`` and ``keys``, the digests of the lines that the document loses."""
    spark = docs.sparkSession
    bits = bits_for(docs.count())
    path = new_path(spark, "line-filter")
    twice_seen(docs, bits, min_chars).write.parquet(path)

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = load_filter(path)
        for batch in slices(batches):
            owners, keys = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = {key for key in line_keys(text, min_chars) if key is not None}
                keys += own
                owners += [doc] * len(own)
            hit = suspected([xxhash.xxh3_64_intdigest(key) for key in keys], twice, bits) if keys else []
            chosen = np.flatnonzero(hit)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([owners[k] for k in chosen], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(keys[k]) for k in chosen], pa.binary()),
                ],
                [DOC, "key"],
            )

    rows = materialize(docs.mapInArrow(suspects, f"{DOC} long, key binary"), "line-suspects")
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max(DOC).alias("keeper"))
    repeated = materialize(counts.filter(F.col("n") >= min_documents), "repeated-lines")
    # At most HOT_KEYS keys can hold so many rows each; they are broadcast, and what is
    # left to shuffle has no more rows of one key than that.
    hot = F.col("n") > rows.count() // HOT_KEYS
    common = F.broadcast(repeated.filter(hot).select("key", "keeper"))
    rare = repeated.filter(~hot).select("key", F.col("keeper").alias("rare_keeper"))
    marked = rows.join(common, "key", "left")
    known = marked.filter(F.col("keeper").isNotNull())
    others = marked.filter(F.col("keeper").isNull()).drop("keeper").join(rare, "key")
    lost = known.unionByName(others.withColumnRenamed("rare_keeper", "keeper")).filter(F.col(DOC) != F.col("keeper"))
    return lost.groupBy(DOC).agg(F.collect_list("key").alias("keys"))


def drop_repeated_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_documents: int = MIN_DOCUMENTS,
) -> DataFrame:
    """``_doc``, the ID, ``text`` without the dropped lines, ``n_lines`` and ``n_dropped``.

    ``docs`` may already carry ``_doc`` from ``identified``, as stages of a pipeline do.
    """
    rows = docs.select(F.col(DOC), F.col(id_col).alias("doc_id"), blank(text_col).alias("text"))
    lost = repeats(rows.select(DOC, "text"), min_chars, min_documents)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text=2):
            texts, totals, dropped = [], [], []
            for text, keys in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                lines = text.split("\n")
                totals.append(len(lines))
                if keys:
                    gone = set(keys)
                    own = line_keys(text, min_chars)
                    kept = [
                        line
                        for line, key in zip(lines, own, strict=True)
                        if key is None or xxhash.xxh3_128_digest(key) not in gone
                    ]
                    dropped.append(len(lines) - len(kept))
                    texts.append("\n".join(kept))
                else:
                    dropped.append(0)
                    texts.append(text)
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string())]
            columns += [pa.array(totals, pa.int64()), pa.array(dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [DOC, "doc_id", "text", "n_lines", "n_dropped"])

    kind = dict(rows.dtypes)["doc_id"]
    joined = rows.join(lost, DOC, "left").select(DOC, "doc_id", "text", "keys")
    return joined.mapInArrow(clean, f"{DOC} long, doc_id {kind}, text string, n_lines long, n_dropped long")


OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, split[i] AS line,
         regexp_replace(regexp_replace(split[i], '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS bare
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS split FROM documents),
       unnest(range(1, len(split) + 1)) AS t(i)
), keyed AS (
  SELECT doc_id, i, line,
         translate(bare, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.doc_id, i, line, r.key IS NOT NULL AND k.doc_id <> r.keeper AS gone
  FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op4_line_dedup", OP4_SQL)
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = identified(documents(spark, sf_dir).select("doc_id", "text"))
    return drop_repeated_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )
