"""Windows of symbols that also occur earlier in the corpus, whatever the symbols are.

Every window picks an anchor by its content (``anchors``). A run of windows with one
anchor is a record: ``key`` (the anchor's content), ``group`` (a hash of all symbols the
run covers and of the anchor's place), document, first window, number of windows. Equal
windows have equal keys, so:

1. Records of equal key and group are copies. All but the first are covered. Each task
   combines its own records first; only the first of each group is shuffled, so a group
   that holds a third of all rows sends one record per task.
2. A key with one group left is settled. For a key with several, the windows of the first
   records of its groups are compared one by one: they are cut from the texts, brought
   together by key, and ``resolve`` tells which windows occur earlier.
3. What is covered is gathered per document and applied to its text.

Records travel as packed columns, bucketed by key. No step needs more memory than one
bucket. The number of buckets follows the session's shuffle partitions, and in step 2 also
the symbols that are left to compare, as every task sends a packet to nearly every bucket.

A wide key, one with more than ``limit`` symbols under it, is not gathered. Its records are
dealt by group in step 1, and in step 2 cut into single windows, whose key is a hash of the
old one and of all symbols of the window: equal windows still meet, others spread over all
tasks. Each task sends only the first of its equal windows. A sample tells which keys are wide before anything is dealt, exact sums tell it of
all others in step 1. That only decides where work is done, never what is covered.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import MIX_1, mix
from .common import DOC, materialize, partitions, slices

RECORD = np.dtype([("key", "<u8"), ("group", "<u8"), ("doc", "<i8"), ("first", "<i8"), ("n", "<i4"), ("off", "<i4")])
BUCKETS_PER_TASK = 8
#: Symbols that are worth a bucket of their own when windows are compared.
BUCKET_SYMBOLS = 1 << 20
ROWS = f"{DOC} long, start long, n int, off int, key long, wide boolean"
#: Documents, and characters of each, in which wide keys are looked for, and the least groups there.
SAMPLE = 4000
SAMPLE_TEXT = 1 << 16
SAMPLE_GROUPS = 8


class Windows(NamedTuple):
    """How texts become symbols and windows become anchors."""

    width: int
    #: Text as bytes to (key, group, first, n, off) arrays.
    anchors: Callable[[bytes], tuple[np.ndarray, ...]]
    #: Text and its requested records to one payload per record.
    payloads: Callable[[bytes, np.ndarray], list[bytes]]
    #: Records of whole keys with their payloads to (record, window) pairs that occur earlier.
    resolve: Callable[[np.ndarray, list[bytes]], tuple[np.ndarray, np.ndarray]]
    #: Text and requested records to one hash for every window of each.
    hashes: Callable[[bytes, np.ndarray], np.ndarray] | None = None
    #: Symbols under one key that one task compares; without ``hashes`` all of them.
    limit: int = 1 << 21


def _pack(rows: np.ndarray) -> bytes:
    """Column by column: sorted documents and small numbers compress well."""
    return zlib.compress(b"".join(np.ascontiguousarray(rows[name]).tobytes() for name in RECORD.names), 1)


def _unpack(data: bytes) -> np.ndarray:
    raw = zlib.decompress(data)
    rows, at = np.empty(len(raw) // RECORD.itemsize, RECORD), 0
    for name in RECORD.names:
        size = len(rows) * RECORD[name].itemsize
        rows[name] = np.frombuffer(raw, RECORD[name], len(rows), at)
        at += size
    return rows


def first_of_groups(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order of key, group, document and place; whether each begins its group."""
    rows = rows[np.lexsort((rows["first"], rows["doc"], rows["group"], rows["key"]))]
    begins = np.ones(len(rows), bool)
    begins[1:] = (rows["key"][1:] != rows["key"][:-1]) | (rows["group"][1:] != rows["group"][:-1])
    return rows, begins


def covered_spans(docs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Unite spans that touch or overlap within a document."""
    if not len(docs):
        return docs, starts, ends
    order = np.lexsort((starts, docs))
    docs, starts, ends = docs[order], starts[order], ends[order]
    # The running largest end must not reach over from one document to the next.
    shift = np.cumsum(np.concatenate(([0], docs[1:] != docs[:-1]))) * (int(ends.max()) + 2)
    reach = np.maximum.accumulate(ends + shift)
    new = np.ones(len(docs), bool)
    new[1:] = (starts + shift)[1:] > reach[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(docs)) - 1
    return docs[at], starts[at], reach[last] - shift[last]


def _spans(docs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    """Covered spans as rows; ``n`` is their length, they have no key."""
    docs, starts, ends = covered_spans(docs, starts, ends)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(docs, pa.int64()),
            pa.array(starts, pa.int64()),
            pa.array(ends - starts, pa.int32()),
            pa.nulls(len(docs), pa.int32()),
            pa.nulls(len(docs), pa.int64()),
            pa.nulls(len(docs), pa.bool_()),
        ],
        [DOC, "start", "n", "off", "key", "wide"],
    )


def _buckets(batches: Iterator[pa.RecordBatch], column: str = "bucket") -> Iterator[tuple[int, list[dict]]]:
    """Rows of one bucket after another, from a partition sorted by bucket."""
    held, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row[column] != held and rows:
                yield held, rows
                rows = []
            held = row[column]
            rows.append(row)
    if rows:
        yield held, rows


def _single(text: bytes, rows: np.ndarray, windows: Windows) -> np.ndarray:
    """Each window of the records as a record of its own, with a key of its content."""
    out = np.repeat(rows, rows["n"])
    inside = np.arange(len(out)) - np.repeat(np.cumsum(rows["n"]) - rows["n"], rows["n"])
    out["key"] = mix(out["key"] * MIX_1 + windows.hashes(text, rows))
    out["first"] += inside
    out["off"] -= inside.astype(np.int32)
    out["n"] = 1
    return out


def _again(rows: np.ndarray, payloads: list[bytes], alone: np.ndarray) -> np.ndarray:
    """Single windows (``alone``) that equal an earlier one among the rows."""
    again = np.zeros(len(rows), bool)
    at = np.flatnonzero(alone)
    at = at[np.lexsort((rows["first"][at], rows["doc"][at], rows["key"][at]))]
    begins = np.ones(len(at), bool)
    begins[1:] = rows["key"][at][1:] != rows["key"][at][:-1]
    first = np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
    for k in np.flatnonzero(~begins).tolist():
        again[at[k]] = payloads[at[k]] == payloads[at[first[k]]]
    return again


def symbols_of(rows: np.ndarray, width: int) -> np.ndarray:
    """Symbols that each record covers, and one that ends it."""
    return rows["n"].astype(np.int64) + width


def wide_keys(docs: DataFrame, windows: Windows) -> np.ndarray:
    """Keys that are wide as far as a sample of the documents tells, in order."""
    if windows.hashes is None:
        return np.zeros(0, np.uint64)
    total = docs.count()
    # Every document of a small table; otherwise about ``SAMPLE`` of them.
    step = max(1, total // SAMPLE)
    chosen = docs.filter(F.pmod(F.xxhash64(DOC), F.lit(step)) == 0)
    chosen = chosen.select(DOC, F.substring("text", 1, SAMPLE_TEXT).alias("text"))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                key, group, _, n, _ = windows.anchors(text)
                columns = [pa.array(key.view(np.int64)), pa.array(group.view(np.int64)), pa.array(n + windows.width, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "group", "symbols"])

    groups = chosen.mapInArrow(seen, "key long, group long, symbols long").groupBy("key", "group").agg(F.max("symbols").alias("symbols"))
    keys = groups.groupBy("key").agg(F.count(F.lit(1)).alias("groups"), F.sum("symbols").alias("symbols"))
    wide = keys.filter((F.col("groups") >= SAMPLE_GROUPS) & (F.col("symbols") * step > windows.limit)).select("key").collect()
    return np.sort(np.array([row["key"] for row in wide], np.int64).view(np.uint64))


def covered(docs: DataFrame, windows: Windows) -> DataFrame:
    """``_doc`` and ``spans``: what of each document is covered, in symbols.

    ``docs`` has ``_doc`` (unique, in the order of the documents) and ``text``.
    """
    spark = docs.sparkSession
    # Several buckets for each task: their hashes spread more evenly than the tasks' own.
    n_buckets = BUCKETS_PER_TASK * partitions(spark)
    width = windows.width
    wide = wide_keys(docs, windows)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8 << 20):
            parts = []
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for doc, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                key, group, first, n, off = windows.anchors(text)
                own = np.empty(len(key), RECORD)
                own["key"], own["group"], own["doc"] = key, group, doc
                own["first"], own["n"], own["off"] = first, n, off
                parts.append(own)
            rows, begins = first_of_groups(np.concatenate(parts))
            sent, copies = rows[begins], rows[~begins]
            dealt = np.where(np.isin(sent["key"], wide), mix(sent["key"] ^ mix(sent["group"])), sent["key"])
            bucket = dealt % np.uint64(n_buckets)
            order = np.lexsort((sent["first"], sent["doc"], bucket))
            sent, bucket = sent[order], bucket[order]
            numbers, at = np.unique(bucket, return_index=True)
            blobs = [_pack(part) for part in np.split(sent, at[1:])] if len(sent) else []
            out = [(int(k), 0, blob) for k, blob in zip(numbers, blobs, strict=True)]
            if len(copies):
                # Already known to be covered; any bucket may carry them.
                out.append((int(mix(copies["doc"][:1].astype(np.uint64))[0] % np.uint64(n_buckets)), 1, _pack(copies)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, kind) for x, kind in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary()))]
                if out
                else [pa.array([], kind) for kind in (pa.int32(), pa.int32(), pa.binary())],
                ["bucket", "copies", "data"],
            )

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in _buckets(batches):
            known = [_unpack(row["data"]) for row in blobs if row["copies"]]
            rows, begins = first_of_groups(
                np.concatenate([np.empty(0, RECORD), *[_unpack(row["data"]) for row in blobs if not row["copies"]]])
            )
            gone = np.concatenate([rows[~begins], *known])
            yield _spans(gone["doc"], gone["first"], gone["first"] + gone["n"] - 1 + width)
            groups = rows[begins]
            _, where, counts = np.unique(groups["key"], return_inverse=True, return_counts=True)
            sums = np.bincount(where, symbols_of(groups, width), len(counts))
            known = np.isin(groups["key"], wide)
            # Groups of a key known as wide are elsewhere, too.
            chosen = (counts[where] > 1) | known
            open_, split = groups[chosen], known[chosen]
            if windows.hashes is not None:
                split = split | (sums[where][chosen] > windows.limit)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(open_["doc"]),
                    pa.array(open_["first"]),
                    pa.array(open_["n"]),
                    pa.array(open_["off"]),
                    pa.array(np.ascontiguousarray(open_["key"]).view(np.int64)),
                    pa.array(split),
                ],
                [DOC, "start", "n", "off", "key", "wide"],
            )

    sent = docs.select(DOC, "text").mapInArrow(records, "bucket int, copies int, data binary")
    by_bucket = sent.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket")
    settled = materialize(by_bucket.mapInArrow(settle, ROWS), "settled")
    left = settled.filter(F.col("key").isNotNull())
    symbols = F.when(F.col("wide"), F.col("n").cast("long") * width).otherwise(F.col("n").cast("long") + width)
    volume = left.agg(F.sum(symbols).alias("symbols")).first()["symbols"] or 0
    n_compared = min(n_buckets, 1 + volume // BUCKET_SYMBOLS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            parts, payloads, alone = [], [], []
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for doc, text, wanted in zip(batch.column(0).to_pylist(), texts, batch.column(2), strict=True):
                own = np.empty(len(wanted), RECORD)
                fields = wanted.values
                own["doc"], own["group"] = doc, 0
                own["first"], own["n"] = fields.field("start").to_numpy(), fields.field("n").to_numpy()
                own["off"], own["key"] = fields.field("off").to_numpy(), fields.field("key").to_numpy().view(np.uint64)
                split = fields.field("wide").to_numpy(zero_copy_only=False)
                if split.any():
                    own = np.concatenate([own[~split], _single(text, own[split], windows)])
                alone.append(np.arange(len(own)) >= np.count_nonzero(~split))
                parts.append(own)
                payloads += windows.payloads(text, own)
            rows = np.concatenate([np.empty(0, RECORD), *parts])
            known = _again(rows, payloads, np.concatenate([np.empty(0, bool), *alone]))
            bucket = (rows["key"] % np.uint64(n_compared)).astype(np.int64)
            out = []
            if known.any():
                # Already known to be covered; any bucket may carry them.
                spread = mix(rows["doc"][known][:1].astype(np.uint64))[0] % np.uint64(n_compared)
                out.append((int(spread), _pack(rows[known]), None, None))
            for k in np.unique(bucket[~known]):
                here = np.flatnonzero((bucket == k) & ~known)
                own = [payloads[i] for i in here]
                sizes = np.array([len(x) for x in own], "<i4").tobytes()
                out.append((int(k), _pack(rows[here]), zlib.compress(sizes, 1), zlib.compress(b"".join(own), 1)))
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
            columns = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)],
                ["bucket", "data", "sizes", "payload"],
            )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in _buckets(batches):
            known = [_unpack(row["data"]) for row in blobs if row["sizes"] is None]
            if known:
                gone = np.concatenate(known)
                yield _spans(gone["doc"], gone["first"], gone["first"] + width)
            blobs = [row for row in blobs if row["sizes"] is not None]
            rows = np.concatenate([np.empty(0, RECORD), *[_unpack(row["data"]) for row in blobs]])
            if not len(rows):
                continue
            payloads: list[bytes] = []
            for row in blobs:
                at, raw = 0, zlib.decompress(row["payload"])
                for size in np.frombuffer(zlib.decompress(row["sizes"]), "<i4").tolist():
                    payloads.append(raw[at : at + size])
                    at += size
            record, window = windows.resolve(rows, payloads)
            starts = rows["first"][record] + window
            yield _spans(rows["doc"][record], starts, starts + width)

    open_ = left.groupBy(DOC).agg(
        F.collect_list(F.struct("start", "n", "off", "key", "wide")).alias("wanted")
    )
    contexts = docs.select(DOC, "text").join(open_, DOC).select(DOC, "text", "wanted")
    payloads = contexts.mapInArrow(cut, "bucket int, data binary, sizes binary, payload binary")
    compared = payloads.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket").mapInArrow(compare, ROWS)
    spans = settled.filter(F.col("key").isNull()).unionByName(compared)
    return spans.groupBy(DOC).agg(F.collect_list(F.struct("start", "n")).alias("spans"))


def keep_mask(length: int, spans: pa.Scalar) -> np.ndarray:
    """Symbols of a text that no span covers."""
    change = np.zeros(length + 1, np.int64)
    if spans.is_valid:
        start = spans.values.field("start").to_numpy()
        np.add.at(change, start, 1)
        np.add.at(change, start + spans.values.field("n").to_numpy(), -1)
    return np.cumsum(change[:-1]) == 0


def n_runs(keep: np.ndarray) -> int:
    """Maximal runs of what is not kept."""
    return int(np.count_nonzero(np.diff(np.concatenate(([True], keep)).astype(np.int8)) == -1))
