"""Packing of token IDs into windows by best-fit decreasing.

A document longer than a window is first cut into full windows; they are sequences of
their own. What remains is dealt into groups by a hash of the piece, sorted there by
falling length, and each piece goes to the open window with the least room that still
holds it. A segment tree over the room left finds that window. A group needs memory for
its open windows only, pieces pass through one by one, and a very long document is dealt
over all groups piece by piece.

Cases: a null or empty text has only the end token; rows without ID and repeated rows are
packed like any other; an empty table gives no piece; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blank, documents, partitions, slices
from .encoding import encoder
from .registry import query

WINDOW = 2048
#: Sequences of a group are numbered from group times this.
GROUP_STRIDE = 1 << 40


class OpenWindows:
    """Open windows by the room they have left, with a segment tree over the rooms."""

    def __init__(self, size: int):
        self.leaves = 1
        while self.leaves <= size:
            self.leaves *= 2
        self.any = bytearray(2 * self.leaves)
        self.by_room: list[list[int]] = [[] for _ in range(size + 1)]

    def put(self, room: int, window: int) -> None:
        if room:
            self.by_room[room].append(window)
            node = self.leaves + room
            while node and not self.any[node]:
                self.any[node] = 1
                node //= 2

    def take(self, length: int) -> tuple[int, int] | None:
        """The window with the least room of at least ``length``, and that room."""
        node = self.leaves + length
        if not self.any[node]:
            # Climb until a right neighbour has windows, then go down its left-most path.
            while node > 1 and (node & 1 or not self.any[node + 1]):
                node //= 2
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.any[2 * node] else 2 * node + 1
        room = node - self.leaves
        window = self.by_room[room].pop()
        if not self.by_room[room]:
            self.any[node] = 0
            while node > 1:
                node //= 2
                self.any[node] = self.any[2 * node] | self.any[2 * node + 1]
        return window, room


def pieces(
    docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """Full windows and the rest of every document, as little-endian IDs of 2 or 4 bytes."""
    from tokenizers import Tokenizer

    width = 2 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else 4
    end = np.array([end_id], f"<u{width}").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, step = encoder(path, spaced=False, width=width), window * width
        for batch in slices(batches):
            rows = []
            encoded = tool.encode(batch.column(1).to_pylist())
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded, strict=True):
                ids += end
                rows += [
                    (doc_id, at // width, ids[at : at + step], len(ids) // width)
                    for at in range(0, len(ids), step)
                ]
            columns = [pa.array(x, kind) for x, kind in zip(zip(*rows), (batch.column(0).type, pa.int64(), pa.binary(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "ids", "doc_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), blank(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    cut_rows = rows.mapInArrow(cut, f"doc_id {kind}, start long, ids binary, doc_tokens long")
    return cut_rows.withColumn("length", F.expr(f"octet_length(ids) div {width}"))


def pack(cut: DataFrame, window: int = WINDOW) -> DataFrame:
    """Place every piece: ``sequence_id`` and ``offset``; IDs become 4 bytes wide."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, last = OpenWindows(window), TaskContext.get().partitionId() * GROUP_STRIDE
        for batch in batches:
            sequences, offsets, wide = [], [], []
            for length, ids in zip(batch.column(4).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = tree.take(length)
                if found is None:
                    found = last, window
                    last += 1
                number, room = found
                tree.put(room - length, number)
                sequences.append(number)
                offsets.append(window - room)
                kind = f"<u{len(ids) // length}"
                wide.append(np.frombuffer(ids, kind).astype("<u4").tobytes())
            columns = [batch.column(0), batch.column(1), pa.array(wide, pa.binary()), batch.column(3)]
            columns += [batch.column(4), pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())]
            yield pa.RecordBatch.from_arrays(
                columns, ["doc_id", "start", "ids", "doc_tokens", "length", "sequence_id", "offset"]
            )

    spread = cut.repartition(partitions(cut.sparkSession), F.xxhash64("doc_id", "start", F.crc32("ids")))
    ordered = spread.sortWithinPartitions(F.desc("length"), "doc_id", "start", "ids")
    return ordered.mapInArrow(
        place,
        f"doc_id {dict(cut.dtypes)['doc_id']}, start long, ids binary, doc_tokens long, length long, sequence_id long, offset long",
    )


def packed(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(pieces(docs, public_tokenizers.path("word_bpe_49k.json"), 1)).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir))
