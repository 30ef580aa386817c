"""Token files: every document compressed on its own with one shared dictionary.

A shard file holds, little-endian: 8 bytes magic, 32 bytes SHA-256 of the dictionary
(zeros without one), the compressed documents one after another, then the index (per
document: has an ID, ID, offset, compressed length, number of tokens), and last the
number of documents and the offset of the index. A reader seeks to the end, reads the
index and then only the document it wants.

The dictionary is trained on the token IDs of a bounded sample: ``SAMPLE_DOCUMENTS``
documents chosen by the hash of their ID, a window of ``SAMPLE_CHARACTERS`` from each.
Everything else covers all rows.

Cases: a null text counts as empty; an empty text has only the end token; rows without
ID come first; repeated rows are written as often as they come, next to each other; an
empty table gives no shard; other columns of the input do not matter.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blank, documents, materialize, new_path, partitions, slices
from .encoding import encoder
from .registry import query

MAGIC = b"LWTOKEN1"
TAIL = np.dtype([("n", "<u8"), ("index", "<u8")])
ENTRY = np.dtype([("known", "u1"), ("id", "<i8"), ("offset", "<u8"), ("size", "<u4"), ("n", "<u4")])
SAMPLE_DOCUMENTS = 500
SAMPLE_CHARACTERS = 2048
DICTIONARY_BYTES = 64 * 1024
LEVEL = 3


def train_dictionary(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> bytes:
    """A dictionary from the bounded sample, or nothing if there is too little text."""
    mark = F.xxhash64(F.col(id_col).cast("string"))
    room = F.greatest(F.lit(1), F.length(text_col) - F.lit(SAMPLE_CHARACTERS) + 1)
    window = F.substr(F.col(text_col), F.pmod(mark, room).cast("int") + 1, F.lit(SAMPLE_CHARACTERS))
    # The smallest hashes first, from a scan of the IDs alone. Rows of one hash count once.
    marks = [row["mark"] for row in docs.select(mark.alias("mark")).orderBy("mark").limit(SAMPLE_DOCUMENTS).collect()]
    rows = docs.filter(mark.isin(marks) & (F.length(text_col) > 0)).groupBy(mark.alias("mark")).agg(F.min(window).alias("text")).orderBy("mark").collect()
    samples = encoder(path, spaced=True).encode([row["text"] for row in rows])
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class ShardWriter:
    """Writes under a name of its own and renames at the end: a task that is run again
    replaces the file as a whole."""

    def __init__(self, uri: str, dictionary: bytes):
        self.files, self.path = _open(uri)
        self.draft = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.files.open_output_stream(self.draft)
        self.codec = zstandard.ZstdCompressor(
            level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        )
        self.out.write(MAGIC + (hashlib.sha256(dictionary).digest() if dictionary else bytes(32)))
        self.at = len(MAGIC) + 32
        self.entries: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self.codec.compress(ids)
        self.out.write(frame)
        self.entries.append((doc_id is not None, doc_id or 0, self.at, len(frame), len(ids) // 4))
        self.at += len(frame)

    def close(self) -> int:
        index = np.array(self.entries, ENTRY)
        self.out.write(index.tobytes() + np.array([(len(index), self.at)], TAIL).tobytes())
        self.out.close()
        if self.files.get_file_info(self.path).type != fs.FileType.NotFound:
            self.files.delete_file(self.path)
        self.files.move(self.draft, self.path)
        return int(index["n"].astype("u8").sum())


class ShardReader:
    """Random access to the documents of one shard."""

    def __init__(self, uri: str, dictionary: bytes):
        files, path = _open(uri)
        self.source = files.open_input_file(path)
        size = self.source.size()
        mark = hashlib.sha256(dictionary).digest() if dictionary else bytes(32)
        if self.source.read_at(len(MAGIC) + 32, 0) != MAGIC + mark:
            raise ValueError(f"{uri} is no token file of this dictionary")
        n, at = np.frombuffer(self.source.read_at(TAIL.itemsize, size - TAIL.itemsize), TAIL)[0]
        self.index = np.frombuffer(self.source.read_at(int(n) * ENTRY.itemsize, int(at)), ENTRY)
        self.codec = zstandard.ZstdDecompressor(
            dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        )

    def ids(self, row: int) -> bytes:
        entry = self.index[row]
        return self.codec.decompress(self.source.read_at(int(entry["size"]), int(entry["offset"])))

    def __enter__(self) -> ShardReader:
        return self

    def __exit__(self, *_) -> None:
        self.source.close()


def write_token_files(
    docs: DataFrame, folder: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write all documents in ascending order of their ID; returns the shards:
    ``shard`` (their order), ``uri``, ``n_docs``, ``n_tokens`` and ``dictionary``."""
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, path, id_col, text_col)
    files, root = _open(folder)
    files.create_dir(root, recursive=True)
    if dictionary:
        with files.open_output_stream(f"{root}/dictionary") as out:
            out.write(dictionary)
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        uri = f"{folder}/shard-{shard:07d}.tokens"
        writer, tool = None, encoder(path, spaced=True)
        for batch in slices(batches):
            writer = writer or ShardWriter(uri, dictionary)
            texts = batch.column(1).to_pylist()
            for doc_id, ids in zip(batch.column(0).to_pylist(), tool.encode(texts), strict=True):
                writer.add(doc_id, ids + end)
        if writer:
            total = writer.close()
            yield pa.RecordBatch.from_pydict(
                {"shard": [shard], "uri": [uri], "n_docs": [len(writer.entries)], "n_tokens": [total]}
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), blank(text_col).alias("text"))
    ordered = rows.repartitionByRange(partitions(spark), F.col("id").asc_nulls_first()).sortWithinPartitions(
        F.col("id").asc_nulls_first(), "text"
    )
    shards = ordered.mapInArrow(write, "shard long, uri string, n_docs long, n_tokens long")
    return materialize(shards, "shards").withColumn("dictionary", F.lit(dictionary))


def read_token_files(shards: DataFrame) -> DataFrame:
    """All documents of the shards: ``doc_id``, ``start`` (IDs of all documents before),
    ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit)."""
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = max(1, shards.count())
    placed = shards.select("uri", "dictionary", before.cast("long").alias("base"), "shard")
    placed = placed.repartitionByRange(n, "shard")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with ShardReader(row["uri"], row["dictionary"]) as reader:
                    index = reader.index
                    counts = index["n"].astype("i8")
                    starts = row["base"] + np.cumsum(counts) - counts
                    for at in range(0, len(index), 256):
                        part = slice(at, at + 256)
                        ids = [reader.ids(k) for k in range(at, min(at + 256, len(index)))]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(index["id"][part], mask=index["known"][part] == 0),
                                pa.array(starts[part]),
                                pa.array(counts[part]),
                                pa.array(ids, pa.binary()),
                            ],
                            ["doc_id", "start", "n_tokens", "ids"],
                        )

    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


@query("op1_token_files")
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_path(spark, "tokens")
    shards = write_token_files(documents(spark, sf_dir), folder, public_tokenizers.path("byte_bpe_50k.json"), 2)
    return read_token_files(shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

