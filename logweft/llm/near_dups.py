"""Near duplicates by an inverted join on MinHash signature coordinates.

Documents with equal shingle sets are united first; one of each class goes on. Every
coordinate of a signature and its value is a token, and a document is posted under its
tokens. Two documents are candidates if at least ``MATCHES`` of ``COORDINATES`` tokens
agree. Tokens are ordered by how many documents have them: of two candidates at least one
common token lies within the first ``COORDINATES - MATCHES + 1`` tokens of both, so only
that prefix is posted, and tokens that a document has alone drop out of it. Candidates
that survive the count of all agreeing coordinates are confirmed on the full sets.

No list emits all its pairs. Before the join, a few rounds link documents that agree in
whole bands of coordinates: such documents have one pivot among them, and each document is
compared with the one of its pivots that is the most like it. Components grow. Pairs
inside a component need no comparison, so a group of near copies costs about as many
comparisons as it has documents. What is left for the join are documents of different
components in one list. Shingles that only one of all these documents has bound what it
can share with any other, and bitmaps of the sets bound how far two of them differ;
documents and pairs beyond a bound go without a comparison. Each document is compared with
the nearest of each other component first, which unites most of these; then all pairs that
are still of different components are compared.

A pair at the limit of 0.75 agrees in 24 of 32 coordinates on average; it is missed if
fewer than 12 agree: probability 6e-6, and only if no third document links the two.

Cases: texts without words and null texts have empty sets and link with nothing; shorter
texts than a shingle have their whole word sequence as one; repeated rows and rows without
ID are documents of their own (see ``common.identified``); an empty table gives no row;
other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import forget
from .anchors import BASE, mix, prefix_hashes, span_hashes
from .common import DOC, blank, documents, identified, materialize, slices
from .components import joined, labels_of
from .recompression import word_hashes
from .registry import query

SHINGLE = 5
COORDINATES = 32
MATCHES = 12
#: Coordinates of a band in each of the rounds before the join; they divide the coordinates
#: or leave a rest that bands do not use.
BAND_WIDTHS = (8, 4, 2)
#: 64-bit words of the bitmap of a shingle set.
BITMAP_WORDS = 16
#: Shingles that all coordinates hash in one go.
SIGNED_AT_ONCE = 2048
_SEEDS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * BASE)


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    names = word_hashes(text.lower())
    n = len(names)
    if not n:
        return names
    first = np.arange(max(1, n - SHINGLE + 1))
    return np.unique(span_hashes(prefix_hashes(names), first, np.minimum(first + SHINGLE, n)))


def signature(shingles: np.ndarray) -> np.ndarray:
    """One token for each coordinate and its value."""
    lows = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), SIGNED_AT_ONCE):
        part = shingles[start : start + SIGNED_AT_ONCE]
        lows = np.minimum(lows, mix(part[None, :] ^ _SEEDS[:, None]).min(axis=1))
    return mix(lows + _SEEDS).view(np.int64)


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """One bit for each shingle, as longs; shingles may share a bit."""
    bits = np.zeros(64 * BITMAP_WORDS, bool)
    bits[mix(shingles) % np.uint64(len(bits))] = True
    return np.packbits(bits).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= 75 * (len(a) + len(b) - common)


def signatures(docs: DataFrame) -> DataFrame:
    """``_doc``, ``n_shingles``, ``print`` (128-bit hash of the set), ``tokens`` and ``bits``."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(text) for text in batch.column(1).cast(pa.binary()).to_pylist()]
            tokens = [signature(x).tolist() if len(x) else None for x in sets]
            columns = [batch.column(0), pa.array([len(x) for x in sets], pa.int64())]
            columns.append(pa.array([xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets], pa.binary()))
            columns.append(pa.array(tokens, pa.list_(pa.int64())))
            columns.append(pa.array([bitmap(x).tolist() if len(x) else None for x in sets], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, [DOC, "n_shingles", "print", "tokens", "bits"])

    return docs.select(DOC, "text").mapInArrow(
        sign, f"{DOC} long, n_shingles long, print binary, tokens array<long>, bits array<long>"
    )


def postings(signed: DataFrame) -> DataFrame:
    """``token``, ``_doc`` and ``before`` for the prefix of each document that can have a
    partner: the tokens of the prefix that come before this one in the common order."""
    rows = signed.select(DOC, F.explode("tokens").alias("token"))
    shared = rows.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    ranked = rows.join(shared, "token").groupBy(DOC).agg(
        F.sort_array(F.collect_list(F.struct("n", "token"))).alias("own")
    )
    # The tokens that a document has alone come first in its order and take their part
    # of the prefix.
    prefix = F.size("own") - F.lit(MATCHES - 1)
    own = F.slice(F.transform("own", lambda x: x["token"]), F.lit(1), prefix)
    return ranked.filter(prefix > 0).select(DOC, own.alias("own")).select(
        DOC, "own", F.posexplode("own").alias("place", "token")
    ).select("token", DOC, F.slice("own", F.lit(1), F.col("place")).alias("before"))


def shareable(texts: DataFrame) -> DataFrame:
    """``_doc``, ``n`` and ``s``: shingles of each document, and those that another one of
    ``texts`` has too."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(text) for text in batch.column(1).cast(pa.binary()).to_pylist()]
            owners = np.repeat(batch.column(0).to_numpy(), [len(x) for x in sets])
            values = np.concatenate(sets).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(owners), pa.array(values)], [DOC, "h"])

    rows = materialize(texts.select(DOC, "text").mapInArrow(cut, f"{DOC} long, h long"), "shingles")
    alone = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(DOC).alias(DOC)).filter("n = 1")
    lost = alone.groupBy(DOC).agg(F.count(F.lit(1)).alias("u"))
    sizes = rows.groupBy(DOC).agg(F.count(F.lit(1)).alias("n"))
    found = sizes.join(lost, DOC, "left").select(DOC, "n", (F.col("n") - F.coalesce("u", F.lit(0))).alias("s"))
    found = materialize(found, "bounds")
    forget(rows)
    return found


def agreeing() -> Column:
    """Coordinates in which the signatures ``ta`` and ``tb`` agree."""
    return F.size(F.filter(F.zip_with("ta", "tb", lambda x, y: x == y), lambda same: same))


def possible() -> Column:
    """Whether sets of ``na`` and ``nb`` shingles with the bitmaps ``va`` and ``vb`` can be
    similar: a bit that only one has is a shingle that only one has, and similar sets
    differ in at most a seventh of the sum of their sizes. Never false for similar sets."""
    differ = F.lit(0)
    for i in range(BITMAP_WORDS):
        differ += F.bit_count(F.get("va", F.lit(i)).bitwiseXOR(F.get("vb", F.lit(i))))
    return 7 * differ <= F.col("na") + F.col("nb")


def side(signed: DataFrame, x: str) -> DataFrame:
    """What ``possible`` and ``agreeing`` need of a side (``a`` or ``b``) of pairs."""
    return signed.select(
        F.col(DOC).alias(x), F.col("tokens").alias(f"t{x}"), F.col("n_shingles").alias(f"n{x}"), F.col("bits").alias(f"v{x}")
    )


def labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``rows`` with the ``label`` of their document, itself where ``labels`` has none."""
    if labels is None:
        return rows.withColumn("label", F.col(DOC))
    own = rows.join(labels.withColumnRenamed("node", DOC), DOC, "left")
    return own.withColumn("label", F.coalesce("label", DOC))


def band_pairs(known: DataFrame, labels: DataFrame | None, width: int) -> DataFrame:
    """Pairs (``a``, ``b``) of documents with the one of their pivots that is the most like
    them. Documents that agree in all coordinates of a band make a list, with one pivot.

    ``known`` has ``_doc``, ``n_shingles``, ``tokens`` and ``bits``.
    """
    bands = [[(first + k * (COORDINATES // width)) % COORDINATES for k in range(width)] for first in range(COORDINATES // width)]
    keys = F.array(*(F.xxhash64(F.lit(width), *(F.get("tokens", F.lit(c)) for c in band)) for band in bands))
    rows = labelled(known.select(DOC, "tokens"), labels).select(DOC, "label", F.explode(keys).alias("key"))
    pivot = F.struct(F.xxhash64(DOC, F.lit(width)), DOC, "label")
    pivots = rows.groupBy("key").agg(
        F.max(pivot).alias("pivot"), F.min("label").alias("least"), F.max("label").alias("most")
    ).filter("least < most").select("key", "pivot")
    # A document has a row for each band at most, so one shuffle by document serves all
    # that follows.
    met = rows.join(pivots, "key").filter(F.col("label") != F.col("pivot.label")).select(
        F.col(DOC).alias("a"), F.col(f"pivot.{DOC}").alias("b")
    ).repartition("a")
    met = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    # One pivot for each document before signatures are joined: that of the most bands.
    best = met.groupBy("a").agg(F.max(F.struct("n", F.xxhash64("a", "b"), "b")).alias("best")).select("a", "best.b")
    close = best.join(side(known, "a"), "a").join(side(known, "b"), "b")
    return close.filter(possible() & (agreeing() >= MATCHES)).select("a", "b")


def remaining_pairs(
    listed: DataFrame, known: DataFrame, labels: DataFrame | None, texts: DataFrame
) -> DataFrame:
    """Pairs of documents of different components that can be similar, each one once.

    Similar sets share at least 75 / 175 of the sum of their sizes, and no more than
    either shares with any document at all. A pair meets in every list of a common token;
    it is taken where that token is the first one common to both, and there the agreeing
    coordinates are counted.
    """
    placed = labelled(listed, labels)
    parts = placed.groupBy("token", "label").agg(F.count(F.lit(1)).alias("n"))
    lists = parts.groupBy("token").agg(
        F.max(F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("parts")
    ).filter("parts > 1").select("token", F.col("main.label").alias("main"))
    rows = materialize(placed.join(lists, "token"), "lists")
    open_ = rows.select(DOC).distinct()
    bounds = shareable(texts.join(open_, DOC, "left_semi"))
    rows = rows.join(bounds, DOC)
    ends = rows.groupBy("token").agg(F.min("n").alias("least_n"), F.max("s").alias("most_s"))
    able = 175 * F.least("s", "most_s") >= 75 * (F.col("n") + F.col("least_n"))
    rows = materialize(
        rows.join(ends, "token").filter(able).join(known.select(DOC, "tokens", "bits"), DOC)
        .select("token", DOC, "label", "main", "n", "s", "before", "tokens", "bits"), "open"
    )
    # Every pair of different components has a side outside the largest one.
    minor = rows.filter(F.col("label") != F.col("main")).select(
        "token", F.col(DOC).alias("a"), F.col("label").alias("la"), "main", F.col("n").alias("na"),
        F.col("s").alias("sa"), F.col("before").alias("fa"), F.col("tokens").alias("ta"), F.col("bits").alias("va"),
    )
    other = rows.select(
        "token", F.col(DOC).alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb"),
        F.col("s").alias("sb"), F.col("before").alias("fb"), F.col("tokens").alias("tb"), F.col("bits").alias("vb"),
    )
    return minor.join(
        other,
        (minor["token"] == other["token"])
        & (F.col("la") != F.col("lb"))
        & ((F.col("lb") == F.col("main")) | (F.col("a") < F.col("b")))
        & (175 * F.least("sa", "sb") >= 75 * (F.col("na") + F.col("nb")))
        & possible()
        & ~F.arrays_overlap("fa", "fb")
        & (agreeing() >= MATCHES),
    ).select("a", "b", "lb", agreeing().alias("n"))


def nearest(pairs: DataFrame) -> DataFrame:
    """Of ``remaining_pairs``, the pair with the most agreeing coordinates of each document
    and other component."""
    best = F.max(F.struct("n", F.xxhash64("a", "b"), "b")).alias("best")
    return pairs.groupBy("a", "lb").agg(best).select("a", "best.b")


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """``pairs`` whose documents have different labels."""
    own = pairs.select("a", "b")
    for x in ("a", "b"):
        own = own.join(labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")), x, "left")
    return own.filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (``a``, ``b``) whose sets are similar."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = None, None
        for batch in slices(batches, text=3):
            left = batch.column(2).cast(pa.binary()).to_pylist()
            right = batch.column(3).cast(pa.binary()).to_pylist()
            good = []
            ids = batch.column(1).to_pylist()
            for b, text_a, text_b in zip(ids, left, right, strict=True):
                if b != held:
                    held, own = b, shingle_set(text_b)
                good.append(similar(shingle_set(text_a), own))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    joined = (
        pairs.join(texts.select(F.col(DOC).alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col(DOC).alias("b"), F.col("text").alias("text_b")), "b")
        .select("a", "b", "text_a", "text_b")
    )
    return joined.mapInArrow(verify, "a long, b long")


def linked(
    pairs: DataFrame, edges: DataFrame | None, texts: DataFrame, steps: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Edges and labels (see ``components``) with the similar ones of ``pairs`` added."""
    found = materialize(confirm(pairs, texts), "links")
    old = [] if edges is None else [edges]
    new = joined(reduce(DataFrame.union, old, found), steps)
    for table in [found, *old]:
        forget(table)
    return new, labels_of(new)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``_doc``, ``n_shingles`` and ``label``, the smallest document reachable.

    ``docs`` has ``_doc`` (see ``common.identified``) and ``text``.
    """
    signed = materialize(signatures(docs), "signatures")
    classes = signed.filter("n_shingles > 0").groupBy("print").agg(F.min(DOC).alias("rep"))
    members = materialize(
        signed.select(DOC, "n_shingles", "print").join(classes, "print", "left").select(
            DOC, "n_shingles", F.coalesce("rep", DOC).alias("rep")
        ),
        "members",
    )
    single = signed.filter("n_shingles > 0").join(
        members.filter(F.col("rep") == F.col(DOC)).select(DOC), DOC, "left_semi"
    )
    listed = materialize(postings(single), "postings")
    posted = listed.select(DOC).distinct()
    texts = materialize(docs.select(DOC, "text").join(posted, DOC, "left_semi"), "candidates")
    known = materialize(signed.select(DOC, "n_shingles", "tokens", "bits").join(posted, DOC, "left_semi"), "candidate-signatures")
    forget(signed)
    edges = labels = None
    for width in BAND_WIDTHS:
        # Labels of one step only cost a round some pairs more; the join needs all steps.
        steps = None if width == BAND_WIDTHS[-1] else 1
        edges, labels = linked(band_pairs(known, labels, width), edges, texts, steps)
    pairs = materialize(remaining_pairs(listed, known, labels, texts), "pairs")
    edges, labels = linked(nearest(pairs), edges, texts)
    edges, labels = linked(apart(pairs, labels), edges, texts)
    forget(pairs)
    return members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        DOC, "n_shingles", F.coalesce("label", "rep").alias("label")
    )


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle
  FROM w, unnest(range(1, greatest(len(words) - 3, 2))) AS t(i) WHERE len(words) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
  FROM s a JOIN s b ON a.shingle = b.shingle GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 100 * common >= 75 * (nx.n + ny.n - common)
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON r.other = l.x
), least AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT l.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, l.doc_id = component_id AS kept
FROM least l LEFT JOIN n ON n.doc_id = l.doc_id
"""


def with_ids(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """Labels as document IDs, and whether a document is the one that stays."""
    ids = docs.select(DOC, "doc_id")
    own = labelled.join(ids, DOC)
    heads = ids.select(F.col(DOC).alias("label"), F.col("doc_id").alias("component_id"))
    return own.join(heads, "label").select(
        "doc_id", "n_shingles", "component_id", (F.col(DOC) == F.col("label")).alias("kept")
    )


@query("op6_near_dups", OP6_SQL)
def op6_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = identified(documents(spark, sf_dir).select("doc_id", blank("text").alias("text")))
    return with_ids(docs, near_duplicates(docs))
