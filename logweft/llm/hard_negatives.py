"""Hard negatives by vertical scans (BOND: branch and bound on decomposed vectors).

Anchors are a stated part of the rows and meet all rows, in groups: rows are dealt over
groups of bounded size, each anchor goes to every group, and a task holds one group at a
time, as one column of numbers for each dimension, while anchors stream past. An anchor
reads the columns in the order of its own components, the largest magnitude first. Between
steps of a few columns the partial scores, with the least and the most that the remaining
columns can add in this group, bound every row's score; rows that cannot matter any more
leave the candidate bitmap, and the columns are cut to the rest when half of it is gone. The
rows that stay have exact scores at the end.

The first pass finds an anchor's positives, the rows of its label with the highest scores: a
row goes if its upper bound is below the best lower bounds. The second pass finds, for each
positive, the best rows of other labels with a score in a window set by the positive's: a
row goes if it lies outside of all windows or below the best rows that are surely inside.
Groups give a few rows for each anchor (and positive), from which the best are ranked.

Cases: rows with a null ID, a null label, a null vector or a null or non-finite component
take no part; equal scores go by ID; rows that repeat an ID are rows of their own (see
``common.identified``), an anchor each if the ID is one; vectors of different length are
compared as if the shorter one ended in zeros; scores must fit in a long; an empty table
gives no row, as does an anchor without positives or a window without rows (a negative
positive score has an empty window); other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import DOC, identified, materialize, partitions, table
from .registry import query

POSITIVES = 5
NEGATIVES = 10
#: Percentages of the positive's score between which a negative's lies.
LEAST, MOST = 30, 90
#: Components of the rows of a group.
GROUP_SIZE = 1 << 22
#: Columns read between two looks at the bounds.
STEP = 8
#: Up to here sums of products are exact as doubles.
EXACT = 1 << 53

Prune = Callable[[np.ndarray, np.ndarray], np.ndarray]


class Group:
    """Rows of a group, ordered by label, as columns."""

    def __init__(self, docs: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((docs, labels))
        self.docs, self.labels = docs[order], labels[order]
        self.size = float(max(vectors.max(initial=0), -float(vectors.min(initial=0))))
        whole = np.ascontiguousarray(vectors[order].T)
        #: As doubles, which are fast, wherever products of two such numbers are exact.
        self.reals = whole.astype(np.float64) if self.size**2 < EXACT else whole
        self.low, self.high = self._ends(slice(None))
        self.of_label = {}
        for label in np.unique(self.labels):
            own = slice(*np.searchsorted(self.labels, [label, label + 1]))
            self.of_label[label] = (own, *self._ends(own))

    def _ends(self, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        part = self.reals[:, rows]
        return part.min(axis=1), part.max(axis=1)

    def scores(
        self, anchor: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray, prune: Prune
    ) -> tuple[np.ndarray, np.ndarray]:
        """The rows that ``prune`` keeps to the end, and their scores."""
        dims = min(len(anchor), len(self.reals))
        anchor, low, high = anchor[:dims], low[:dims], high[:dims]
        largest = float(np.abs(anchor.astype(np.float64)).max(initial=0))
        if largest * max(self.size, 1) * max(dims, 1) >= EXACT:
            # Bounds would be rounded.
            return rows, anchor @ self.reals[:dims, rows].astype(np.int64)
        order = np.argsort(-np.abs(anchor), kind="stable")
        order = order[: np.count_nonzero(anchor)]
        weights = anchor[order].astype(np.float64)
        ends = weights * low[order], weights * high[order]
        least, most = (np.append(np.cumsum(f(*ends)[::-1])[::-1], 0) for f in (np.minimum, np.maximum))
        columns, partial, alive = self.reals, np.zeros(len(rows)), np.ones(len(rows), bool)
        at = rows  # where the candidates are in `columns`
        for start in range(0, len(order), STEP):
            if not len(rows):
                break
            chosen = order[start : start + STEP]
            part = columns[chosen][:, at] if len(at) < columns.shape[1] else columns[chosen]
            partial += weights[start : start + STEP] @ part
            done = min(start + STEP, len(order))
            alive &= prune(partial + least[done], partial + most[done])
            left = np.count_nonzero(alive)
            if 2 * left <= len(rows):
                rows, at, partial = rows[alive], at[alive], partial[alive]
                alive = np.ones(left, bool)
        return rows[alive], partial[alive].astype(np.int64)


def kth(values: np.ndarray, k: int) -> float:
    """The k-th largest value, or less than all if there are fewer."""
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def best(docs: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((docs, -scores))[:k]


Found = list[tuple[int, int, int]]


def positives_of(group: Group, doc: int, label: int, anchor: np.ndarray, k: int = POSITIVES) -> Found:
    """(place of the positive, row, score) of the best rows of the anchor's label."""
    if label not in group.of_label:
        return []
    own, low, high = group.of_label[label]
    rows = np.arange(own.start, own.stop)
    rows = rows[group.docs[own] != doc]
    rows, scores = group.scores(anchor, rows, low, high, lambda least, most: most >= kth(least, k))
    top = best(group.docs[rows], scores, k)
    return [(0, int(group.docs[rows[i]]), int(scores[i])) for i in top]


def window(score: int) -> tuple[int, int]:
    """The least and the largest score of a negative for a positive's score."""
    return -(-LEAST * score // 100), MOST * score // 100


def negatives_of(group: Group, label: int, anchor: np.ndarray, goals: list[int], k: int = NEGATIVES) -> Found:
    """(place of the positive, row, score) of the best rows of other labels in each window."""
    windows = [window(score) for score in goals]
    own = group.of_label[label][0] if label in group.of_label else slice(0, 0)
    rows = np.concatenate((np.arange(own.start), np.arange(own.stop, len(group.docs))))

    def prune(least: np.ndarray, most: np.ndarray) -> np.ndarray:
        useful = np.zeros(len(least), bool)
        for low, high in windows:
            inside = least[(least >= low) & (most <= high)]
            useful |= (most >= max(low, kth(inside, k))) & (least <= high)
        return useful

    rows, scores = group.scores(anchor, rows, group.low, group.high, prune)
    found = []
    for place, (low, high) in enumerate(windows):
        inside = np.flatnonzero((scores >= low) & (scores <= high))
        top = inside[best(group.docs[rows[inside]], scores[inside], k)]
        found += [(place, int(group.docs[rows[i]]), int(scores[i])) for i in top]
    return found


def _vectors(column: pa.ListArray) -> np.ndarray:
    """Vectors as rows, filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    width = sizes.max(initial=0)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _group(parts: list[pa.RecordBatch]) -> Group:
    vectors = [_vectors(part.column("q")) for part in parts]
    width = max(v.shape[1] for v in vectors)
    filled = [np.pad(v, ((0, 0), (0, width - v.shape[1]))) for v in vectors]
    docs, labels = (np.concatenate([part.column(c).to_numpy() for part in parts]) for c in (DOC, "label"))
    return Group(docs, labels, np.concatenate(filled))


def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each group, then the anchors with it: those without goals look for
    positives, those with goals (scores of their positives) for negatives."""
    held, parts, group = None, [], None
    for batch in batches:
        keys = batch.column("g").to_numpy()
        anchors = batch.column("is_anchor").to_numpy(zero_copy_only=False)
        changes = np.flatnonzero((keys[1:] != keys[:-1]) | (anchors[1:] != anchors[:-1])) + 1
        for start, end in zip([0, *changes], [*changes, len(keys)], strict=True):
            if start == end:
                continue
            part = batch.slice(start, end - start)
            if keys[start] != held:
                held, parts, group = keys[start], [], None
            if not anchors[start]:
                parts.append(part)
                continue
            if not parts:
                continue
            if group is None:
                group = _group(parts)
            out: list[tuple] = []
            goals = part.column("goals").to_pylist()
            docs, labels = (part.column(c).to_pylist() for c in (DOC, "label"))
            for i, vector in enumerate(_vectors(part.column("q"))):
                own = (
                    positives_of(group, docs[i], labels[i], vector)
                    if goals[i] is None
                    else negatives_of(group, labels[i], vector, goals[i])
                )
                out += [(docs[i], *row) for row in own]
                if len(out) > 10_000:
                    yield _found(out)
                    out = []
            yield _found(out)


def _found(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor", "place", DOC, "score"])


def meet(rows: DataFrame, anchors: DataFrame, groups: int) -> DataFrame:
    """``anchor``, ``place``, ``_doc`` and ``score`` that the scans of all groups find."""
    held = rows.select(
        F.pmod(F.xxhash64(DOC), F.lit(groups)).cast("int").alias("g"), F.lit(False).alias("is_anchor"), DOC, "label", "q",
        F.lit(None).cast("array<long>").alias("goals"),
    )
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    asked = anchors.select(every.alias("g"), F.lit(True).alias("is_anchor"), DOC, "label", "q", "goals")
    dealt = held.union(asked).repartition(partitions(rows.sparkSession), "g").sortWithinPartitions("g", "is_anchor")
    return dealt.mapInArrow(scanned, f"anchor long, place long, {DOC} long, score long")


def ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), DOC)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: str) -> DataFrame:
    """For each anchor (rows with the condition ``is_anchor``) and each of its positives the
    first negatives: ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``,
    ``positive_score``, ``negative_score``.

    ``rows`` has ``vec_id``, ``label`` and ``q``, an array of longs, without nulls.
    """
    rows = materialize(identified(rows.select("vec_id", "label", "q"), "vec_id"), "vectors")
    size = rows.select(F.sum(F.size("q").cast("long"))).first()[0] or 0
    groups = max(partitions(rows.sparkSession), -(-size // GROUP_SIZE))
    anchors = rows.filter(is_anchor)
    asked = anchors.withColumn("goals", F.lit(None).cast("array<long>"))
    positives = materialize(ranked(meet(rows, asked, groups), ["anchor"], POSITIVES), "positives")
    goals = positives.groupBy(F.col("anchor").alias(DOC)).agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("p"))
    asked = anchors.join(goals.select(DOC, F.col("p.score").alias("goals")), DOC)
    negatives = ranked(meet(rows, asked, groups), ["anchor", "place"], NEGATIVES)
    ids = rows.select(DOC, "vec_id")

    def named(name: str) -> DataFrame:
        return ids.select(F.col(DOC).alias(name), F.col("vec_id").alias(f"{name}_id"))

    of = positives.select(
        "anchor", (F.col("rank") - 1).cast("long").alias("place"), F.col(DOC).alias("positive"), F.col("score").alias("positive_score")
    )
    pairs = of.join(named("anchor"), "anchor").join(named("positive"), "positive")
    out = negatives.select("anchor", "place", "rank", F.col(DOC).alias("negative"), F.col("score").alias("negative_score"))
    return out.join(named("negative"), "negative").join(pairs, ["anchor", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def quantized(embeddings: DataFrame) -> DataFrame:
    """Whole components of the rows that take part; every seventh label is moved by one."""
    x = F.col("embedding")
    usable = F.forall(x, lambda v: F.coalesce((v.cast("double") < float("inf")) & (v.cast("double") > float("-inf")), F.lit(False)))
    label = F.col("label").cast("long")
    return embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.when(usable, F.transform(x, lambda v: F.floor(256 * v.cast("double")).cast("long"))).alias("q"),
    ).filter("vec_id IS NOT NULL AND label IS NOT NULL AND q IS NOT NULL")


OP13_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, e.vec_id AS id, a.label = e.label AS same,
    list_inner_product(a.q, e.q)::BIGINT AS score
  FROM e a JOIN e ON a.vec_id % 100 = 0 AND a.vec_id <> e.vec_id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, positive_id,
  row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
  AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


@query("op13_hard_negatives", OP13_SQL)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(quantized(table(spark, sf_dir, "embeddings")), "vec_id % 100 = 0")
