"""Hard negatives against all scores."""

from __future__ import annotations

import math
import random

import brute
import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from logweft.llm import hard_negatives
from logweft.llm.queries import ORACLES, QUERIES

COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def plain(rows):
    usable = []
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        usable.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * x) for x in vector]))
    usable.sort()
    out = []
    for place, (anchor, label, vector) in enumerate(usable):
        if anchor % 100:
            continue
        scored = [
            (-sum(x * y for x, y in zip(vector, other[2])), i, other) for i, other in enumerate(usable) if i != place
        ]
        scored.sort()
        for score, _, positive in [x for x in scored if x[2][1] == label][:5]:
            found = [x for x in scored if x[2][1] != label and 30 * -score <= 100 * -x[0] <= 90 * -score][:10]
            out += [(anchor, positive[0], k, x[2][0], -score, -x[0]) for k, x in enumerate(found, 1)]
    return sorted(out, key=repr)


def made(width=12, scale=1.0):
    rng = random.Random(9)
    centres = [[rng.gauss(0, 1) / (1 + d) for d in range(width)] for _ in range(4)]
    rows = []
    for vec_id in range(90, 620):
        centre = rng.choice(centres)
        rows.append((vec_id, [scale * (x + rng.gauss(0, 0.2)) for x in centre], rng.randrange(3)))
    rows += [(700, None, 1), (800, [0.1] * width, None), (None, [0.1] * width, 1), (900, [0.1, None], 1)]
    rows += [(1000, [float("nan")] * width, 1), (1100, [float("inf")] * width, 1), (1200, [], 1), (1300, [0.5], 0)]
    rows += [(1400, [0.0] * width, 2), (1500, [-0.3] * width, 0)] + [(1601 + i, rows[10][1], i % 3) for i in range(40)]
    return rows + [rows[10], rows[10], (rows[10][0], rows[11][1], 2)]


def frame(spark, rows):
    full = [(*row, 1, 1, None) for row in rows]
    kind = "vec_id long, embedding array<double>, label int, q int, g int, _doc string"
    return spark.createDataFrame(full, kind).repartition(3)


@pytest.mark.parametrize("rows", [made(), made(scale=3e6), made()[:11], []])
def test_cases(spark, rows):
    got = hard_negatives.hard_negatives(hard_negatives.quantized(frame(spark, rows)), "vec_id % 100 = 0")
    want = plain(rows)
    assert brute.collected(got, *COLUMNS) == want
    assert len(rows) < 100 or len(want) > 100


def test_query(spark):
    path = f"{brute.SF_DIR}/embeddings.parquet"
    rows = [tuple(r[c] for c in ("vec_id", "embedding", "label")) for r in pq.read_table(path).to_pylist()]
    got = brute.collected(QUERIES["op13_hard_negatives"](spark, brute.SF_DIR), *COLUMNS)
    base = duckdb.connect()
    base.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{path}'")
    sql = base.sql(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLES['op13_hard_negatives']})").fetchall()
    assert got == plain(rows) == sorted((tuple(r) for r in sql), key=repr)


def test_scan_prunes():
    """Rows leave before the last column, and nothing that matters does."""
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(2000, 64)) * 100 / np.arange(1, 65)).astype(np.int64)
    group = hard_negatives.Group(np.arange(2000), np.zeros(2000, np.int64), vectors)
    seen = []

    def prune(least, most):
        seen.append(len(least))
        return most >= hard_negatives.kth(least, 5)

    rows, scores = group.scores(vectors[0], np.arange(2000), group.low, group.high, prune)
    exact = vectors @ vectors[0]
    assert np.array_equal(scores, exact[group.docs[rows]]) and seen[-1] < 200
    assert set(np.argsort(-exact, kind="stable")[:5]) <= set(group.docs[rows].tolist())
