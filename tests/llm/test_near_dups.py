"""Near duplicates against all pairs."""

from __future__ import annotations

import random
import re

import brute
import pytest

from logweft.llm import components as components_module
from logweft.llm import near_dups
from logweft.llm.common import identified
from logweft.llm.components import components
from logweft.llm.queries import QUERIES

COLUMNS = ("doc_id", "n_shingles", "component_id", "kept")


def plain(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))
    sets = []
    for _, text in rows:
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", folded)
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and 100 * common >= 75 * (len(a) + len(sets[j]) - common):
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
    return sorted(
        ((r[0], len(sets[i]), rows[root(i)][0], root(i) == i) for i, r in enumerate(rows)), key=repr
    )


def made(seed: int):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    rows: list[tuple] = [(1, None), (2, ""), (3, "One two"), (4, "one TWO"), (None, "one two"), (5, "É x y z a b"), (6, "é x y z a b")]
    base = [rng.choice(words) for _ in range(80)]
    for k in range(60):
        own = list(base)
        for _ in range(rng.randint(0, 5)):
            own[rng.randrange(80)] = rng.choice(words)
        rows.append((10 + k, " ".join(own)))
    rows += [(100, rows[9][1]), (100, rows[9][1]), (101, rows[10][1].upper())]
    for k in range(40):
        rows.append((200 + k, " ".join(base[:30] + [rng.choice(words) for _ in range(rng.randint(5, 60))])))
    return rows


def test_query(spark):
    got = brute.collected(QUERIES["op6_near_dups"](spark, brute.SF_DIR), *COLUMNS)
    want = plain(brute.documents())
    assert got == want and not all(row[3] for row in want)


@pytest.mark.parametrize(("rows", "widths"), [(made(1), ()), (made(2), near_dups.BAND_WIDTHS), ([], (4,))])
def test_cases(spark, rows, widths, monkeypatch):
    monkeypatch.setattr(near_dups, "BAND_WIDTHS", widths)
    docs = identified(brute.frame(spark, rows).drop("_doc").selectExpr("doc_id", "coalesce(text, '') AS text"))
    got = near_dups.with_ids(docs, near_dups.near_duplicates(docs))
    assert brute.collected(got, *COLUMNS) == plain(rows)


def test_components(spark):
    edges = [(i + 1, i) for i in range(30)] + [(50, 60), (60, 55), (70, 70)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, 60: 50, 55: 50}


def test_steps_end_at_stars(spark, monkeypatch):
    """Edges that are stars already take one step, and a long path ends as one star."""
    steps = []
    stored = components_module.materialize
    monkeypatch.setattr(components_module, "materialize", lambda df, name: steps.append(name) or stored(df, name))
    edges = spark.createDataFrame([(1, 0), (2, 0), (5, 4)], "a long, b long")
    assert {(r["node"], r["label"]) for r in components(edges).collect()} == {(1, 0), (2, 0), (5, 4)}
    assert len(steps) == 1
    path = spark.createDataFrame([(i + 1, i) for i in range(30)], "a long, b long")
    few = components_module.labels_of(components_module.joined(path, 1)).collect()
    assert {r["label"] for r in few} <= set(range(30)) and len(few) == 30
    assert {r["label"] for r in components(components_module.joined(path, 1)).collect()} == {0}


def test_pairs_after_the_nearest(spark):
    """A document next to all of a component is compared with one of it, then with none."""
    pairs = spark.createDataFrame(
        [(9, b, 0, 12 + b) for b in range(5)] + [(9, 20, 20, 12), (8, 1, 0, 13)], "a long, b long, lb long, n int"
    )
    first = {(r["a"], r["b"]) for r in near_dups.nearest(pairs).collect()}
    assert first == {(9, 4), (9, 20), (8, 1)}
    labels = spark.createDataFrame([(i, 0) for i in (1, 2, 3, 4, 9)], "node long, label long")
    assert {(r["a"], r["b"]) for r in near_dups.apart(pairs, labels).collect()} == {(9, 20), (8, 1)}
