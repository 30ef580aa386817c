"""Line dedup against a plain version."""

from __future__ import annotations

import brute
import numpy as np
import pytest

from logweft.llm import line_dedup
from logweft.llm.common import identified
from logweft.llm.queries import QUERIES

LONG = "A line of text that is long enough to be counted here"
ROWS = [
    (1, None),
    (2, ""),
    (3, f"{LONG}\nshort\n  {LONG.upper()} \t"),
    (4, f"é{LONG}\n{LONG}"),
    (5, f"{LONG.lower()}\n\n"),
    (5, f"{LONG.lower()}\n\n"),
    (None, f"{LONG}\r\nown line of a row without any identity"),
    (7, "\n".join(["é" * 39, "é" * 40, "İ" * 40])),
    *[(20 + i, "\n".join(["é" * 39, "é" * 40, "İ" * 40, "i̇" * 40])) for i in range(5)],
]


def plain(rows):
    """By order of the ID, nulls last."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1] or ""))
    holders: dict = {}
    split = {}
    for rank, i in enumerate(order):
        lines = (rows[i][1] or "").split("\n")
        keys = []
        for line in lines:
            key = "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
            keys.append(key)
            if len(key) >= 40:
                holders.setdefault(key, set()).add(rank)
        split[i] = (rank, lines, keys)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        rank, lines, keys = split[i]
        kept = [
            line
            for line, key in zip(lines, keys, strict=True)
            if len(holders.get(key, ())) < 5 or max(holders[key]) == rank
        ]
        out.append((doc_id, len(lines), len(lines) - len(kept), brute.sha("\n".join(kept).encode())))
    return sorted(out, key=repr)


def test_query(spark):
    got = brute.collected(QUERIES["op4_line_dedup"](spark, brute.SF_DIR), "doc_id", "n_lines", "n_dropped", "kept_sha256")
    want = plain(brute.documents())
    assert got == want and any(row[2] for row in want)


@pytest.mark.parametrize("hot_keys", [1, 4, 1 << 16])
@pytest.mark.parametrize("rows", [ROWS, []])
def test_cases(spark, rows, hot_keys, monkeypatch):
    """With no, some and all repeated lines broadcast."""
    monkeypatch.setattr(line_dedup, "HOT_KEYS", hot_keys)
    docs = identified(brute.frame(spark, rows).drop("_doc").select("doc_id", "text"))
    got = line_dedup.drop_repeated_lines(docs)
    got = got.selectExpr("doc_id", "n_lines", "n_dropped", "sha2(text, 256) AS s")
    assert brute.collected(got, *got.columns) == plain(rows)


def test_full_filter_changes_nothing(spark, monkeypatch):
    """A filter with far too few bits suspects everything; the result is the same."""
    monkeypatch.setattr(line_dedup, "bits_for", lambda n: 1 << 10)
    got = brute.collected(QUERIES["op4_line_dedup"](spark, brute.SF_DIR), "doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert got == plain(brute.documents())


def test_filter_has_all_repeats():
    rng = np.random.default_rng(0)
    hashes = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    segment, first, second = line_dedup.places(hashes, 1 << 20)
    twice = [line_dedup._unpack(line_dedup._pack(first[segment == k], second[segment == k], 1 << 20)) for k in range(64)]
    assert line_dedup.suspected(hashes.tolist(), twice, 1 << 20).all()
    others = rng.integers(0, 1 << 63, 10000, dtype=np.uint64)
    assert line_dedup.suspected(others.tolist(), twice, 1 << 20).mean() < 0.01
