"""SimHash classes against all pairs."""

from __future__ import annotations

import random
import re

import brute
import pytest
import xxhash

from logweft.llm import simhash
from logweft.llm.common import identified
from logweft.llm.queries import QUERIES

COLUMNS = ("doc_id", "fingerprint", "component_id")


def print_of(text: str | None) -> int:
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", folded)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> bit & 1 for h in hashes) > len(hashes)) << bit for bit in range(64))


def linked(prints: list[int], distance: int = 4) -> list[int]:
    label = list(range(len(prints)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= distance:
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(prints))]


def plain(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))
    prints = [print_of(text) for _, text in rows]
    return sorted(
        ((r[0], f"{prints[i]:016x}", rows[head][0]) for i, (r, head) in enumerate(zip(rows, linked(prints), strict=True))),
        key=repr,
    )


def test_query(spark):
    got = brute.collected(QUERIES["op11_simhash"](spark, brute.SF_DIR), *COLUMNS)
    want = plain(brute.documents())
    assert got == want and any(row[0] != row[2] for row in want)


def made():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows: list[tuple] = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one TWO"), (None, "one two"), (6, "É x"), (7, "é x")]
    base = [rng.choice(words) for _ in range(300)]
    for k in range(40):
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(300)] = rng.choice(words)
        rows.append((10 + k, " ".join(own)))
    return rows + [(20, rows[9][1]), (20, rows[9][1])]


@pytest.mark.parametrize("rows", [made(), []])
def test_cases(spark, rows):
    docs = identified(brute.frame(spark, rows).drop("_doc").selectExpr("doc_id", "coalesce(text, '') AS text", "lang AS label"))
    assert brute.collected(simhash.with_ids(docs, simhash.near_prints(docs)), *COLUMNS) == plain(rows)


def test_long_texts(monkeypatch):
    rng = random.Random(6)
    text = "".join(rng.choice(["a ", "bb\n", "C  ", "dddddddd\t"]) for _ in range(900)) + "x" * 300
    want = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "PIECE", 40)
    monkeypatch.setattr(simhash, "COUNTED", 7)
    assert simhash.fingerprint(text.encode()) == want == print_of(text)


@pytest.mark.parametrize("distance", [0, 4])
def test_links(spark, distance):
    """Prints around a few centres, at every distance and on both sides of the limit."""
    rng = random.Random(distance)
    centres = [0, (1 << 64) - 1, *(rng.getrandbits(64) for _ in range(6))]
    prints = set(centres)
    for centre in centres:
        for _ in range(60):
            flipped = centre
            for bit in rng.sample(range(64), rng.randint(1, 9)):
                flipped ^= 1 << bit
            prints.add(flipped)
    prints = sorted(prints, key=lambda p: rng.random())
    rows = [(simhash._signed(p), i) for i, p in enumerate(prints)]
    found = simhash.links(spark.createDataFrame(rows, "print long, rep long").repartition(3), distance)
    got = {r["node"]: r["label"] for r in found.collect()}
    want = linked(prints, distance)
    assert [got.get(i, i) for i in range(len(prints))] == want
    assert distance == 0 or len(set(want)) < len(prints)
