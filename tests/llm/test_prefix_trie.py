"""The prefix trie against a plain one."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import brute
import duckdb
import pyarrow.parquet as pq
import pytest

from logweft.llm import prefix_trie
from logweft.llm.queries import ORACLES, QUERIES

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def code(role: str | None, text: str | None) -> str:
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]


def plain(rows):
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own[conv_id].append(((turn is not None, turn or 0), code(role, text), (role or "", text or "")))
    own = {c: [t[2] for t in sorted(turns)] for c, turns in own.items()}
    members = defaultdict(list)
    ends = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    out = []
    for node, ids in members.items():
        under = [x for x in members if x[: len(node)] == node]
        inner = {x[:-1] for x in members if x}
        saved = sum((len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in under if x)
        out.append((
            min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids),
            sum(len(x) == len(node) + 1 for x in under), sum(x not in inner for x in under), saved,
            hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def made():
    rng = random.Random(3)
    rows = [(None, 1, "user", "lost"), (7, None, None, None), (7, 1, "user", None), (7, 1, None, "user"), (7, 1, None, "user")]
    rows += [(20, t, "user", "x y  z") for t in range(30)]
    for c in range(21, 40):
        rows += [(c, t, "user", rng.choice(["x y  z", "x", ""])) for t in range(rng.randint(1, 5))]
    for c in range(5000, 9000, 61):
        rows += [(c, t, rng.choice(["user", "bot"]), rng.choice(["a", "b c"])) for t in range(rng.randint(1, 4))]
    return rows


def frame(spark, rows):
    full = [(*row, "extra", 1) for row in rows]
    kind = "conv_id long, turn int, role string, text string, seq string, shard int"
    return spark.createDataFrame(full, kind).repartition(3)


@pytest.mark.parametrize(("rows", "turns"), [(made(), 1), (made(), 25), (made()[:1], 9), ([], 9), ([(41, 1, "a", "b")], 9)])
def test_cases(spark, rows, turns, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK_TURNS", turns)
    got = prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.encoded(frame(spark, rows))))
    assert brute.collected(got, *COLUMNS) == plain(rows)


def test_query(spark):
    path = f"{brute.SF_DIR}/conversations.parquet"
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in pq.read_table(path).to_pylist()]
    got = brute.collected(QUERIES["op12_prefix_trie"](spark, brute.SF_DIR), *COLUMNS)
    base = duckdb.connect()
    base.sql(f"CREATE VIEW conversations AS SELECT * FROM '{path}'")
    sql = sorted((tuple(r) for r in base.sql(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLES['op12_prefix_trie']})").fetchall()), key=repr)
    assert got == plain(rows) == sql


@pytest.mark.parametrize("cut", [1, 3, 50])
def test_blocks(cut):
    """Sums over blocks do not depend on where blocks end."""
    rng = random.Random(cut)
    texts = sorted({bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 7))) for _ in range(60)})
    rows = [(b"".join(bytes([c]) * 16 for c in t), [1] * len(t), 1, i, "e") for i, t in enumerate(texts)]
    totals = defaultdict(lambda: [0, 0, 0, 0])
    for start in range(0, len(rows), cut):
        block = rows[start : start + cut]
        before = rows[start - 1][0] if start else None
        after = rows[start + cut][0] if start + cut < len(rows) else None
        for node in prefix_trie.block_nodes(block, before, after).to_pylist():
            own = totals[node["key"] or (start, node["conv_id"], node["depth"])]
            for i, name in enumerate(("n_convs", "n_children", "n_leaves", "saved_tokens")):
                own[i] += node[name]
    prefixes = {t[:d] for t in texts for d in range(len(t) + 1)}
    root = totals[b"root"] if cut < len(rows) else totals[(0, 0, 0)]
    leaves = sum(not any(q != p and q.startswith(p) for q in prefixes) for p in prefixes)
    saved = sum(sum(t.startswith(p) for t in texts) - 1 for p in prefixes if p)
    assert root == [len(texts), sum(len(p) == 1 for p in prefixes), leaves, saved]
    assert len(totals) == len(prefixes)
