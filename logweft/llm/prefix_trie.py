"""Prefix trie of conversations: one node for each distinct sequence of first turns.

Turns are encoded once, as 128 bits of the SHA-256 of role and text; a conversation is the
string of its codes. Equal conversations are united, and the distinct sequences are sorted
over range shards, so the conversations of a node lie side by side. Of a hot sequence only
packets of members travel, 256 consecutive IDs at most in each.

A shard is taken in blocks. The codes of a block get small numbers in code order, a ternary
search tree over these takes the sequences in median order, which balances the search trees
of all its levels, and a traversal with a stack, read backwards, adds up members, leaves
and savings below every node. Memory is bound by the block, not by the shard.

Nodes that continue in a neighbouring block or shard lie on the first or last path of a
block, as far as the neighbour's sequence agrees. Each block knows that sequence (the ends
of the shards travel as rows between shards), and so which of its nodes are new and which
paths go on: what it counts adds up over blocks without correction. These boundary nodes
are merged by the hash of their path; all others leave the block complete, but for the
parent's ID if the parent is a boundary node.

Cases: a null role or text is empty; rows without ``conv_id`` take no part; null turns come
first, and equal turns in the order of their codes; repeated rows are turns of their own; a
text of any length is one turn; an empty table gives no node, and any conversation, even
without turns, gives a root; other columns do not matter. One conversation's codes (16
bytes a turn) must fit in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import lookup_join
from .common import materialize, partitions, table
from .registry import query

CODE = 16
#: Bits of conversation IDs that share a packet of members.
PACKET_BITS = 8
#: Turns that a block of sequences has before it is closed.
BLOCK_TURNS = 1 << 17
NOTHING = hashlib.sha256(b"").hexdigest()
_WORD = r"[^\x20\x09-\x0D]+"
_NEXT = 1 << 62

Sequence = tuple[bytes, list[int], int, int, str]


def encoded(conversations: DataFrame) -> DataFrame:
    """``conv_id`` and ``turns``, the ordered (``code``, ``words``) of each conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    code = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * CODE)
    rows = conversations.select(
        F.expr("try_cast(conv_id AS bigint)").alias("conv_id"),
        F.struct(F.col("turn"), code.alias("code"), F.regexp_count(text, F.lit(_WORD)).alias("words")).alias("turn"),
    ).filter("conv_id IS NOT NULL")
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return ordered.select("conv_id", F.transform("turns", lambda t: F.struct(t["code"], t["words"])).alias("turns"))


def packets(conversations: DataFrame) -> DataFrame:
    """Equal conversations by packets of members: ``seq``, ``packet``, ``words``, ``members``."""
    turns = F.col("turns")
    rows = conversations.select(
        "conv_id",
        F.unhex(F.array_join(F.transform(turns, lambda t: t["code"]), "")).alias("seq"),
        F.transform(turns, lambda t: t["words"].cast("long")).alias("words"),
    )
    return rows.groupBy("seq", F.shiftright("conv_id", PACKET_BITS).alias("packet")).agg(
        F.first("words").alias("words"), F.sort_array(F.collect_list("conv_id")).alias("members")
    )


def _rows(batches: Iterator[pa.RecordBatch], size: int = 500) -> Iterator[dict]:
    """Rows as Python values, a few at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            yield from batch.slice(start, size).to_pylist()


def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each sequence from its packets, which follow each other."""
    held: Sequence | None = None
    hasher = hashlib.sha256()
    done: list[Sequence] = []
    for row in _rows(batches):
        members = ",".join(map(str, row["members"])).encode()
        if held and held[0] == row["seq"]:
            hasher.update(b"," + members)
            held = (*held[:2], held[2] + len(row["members"]), min(held[3], row["members"][0]), "")
            continue
        if held:
            done.append((*held[:4], hasher.hexdigest()))
        if len(done) == 500:
            yield _sequences(done)
            done = []
        hasher = hashlib.sha256(members)
        held = (row["seq"], row["words"], len(row["members"]), row["members"][0], "")
    if held:
        yield _sequences([*done, (*held[:4], hasher.hexdigest())])


def _sequences(rows: list[Sequence]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string()]
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["seq", "words", "n", "conv_id", "ends"]
    )


def shared(a: bytes | None, b: bytes | None) -> int:
    """Turns that two sequences begin with in common; -1 if there is no other sequence."""
    if a is None or b is None:
        return -1
    n = min(len(a), len(b)) // CODE
    if a[: n * CODE] == b[: n * CODE]:
        return n
    low, high = 0, n  # the first `low` turns agree, the first `high` do not
    while high - low > 1:
        middle = (low + high) // 2
        if a[low * CODE : middle * CODE] == b[low * CODE : middle * CODE]:
            low = middle
        else:
            high = middle
    return low


def path_keys(seq: bytes, depth: int) -> list[bytes]:
    """Hashes of the paths to the first ``depth`` turns, the root's first."""
    keys = [b"root"] if depth >= 0 else []
    for d in range(depth):
        keys.append(hashlib.sha256(keys[-1] + seq[d * CODE : (d + 1) * CODE]).digest()[:CODE])
    return keys


class Tree:
    """A ternary search tree of sequences of small numbers; node 0 is the root."""

    def __init__(self) -> None:
        self.symbol, self.less, self.down, self.more = [-1], [-1], [-1], [-1]
        self.n, self.least, self.words, self.end = [0], [_NEXT], [0], [-1]

    def _new(self, symbol: int, words: int) -> int:
        for column, value in (
            (self.symbol, symbol), (self.less, -1), (self.down, -1), (self.more, -1),
            (self.n, 0), (self.least, _NEXT), (self.words, words), (self.end, -1),
        ):
            column.append(value)
        return len(self.symbol) - 1

    def insert(self, symbols: list[int], words: list[int], n: int, conv_id: int, row: int) -> list[int]:
        """Add a sequence of ``n`` members; the nodes of its path."""
        path = [0]
        for symbol, count in zip(symbols, words, strict=True):
            at, links, place = self.down[path[-1]], self.down, path[-1]
            while at >= 0 and self.symbol[at] != symbol:
                links, place = (self.less if symbol < self.symbol[at] else self.more), at
                at = links[at]
            if at < 0:
                at = links[place] = self._new(symbol, count)
            path.append(at)
        for node in path:
            self.n[node] += n
            if conv_id < self.least[node]:
                self.least[node] = conv_id
        self.end[path[-1]] = row
        return path

    def traversed(self) -> Iterator[tuple[int, int, int]]:
        """Node, parent and depth, parents first."""
        stack = [(0, -1, 0)]
        while stack:
            node, parent, depth = stack.pop()
            yield node, parent, depth
            if depth:
                stack += [(x, parent, depth) for x in (self.less[node], self.more[node]) if x >= 0]
            if self.down[node] >= 0:
                stack.append((self.down[node], node, depth + 1))


def medians(n: int) -> Iterator[int]:
    """0 to ``n - 1``, the middle of every range before its halves."""
    stack = [(0, n)]
    while stack:
        low, high = stack.pop()
        if low < high:
            middle = (low + high) // 2
            yield middle
            stack += [(low, middle), (middle + 1, high)]


NODE = (
    "key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
)
_NODE_TYPES = [pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.string()]
_NODE_NAMES = [part.split()[0] for part in NODE.split(", ")]


def block_nodes(block: list[Sequence], before: bytes | None, after: bytes | None) -> pa.RecordBatch:
    """Nodes of consecutive sequences between the sequences ``before`` and ``after`` them.

    Boundary nodes have a ``key``; nodes below one have its key as ``parent_key``.
    """
    codes = {seq[i : i + CODE] for seq, *_ in block for i in range(0, len(seq), CODE)}
    number = {code: i for i, code in enumerate(sorted(codes))}
    tree, paths = Tree(), {}
    for row in medians(len(block)):
        seq, words, n, conv_id, _ = block[row]
        symbols = [number[seq[i : i + CODE]] for i in range(0, len(seq), CODE)]
        path = tree.insert(symbols, words, n, conv_id, row)
        if row in (0, len(block) - 1):
            paths[row] = path
    first, last = block[0][0], block[-1][0]
    back, ahead = shared(before, first), shared(last, after)
    keys: dict[int, bytes] = {}
    for row, depth in ((0, back), (len(block) - 1, ahead)):
        keys.update(zip(paths[row], path_keys(block[row][0], depth)))
    old = set(paths[0][: back + 1])
    continued = paths[len(block) - 1][-1] if ahead >= 0 and ahead * CODE == len(last) else -1

    order = list(tree.traversed())
    size = len(tree.symbol)
    children, below, leaves, saved = [0] * size, [0] * size, [0] * size, [0] * size
    for node, parent, _ in reversed(order):
        if not below[node] and node != continued:
            leaves[node] += 1
        saved[node] += (tree.n[node] - (node not in old)) * tree.words[node]
        if parent >= 0:
            below[parent] += 1
            children[parent] += node not in old
            leaves[parent] += leaves[node]
            saved[parent] += saved[node]
    rows = [
        (
            keys.get(node), keys.get(parent), tree.least[node], depth,
            tree.least[parent] if parent >= 0 and parent not in keys else None,
            tree.n[node], children[node], leaves[node], saved[node],
            block[tree.end[node]][4] if tree.end[node] >= 0 else None,
        )
        for node, parent, depth in order
    ]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), _NODE_TYPES, strict=True)], _NODE_NAMES
    )


def _blocks(rows: Iterable[dict]) -> Iterator[tuple[list[Sequence], bytes | None, bytes | None]]:
    """Blocks of sequences with their neighbours. Rows come by shard and place; the first
    and last row of a shard may be an end of its neighbours, without members."""
    shard, before, block, turns = None, None, [], 0
    for row in rows:
        if row["shard"] != shard:
            if block:
                yield block, before, None
            shard, before, block, turns = row["shard"], None, [], 0
        if row["n"] is None:
            if block:
                yield block, before, row["seq"]
                block, turns = [], 0
            before = row["seq"]
            continue
        if turns >= BLOCK_TURNS:
            yield block, before, row["seq"]
            before, block, turns = block[-1][0], [], 0
        block.append((row["seq"], row["words"], row["n"], row["conv_id"], row["ends"]))
        turns += 1 + len(row["words"])
    if block:
        yield block, before, None


def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, before, after in _blocks(_rows(batches)):
        nodes = block_nodes(block, before, after)
        for start in range(0, nodes.num_rows, 10_000):
            yield nodes.slice(start, 10_000)


def merged(nodes: DataFrame) -> DataFrame:
    """Boundary nodes united, and the parents' IDs below them."""
    def total(name: str) -> Column:
        return F.sum(name).alias(name)

    boundary = nodes.filter("key IS NOT NULL").groupBy("key").agg(
        F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"),
        *(total(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.max("ends_sha256").alias("ends_sha256"),
    )
    boundary = materialize(boundary, "boundary")
    inner = nodes.filter("key IS NULL")
    shown = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    hanging = inner.filter("parent_key IS NOT NULL").select("parent_key", *shown).union(boundary.select("parent_key", *shown))
    parents = boundary.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    placed = lookup_join(hanging, parents, ["parent_key"], F.struct("conv_id", "depth"))
    out = [*shown[:2], "parent_conv_id", *shown[2:]]
    return inner.filter("parent_key IS NULL").select(*out).union(placed.select(*out)).withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING))
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Nodes of the trie of ``conversations`` (``conv_id``, unique, and ``turns``; see ``encoded``).

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` (tokens that prefix sharing saves in the subtree) and
    ``ends_sha256`` of the sorted members that end at the node.
    """
    n = partitions(conversations.sparkSession)
    ordered = packets(conversations).repartitionByRange(n, "seq").sortWithinPartitions("seq", "packet")
    rows = ordered.mapInArrow(united, "seq binary, words array<long>, n long, conv_id long, ends string")
    stored = materialize(
        rows.withColumn("shard", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), "sequences"
    )
    # One row for each shard.
    ends = stored.groupBy("shard").agg(F.min_by("seq", "place").alias("first"), F.max_by("seq", "place").alias("last"))
    order = Window.orderBy("shard")
    around = ends.select("shard", F.lag("last").over(order).alias("before"), F.lead("first").over(order).alias("after"))
    around = materialize(around, "shard-ends")
    for name, place in (("before", -1), ("after", _NEXT)):
        end = around.filter(F.col(name).isNotNull()).select("shard", F.col(name).alias("seq"), F.lit(place).cast("long").alias("place"))
        stored = stored.unionByName(end, allowMissingColumns=True)
    dealt = stored.repartition(n, "shard").sortWithinPartitions("shard", "place")
    return merged(materialize(dealt.mapInArrow(grown, NODE), "nodes"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Every conversation c with its first h turns replaced by those of conversation
    c - c % 20, where h is crc32 of c's decimal digits modulo 4."""
    heads = conversations.filter("conv_id % 20 = 0").select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, 3).alias("head")
    )
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(4)).cast("int")
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), h)
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
    based = conversations.withColumn("base", F.expr("conv_id - conv_id % 20"))
    return based.join(heads, "base", "left").select("conv_id", F.concat(head, rest).alias("turns"))


OP12_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), e AS (
  SELECT conv_id, turn, substr(sha256(length(role) || ':' || role || text), 1, 32) AS code,
    len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS words
  FROM t
), own AS (
  SELECT conv_id, list({'code': code, 'words': words} ORDER BY turn NULLS FIRST, code) AS turns,
    list_reduce(list_concat([4294967295], flatten(list_transform(string_split(conv_id::VARCHAR, ''),
      lambda d: [ascii(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END) AS crc
  FROM e GROUP BY conv_id
), c AS (
  SELECT o.conv_id, list_concat(coalesce(b.turns[1:xor(o.crc, 4294967295) % 4], []),
    o.turns[xor(o.crc, 4294967295) % 4 + 1:]) AS turns
  FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20
), p AS (
  SELECT conv_id, d, len(turns) AS turns,
    array_to_string(list_transform(turns[1:d], lambda x: x.code), '') AS node,
    CASE WHEN d > 0 THEN array_to_string(list_transform(turns[1:d - 1], lambda x: x.code), '') END AS parent,
    CASE WHEN d > 0 THEN turns[d].words ELSE 0 END AS words
  FROM c, unnest(range(0, len(turns) + 1)) AS u(d)
), n AS (
  SELECT node, any_value(parent) AS parent, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = turns), '')) AS ends_sha256
  FROM p GROUP BY node, d
), k AS (
  SELECT parent AS node, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent
), s AS (
  SELECT p.node, sum((n.n_convs - 1) * n.words) AS saved_tokens, count(*) FILTER (k.node IS NULL) AS n_leaves
  FROM n JOIN p ON p.conv_id = n.conv_id AND p.d <= n.depth LEFT JOIN k ON k.node = n.node GROUP BY p.node
)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children,
  s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN s ON s.node = n.node LEFT JOIN k ON k.node = n.node LEFT JOIN n up ON up.node = n.parent
"""


@query("op12_prefix_trie", OP12_SQL)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(encoded(table(spark, sf_dir, "conversations"))))
