"""Removal of word sequences that occur earlier, found by recompression.

In each round first runs of one symbol and then pairs of symbols become new symbols: a
hash bit puts every symbol left or right, and each left symbol with a right one behind
it makes a pair. Names are 64-bit hashes of what they stand for, so all tasks give equal
stretches equal names without a table of names to exchange.

Whether a symbol comes into being depends on its neighbours. Each symbol carries the
reach of words that decided it; equal word sequences have the same symbols among those
whose reach lies inside. Every window of ``WIDTH`` words is represented by the symbol
inside it that stands for the most words, of those the one with the smallest hash; level 0,
the words themselves, always has one. ``repeats`` brings equal symbols together and
verifies the windows around them.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A word goes if a window that covers it has a
word sequence that also starts earlier: in a smaller document or earlier in the same one.

Cases: a null text has no words; texts with fewer words than a window lose nothing;
repeated rows and rows without ID are documents of their own (see ``common.identified``);
an empty table gives no row; other columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import _LOW, BASE, MIX_1, mix, prefix_hashes, span_hashes
from .common import DOC, blank, documents, identified, slices
from .registry import query
from .repeats import Windows, covered, keep_mask

WIDTH = 20
ROUNDS = 2
#: Windows handled at a time within a text.
BLOCK = 1 << 18
#: Longer words get a hash of their own kind.
LONG_WORD = 256
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * BASE)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SALT = np.uint64(0xD6E8FEB86659FD93)
#: A symbol's length comes first where symbols are compared, then its hash.
_LENGTH_BITS, _LENGTH_SHIFT, _LONGEST = np.uint64(6), np.uint64(58), 63
_NOTHING = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)


def word_hashes(text: bytes) -> np.ndarray:
    raw = np.frombuffer(text, np.uint8)
    inner = np.concatenate(([False], ~_SPACE[raw], [False]))
    edges = np.flatnonzero(inner[1:] != inner[:-1])
    starts, ends = edges[::2], edges[1::2]
    out = span_hashes(prefix_hashes(_BYTES[raw]), starts, ends) if len(starts) else np.zeros(0, np.uint64)
    for k in np.flatnonzero(ends - starts > LONG_WORD):
        out[k] = xxhash.xxh3_64_intdigest(text[starts[k] : ends[k]])
    return out


class Level:
    """Symbols of one level: names, first word, and the reach that decided each."""

    def __init__(self, names: np.ndarray, starts: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.names, self.starts, self.low, self.high = names, starts, low, high

    def merged(self, first: np.ndarray, names: np.ndarray, low: np.ndarray, high: np.ndarray) -> Level:
        """Neighbours from each ``first`` to the next become one symbol."""
        last = np.append(first[1:], len(self.names)) - 1
        return Level(names, self.starts[first], low[first], high[last])


def _with_neighbours(level: Level, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Reach of the neighbour before and behind; beyond the text nothing is known."""
    return np.concatenate(([-1], level.low[:-1])), np.concatenate((level.high[1:], [n_words + 1]))


def next_level(level: Level, n_words: int) -> Level:
    # Runs: that one ends is known from the symbols next to it.
    names = level.names
    first = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
    times = np.diff(np.append(first, len(names))).astype(np.uint64)
    low, high = _with_neighbours(level, n_words)
    named = np.where(times > 1, mix(names[first] * MIX_1 + times), names[first])
    runs = level.merged(first, named, low, high)
    # Pairs: two symbols of a pair know of it themselves, all others from their neighbours.
    names = runs.names
    left = (mix(names ^ _SALT) & np.uint64(1)).astype(bool)
    opens = np.zeros(len(names), bool)
    opens[:-1] = left[:-1] & ~left[1:]
    closes = np.concatenate(([False], opens[:-1]))
    before, behind = _with_neighbours(runs, n_words)
    # A left symbol could only join its right neighbour, a right one its left neighbour.
    low = np.where(opens | closes | left, runs.low, np.minimum(before, runs.low))
    high = np.where(opens | closes | ~left, runs.high, np.maximum(behind, runs.high))
    first = np.flatnonzero(~closes)
    paired = np.where(opens[first], mix(names[first] * BASE + np.roll(names, -1)[first]), names[first])
    return runs.merged(first, paired, low, high)


def _smallest(packed: np.ndarray, first: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """Minimum of ``packed`` over each range of at most ``WIDTH``, by doubling."""
    tables = [packed]
    while 2 ** len(tables) <= WIDTH:
        half = 2 ** (len(tables) - 1)
        rest = np.full(min(half, len(packed)), ~np.uint64(0))
        tables.append(np.minimum(tables[-1], np.concatenate((tables[-1][half:], rest))[: len(packed)]))
    power = np.log2(np.maximum(behind - first, 1)).astype(np.int64)
    best = np.empty(len(first), np.uint64)
    for p in np.unique(power):
        same = power == p
        best[same] = np.minimum(tables[p][first[same]], tables[p][behind[same] - 2**p])
    return best


def chosen_symbols(names: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each window: level and symbol that represent it, the symbol's first word and its
    length. Of equally long symbols the highest level wins."""
    n = len(names)
    here = np.arange(n)
    levels = [Level(names, here, here, here + 1)]
    for _ in range(ROUNDS):
        levels.append(next_level(levels[-1], n))
    windows = np.arange(n - WIDTH + 1)
    level_of, start, size = (np.zeros(len(windows), np.int64) for _ in range(3))
    symbol = np.zeros(len(windows), np.uint64)
    for number in range(ROUNDS, -1, -1):
        level = levels[number]
        first = np.searchsorted(level.low, windows, "left")
        behind = np.searchsorted(level.high, windows + WIDTH, "right")
        some = np.flatnonzero(first < behind)
        # No symbol inside a window is longer than it; the others are never looked at.
        length = np.minimum(np.diff(np.append(level.starts, n)), _LONGEST)
        order = (_LONGEST - length).astype(np.uint64) << _LENGTH_SHIFT
        order |= (mix(level.names ^ MIX_1) >> _LENGTH_BITS) & ~_LOW
        best = _smallest(order | np.arange(len(level.names), dtype=np.uint64), first[some], behind[some])
        at = (best & _LOW).astype(np.int64)
        longer = length[at] > size[some]
        at, some = at[longer], some[longer]
        level_of[some], symbol[some], start[some], size[some] = number, level.names[at], level.starts[at], length[at]
    return level_of, symbol, start, size


def anchors(text: bytes) -> tuple[np.ndarray, ...]:
    """Runs of windows that one symbol represents."""
    names = word_hashes(text)
    if len(names) < WIDTH:
        return _NOTHING
    parts = []
    for at in range(0, len(names) - WIDTH + 1, BLOCK):
        own = names[at : at + BLOCK + WIDTH - 1]
        level, symbol, start, _ = chosen_symbols(own)
        change = (np.diff(start) != 0) | (np.diff(level) != 0)
        first = np.concatenate(([0], np.flatnonzero(change) + 1))
        n = np.diff(np.append(first, len(start)))
        off = start[first] - first
        key = mix(symbol[first] + level[first].astype(np.uint64) * MIX_1)
        shape = key + (off.astype(np.uint64) << np.uint64(32)) + n.astype(np.uint64)
        prefix = prefix_hashes(own)
        group = mix(span_hashes(prefix, first, first + n - 1 + WIDTH) + mix(shape))
        parts.append((key, group, first + at, n, off))
    return tuple(np.concatenate(x) for x in zip(*parts))


def window_hashes(text: bytes, rows: np.ndarray) -> np.ndarray:
    """A hash of every window of each record."""
    names = word_hashes(text)
    behind = np.cumsum(rows["n"])
    start = np.arange(behind[-1]) - np.repeat(behind - rows["n"] - rows["first"], rows["n"])
    return span_hashes(prefix_hashes(mix(names ^ _SALT)), start, start + WIDTH)


def payloads(text: bytes, rows: np.ndarray) -> list[bytes]:
    """The hashes of the windows of each record; with the key they make 128 bits."""
    behind = np.cumsum(rows["n"])
    hashes = window_hashes(text, rows).tobytes()
    return [hashes[8 * (b - n) : 8 * b] for b, n in zip(behind.tolist(), rows["n"].tolist(), strict=True)]


def resolve(rows: np.ndarray, hashes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Windows whose sequence occurs earlier under the same symbol."""
    verified = np.frombuffer(b"".join(hashes), np.uint64)
    record = np.repeat(np.arange(len(rows)), rows["n"])
    window = np.arange(len(record)) - np.repeat(np.cumsum(rows["n"]) - rows["n"], rows["n"])
    key, place = rows["key"][record], rows["first"][record] + window
    order = np.lexsort((place, rows["doc"][record], verified, key))
    again = np.zeros(len(order), bool)
    again[1:] = (verified[order][1:] == verified[order][:-1]) & (key[order][1:] == key[order][:-1])
    chosen = order[again]
    return record[chosen], window[chosen]


WORD_WINDOWS = Windows(WIDTH, anchors, payloads, resolve, window_hashes)


def remove_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``kept`` (remaining words, joined by a space), ``n_words``, ``n_removed``."""
    chosen = identified(docs.select(F.col(id_col).alias("doc_id"), blank(text_col).alias("text")))
    spans = covered(chosen, WORD_WINDOWS)
    kind = dict(chosen.dtypes)["doc_id"]

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kept, totals, gone = [], [], []
            for text, own in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = WORD.findall(text)
                rest = words
                if own.is_valid:
                    rest = [words[k] for k in np.flatnonzero(keep_mask(len(words), own))]
                kept.append(" ".join(rest))
                totals.append(len(words))
                gone.append(len(words) - len(rest))
            columns = [batch.column(0), pa.array(kept, pa.string())]
            columns += [pa.array(totals, pa.int64()), pa.array(gone, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "kept", "n_words", "n_removed"])

    return (
        chosen.join(spans, DOC, "left")
        .select("doc_id", "text", "spans")
        .mapInArrow(remove, f"doc_id {kind}, kept string, n_words long, n_removed long")
    )


OP10_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 19], ' ') AS seq
  FROM w, unnest(range(1, greatest(len(words) - 18, 1))) AS t(i)
), ranked AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY seq ORDER BY doc_id, i) AS k FROM windows
), marks AS (
  SELECT doc_id, i + j AS i FROM ranked, unnest(range(20)) AS t(j) WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, i FROM marks
), words AS (
  SELECT doc_id, i, words[i] AS word FROM w, unnest(range(1, len(words) + 1)) AS t(i)
), kept AS (
  SELECT a.doc_id, count(*) AS n_words, count(g.i) AS n_removed,
         string_agg(word, ' ' ORDER BY a.i) FILTER (g.i IS NULL) AS text
  FROM words a LEFT JOIN gone g ON a.doc_id = g.doc_id AND a.i = g.i GROUP BY a.doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


@query("op10_recompression", OP10_SQL)
def op10_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated_words(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
