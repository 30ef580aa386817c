"""Suffix array by linear grouping (G. Baier, CPM 2016), and byte windows compared with it.

Phase one puts suffixes with the same longest Lyndon prefix into one group. Groups are
taken in falling order; the previous-smaller pointers of their suffixes lead to the
suffixes whose prefix grows by this Lyndon word, and those move up within their group,
the further the more often the word follows. Phase two goes through the suffixes in
rising order and puts those that end where the current one starts in the next free place
of their group. No suffix is renamed and nothing is sorted recursively.
"""

from __future__ import annotations

import numpy as np

from .anchors import BASE, BLOCK, mix, prefix_hashes, powers, runs_of_minimum, span_hashes

WIDTH = 100
ANCHOR = 32
#: Symbols of one suffix array; a key with more than that is split by the content of its
#: windows (``repeats``).
TEXT = 1 << 17
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * BASE)
_NOTHING = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)


def suffix_array(text: list[int]) -> list[int]:
    """Suffixes in rising order. Symbol 0 separates strings: nothing is compared beyond it,
    suffixes that agree up to it come in any order."""
    n = len(text)
    order = np.argsort(np.array(text, np.int64), kind="stable").tolist()
    place, link, size = [0] * n, [0] * n, [0] * (n + 1)
    start = 0
    for i, s in enumerate(order):
        if text[s] != text[order[start]]:
            start = i
        place[s] = i
        link[s] = start
        size[start] += 1
    zeros = size[0] if n and text[order[0]] == 0 else 0
    previous = [-1] * n
    end = n - 1
    while end >= zeros:
        group = link[order[end]]
        if group == end:
            # Most groups hold one suffix: its parent moves to the end of its own group.
            s = order[end]
            p = s - 1
            while p >= 0 and link[p] > group:
                p = previous[p]
            previous[s] = p
            if p >= 0 and text[p]:
                g = link[p]
                if size[g] > 1:
                    size[g] -= 1
                    last = g + size[g]
                    i, q = place[p], order[last]
                    order[i], order[last] = q, p
                    place[q], place[p] = i, last
                    link[p] = last
                    size[last] = 1
            end -= 1
            continue
        members = order[group : end + 1]
        members.sort()
        found: dict[int, int] = {}
        for s in members:
            p = s - 1
            while p >= 0 and link[p] >= group:
                p = previous[p]
            previous[s] = p
            if p >= 0 and text[p]:
                found[p] = found.get(p, 0) + 1
        if found:
            by_group: dict[int, list[int]] = {}
            for p in found:
                by_group.setdefault(link[p], []).append(p)
            for g, moved in by_group.items():
                if size[g] == 1:
                    continue
                if len(moved) > 1:
                    moved.sort(key=found.__getitem__, reverse=True)
                at = g + size[g]
                times, count = -1, 0
                size[g] -= len(moved)
                for p in moved:
                    at -= 1
                    i, q = place[p], order[at]
                    order[i], order[at] = q, p
                    place[q], place[p] = i, at
                # From the end down: runs that follow equally often are one new group.
                at = g + size[g] + len(moved)
                k = 0
                while k < len(moved):
                    times = found[moved[k]]
                    j = k
                    while j < len(moved) and found[moved[j]] == times:
                        j += 1
                    count = j - k
                    at -= count
                    for p in moved[k:j]:
                        link[p] = at
                    size[at] = count
                    k = j
        end = group - 1
    free = list(range(n))
    placed = bytearray(n)
    out = order[:zeros] + [-1] * (n - zeros)
    for s in out[:zeros]:
        placed[s] = 1
    if n and not (zeros and text[-1] == 0):
        raise ValueError("the text must end with symbol 0")
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = link[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = previous[j]
    return out


def anchors(text: bytes) -> tuple[np.ndarray, ...]:
    """Anchors of the byte windows of a text: its ``ANCHOR`` bytes with the smallest hash."""
    if len(text) < WIDTH:
        return _NOTHING
    parts = []
    for at in range(0, len(text) - WIDTH + 1, BLOCK):
        symbols = _BYTES[np.frombuffer(text, np.uint8, min(BLOCK + WIDTH - 1, len(text) - at), at)]
        prefix = prefix_hashes(symbols)
        _, down = powers(len(prefix))
        hashes = mix((prefix[ANCHOR:] - prefix[:-ANCHOR]) * down[: len(prefix) - ANCHOR])
        first, n, anchor = runs_of_minimum(hashes, WIDTH - ANCHOR + 1)
        key, off = hashes[anchor], anchor - first
        shape = key + (off.astype(np.uint64) << np.uint64(32)) + n.astype(np.uint64)
        group = mix(span_hashes(prefix, first, first + n - 1 + WIDTH) + mix(shape))
        parts.append((key, group, first + at, n, off))
    return tuple(np.concatenate(x) for x in zip(*parts))


def payloads(text: bytes, rows: np.ndarray) -> list[bytes]:
    """The bytes that the windows of each record cover."""
    ends = rows["first"] + rows["n"] - 1 + WIDTH
    return [text[a:b] for a, b in zip(rows["first"].tolist(), ends.tolist(), strict=True)]


def window_hashes(text: bytes, rows: np.ndarray) -> np.ndarray:
    """A hash of every window of each record."""
    out = []
    for first, n in zip(rows["first"].tolist(), rows["n"].tolist(), strict=True):
        prefix = prefix_hashes(_BYTES[np.frombuffer(text, np.uint8, n - 1 + WIDTH, first)])
        start = np.arange(n)
        out.append(span_hashes(prefix, start, start + WIDTH))
    return np.concatenate(out)


def earlier_windows(rows: np.ndarray, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of ``strings`` that also start earlier, by one suffix array over them all."""
    sizes = np.array([len(x) + 1 for x in strings])
    starts = np.concatenate(([0], np.cumsum(sizes)))
    raw = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    symbols = raw.astype(np.int64) + 1
    symbols[starts[1:] - 1] = 0
    owner = np.repeat(np.arange(len(strings)), sizes)
    inside = np.arange(len(raw)) - starts[owner]
    order = np.array(suffix_array(symbols.tolist()), np.int64)
    order = order[inside[order] < rows["n"][owner[order]]]
    # Equal windows are neighbours now; compare the bytes themselves.
    views = np.lib.stride_tricks.sliding_window_view(raw, WIDTH)
    new = np.ones(len(order), bool)
    for at in range(1, len(order), 1 << 14):
        part = slice(at, min(at + (1 << 14), len(order)))
        before = slice(at - 1, part.stop - 1)
        new[part] = (views[order[part]] != views[order[before]]).any(axis=1)
    run = np.cumsum(new) - 1
    record, window = owner[order], inside[order]
    place = rows["first"][record] + window
    by = np.lexsort((place, rows["doc"][record], run))
    again = np.ones(len(by), bool)
    again[0:1] = False
    again[1:] = run[by][1:] == run[by][:-1]
    chosen = by[again]
    return record[chosen], window[chosen]


def suspected(rows: np.ndarray, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The parts of ``strings`` with all windows whose hash another window has: the record of
    each part, the windows left out before it, its bytes. Equal windows have equal hashes, so
    what is left out equals nothing; equal hashes prove nothing, the suffix array decides."""
    n = rows["n"].astype(np.int64)
    sizes = np.array([len(x) for x in strings])
    prefix = prefix_hashes(_BYTES[np.frombuffer(b"".join(strings), np.uint8)])
    owner = np.repeat(np.arange(len(strings)), n)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    start = inside + (np.cumsum(sizes) - sizes)[owner]
    _, which, times = np.unique(span_hashes(prefix, start, start + WIDTH), return_inverse=True, return_counts=True)
    at = np.flatnonzero(times[which] > 1)
    if not len(at):
        return at, at, []
    # A gap shorter than a window costs less than another part.
    new = np.concatenate(([True], (owner[at][1:] != owner[at][:-1]) | (np.diff(inside[at]) > WIDTH)))
    last = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
    parent, low, high = owner[at[new]], inside[at[new]], inside[last]
    return parent, low, [strings[i][a : b + WIDTH] for i, a, b in zip(parent.tolist(), low.tolist(), high.tolist(), strict=True)]


def resolve(rows: np.ndarray, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of whole keys that occur earlier, by suffix arrays over what may be repeated."""
    order = np.argsort(rows["key"], kind="stable")
    keys = rows["key"][order]
    # A window by itself under its key equals no other.
    new = np.concatenate(([True], keys[1:] != keys[:-1], [True]))
    order = order[~(new[:-1] & new[1:] & (rows["n"][order] == 1))]
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = rows["key"][order]
    bounds = np.concatenate((np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))), [len(order)]))
    records, windows, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    while at < len(bounds) - 1:
        stop, total = at, 0
        while stop < len(bounds) - 1 and (stop == at or total < TEXT):
            total += sum(len(strings[i]) + 1 for i in order[bounds[stop] : bounds[stop + 1]])
            stop += 1
        own = order[bounds[at] : bounds[stop]]
        parent, skipped, parts = suspected(rows[own], [strings[i] for i in own])
        if len(parts):
            chosen = rows[own][parent]
            chosen["first"] += skipped
            chosen["n"] = [len(x) - WIDTH + 1 for x in parts]
            record, window = earlier_windows(chosen, parts)
            records.append(own[parent[record]])
            windows.append(window + skipped[record])
        at = stop
    return np.concatenate(records), np.concatenate(windows)
