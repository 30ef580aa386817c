"""Anchors of fixed-length windows over a symbol sequence, in numpy.

Every window of ``width`` symbols picks one anchor inside itself by its content
alone, so equal windows pick the same anchor at the same place. Consecutive
windows mostly share their anchor; they are kept as one run.
"""

from __future__ import annotations

import numpy as np

#: Fixed odd factors of the hashes.
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
MIX_2 = np.uint64(0x94D049BB133111EB)
_SHIFT_1, _SHIFT_2, _SHIFT_3 = np.uint64(30), np.uint64(27), np.uint64(31)
BLOCK = 1 << 20
_LOW_BITS = 21
_LOW = np.uint64((1 << _LOW_BITS) - 1)
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    x = (x ^ (x >> _SHIFT_1)) * MIX_1
    x = (x ^ (x >> _SHIFT_2)) * MIX_2
    return x ^ (x >> _SHIFT_3)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for name, factor in (("up", BASE), ("down", inverse)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_hashes(symbols: np.ndarray) -> np.ndarray:
    """Running polynomial hash; ``span_hashes`` reads any span from it."""
    up, _ = powers(len(symbols))
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * up, out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    reach, out = 1, values
    while 2 * reach <= width:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def runs_of_minimum(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and anchor of each run of windows.

    The anchor is the leftmost of the smallest of ``width`` neighbouring hashes.
    """
    packed = (hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64)
    at = (sliding_minimum(packed, width) & _LOW).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1))
    return first, np.diff(np.append(first, len(at))), at[first]
