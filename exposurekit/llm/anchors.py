"""Content-defined anchors of all fixed-length byte windows, for finding where windows may repeat.

Of the grams inside a window, the one with the smallest hash is its anchor (the
leftmost of equals). Equal windows have equal anchors at equal places, so windows can
only be equal if their anchors' grams are. An anchor owns the run of windows that
chose it; the text of that run is its stretch.
"""

from __future__ import annotations

import numpy as np

GRAM = 32

_BASE = np.uint64(0x9E3779B97F4A7C15)  # any odd numbers do
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_powers[name]) < n:
        steps = np.full(max(n, 1 << 22), base, np.uint64)
        steps[0] = 1
        _powers[name] = np.multiply.accumulate(steps)
    return _powers[name][:n]


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of ``data[i:i + gram]`` for every i, from differences of a running polynomial."""
    n = len(data)
    if n < gram:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, n), out=sums[1:])
    x = (sums[gram:] - sums[:-gram]) * _power("down", _BASE_INVERSE, n - gram + 1)
    x ^= x >> np.uint64(32)
    x *= _MIX
    x ^= x >> np.uint64(29)
    return x


def stretches(data: np.ndarray, offsets: np.ndarray, window: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first window, last window (bytes from the row's start) and gram hash of every anchor of every row."""
    none = np.zeros(0, np.int64)
    if len(data) < window:
        return none, none, none, np.zeros(0, np.uint64)
    hashes = gram_hashes(data, gram)
    bits = np.uint64(len(hashes).bit_length())
    least = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)  # the leftmost of equal ones
    reach, want = 1, window - gram + 1
    while 2 * reach <= want:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < want:
        least = np.minimum(least[: len(least) - (want - reach)], least[want - reach :])
    chosen = (least & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    # windows that start in a row and end in it
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(chosen)]
    inside = np.flatnonzero(np.arange(window, window + len(chosen)) <= offsets[1:][row])
    chosen, row = chosen[inside], row[inside]
    if not len(chosen):
        return none, none, none, np.zeros(0, np.uint64)
    fresh = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1])]))
    last = np.append(fresh[1:], len(chosen)) - 1
    start = offsets[row[fresh]]
    return row[fresh], inside[fresh] - start, inside[last] - start, hashes[chosen[fresh]]
