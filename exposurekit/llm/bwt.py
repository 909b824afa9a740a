"""Burrows-Wheeler transforms of string collections, merged by iterative interleave refinement.

Strings are rows of bytes that end in a terminator (symbol 0; a byte is its value plus
one). The transform of a collection lists, for all suffixes in order, the symbol before
them; the suffixes that are just a terminator come first, in the order of strings.

Merging starts from the interleave by prefixes of length 0, in which all suffixes are
one block. From the interleave by i characters, a stable sort by the symbol before
every suffix and a step to that longer suffix give the interleave by i + 1: inside a
collection the order is known already, so only symbols are sorted. A block falls apart
where symbols or blocks differ; that is where common prefixes end. To find the windows
that repeat, only the suffixes that start where a window ends need to be refined: every
round takes each of them one symbol towards the window's start. Suffixes alone in their
block cannot belong to a repeat and are left out of further rounds.
"""

from __future__ import annotations

import numpy as np


def transform(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Transform of strings laid one after the other; equal suffixes go by string."""
    width = int(lengths.max()) + 1
    inside = np.arange(width) < lengths[:, None]
    text = np.zeros((len(lengths), width), np.uint8)
    text[inside] = data + np.uint8(1)
    suffix = np.flatnonzero((np.arange(width) <= lengths[:, None]).ravel())  # with the lone terminator
    padded = np.zeros((len(lengths), width + 8), np.uint8)
    padded[:, :width] = text
    key = np.zeros((len(lengths), width), np.uint64)
    for j in range(8):
        key = key << np.uint64(8) | padded[:, j : j + width]
    key, reach = key.ravel()[suffix], 8
    rank = np.zeros((len(lengths), width), np.uint64)
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        step = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if reach >= width or step[-1] == len(order) - 1:
            break
        rank.ravel()[suffix[order]] = step + 1  # 0 is past the end
        ahead = np.zeros_like(rank)
        if reach < width:
            ahead[:, :-reach] = rank[:, reach:]
        key = (rank.ravel()[suffix] << np.uint64(32)) | ahead.ravel()[suffix]
        reach *= 2
    before = np.zeros_like(text)
    before[:, 1:] = text[:, :-1]
    return before.ravel()[suffix[order]]


def steps(symbols: np.ndarray) -> np.ndarray:
    """For every suffix the place of the suffix one symbol longer; meaningless where that symbol is a terminator."""
    longer = np.empty(len(symbols), np.int64)
    longer[np.argsort(symbols, kind="stable")] = np.arange(len(symbols))
    return longer


def places(symbols: np.ndarray, longer: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """String and position of every suffix, walking all strings at once from their ends."""
    string, position = np.zeros(len(symbols), np.int32), np.zeros(len(symbols), np.int32)
    row, who, at = np.arange(len(lengths)), np.arange(len(lengths)), lengths.astype(np.int64).copy()
    while len(row):
        string[row], position[row] = who, at
        more = symbols[row] != 0
        row, who, at = longer[row[more]], who[more], at[more] - 1
    return string, position


def repeats(shards: list[tuple[np.ndarray, np.ndarray]], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes whose first ``depth`` bytes occur more than once in all collections.

    ``shards``: transform and string lengths of every collection. Returns string
    (numbered through all collections), position, and interval; suffixes of an interval
    start with the same ``depth`` bytes.
    """
    symbols = np.concatenate([s for s, _ in shards])
    longer, string, position = [], [], []
    base = strings = 0
    for own, lengths in shards:
        step = steps(own)
        who, at = places(own, step, lengths)
        longer.append(step + base)
        string.append(who + strings)
        position.append(at)
        base, strings = base + len(own), strings + len(lengths)
    longer, string, position = np.concatenate(longer), np.concatenate(string), np.concatenate(position)
    live = np.flatnonzero(position >= depth)  # ends of windows: depth steps back is a window's start
    fresh = np.zeros(len(live), bool)  # where a block starts
    fresh[:1] = True
    for _ in range(depth):
        symbol = symbols[live]
        block = np.cumsum(fresh, dtype=np.int32)
        order = np.argsort(symbol, kind="stable")
        symbol, block = symbol[order], block[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])
        alone = fresh & np.append(fresh[1:], True)
        kept = np.flatnonzero(~alone)
        live, fresh = longer[live[order[kept]]], fresh[kept]
        if not len(live):
            break
    return string[live], position[live], np.cumsum(fresh) - 1
