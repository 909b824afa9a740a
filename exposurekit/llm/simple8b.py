"""Simple-8b coding of whole numbers in 64-bit words, encoded and decoded by array operations.

The top 4 bits of a word select how many values share its 60 bits. Selector 15 is an
escape: the next word holds one value of up to 64 bits. Blocks of ``BLOCK`` values
are coded apart; the word offset of every block lets any block be decoded alone.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = 60 // COUNTS
SHIFTS = [np.arange(n, dtype=np.uint64) * np.uint64(60 // n) for n in COUNTS]
ESCAPE = 15
_SMALL = np.array([i.bit_length() for i in range(1 << 16)], np.uint8)


def bit_lengths(values: np.ndarray) -> np.ndarray:
    if values.dtype.itemsize <= 2 or (len(values) and values.max() < 1 << 16):
        return _SMALL[values.astype(np.uint16)]
    out, rest = np.zeros(len(values), np.uint8), values.astype(np.uint64)
    for step in (32, 16, 8, 4, 2, 1):
        high = rest >= np.uint64(1 << step)
        out += (high * step).astype(np.uint8)
        rest = np.where(high, rest >> np.uint64(step), rest)
    return out + (rest > 0).astype(np.uint8)


def encode(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the index of the first word of every block with the number of words at the end."""
    n = len(values)
    blocks = -(-n // block)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    padded = np.zeros(blocks * block, np.uint64)
    padded[:n] = values
    width = np.zeros(blocks * block, np.uint8)
    width[:n] = bit_lengths(values)
    width = width.reshape(blocks, block)
    choice = np.full((blocks, block), ESCAPE, np.uint8)
    for s in range(len(COUNTS) - 1, -1, -1):
        fits, reach = width <= BITS[s], 1  # do this value and the reach - 1 after it fit? What lies past the block does
        while reach < COUNTS[s]:
            more = min(reach, int(COUNTS[s]) - reach)
            fits[:, :-more] &= fits[:, more:].copy()
            reach += more
        np.copyto(choice, s, where=fits)
    step = np.ones(16, np.int64)
    step[: len(COUNTS)] = COUNTS
    at, column = np.zeros(blocks, np.int64), np.arange(blocks)
    sizes = np.minimum(block, n - column * block)
    found = []
    while len(column):
        selector = choice[column, at]
        found.append((column, at, selector))
        at = at + step[selector]
        more = at < sizes[column]
        at, column = at[more], column[more]
    column, at, selector = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(column, kind="stable")
    column, at, selector = column[order], at[order], selector[order]
    takes = 1 + (selector == ESCAPE)  # an escaped value is a word of its own
    slot = np.cumsum(takes) - takes
    words = np.zeros(int(takes.sum()), np.uint64)
    words[slot] = selector.astype(np.uint64) << np.uint64(60)
    first = column * block + at
    padded = np.append(padded, np.zeros(64, np.uint64))
    ends = np.append(np.minimum((column + 1) * block, n), n)
    for s in np.unique(selector):
        mine = np.flatnonzero(selector == s)
        if s == ESCAPE:
            words[slot[mine] + 1] = padded[first[mine]]
            continue
        places = first[mine, None] + np.arange(COUNTS[s])
        packed = padded[places]
        short = np.flatnonzero(places[:, -1] >= ends[mine])  # at the end of a block
        packed[short] *= places[short] < ends[mine[short], None]
        words[slot[mine]] |= np.bitwise_or.reduce(packed << SHIFTS[s], axis=1)
    starts = np.append(slot[np.searchsorted(column, np.arange(blocks))], len(words))
    return words, starts


def decode(words: np.ndarray, starts: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The ``n`` values of consecutive blocks; ``starts`` as given by ``encode`` or a part of it."""
    if not n:
        return np.zeros(0, np.uint64)
    base = int(starts[0])
    words = words[base : int(starts[-1])]
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = _escaped(selector)
    selector[raw] = 14  # a value, not a word with a selector
    count = np.zeros(16, np.int64)
    count[: len(COUNTS)] = COUNTS
    count[ESCAPE] = 1
    # values after each word inside its block; a word that ends a block may hold fewer
    blocks = len(starts) - 1
    owner = np.repeat(np.arange(blocks), np.diff(starts))
    before = np.cumsum(count[selector]) - count[selector]
    begins = starts[:-1] - base
    first = before - before[begins][owner] + owner * block
    limit = np.minimum((owner + 1) * block, n)
    out = np.zeros(blocks * block + 64, np.uint64)
    for s in np.unique(selector):
        mine = np.flatnonzero(selector == s)
        if s == ESCAPE:
            out[first[mine]] = words[mine + 1]
        elif s < len(COUNTS):
            mask = np.uint64((1 << int(BITS[s])) - 1)
            values = (words[mine, None] >> SHIFTS[s]) & mask
            places = first[mine, None] + np.arange(COUNTS[s])
            inside = places < limit[mine, None]
            if inside.all():
                out[places] = values
            else:
                out[places[inside]] = values[inside]
    return out[:n]


def _escaped(selector: np.ndarray) -> np.ndarray:
    """Indices of words that are escaped values: each follows an escape that is not a value itself."""
    found, skip = [], -1
    for i in np.flatnonzero(selector == ESCAPE).tolist():
        if i != skip:
            skip = i + 1
            found.append(skip)
    return np.array(found, np.int64)
