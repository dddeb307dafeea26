"""Simple-8b: a 64-bit word holds a selector and as many equally wide ids as fit in 60 bits.

Ids go in blocks of ``BLOCK``; every block starts a word, and its first word's place is kept,
so blocks decode independently and all at once. The last word of a block may hold fewer ids
than its selector says; the block's size tells. Ids of over 60 bits take an escape word that
holds their top bits, followed by a word for the rest.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024
# Fixed values of the format: ids in a word and bits of each, by selector.
COUNTS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0, 0], np.int64)
BITS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 0, 0], np.int64)
_LAST = 13
_ESCAPE = np.uint64(15)
_PAYLOAD = np.uint64(60)


_SHORT = np.concatenate([[0], *(np.full(1 << k, k + 1) for k in range(16))]).astype(np.uint8)


def _widths(ids: np.ndarray) -> np.ndarray:
    if ids.dtype == np.uint16:
        return _SHORT[ids]
    out = np.zeros(ids.shape, np.uint8)
    left = ids.copy()
    for step in (32, 16, 8, 4, 2, 1):
        high = left >> np.uint64(step)
        big = high > 0
        out += big * np.uint8(step)
        left = np.where(big, high, left)
    return out + (left > 0)


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words, and for every block of ids the place of its first word."""
    ids = np.asarray(ids)
    if not len(ids):
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    kind = np.uint16 if ids.max() < 1 << 16 else np.uint64
    blocks = -(-len(ids) // BLOCK)
    wide = BLOCK + 64  # behind a block, zeros that take no bits
    grid = np.zeros((blocks, wide), kind)
    flat = np.zeros(blocks * BLOCK, kind)
    flat[: len(ids)] = ids
    grid[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    grid, row = grid.ravel(), np.arange(blocks) * wide
    size = np.full(blocks, BLOCK)
    size[-1] = len(ids) - (blocks - 1) * BLOCK
    width = _widths(grid)
    # The widest of the next n ids, for growing n; the largest count that fits wins.
    choice = np.zeros(len(grid), np.uint8)
    most, n = width, 1
    for selector in range(1, _LAST + 1):
        want = int(COUNTS[selector])
        while n < want:
            step = min(n, want - n)
            ahead = np.zeros_like(most)
            ahead[:-step] = most[step:]
            most, n = np.maximum(most, ahead), n + step
        np.copyto(choice, np.uint8(selector), where=most <= BITS[selector])
    places = []
    at, stop = row.copy(), row + size
    while len(at):  # all blocks advance by one word
        places.append(at)
        at = at + COUNTS[choice[at]]
        on = at < stop
        at, stop = at[on], stop[on]
    places = np.sort(np.concatenate(places))
    chosen = choice[places]
    words = chosen.astype(np.uint64) << _PAYLOAD
    for selector in np.flatnonzero(np.bincount(chosen)).tolist():
        mine = np.flatnonzero(chosen == selector)
        start, bits = places[mine], int(BITS[selector])
        packed = np.zeros(len(mine), np.uint64)
        for k in range(int(COUNTS[selector])):
            value = grid[start + k].astype(np.uint64) & np.uint64((1 << 60) - 1)
            packed |= value << np.uint64(k * bits)
        words[mine] |= packed
    first = np.searchsorted(places, row)
    escaped = np.flatnonzero(width[places] > 60)
    if len(escaped):
        tops = (_ESCAPE << _PAYLOAD) | (grid[places[escaped]] >> _PAYLOAD)
        words = np.insert(words, escaped, tops)
        first = first + np.searchsorted(escaped, first, "left")
    return words, first.astype(np.int32)


def decode(words: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of ``encode``'s words."""
    words = np.asarray(words, np.uint64)
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    selector = (words >> _PAYLOAD).astype(np.int64)
    count = COUNTS[selector]
    size = np.full(len(first), BLOCK)
    size[-1] = n - (len(first) - 1) * BLOCK
    last = np.append(first[1:], len(words)) - 1
    count[last] -= np.add.reduceat(count, first) - size
    start = np.cumsum(count) - count
    for s in np.flatnonzero(np.bincount(selector)).tolist():
        if s > _LAST:
            continue
        mine = np.flatnonzero(selector == s)
        bits, mask = int(BITS[s]), np.uint64((1 << int(BITS[s])) - 1)
        value, at, left = words[mine], start[mine], count[mine]
        for k in range(int(COUNTS[s])):
            here = left > k
            if not here.all():
                value, at, left = value[here], at[here], left[here]
            out[at + k] = (value >> np.uint64(k * bits)) & mask
    tops = np.flatnonzero(selector == 15)
    if len(tops):
        out[start[tops + 1]] |= (words[tops] & np.uint64(15)) << _PAYLOAD
    return out
