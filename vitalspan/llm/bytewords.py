"""Hashing the words of whole Arrow text columns without making Python strings.

A word's hash is a polynomial in its bytes modulo 2**64, taken from one running sum over the
buffer, so a batch costs a handful of NumPy passes whatever the number of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_STEP = 1 << 18
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class ByteWords:
    """Words are the longest runs of bytes for which ``table`` is true; A-Z count as a-z."""

    def __init__(self, table: np.ndarray, fold: bool = True):
        self.table = table.astype(bool)
        letters = np.arange(256, dtype=np.uint64)
        if fold:
            letters[65:91] += np.uint64(32)
            self.table[65:91] = self.table[97:123]
        self.values = mix((letters + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
        self.up = _powers(_BASE, 2 * _STEP)
        self.down = _powers(_INVERSE, 2 * _STEP)

    def _piece(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inside = self.table[data]
        before = np.empty_like(inside)
        before[0] = False
        before[1:] = inside[:-1]
        before[first] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[-1] = False
        after[:-1] = inside[1:]
        after[first[first > 0] - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        if len(data) > len(self.up):
            self.up, self.down = _powers(_BASE, len(data)), _powers(_INVERSE, len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[: len(data)], out=sums[1:])
        raw = (sums[ends] - sums[starts]) * self.down[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)), starts, ends

    def of(
        self, data: np.ndarray, offsets: np.ndarray, cuts: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all words, the words' (start, end) bytes, and each text's first word.

        ``offsets`` has the first byte of every text and the end; ``cuts`` bytes at which a
        word begins anew. Long buffers go through in pieces that end between words.
        """
        found, at = [], 0
        base, total = int(offsets[0]), int(offsets[-1])
        at = base
        marks = np.unique(offsets[:-1] if cuts is None else np.concatenate([offsets[:-1], cuts]))
        while at < total:
            end = min(at + _STEP, total)
            while end < total:  # on to the end of the word
                ahead = data[end - 1 : min(end + 4096, total)]
                gap = np.flatnonzero(~self.table[ahead])
                if len(gap):
                    end = end - 1 + int(gap[0]) if gap[0] else end
                    break
                end = min(end + 4096, total)
            lo, hi = np.searchsorted(marks, (at, end))
            hashes, starts, ends = self._piece(data[at:end], marks[lo:hi] - at)
            found.append((hashes, starts + at, ends + at))
            at = end
        if not found:
            none = np.zeros(0, np.int64)
            return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
        hashes, starts, ends = (np.concatenate(x) for x in zip(*found))
        return hashes, starts, ends, np.searchsorted(starts, offsets)


def table_of(test) -> np.ndarray:
    return np.array([bool(test(b)) for b in range(256)])


#: ``[^\x20\x09-\x0D]+``
SPACED = table_of(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``
PLAIN = table_of(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a text column; NULL is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most ``most`` bytes of text, or one row that has more."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_buffer(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
            end = max(at + 1, min(end, batch.num_rows))
            yield batch.slice(at, end - at)
            at = end
