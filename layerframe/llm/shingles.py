"""Word shingles of whole texts as sets of 64-bit hashes, in NumPy.

Works on the bytes of an Arrow string column, a few megabytes at a time, so
memory does not depend on the size of a batch (a single longer text is one step).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

STEP_BYTES = 2 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACES = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def of(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < size:
            n = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_BASE, n, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(_INVERSE, n, 1 << 64))])
        return self.up, self.down


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of an Arrow string column without nulls."""
    column = column.cast(pa.string()) if not pa.types.is_string(column.type) else column
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def word_hashes(data: np.ndarray, offsets: np.ndarray, powers: _Powers) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every word; offsets begin at 0."""
    lowered = _LOWER[data]
    word = ~_SPACE[lowered]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] |= word[edges]
    last[edges - 1] |= word[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers.of(len(data) + 1)
    total = np.empty(len(data) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum((lowered.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    hashes = mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return np.searchsorted(offsets, starts, "right") - 1, hashes


def shingle_sets(column: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sizes, hashes) for runs of rows; hashes are sorted and distinct per row.

    A text with fewer words is one shingle of all of them; one without has none.
    """
    offsets, data = text_bytes(column)
    powers, row, rows = _Powers(), 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + STEP_BYTES, "right")) - 1
        end = min(max(end, row + 1), rows)
        part = offsets[row : end + 1] - offsets[row]
        yield row, *_distinct(*word_hashes(data[offsets[row] : offsets[end]], part, powers), end - row, words)
        row = end


def _distinct(document: np.ndarray, hashes: np.ndarray, rows: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    counts = np.bincount(document, minlength=rows)
    begin = np.concatenate([[0], np.cumsum(counts)])
    if len(hashes) >= words:
        full = len(hashes) - words + 1
        whole = document[:full] == document[words - 1 :]
        total = np.zeros(full, dtype=np.uint64)
        for place in range(words):
            total += hashes[place : place + full] * _PLACES[place % len(_PLACES)]
        owner, value = document[:full][whole], mix64(total[whole])
    else:
        owner, value = document[:0], hashes[:0]
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        few = np.array(
            [
                np.bitwise_xor.reduce(mix64(hashes[begin[d] : begin[d + 1]] + np.arange(1, counts[d] + 1, dtype=np.uint64) * _PLACES[0]))
                for d in short
            ],
            dtype=np.uint64,
        )
        owner, value = np.concatenate([owner, short]), np.concatenate([value, mix64(few + counts[short].astype(np.uint64))])
        order = np.argsort(owner, kind="stable")
        owner, value = owner[order], value[order]
    bounds = np.searchsorted(owner, np.arange(rows + 1))
    for d in range(rows):
        value[bounds[d] : bounds[d + 1]].sort()
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return np.bincount(owner[new], minlength=rows), value[new]
