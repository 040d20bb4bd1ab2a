"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage
return; in UTF-8 none of these occurs inside a longer character, so bytes and code points agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_PRIME = 0x9E3779B97F4A7C15
_INVERSE = pow(_PRIME, -1, 1 << 64)
_BYTE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK_BYTES), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, nulls as empty, and the n + 1 offsets of its texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `limit` bytes of text; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_bytes(batch.column(text))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(at, at[first] + limit, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


class Words:
    """Word boundaries in a piece: `start` and `end` (bytes), `text` (index of the word's text)."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at, self.n_texts = data, at, len(at) - 1
        inside = ~SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[at] = True
        before = np.empty(len(data), bool)
        if len(data):
            before[0] = True
            np.logical_not(inside[:-1], out=before[1:])
            before |= edge[:-1]
        self.start = np.flatnonzero(inside & before)
        after = np.ones(len(data), bool)
        if len(data):
            np.logical_not(inside[1:], out=after[:-1])
            after |= edge[1:]
        self.end = np.flatnonzero(inside & after) + 1
        self.text = np.searchsorted(at, self.start, "right") - 1
        self.count = np.bincount(self.text, minlength=self.n_texts)
        self.first = np.concatenate(([0], np.cumsum(self.count)))

    def hashes(self, table: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each word; `table` maps its bytes first (LOWER: A-Z as a-z)."""
        return span_hashes(self.data if table is None else table[self.data], self.start, self.end)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span."""
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * _power(_PRIME, len(data)), out=sums[1:])
    span = (sums[end] - sums[start]) * _power(_INVERSE, len(data) + 1)[start]
    return mixed(span + (end - start).astype(np.uint64))


def alike(left: np.ndarray, right: np.ndarray) -> int:
    """Number of values that two sorted sets of distinct values share."""
    if not len(left) or not len(right):
        return 0
    if len(left) > len(right):
        left, right = right, left
    at = np.searchsorted(right, left)
    return int((right[np.minimum(at, len(right) - 1)] == left).sum())
