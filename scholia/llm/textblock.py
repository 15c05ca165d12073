"""Vectorised text kernels: an Arrow string column is read as one byte array with row offsets.

All functions work on whole texts. A block holds a few MB (or a single longer text), so memory is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CODES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, ..., base ** n modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        x = np.full(max(n, BLOCK_BYTES) + 1, base, np.uint64)
        x[0] = 1
        have = _powers[base] = np.multiply.accumulate(x)
        if n > 4 * BLOCK_BYTES:
            del _powers[base]
    return have


class Block:
    """Rows of a text column: bytes, and off[i] to off[i + 1] for row i."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off, self.n = data, off, len(off) - 1

    def row_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.off, at, "right") - 1

    def lowered(self) -> "Block":
        return Block(_LOWER[self.data], self.off)

    def prefix(self, data: np.ndarray | None = None) -> np.ndarray:
        """Prefix sums of a polynomial hash; see spans()."""
        data = self.data if data is None else data
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_CODES[data] * powers(_BASE, len(data))[: len(data)], out=out[1:])
        return out

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each maximal run of bytes other than 0x20 and 0x09-0x0D; runs end with their row."""
        word = ~_SPACE[self.data]
        edge = np.zeros(len(word) + 1, bool)
        edge[self.off] = True
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1] | edge[1:-1]
        last[:-1] &= ~word[1:] | edge[1:-1]
        return np.flatnonzero(first), np.flatnonzero(last) + 1


def spans(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, independent of its place."""
    n = len(prefix)
    h = (prefix[end] - prefix[start]) * powers(_UNBASE, n)[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def column(values: pa.Array | pa.ChunkedArray) -> Block:
    """Null counts as empty."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if values.null_count:
        values = values.fill_null("")
    if len(values) == 0:
        return Block(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    wide = pa.types.is_large_string(values.type)
    _, offsets, data = values.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Block(raw[off[0] : off[-1]], off - off[0])


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, Block]]:
    """Slices of the batches with about `most` bytes of text each (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        off = column(batch.column(text)).off
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            part = batch.slice(at, to - at)
            yield part, column(part.column(text))
            at = to


def per_row(block: Block, at: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Count (or sum of weights) by row of byte positions."""
    out = np.bincount(block.row_of(at), weights, block.n)
    return out.astype(np.int64)
