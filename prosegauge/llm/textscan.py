"""Words, shingles and windows of whole texts as numpy arrays.

Texts come from Arrow string columns, whose UTF-8 bytes lie one after another,
so a block of rows is scanned with a few array operations and no Python string
is made.  A word is a run of bytes outside ``\\x20 \\x09-\\x0D``; those bytes never
occur inside a longer UTF-8 sequence.  Hashes are 64 bits wide and depend on the
bytes alone, so every task and every attempt of a task gets the same ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text scanned at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_WINDOW_BASE = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of `x` over the whole word (a bijection of 64 bits)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))


class _Powers:
    """Powers of an odd base modulo 2**64 and their inverses, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.size = base, 0
        self.up = self.down = np.ones(0, _U)

    def _powers(self, base: int) -> np.ndarray:
        steps = np.full(self.size, base, _U)
        steps[0] = 1
        return np.cumprod(steps, dtype=_U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.size:
            self.size = max(n, 2 * self.size, 1 << 16)
            self.up = self._powers(self.base)
            self.down = self._powers(pow(self.base, -1, 1 << 64))
        return self.up[:n], self.down[:n]


_BYTE_POWERS, _WINDOW_POWERS = _Powers(_BASE), _Powers(_WINDOW_BASE)


@dataclass
class Words:
    """The words of a block of rows."""

    row: np.ndarray  # row of the block that each word belongs to
    start: np.ndarray  # byte offsets in `data`
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # for each row, the index of its first word; one more entry at the end
    data: np.ndarray

    def __len__(self) -> int:
        return len(self.row)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_blocks(batch: pa.RecordBatch, name: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Split a batch so that each piece has at most `limit` bytes of text, or one row."""
    if not batch.num_rows:
        return
    _, offsets = text_buffers(batch.column(name))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    up, down = _BYTE_POWERS.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(_U))


def scan_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Words of the rows whose bytes are ``data[offsets[i]:offsets[i + 1]]``."""
    if lower:
        data = _LOWER[data]
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)  # a row begins here
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = solid[1:]
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(row, start, end, hash_spans(data, start, end), first, data)


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start index and hash of every run of `size` words inside one row."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    at = np.flatnonzero(words.row[:n] == words.row[size - 1 :])
    return at, window_hashes(words.hash, at, size)


def window_hashes(hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` entries of `hashes` from each place of `at`."""
    if size <= 8:
        total = np.zeros(len(at), _U)
        for k in range(size):
            total += hashes[at + k] * _U(pow(_WINDOW_BASE, k, 1 << 64))
    else:
        up, down = _WINDOW_POWERS.get(len(hashes) + 1)
        sums = np.zeros(len(hashes) + 1, _U)
        np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
        total = (sums[at + size] - sums[at]) * down[at]
    return mix(total + _U(size))
