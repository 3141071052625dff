"""Vectorised word splitting and hashing over the byte buffers of Arrow string columns.

Words are runs of bytes outside ``[\\x20\\x09-\\x0D]``. Their hashes are 64-bit polynomials taken
from prefix sums over the buffer, so a batch costs a fixed number of numpy passes and no Python
loop over words. Batches are cut into slices of a megabyte first, which bounds memory
whatever the length of the texts; only a single longer text makes a longer slice.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from voxledger.llm.units import let_go

SLICE_BYTES = 1_000_000

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def _power_table(name: str, base: np.uint64, n: int) -> np.ndarray:
    table = _powers.get(name)
    if table is None or len(table) < n:
        size = max(n, 1 << 16)
        table = np.full(size, base, np.uint64)
        table[0] = 1
        table = np.cumprod(table, dtype=np.uint64)
        if size <= 4 * SLICE_BYTES:
            _powers[name] = table
    return table


@dataclass
class Words:
    """Words of a run of texts: byte bounds, hashes, the text of each word, and word bounds of each text."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    text: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def give_back() -> None:
    """Free memory that the allocators of this worker keep goes back to the system, for the tasks after this one."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim is not None:
        trim(0)


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Pieces of a string column of about ``limit`` bytes, each with its first row's number."""
    let_go()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, n = 0, len(column)
    while at < n:
        before = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, before + limit, side="right")))
        yield at, column.slice(at, end - at)
        at = end
    give_back()


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string or binary column; null is empty."""
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = pc.fill_null(column.cast(pa.large_binary()), b"") if binary else pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0 or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, equal for equal bytes wherever they stand."""
    n = len(data)
    if len(start) == 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power_table("p", _BASE, n)[:n], out=sums[1:])
    value = (sums[end] - sums[start]) * _power_table("i", _INVERSE, n + 1)[start]
    return mix(value ^ ((end - start).astype(np.uint64) << np.uint64(48)))


def words(column: pa.Array, lower: bool = True) -> Words:
    """All words of the texts; ``lower`` changes A-Z only."""
    data, offsets = buffer(column)
    if lower and len(data):
        data = np.where((data >= 65) & (data <= 90), data | 32, data)
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~SEPARATOR[data]
    cut = inside.copy()
    cut[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    cut[heads] |= inside[heads]
    start = np.flatnonzero(cut)
    last = inside[:-1] & ~inside[1:]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[tails] |= inside[tails]
    end = np.flatnonzero(last) + 1
    text = np.searchsorted(offsets, start, side="right") - 1
    first = np.searchsorted(start, offsets, side="left")
    return Words(data, start, end, span_hash(data, start, end), text, first)


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of per-word values for each text."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def windows(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order-sensitive hashes of all windows of ``width`` items, and window bounds of each text.

    A text with fewer items, but at least one, gives one window: its whole sequence.
    """
    counts = np.diff(first)
    number = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(number)])
    texts = np.repeat(np.arange(len(counts)), number)
    place = first[texts] + np.arange(bounds[-1]) - bounds[texts]
    length = np.minimum(counts[texts], width)
    value = np.full(len(place), 0x51ED270B, np.uint64)
    limit = max(len(hashes) - 1, 0)
    for k in range(width):
        step = mix(value * np.uint64(0xD6E8FEB86659FD93) + hashes[np.minimum(place + k, limit)]) if len(hashes) else value
        value = np.where(k < length, step, value)
    return value, bounds
