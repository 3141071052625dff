"""Matrices of edit distances as bits, for many pairs of item codes at once.

A column of the matrix is one 64-bit integer of differences a pair (Myers 1999, in Hyyro's form of 2001), so references of
up to 64 items advance together, one numpy step an item of the hypothesis.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The longest reference and hypothesis of a pair that advances with others.
SHORT, SHORT_OTHER = 64, 128
_CELLS = 1 << 16  # places that one numpy step works on
_ONE = np.uint64(1)

#: Bytes of text that one slice of rows may hold, but for a longer single row.
SLICE_BYTES = 2_000_000


def slices(*columns: pa.Array) -> Iterator[tuple[int, int]]:
    """Slices (start, rows) of about ``SLICE_BYTES`` bytes."""
    sizes = np.cumsum(sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns))
    at = 0
    while at < len(sizes):
        before = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, side="right")))
        yield at, end - at
        at = end


class Words:
    """The words of several columns of texts as codes, split at white space as ``str.split`` does; null has no words.

    A text that comes again, such as one reference of several hypotheses, is split once; ``which`` numbers the texts.
    """

    def __init__(self, *columns: pa.Array):
        # The type with 64-bit offsets, as one very long row may pass 2 GB.
        known = pc.dictionary_encode(pa.concat_arrays([c.cast(pa.large_string()) for c in columns]))
        self.which = pc.fill_null(known.indices, len(known.dictionary)).to_numpy(zero_copy_only=False).reshape(len(columns), len(columns[0]))
        split = pc.utf8_split_whitespace(known.dictionary)
        flat, ends = split.flatten(), np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))
        # A text that begins or ends with white space has an empty word there.
        full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False).astype(bool)
        self.codes = pc.dictionary_encode(flat).indices.to_numpy(zero_copy_only=False)[full].astype(np.int32)
        edges = np.concatenate([[0], np.cumsum(full)])[np.concatenate([[0], ends])]
        starts, lengths = edges, np.append(np.diff(edges), 0)
        self.starts, self.lengths = starts[self.which], lengths[self.which]

    def of(self, column: int, row: int) -> list[int]:
        at = self.starts[column, row]
        return self.codes[at : at + self.lengths[column, row]].tolist()

    def table(self, column: int, rows: np.ndarray, fill: int) -> np.ndarray:
        return padded(self.codes, self.starts[column, rows], self.lengths[column, rows], fill)


def padded(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, fill: int) -> np.ndarray:
    """Codes as [place, pair], padded at the end."""
    place = np.arange(int(lengths.max()))[:, None]
    inside = place < lengths[None, :]
    out = np.full(inside.shape, fill, dtype=np.int32)
    out[inside] = codes[(starts[None, :] + place)[inside]]
    return out


def groups(n: np.ndarray, m: np.ndarray) -> Iterator[np.ndarray]:
    """Index groups of pairs of similar size, bounded in places of the longer side."""
    size = np.maximum(n, m)
    order = np.lexsort((n + m, size))
    ordered = size[order]
    start = 0
    while start < len(order):
        similar = np.searchsorted(ordered, ordered[start] * 1.25 + 1, side="right")
        end = min(int(similar), start + max(1, _CELLS // int(ordered[start] + 1)))
        yield order[start:end]
        start = end


def _equal_items(ref: np.ndarray, hyp: np.ndarray) -> np.ndarray:
    """Places in the reference that hold each item of the hypothesis, as bits; made byte by byte, which moves least memory."""
    out = np.zeros((*hyp.shape, 8), np.uint8)
    for low in range(0, len(ref), 8):
        byte = np.zeros(hyp.shape, np.uint8)
        for i, items in enumerate(ref[low : low + 8]):
            byte |= (hyp == items).view(np.uint8) << np.uint8(i)
        out[:, :, low >> 3] = byte
    return out.view("<u8")[:, :, 0].astype(np.uint64)


def columns_of(ref: np.ndarray, n: np.ndarray, hyp: np.ndarray, kept: bool = False):
    """Distances of the references to each beginning of the hypotheses, [items of the hypothesis, pair].

    ``kept`` gives the bits to walk back by as well: equal items, diagonals that cost nothing, rises along the reference.
    """
    equal = _equal_items(ref, hyp)
    score = n.astype(np.int64)
    plus, minus = np.full(len(n), ~np.uint64(0)), np.zeros(len(n), np.uint64)
    last = np.maximum(n - 1, 0).astype(np.uint64)
    scores = np.empty((len(hyp) + 1, len(n)), np.int32)
    scores[0] = score
    free, rises = (np.empty(hyp.shape, np.uint64) for _ in range(2)) if kept else (None, None)
    for j, eq in enumerate(equal):
        x = eq | minus
        diagonal = (((x & plus) + plus) ^ plus) | x
        up, down = minus | ~(diagonal | plus), plus & diagonal
        score += ((up >> last) & _ONE).astype(np.int64)
        score -= ((down >> last) & _ONE).astype(np.int64)
        scores[j + 1] = score
        up = (up << _ONE) | _ONE
        plus, minus = (down << _ONE) | ~(diagonal | up), up & diagonal
        if kept:
            free[j], rises[j] = diagonal, plus
    return (scores, equal, free, rises) if kept else scores
