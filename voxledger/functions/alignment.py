"""Substitutions, deletions and insertions of word alignments.

The split depends on which of several cheapest alignments is taken: walking back from the end,
a match is preferred, then a substitution, a deletion, an insertion.  That choice looks only at
the three neighbours of a cell.  An Arrow UDF works on many pairs at once.  For pairs of usual length the
matrix is kept as bits (:mod:`voxledger.functions.bits`) and walked back.  For longer ones the counts are carried forward
with the distances, one numpy step per anti-diagonal, whose cells do not depend on each other.  References of
hundreds of words go one by one, their matrix as integers of any size, of which about the root of the columns is held.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxledger.functions import bits
from voxledger.functions.distance import Reference
from voxledger.functions.text import _col

_CELLS = 1 << 17  # padded cells that one numpy step works on

# A cell is one integer: cost, then the rank of the step taken, then the two counts.  Fields of
# 20 bits hold pairs of up to a million words; longer ones use Python integers with wider fields.
_NARROW, _WIDE = 20, 60


def align_counts(ref: np.ndarray, n: np.ndarray, hyp: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Rows of (substitutions, deletions, insertions).

    ``ref`` and ``hyp`` are padded codes [place, pair]; ``n`` and ``m`` are the true lengths.
    """
    narrow = int((n + m).max()) < 1 << _NARROW
    bits, dtype = (_NARROW, np.int64) if narrow else (_WIDE, object)
    deletion, substitution, rank, unit = 1, 1 << bits, 1 << 2 * bits, 4 << 2 * bits
    field, unreached = substitution - 1, ((1 << bits) - 1) * unit
    rows, cols = ref.shape[0], hyp.shape[0]
    backwards = hyp[::-1]
    total = n + m
    out = np.zeros(len(n), dtype=dtype)
    before, last = None, np.zeros((1, len(n)), dtype=dtype)
    # Diagonal s holds the cells (i, s - i); ``low`` is the smallest i on it.
    low_before = low_last = 0
    for s in range(1, rows + cols + 1):
        low, high = max(0, s - cols), min(rows, s)
        cell = np.full((high - low + 1, len(n)), unreached, dtype=dtype)

        left = slice(low, min(high, s - 1) + 1)  # from (i, j - 1): an insertion
        if left.stop > left.start:
            cell[: left.stop - low] = last[left.start - low_last : left.stop - low_last] + (unit + 2 * rank)
        first = max(low, 1)  # from (i - 1, j): a deletion
        if high >= first:
            deleted = last[first - 1 - low_last : high - low_last] + (unit + rank + deletion)
            np.minimum(cell[first - low :], deleted, out=cell[first - low :])
        end = min(high, s - 1)  # from (i - 1, j - 1): a match or a substitution
        if end >= first:
            differ = ref[first - 1 : end] != backwards[cols - s + first : cols - s + end + 1]
            kept = before[first - 1 - low_before : end - low_before] + differ.astype(dtype) * (unit + substitution)
            inner = cell[first - low : end - low + 1]
            np.minimum(inner, kept, out=inner)
        cell &= ~(3 * rank)

        done = np.flatnonzero(total == s)
        if len(done):
            out[done] = cell[n[done] - low, done]
        before, last, low_before, low_last = last, cell, low_last, low
    subs, dels = (out // substitution) & field, out & field
    return np.stack([subs, dels, out // unit - subs - dels], axis=1).astype(np.int64)


def _groups(n: np.ndarray, m: np.ndarray) -> Iterator[np.ndarray]:
    """Index groups of pairs of similar size, bounded in padded cells of one diagonal."""
    size = n + m
    order = np.argsort(size, kind="stable")
    start = 0
    while start < len(order):
        similar = np.searchsorted(size[order], size[order[start]] * 1.25 + 4, side="right")
        end = min(int(similar), start + max(1, _CELLS // int(size[order[start]] + 1)))
        yield order[start:end]
        start = end


def _walked(ref: np.ndarray, n: np.ndarray, hyp: np.ndarray, m: np.ndarray) -> np.ndarray:
    """:func:`align_counts` for references of at most ``bits.SHORT`` words."""
    scores, equal, free, rises = bits.columns_of(ref, n, hyp, kept=True)
    i, j, subs, dels = n.astype(np.int64), m.astype(np.int64), np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    at = np.flatnonzero((i > 0) & (j > 0))
    while len(at):
        column, place = j[at] - 1, (i[at] - 1).astype(np.uint64)
        match, costless, rise = (((x[column, at] >> place) & np.uint64(1)).astype(bool) for x in (equal, free, rises))
        diagonal = match | ~costless
        deleted = ~diagonal & rise
        subs[at] += diagonal & ~match
        dels[at] += deleted
        i[at] -= diagonal | deleted
        j[at] -= ~deleted
        at = at[(i[at] > 0) & (j[at] > 0)]
    dels += i  # what is left of a reference whose hypothesis is used up
    return np.stack([subs, dels, scores[m, np.arange(len(n))] - subs - dels], axis=1).astype(np.int64)


def _long_counts(ref: list[int], hyp: list[int]) -> tuple[int, int, int]:
    """:func:`align_counts` of one pair, its columns as integers of any size.

    Of every block of columns the first is kept; a block is worked out again when it is walked back.
    """
    n, m = len(ref), len(hyp)
    known = Reference(ref).bits_of(hyp)
    full, block = (1 << n) - 1, math.isqrt(m) + 1

    def column(eq: int, plus: int, minus: int) -> tuple[int, int, int]:
        x = eq | minus
        diagonal = ((((x & plus) + plus) ^ plus) | x) & full
        up, down = minus | (full & ~(diagonal | plus)), plus & diagonal
        up = ((up << 1) | 1) & full
        return ((down << 1) & full) | (full & ~(diagonal | up)), up & diagonal, diagonal

    begins, plus, minus = [], full, 0
    for k, word in enumerate(hyp):
        if k % block == 0:
            begins.append((plus, minus))
        plus, minus, _ = column(known[word], plus, minus)
    i, j, subs, dels, ins = n, m, 0, 0, 0
    for b in reversed(range(len(begins))):
        (plus, minus), start, held = begins[b], b * block, []
        for word in hyp[start : start + block]:
            plus, minus, diagonal = column(known[word], plus, minus)
            held.append((diagonal, plus))
        while i and j > start:
            diagonal, rises = held[j - start - 1]
            if (match := ref[i - 1] == hyp[j - 1]) or not diagonal >> (i - 1) & 1:
                subs += not match
                i, j = i - 1, j - 1
            elif rises >> (i - 1) & 1:
                dels, i = dels + 1, i - 1
            else:
                ins, j = ins + 1, j - 1
    return subs, dels + i, ins + j


#: Up to here the diagonals of many pairs together are cheaper than the columns of each.
_DIAGONAL = 256


def align_arrays(ref: pa.Array, hyp: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Counts and reference lengths of text pairs, words split at white space."""
    words = bits.Words(ref, hyp)
    n, m = words.lengths
    counts = np.zeros((len(ref), 3), dtype=np.int64)
    counts[:, 1], counts[:, 2] = np.where(m == 0, n, 0), np.where(n == 0, m, 0)
    some = (n > 0) & (m > 0) & (words.which[0] != words.which[1])
    short = some & (n <= bits.SHORT) & (m <= bits.SHORT_OTHER)
    middle = some & ~short & (n <= _DIAGONAL) & (m <= _DIAGONAL)
    for rows, grouped, count in ((short, bits.groups, _walked), (middle, _groups, align_counts)):
        rows = np.flatnonzero(rows)
        for g in grouped(n[rows], m[rows]):
            g = rows[g]
            counts[g] = count(words.table(0, g, -1), n[g], words.table(1, g, -2), m[g])
    for i in np.flatnonzero(some & ~short & ~middle).tolist():
        counts[i] = _long_counts(words.of(0, i), words.of(1, i))
    return counts, n


def align_texts(refs: list[str], hyps: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """:func:`align_arrays` of lists."""
    return align_arrays(pa.array(refs, pa.string()), pa.array(hyps, pa.string()))


_COUNTS = ("subs", "dels", "ins", "ref_words")


def _align(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    returned = pa.struct([pa.field(c, pa.int64()) for c in _COUNTS])
    for ref, hyp in batches:
        parts = [pa.array([], returned)]
        for start, rows in bits.slices(ref, hyp):
            pair = ref.slice(start, rows), hyp.slice(start, rows)
            none = np.asarray(pair[0].is_null(), bool) | np.asarray(pair[1].is_null(), bool)
            counts, words = align_arrays(*pair)
            parts.append(pa.StructArray.from_arrays([pa.array(v, pa.int64(), mask=none) for v in (*counts.T, words)], fields=[*returned]))
        yield pa.concat_arrays(parts)


_align.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
_aligned = F.arrow_udf(_align, T.StructType([T.StructField(c, T.LongType()) for c in _COUNTS]))


def add_alignment_counts(df: DataFrame, ref: Column | str, hyp: Column | str) -> DataFrame:
    """Add ``subs``, ``dels``, ``ins`` and ``ref_words`` of each text pair (null for null text)."""
    kept = [c for c in df.columns if c not in _COUNTS]
    scored = df.withColumn("_ops", _aligned(_col(ref), _col(hyp)))
    return scored.select(*kept, *[F.col(f"_ops.{c}").alias(c) for c in _COUNTS])
