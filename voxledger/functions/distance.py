"""Edit distance on words and characters.

The method is bit-parallel: a row of the matrix is one integer, and every item of the hypothesis costs
a few operations on it. Words of a slice of rows are split and numbered by Arrow, and pairs of usual length advance
together (:mod:`voxledger.functions.bits`). Longer pairs and characters go one pair at a time on integers of any size: each
item of the hypothesis finds its places in the reference by one dictionary, so preparation is linear. All hypotheses of a
reference are scored in one Arrow call that reads the reference once. Scoring is narrow: no shuffle, nothing
shared between rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxledger.functions import bits
from voxledger.functions.text import _col


class Reference:
    """A reference, prepared to be compared with many hypotheses."""

    def __init__(self, items: Sequence):
        self.items = items
        self.places: dict = {}
        for i, item in enumerate(items):
            self.places.setdefault(item, []).append(i)

    def _bits(self, item) -> int:
        row = bytearray(len(self.items) // 8 + 1)
        for i in self.places.get(item, ()):
            row[i >> 3] |= 1 << (i & 7)
        return int.from_bytes(row, "little")

    def bits_of(self, other: Sequence) -> dict:
        """The places in the reference of each item of another sequence."""
        return {item: self._bits(item) for item in set(other)}

    def distance(self, other: Sequence) -> int:
        """Levenshtein distance by the bit-vector method of Myers (1999) in Hyyro's form (2001)."""
        n = len(self.items)
        if not n or not other:
            return max(n, len(other))
        if self.items == other:
            return 0
        known = self.bits_of(other)
        full, last = (1 << n) - 1, 1 << (n - 1)
        plus, minus, score = full, 0, n
        for item in other:
            eq = known[item]
            vertical = eq | minus
            horizontal = (((eq & plus) + plus) ^ plus) | eq
            up = minus | (full & ~(horizontal | plus))
            down = plus & horizontal
            if up & last:
                score += 1
            elif down & last:
                score -= 1
            up = (up << 1) | 1
            plus = full & ((down << 1) | ~(vertical | up))
            minus = full & up & vertical
        return score


def bit_parallel_distance(a: Sequence, b: Sequence) -> int:
    return Reference(a).distance(b)


def word_edits(ref: pa.Array, hyps: Sequence[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """Words of each reference and word edits [hypothesis, row]; a null text counts as one without words."""
    words = bits.Words(ref, *hyps)
    n, edits = words.lengths[0], np.zeros((len(hyps), len(ref)), np.int64)
    singly = []
    for k, out in enumerate(edits, 1):
        m = words.lengths[k]
        other = words.which[0] != words.which[k]
        out[:] = np.where(other, np.maximum(n, m), 0)
        other &= (n > 0) & (m > 0)
        short = (n <= bits.SHORT) & (m <= bits.SHORT_OTHER)
        rows = np.flatnonzero(other & short)
        for g in bits.groups(n[rows], m[rows]):
            g = rows[g]
            scores = bits.columns_of(words.table(0, g, -1), n[g], words.table(k, g, -2))
            out[g] = scores[m[g], np.arange(len(g))]
        singly += [(words.which[0, i], i, k) for i in np.flatnonzero(other & ~short).tolist()]
    for _, same in groupby(sorted(singly), key=itemgetter(0)):
        reference = None
        for _, i, k in same:
            reference = reference or Reference(words.of(0, i))
            edits[k - 1, i] = reference.distance(words.of(k, i))
    return n, edits


def _word_scorer(n_hyps: int):
    """Arrow UDF (reference, hypotheses...) -> (words of the reference, edits of each hypothesis)."""
    fields = ["n", *[f"e{i}" for i in range(n_hyps)]]
    returned = pa.struct([pa.field(f, pa.int64()) for f in fields])

    def score(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            parts = [pa.array([], returned)]
            for start, rows in bits.slices(*columns):
                ref, *hyps = (c.slice(start, rows) for c in columns)
                n, edits = word_edits(ref, hyps)
                none = np.asarray(ref.is_null(), bool)
                masks = [none, *[none | np.asarray(h.is_null(), bool) for h in hyps]]
                parts.append(pa.StructArray.from_arrays([pa.array(v, pa.int64(), mask=x) for v, x in zip([n, *edits], masks, strict=True)], fields=[*returned]))
            yield pa.concat_arrays(parts)

    score.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    return F.arrow_udf(score, T.StructType([T.StructField(f, T.LongType()) for f in fields]))


def _char_scorer():
    """Arrow UDF (reference, hypothesis) -> (characters of the reference, edits)."""
    fields = ["n", "e0"]

    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for columns in batches:
            out = []
            for ref, hyp in zip(*columns, strict=True):
                out.append([None, None] if ref is None else [len(ref), None if hyp is None else Reference(ref).distance(hyp)])
            yield pd.DataFrame(out, columns=fields, dtype="Int64")

    score.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(score, T.StructType([T.StructField(f, T.LongType()) for f in fields]))


def _add_edits(df: DataFrame, ref, hyps: Sequence, edits: Sequence[str], length: str, scorer) -> DataFrame:
    kept = [c for c in df.columns if c not in (*edits, length)]
    scored = df.withColumn("_scores", scorer(_col(ref), *[_col(h) for h in hyps]))
    values = [F.col(f"_scores.e{i}").alias(e) for i, e in enumerate(edits)]
    return scored.select(*kept, *values, F.col("_scores.n").alias(length))


def add_word_edits(
    df: DataFrame, ref: Column | str, hyp: Column | str, *, edits: str = "edits", ref_words: str = "ref_words"
) -> DataFrame:
    """Add the word edit distance of a text pair and the reference word count; null for a null text."""
    return _add_edits(df, ref, [hyp], [edits], ref_words, _word_scorer(1))


def add_word_edits_of(
    df: DataFrame, ref: Column | str, hyps: Sequence[Column | str], edits: Sequence[str], *, ref_words: str = "ref_words"
) -> DataFrame:
    """Word edit distances of several hypotheses of one reference, in one call a row."""
    return _add_edits(df, ref, hyps, edits, ref_words, _word_scorer(len(hyps)))


def add_char_edits(
    df: DataFrame, ref: Column | str, hyp: Column | str, *, edits: str = "edits", ref_chars: str = "ref_chars"
) -> DataFrame:
    """Add the character edit distance of a text pair and the reference length (spaces count)."""
    return _add_edits(df, ref, [hyp], [edits], ref_chars, _char_scorer())


def error_rate(edits: Column | str, length: Column | str) -> Column:
    """``edits / length`` as a fraction; null where the reference is empty."""
    return F.try_divide(_col(edits).cast("double"), _col(length).cast("double"))
