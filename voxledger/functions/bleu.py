"""BLEU: 13a tokens, clipped n-gram matches per row, corpus score from pooled counts.

Tokens of a slice of rows become numbers in one Arrow call. An n-gram's code is the rank of the pair (code of its
first n - 1 tokens, last token); the code of a single token is that of (row, token), so equal codes mean equal grams of one
row, and one sort an order counts them on both sides. Corpus BLEU then shuffles only a dozen sums per
group, never n-grams. Word edits can be taken in the same call.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import chain, count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxledger.functions.distance import word_edits
from voxledger.functions.text import _col, tokenize

ORDERS = (1, 2, 3, 4)

# The public 13a tokeniser, as (pattern, replacement) in order of application.
TOKENIZER_13A = (
    ("<skipped>", ""),
    ("-\n", ""),
    ("\n", " "),
    ("&quot;", '"'),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("^", " "),
    ("$", " "),
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "),
    (r"([^0-9])([\.,])", r"\1 \2 "),
    (r"([\.,])([^0-9])", r" \1 \2"),
    (r"([0-9])(-)", r"\1 \2 "),
)


def tokenize_13a(c: Column | str) -> Column:
    """Tokens of the mteval-13a scheme, case kept."""
    text = _col(c)
    for pattern, replacement in TOKENIZER_13A:
        if pattern == "^":
            text = F.concat(F.lit(" "), text)
        elif pattern == "$":
            text = F.concat(text, F.lit(" "))
        elif "[" in pattern:
            text = F.regexp_replace(text, pattern, replacement.replace("\\", "$"))
        else:
            text = F.replace(text, F.lit(pattern), F.lit(replacement))
    return tokenize(text)


_PLAIN = [(p, r) for p, r in TOKENIZER_13A if len(p) > 1 and "[" not in p or p == "\n"]
_CLASSES = [(re.compile(p), r) for p, r in TOKENIZER_13A if "[" in p]
#: What the first class of :data:`TOKENIZER_13A` matches but for the space: a space between spaces changes no token.
_MARKS = [c for c in map(chr, range(128)) if c != " " and _CLASSES[0][0].match(c)]
_NEIGHBOURS = re.compile(r"[.,][.,]")
_INSIDE = re.compile(r"([0-9])([.,])(?=[0-9])")
#: Stand for a full stop and a comma between digits.
_HELD = {".": "\ue000", ",": "\ue001"}


def _by_classes(lines: list[str]) -> list[list[str]]:
    joined = "\n".join(lines)
    for pattern, replacement in _CLASSES:
        joined = pattern.sub(replacement, joined)
    return [line.split() for line in joined.split("\n")]


def _by_marks(lines: list[str]) -> list[list[str]]:
    """:func:`_by_classes` of lines in which no full stop or comma follows another: one stays in its word between digits only."""
    joined = "\n".join(lines)
    for mark in _MARKS:
        joined = joined.replace(mark, f" {mark} ")
    if "." in joined or "," in joined:
        joined = _INSIDE.sub(lambda m: m[1] + _HELD[m[2]], joined)
        for mark, held in _HELD.items():
            joined = joined.replace(mark, f" {mark} ").replace(held, mark)
    if "-" in joined:
        joined = _CLASSES[-1][0].sub(_CLASSES[-1][1], joined)
    return [line.split() for line in joined.split("\n")]


def tokens_13a(texts: Sequence[str]) -> list[list[str]]:
    """Tokens of many texts at once; the same as :func:`tokenize_13a`.

    Between padded lines no rule reaches from one text to the next.
    """
    lines = []
    for text in texts:
        for pattern, replacement in _PLAIN:
            if pattern in text:
                text = text.replace(pattern, replacement)
        lines.append(f" {text} ")
    odd = [i for i, line in enumerate(lines) if _NEIGHBOURS.search(line) or "\ue000" in line or "\ue001" in line]
    tokens = _by_marks(lines) if lines else []
    if odd:
        for i, line in zip(odd, _by_classes([lines[i] for i in odd]), strict=True):
            tokens[i] = line
    return tokens


def ngram_counts(refs: Sequence[list[str]], hyps: Sequence[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Clipped matches and numbers of hypothesis grams, [order, row]."""
    rows = len(refs)
    sizes = np.array([len(t) for t in chain(refs, hyps)], np.int64)
    flat = list(chain.from_iterable(chain(refs, hyps)))
    seen: dict[str, int] = {}
    ids = np.fromiter(map(seen.setdefault, flat, count()), np.int64, len(flat))
    text = np.repeat(np.arange(2 * rows), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat))  # tokens from here to the end of the text
    match = np.zeros((len(ORDERS), rows), np.int64)
    total = np.maximum(sizes[rows:] - (np.array(ORDERS)[:, None] - 1), 0)
    at = np.arange(len(flat))
    code = text % rows if rows else text
    for n in ORDERS:
        whole = left[at] >= n
        at, code = at[whole], code[whole]
        if not len(at):
            break
        _, first, code = np.unique(code * len(flat) + ids[at + n - 1], return_index=True, return_inverse=True)
        of_ref = text[at] < rows
        both = np.minimum(np.bincount(code[of_ref], minlength=len(first)), np.bincount(code[~of_ref], minlength=len(first)))
        match[n - 1] = np.bincount(text[at][first] % rows, both, rows).astype(np.int64)
    return match, total


#: Characters that one slice of rows may hold, but for a longer single row.
SLICE_CHARS = 1_000_000

COUNT_COLUMNS = tuple(f"match_{n}" for n in ORDERS) + tuple(f"total_{n}" for n in ORDERS) + ("hyp_len", "ref_len")


def _slices(*columns: pd.Series) -> Iterator[slice]:
    """Slices of the rows with about ``SLICE_CHARS`` characters."""
    sizes = np.cumsum(sum(np.array([0 if t is None else len(t) for t in c], np.int64) for c in columns))
    at = 0
    while at < len(sizes):
        before = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + SLICE_CHARS, side="right")))
        yield slice(at, end)
        at = end


def _pair_counts(ref: Sequence[str | None], hyp: Sequence[str | None]) -> dict[str, pd.arrays.IntegerArray]:
    """The count columns of a slice; null where the text that they count is null."""
    no_ref, no_hyp = (np.array([t is None for t in c], bool) for c in (ref, hyp))
    refs, hyps = (tokens_13a(["" if t is None else t for t in c]) for c in (ref, hyp))
    match, total = ngram_counts(refs, hyps)
    out = {f"match_{n}": (match[n - 1], no_ref | no_hyp) for n in ORDERS} | {f"total_{n}": (total[n - 1], no_hyp) for n in ORDERS}
    out |= {"hyp_len": (total[0], no_hyp), "ref_len": (np.array([len(t) for t in refs], np.int64), no_ref)}
    return {k: pd.arrays.IntegerArray(v, mask) for k, (v, mask) in out.items()}


def _scorer(with_edits: bool):
    """Arrow UDF (reference, hypothesis, and the same cleaned for word edits) -> counts (and length and edits)."""
    fields = [*COUNT_COLUMNS, *(("ref_words", "edits") if with_edits else ())]

    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for columns in batches:
            parts = []
            for rows in _slices(*columns):
                ref, hyp, *words = (c.iloc[rows].tolist() for c in columns)
                part = _pair_counts(ref, hyp)
                if with_edits:
                    clean_ref, clean_hyp = (pa.array(c, pa.large_string()) for c in words)
                    lengths, edits = word_edits(clean_ref, [clean_hyp])
                    no_ref = np.asarray(clean_ref.is_null(), bool)
                    no_pair = no_ref | np.asarray(clean_hyp.is_null(), bool)
                    part |= {"ref_words": pd.arrays.IntegerArray(lengths, no_ref), "edits": pd.arrays.IntegerArray(edits[0], no_pair)}
                parts.append(pd.DataFrame(part, columns=fields))
            yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({f: pd.array([], "Int64") for f in fields})

    score.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(score, T.StructType([T.StructField(f, T.LongType()) for f in fields]))


def add_bleu_counts(df: DataFrame, ref: Column | str, hyp: Column | str) -> DataFrame:
    """Add ``match_1..4``, ``total_1..4``, ``hyp_len`` and ``ref_len`` of each text pair."""
    scored = df.withColumn("_counts", _scorer(False)(_col(ref), _col(hyp)))
    return scored.select(*df.columns, *[F.col(f"_counts.{c}").alias(c) for c in COUNT_COLUMNS])


def add_bleu_counts_and_edits(
    df: DataFrame, ref: Column | str, hyp: Column | str, clean_ref: Column | str, clean_hyp: Column | str
) -> DataFrame:
    """:func:`add_bleu_counts`, with ``edits`` and ``ref_words`` of the cleaned texts, in one Arrow call."""
    scored = df.withColumn("_counts", _scorer(True)(*map(_col, (ref, hyp, clean_ref, clean_hyp))))
    return scored.select(*df.columns, *[F.col(f"_counts.{c}").alias(c) for c in (*COUNT_COLUMNS, "edits", "ref_words")])


def pooled_counts() -> list[Column]:
    """Aggregates that pool the row counts of :func:`add_bleu_counts`."""
    return [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNT_COLUMNS]


def brevity_penalty() -> Column:
    hyp, ref = F.col("hyp_len").cast("double"), F.col("ref_len").cast("double")
    return F.when(hyp >= ref, F.lit(1.0)).otherwise(F.exp(1 - F.try_divide(ref, hyp)))


def bleu_from_counts(smooth: bool = True) -> Column:
    """Corpus BLEU of pooled counts.

    ``smooth=True``: 0-100, the k-th order without a match counts as ``1 / 2^k`` matches.
    ``smooth=False``: 0-1, zero as soon as one order has no match.
    """
    match = [F.col(f"match_{n}").cast("double") for n in ORDERS]
    total = [F.col(f"total_{n}").cast("double") for n in ORDERS]
    empty = match[0] == 0
    for t in total:
        empty = empty | (t == 0)
    logs, missed = [], F.lit(0)
    for m, t in zip(match, total):
        missed = missed + F.when(m == 0, 1).otherwise(0)
        matched = F.when(m == 0, F.pow(F.lit(0.5), missed)).otherwise(m) if smooth else m
        if not smooth:
            empty = empty | (m == 0)
        logs.append(F.ln(F.try_divide(matched, t)))
    mean = (logs[0] + logs[1] + logs[2] + logs[3]) / 4
    scale = 100.0 if smooth else 1.0
    return F.when(empty, F.lit(0.0)).otherwise(F.lit(scale) * brevity_penalty() * F.exp(mean))
