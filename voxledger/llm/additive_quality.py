"""Text quality by a generalised additive model with pairwise interactions.

Twelve statistics of a text are binned by quantiles of the training sample. Boosting goes round the
features in turn: each step fits a tree of at most four leaves to the logistic gradient over one
feature's bins and adds a small part of it to that feature's table. When the single tables are done, the
pairs whose coarse grids explain most of what is left get tables of their own, boosted the same
way with trees over both axes. A score is the sum of table look-ups, made for whole batches
at once, put through the logistic function.

The training sample is bounded by ``rows`` (in order of a hash of the id) and holds only rows that
may be learned from. Every whole text is scored.

Null and empty texts have all statistics 0 and a score like any other. With labels of one kind only,
every score is that kind; without labels it is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxledger.llm.bytetext import per_text, slices, windows, words
from voxledger.llm.tables import held_out

FEATURES = (
    "words upper marks symbols distinct same_as_last repeated_windows digits lines word_length stops longest".split()
)


@dataclass(frozen=True)
class Parameters:
    rows: int = 20_000  # bound of the training sample
    bins: int = 64
    coarse: int = 12  # bins of an axis of a pair
    rounds: int = 150
    pair_rounds: int = 60
    pairs: int = 6
    leaves: int = 4
    rate: float = 0.1
    least_rows: int = 10  # rows of a leaf
    smooth: float = 1.0


@dataclass
class Model:
    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Rows of features to probabilities: bin look-ups and additions only."""
        total = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[j], x[:, j], side="right")]
        if self.pairs:
            coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.coarse_edges)]
            for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
                total += table[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-total))


_UPPER, _LETTER, _MARK, _SYMBOL, _DIGIT, _STOP, _LINE, _POINT = range(8)
_CLASS = np.zeros((8, 256), bool)
_CLASS[_UPPER, 65:91] = True
_CLASS[_LETTER, 65:91] = _CLASS[_LETTER, 97:123] = True
_CLASS[_MARK, list(b"!?\"'();:-")] = True
_CLASS[_SYMBOL, list(b"#*$%&|<>")] = True
_CLASS[_DIGIT, 48:58] = True
_CLASS[_STOP, list(b".,")] = True
_CLASS[_LINE, 10] = True
_CLASS[_POINT] = (np.arange(256) & 0xC0) != 0x80  # first byte of a code point


def features(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text of a slice."""
    w = words(column, lower=False)
    n, rows = w.counts, len(column)
    n1 = np.maximum(n, 1).astype(float)
    # Byte classes are summed over whole texts, blanks included.
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) if t else 0 for t in column.to_pylist()])])

    def count(kind: int) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(_CLASS[kind][w.data])])
        return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)

    size = w.end - w.start
    text = w.text
    order = np.lexsort((w.hash, text))
    new = np.ones(len(order), bool)
    new[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (text[order][1:] != text[order][:-1])
    distinct = np.bincount(text[order][new], minlength=rows)
    same = np.zeros(len(text), np.int64)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (text[1:] == text[:-1])
    value, bounds = windows(w.hash, w.first, 3)
    of = np.repeat(np.arange(rows), np.diff(bounds))
    order = np.lexsort((value, of))
    again = np.zeros(len(order), bool)
    again[1:] = (value[order][1:] == value[order][:-1]) & (of[order][1:] == of[order][:-1])
    repeated = np.bincount(of[order][again], minlength=rows) / np.maximum(np.diff(bounds), 1)
    longest = np.zeros(rows)
    np.maximum.at(longest, text, size)
    letters = np.maximum(count(_LETTER), 1)
    lines = count(_LINE) + 1
    return np.column_stack(
        [
            np.log1p(n),
            count(_UPPER) / letters,
            count(_MARK) / n1,
            count(_SYMBOL) / n1,
            distinct / n1,
            per_text(same, w.first) / n1,
            repeated,
            count(_DIGIT) / n1,
            np.where(n > 0, np.log1p(n / lines), 0),
            per_text(size, w.first) / n1,
            count(_STOP) / n1,
            np.log1p(longest),
        ]
    )


def _leaves(g: np.ndarray, h: np.ndarray, n: np.ndarray, p: Parameters) -> np.ndarray:
    """A tree over ordered bins: the value of every bin."""
    cuts = [0, len(g)]
    cg, ch, cn = (np.concatenate([[0], np.cumsum(x)]) for x in (g, h, n))

    def worth(a, b):
        return (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + p.smooth)

    for _ in range(p.leaves - 1):
        best = 1e-9, None
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            k = np.arange(a + 1, b)
            k = k[(cn[k] - cn[a] >= p.least_rows) & (cn[b] - cn[k] >= p.least_rows)]
            if len(k):
                gain = worth(a, k) + worth(k, b) - worth(a, b)
                if gain.max() > best[0]:
                    best = gain.max(), int(k[gain.argmax()])
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + p.smooth)
    return out


def _grid_leaves(g: np.ndarray, h: np.ndarray, n: np.ndarray, p: Parameters) -> np.ndarray:
    """A tree of two levels over a grid; every cut goes along either axis."""

    def cut(box: tuple[int, int, int, int]):
        a, b, c, d = box
        part = g[a:b, c:d], h[a:b, c:d], n[a:b, c:d]
        whole = part[0].sum() ** 2 / (part[1].sum() + p.smooth)
        best = 1e-9, None
        for axis in (0, 1):
            sg, sh, sn = (np.cumsum(x.sum(axis=1 - axis)) for x in part)
            left, right = (sg[:-1], sh[:-1], sn[:-1]), (sg[-1] - sg[:-1], sh[-1] - sh[:-1], sn[-1] - sn[:-1])
            gain = left[0] ** 2 / (left[1] + p.smooth) + right[0] ** 2 / (right[1] + p.smooth) - whole
            gain = np.where((left[2] >= p.least_rows) & (right[2] >= p.least_rows), gain, -1)
            if len(gain) and gain.max() > best[0]:
                k = int(gain.argmax()) + 1
                best = gain.max(), [(a, a + k, c, d), (a + k, b, c, d)] if axis == 0 else [(a, b, c, c + k), (a, b, c + k, d)]
        return best[1] or [box]

    out = np.zeros(g.shape)
    for half in cut((0, g.shape[0], 0, g.shape[1])):
        for a, b, c, d in cut(half):
            out[a:b, c:d] = g[a:b, c:d].sum() / (h[a:b, c:d].sum() + p.smooth)
    return out


def _quantile_edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def train(x: np.ndarray, y: np.ndarray, p: Parameters) -> Model:
    """Cyclic boosting of single tables, then of the tables of the best pairs."""
    share = float(np.mean(y)) if len(y) else 0.5
    if share in (0.0, 1.0) or not len(y):
        return Model(0.0 if not len(y) else 40.0 * (2 * share - 1))
    width = x.shape[1]
    model = Model(float(np.log(share / (1 - share))), [_quantile_edges(x[:, j], p.bins) for j in range(width)])
    model.coarse_edges = [_quantile_edges(x[:, j], p.coarse) for j in range(width)]
    at = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    size = [len(e) + 1 for e in model.edges]
    rows = [np.bincount(a, minlength=s) for a, s in zip(at, size, strict=True)]
    model.tables = [np.zeros(s) for s in size]
    total = np.full(len(y), model.intercept)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-total))
        return y - q, q * (1 - q)

    for _ in range(p.rounds):
        for j in range(width):
            g, h = slope()
            step = p.rate * _leaves(np.bincount(at[j], g, size[j]), np.bincount(at[j], h, size[j]), rows[j], p)
            model.tables[j] += step
            total += step[at[j]]
    coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.coarse_edges)]
    shape = [len(e) + 1 for e in model.coarse_edges]

    def grid(i: int, j: int, v: np.ndarray | None) -> np.ndarray:
        return np.bincount(coarse[i] * shape[j] + coarse[j], v, shape[i] * shape[j]).reshape(shape[i], shape[j])

    g, h = slope()
    gain = {}
    for i in range(width):
        for j in range(i):
            gg, hh = grid(i, j, g), grid(i, j, h)
            gain[i, j] = float((gg**2 / (hh + p.smooth)).sum() - (gg.sum(1) ** 2 / (hh.sum(1) + p.smooth)).sum() - (gg.sum(0) ** 2 / (hh.sum(0) + p.smooth)).sum())
    model.pairs = sorted(gain, key=lambda k: (-gain[k], k))[: p.pairs]
    model.pair_tables = [np.zeros((shape[i], shape[j])) for i, j in model.pairs]
    for _ in range(p.pair_rounds):
        for k, (i, j) in enumerate(model.pairs):
            g, h = slope()
            step = p.rate * _grid_leaves(grid(i, j, g), grid(i, j, h), grid(i, j, None), p)
            model.pair_tables[k] += step
            total += step[coarse[i], coarse[j]]
    return model


def _measured(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, column in slices(batch.column("text")):
                x = features(column)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.record_batch([batch.column("id").slice(at, len(column)), batch.column("y").slice(at, len(column)), lists], names=["id", "y", "x"])

    return docs.mapInArrow(run, "id long, y int, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, p: Parameters = Parameters()) -> Model:
    """Learn from ``labels`` (doc_id, quality): rows held out are never looked at."""
    open_rows = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("y")).filter("id is not null and y is not null")
    sample = open_rows.filter(~held_out(F.col("id"))).distinct().orderBy(F.xxhash64("id"), "id", "y").limit(p.rows)
    # At most ``rows`` pairs of numbers.
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("id"))
    # One text an id and label, so rows that repeat an id don't pass the bound.
    texts = texts.groupBy("id", "y").agg(F.min("text").alias("text"))
    got = _measured(texts).toArrow().sort_by([("id", "ascending"), ("y", "ascending")])
    x = np.array(got.column("x").to_pylist()).reshape(got.num_rows, len(FEATURES))
    return train(x, got.column("y").to_numpy().astype(float), p)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row, from the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, column in slices(batch.column("text")):
                yield pa.record_batch([batch.column("doc_id").slice(at, len(column)), pa.array(shared.value.score(features(column)))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
