"""Toxicity from confirmed toxic examples and unlabelled text, by non-negative positive-unlabelled learning.

A linear numpy classifier over hashed words and word beginnings is trained on two samples: texts
confirmed as toxic, and texts whose labels are hidden. With the share ``prior`` of toxic
texts, the risk on clean texts is that of all texts less ``prior`` times that of toxic ones; where a
batch makes this difference negative, the step goes back (Adam on ``-gradient``), so a flexible model
cannot drive it below zero. Logistic loss.

Both samples are bounded by documented parameters and taken in order of a hash of the id; the prior
is the share over all rows that may be learned from. Samples of any size are trained on for the same number of steps. Scoring covers every whole text. Weights are
one array of fixed size.

Null and empty texts have no features and get the score of the bias. Without a confirmed example or
without unlabelled rows nothing can be learned and every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxledger.llm.bytetext import buffer, slices, span_hash, words
from voxledger.llm.tables import held_out


@dataclass(frozen=True)
class Parameters:
    bits: int = 18  # 2^bits hashed features
    beginnings: tuple[int, ...] = (5, 7)  # bytes of word beginnings
    confirmed_rows: int = 4_000  # bound of the sample of confirmed examples
    unlabelled_rows: int = 12_000  # bound of the sample of texts with hidden labels
    least_share: float = 0.0017  # features in fewer unlabelled texts of the sample are left out,
    least_confirmed: int = 3  # unless so many confirmed texts have them
    most_share: float = 0.2  # features in more unlabelled texts are left out,
    least_gap: float = 0.1  # unless their shares of confirmed and unlabelled texts differ so much
    epochs: int = 20  # of a full unlabelled sample; smaller samples take as many steps
    batch: int = 1_000
    rate: float = 0.02
    decay: float = 1e-3
    scale: float = 5.0


@dataclass(frozen=True)
class Model:
    weights: np.ndarray | None
    bias: float


def features(column: pa.Array, p: Parameters, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (feature, value, bounds): root of a feature's share of the words. ``used`` limits the features."""
    w = words(column)
    hashes = [w.hash] + [span_hash(w.data, w.start, np.minimum(w.end, w.start + k)) ^ np.uint64(k * 0x9E3779B1) for k in p.beginnings]
    index = np.concatenate([(h >> np.uint64(64 - p.bits)).astype(np.int64) for h in hashes])
    text = np.concatenate([w.text] * len(hashes))
    if used is not None:
        keep = used[index]
        index, text = index[keep], text[keep]
    key, count = np.unique((text << p.bits) + index, return_counts=True)
    text, index = key >> p.bits, key & ((1 << p.bits) - 1)
    value = np.sqrt(count / np.maximum(w.counts, 1)[text]).astype(np.float32)
    return index.astype(np.int32), value, np.searchsorted(text, np.arange(len(column) + 1))


class Sparse:
    """Sparse rows with the two products that training needs."""

    def __init__(self, index: np.ndarray, value: np.ndarray, bounds: np.ndarray):
        self.index, self.value, self.bounds = index, value, bounds

    def take(self, rows: np.ndarray) -> Sparse:
        size = np.diff(self.bounds)[rows]
        bounds = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.bounds[rows] - bounds[:-1], size) + np.arange(bounds[-1])
        return Sparse(self.index[at], self.value[at], bounds)

    def dot(self, weights: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.value * weights[self.index])])
        return sums[self.bounds[1:]] - sums[self.bounds[:-1]]

    def back(self, gradient: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.index, np.repeat(gradient, np.diff(self.bounds)) * self.value, size)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train(confirmed: Sparse, unlabelled: Sparse, prior: float, p: Parameters) -> Model:
    """Adam on the non-negative risk estimate."""
    n_u, n_p = len(unlabelled.bounds) - 1, len(confirmed.bounds) - 1
    size = 1 << p.bits
    df = np.bincount(unlabelled.index, minlength=size)
    df_confirmed = np.bincount(confirmed.index, minlength=size)
    telling = np.abs(df_confirmed / n_p - df / n_u) >= p.least_gap
    used = ((df >= max(3, p.least_share * n_u)) | (df_confirmed >= p.least_confirmed)) & ((df <= p.most_share * n_u) | telling)
    keep = np.flatnonzero(used)
    place = np.full(size, -1, np.int32)
    place[keep] = np.arange(len(keep))

    def narrow(x: Sparse) -> Sparse:
        at = place[x.index] >= 0
        bounds = np.concatenate([[0], np.cumsum(at)])[x.bounds]
        return Sparse(place[x.index[at]], x.value[at] * np.float32(p.scale), bounds)

    confirmed, unlabelled = narrow(confirmed), narrow(unlabelled)
    rng = np.random.default_rng(7)
    x = np.zeros(len(keep) + 1)  # the last is the bias
    m, v = np.zeros_like(x), np.zeros_like(x)
    steps = max(1, -(-n_u // p.batch))
    t, last = 0, p.epochs * -(-p.unlabelled_rows // p.batch)
    while t < last:
        deal_u = np.array_split(rng.permutation(n_u), steps)
        deal_p = np.array_split(np.resize(rng.permutation(n_p), max(n_p, steps)), steps)
        for rows_u, rows_p in list(zip(deal_u, deal_p, strict=True))[: last - t]:
            a, b = confirmed.take(rows_p), unlabelled.take(rows_u)
            z_p, z_u = a.dot(x[:-1]) + x[-1], b.dot(x[:-1]) + x[-1]
            s_p, s_u = _sigmoid(z_p), _sigmoid(z_u)
            clean_risk = np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()
            if clean_risk >= 0:
                g_p, g_u = -prior / len(z_p) * np.ones(len(z_p)), s_u / len(z_u)
            else:
                g_p, g_u = prior * s_p / len(z_p), -s_u / len(z_u)
            g = np.append(a.back(g_p, len(keep)) + b.back(g_u, len(keep)) + p.decay * x[:-1], g_p.sum() + g_u.sum())
            t += 1
            m = 0.9 * m + 0.1 * g
            v = 0.999 * v + 0.001 * g * g
            x = x - p.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(size, np.float32)
    weights[keep] = x[:-1] * p.scale
    return Model(weights, float(x[-1]))


def _sparse(rows: pa.Table) -> Sparse:
    """Sparse rows in the order of their ids, read from the Arrow buffers without a copy for each row."""
    rows = rows.combine_chunks()
    order = np.argsort(rows.column("id").to_numpy(), kind="stable")
    (index, bounds), (value, _) = (buffer(rows.column(k).chunk(0).cast(pa.large_binary())) for k in "iv")
    return Sparse(index.view(np.int32), value.view(np.float32), bounds // 4).take(order)


def fit(docs: DataFrame, labels: DataFrame, p: Parameters = Parameters()) -> Model:
    """Learn from ``labels`` (doc_id, toxic): rows held out are never looked at."""
    open_rows = labels.select(F.col("doc_id").alias("id"), "toxic").filter("id is not null and toxic is not null").filter(~held_out(F.col("id")))
    prior = open_rows.agg(F.avg((F.col("toxic") == 1).cast("double")).alias("x")).first()["x"]
    if not prior:
        return Model(None, 0.0)
    order = F.xxhash64("id"), F.col("id")
    confirmed = open_rows.filter("toxic = 1").select("id").distinct().orderBy(*order).limit(p.confirmed_rows)
    hidden = open_rows.select("id").distinct().orderBy(*order).limit(p.unlabelled_rows)
    sample = confirmed.withColumn("part", F.lit(1)).union(hidden.withColumn("part", F.lit(0)))
    # Both limits bound the sample: at most 16,000 ids.
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("id"))
    # One text an id and sample, so rows that repeat an id don't pass the bounds.
    texts = texts.groupBy("id", "part").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, column in slices(batch.column("text")):
                index, value, bounds = features(column, p)
                cut = [(index[a:b].tobytes(), value[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.record_batch([batch.column("id").slice(at, len(column)), batch.column("part").slice(at, len(column)), pa.array([x for x, _ in cut], pa.binary()), pa.array([x for _, x in cut], pa.binary())], names=["id", "part", "i", "v"])

    rows = texts.mapInArrow(run, "id long, part int, i binary, v binary")
    # One sample after the other; rows of one id in the order of their features.
    confirmed, hidden = (rows.filter(F.col("part") == k).drop("part").toArrow() for k in (1, 0))
    if not confirmed.num_rows or not hidden.num_rows:
        return Model(None, 0.0)
    return train(_sparse(confirmed), _sparse(hidden), float(prior), p)


def score(docs: DataFrame, model: Model, p: Parameters = Parameters()) -> DataFrame:
    """(doc_id, score) of every row, from the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one array of 2^bits weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        used = None if own.weights is None else own.weights != 0
        for batch in batches:
            for at, column in slices(batch.column("text")):
                if used is None:
                    out = np.zeros(len(column))
                else:
                    index, value, bounds = features(column, p, used)
                    out = _sigmoid(Sparse(index, value.astype(np.float64), bounds).dot(own.weights) + own.bias)
                yield pa.record_batch([batch.column("doc_id").slice(at, len(column)), pa.array(out)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: Model, limit: float = 0.3, p: Parameters = Parameters()) -> DataFrame:
    """The documents without those that score ``limit`` or more; columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        own = shared.value
        if own.weights is None:
            return pa.array(np.zeros(len(texts)))
        out = [np.zeros(0)]
        for _, column in slices(texts):
            index, value, bounds = features(column, p, own.weights != 0)
            out.append(_sigmoid(Sparse(index, value.astype(np.float64), bounds).dot(own.weights) + own.bias))
        return pa.array(np.concatenate(out))

    return docs.filter(scored("text") < limit)
