"""Near-duplicate classes by min-max hashing.

Each permutation of the shingle hashes gives two signature values, its minimum and its maximum, so
half as many hash evaluations fill a signature. Values of ``rows`` permutations make two bands,
one of minima and one of maxima; documents that share a band are candidates. With 128 permutations
and six rows there are 42 bands, and a pair at similarity 0.8 shares none with probability 3e-6.

How the work stays linear where copies are many:

* Documents with equal shingle sets are one class before any band is built.
* In a band bucket every member is compared with the bucket's first document only, a star, on full
  sets. So a bucket of any size gives one candidate a member.
* What stars leave apart is settled exactly: candidates at similarity 0.5 or more form clusters;
  members outside a cluster's largest class are compared with all its other members. These
  comparisons run on blocks of sets of bounded size, spread by salted keys, inside the tasks, and
  only true links leave them.

Rules: A-Z are lower-cased, words are runs outside ``[\\x20\\x09-\\x0D]``; a text with fewer words
than a shingle is one shingle; a text without words is linked with nothing. A null id takes
no part and is kept. Rows of one id with different texts count as one document for its class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxledger.llm.bitset import bit_set, passes
from voxledger.llm.bytetext import mix, slices, windows, words
from voxledger.llm.components import components
from voxledger.llm.tables import free_names, stored


@dataclass(frozen=True)
class Parameters:
    width: int = 5  # words of a shingle
    percent: int = 80  # similarity of a link
    permutations: int = 128
    rows: int = 6  # signature values of a band
    loose_percent: int = 50  # similarity that ties a cluster together
    block_docs: int = 128  # sets, and shingles, of a block of the exact step
    block_shingles: int = 200_000


def _unique_shingles(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and their bounds."""
    w = words(column)
    value, bounds = windows(w.hash, w.first, width)
    text = np.repeat(np.arange(len(column)), np.diff(bounds))
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    value, text = value[new], text[new]
    return value, np.searchsorted(text, np.arange(len(column) + 1))


def _signatures(value: np.ndarray, bounds: np.ndarray, p: Parameters) -> np.ndarray:
    """Band keys of the texts that have shingles: minima bands, then maxima bands."""
    rng = np.random.default_rng(20_240_229)
    shift = rng.integers(0, 1 << 64, p.permutations, dtype=np.uint64)
    factor = rng.integers(0, 1 << 64, p.permutations, dtype=np.uint64) | np.uint64(1)
    full = bounds[:-1] < bounds[1:]
    at = bounds[:-1][full]
    bands = p.permutations // p.rows
    keys = np.empty((int(full.sum()), 2 * bands), np.uint64)
    for band in range(bands):
        low = np.full(len(at), band + 1, np.uint64)
        high = np.full(len(at), band + 1 + bands, np.uint64)
        for k in range(band * p.rows, (band + 1) * p.rows):
            y = (value ^ shift[k]) * factor[k]
            low = mix(low * np.uint64(0xD6E8FEB86659FD93) + np.minimum.reduceat(y, at))
            high = mix(high * np.uint64(0xD6E8FEB86659FD93) + np.maximum.reduceat(y, at))
        keys[:, band], keys[:, band + bands] = low, high
    return keys


def signatures(docs: DataFrame, p: Parameters) -> DataFrame:
    """(doc, n_shingles, f1, f2, bands): set size, 128-bit hash of the set, band keys (null without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column("text")):
                value, bounds = _unique_shingles(texts, p.width)
                size = np.diff(bounds)
                full = size > 0
                start = bounds[:-1][full]
                prints = []
                for salt in (0x1234567, 0x89ABCDEF):
                    out = np.zeros(len(size), np.uint64)
                    if full.any():
                        out[full] = mix(np.add.reduceat(mix(value ^ np.uint64(salt)), start) + size[full].astype(np.uint64))
                    prints.append(pa.array(out.view(np.int64)))
                keys = _signatures(value, bounds, p).view(np.int64) if full.any() else np.zeros((0, 2 * (p.permutations // p.rows)), np.int64)
                offsets = np.concatenate([[0], np.cumsum(full)]) * keys.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys.ravel()))
                yield pa.record_batch([batch.column("doc").slice(at, len(texts)), pa.array(size), *prints, lists], names=["doc", "n_shingles", "f1", "f2", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc"), "text").mapInArrow(run, "doc long, n_shingles long, f1 long, f2 long, bands array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, n: int, p: Parameters) -> DataFrame:
    """(doc, items): full sets of distinct shingle hashes of the ``n`` or fewer documents ``wanted``.

    A bit set tells the tasks which texts to look at, so no text is shuffled; a few others pass.
    """
    bits = docs.sparkSession.sparkContext.broadcast(bit_set(wanted.select(F.xxhash64("doc").alias("h")), n, 64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = passes(bits.value, batch.column("h").to_numpy().view(np.uint64)) & batch.column("doc").is_valid().to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(near))
            for at, texts in slices(batch.column("text")):
                value, bounds = _unique_shingles(texts, p.width)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(value.view(np.int64)))
                yield pa.record_batch([batch.column("doc").slice(at, len(texts)), lists], names=["doc", "items"])

    doc = F.col("doc_id").cast("long")
    return docs.select(doc.alias("doc"), F.xxhash64(doc).alias("h"), "text").mapInArrow(run, "doc long, items array<long>")


def _block_links(p: Parameters):
    """Links between the sets of two blocks, by products of 0/1 matrices over slices of the vocabulary."""

    def flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        return lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                few, many = (batch.column(k).slice(i, 1).flatten() for k in ("few", "many"))
                (x, nx), (y, ny) = flat(few.field("items")), flat(many.field("items"))
                vocabulary, xi = np.unique(x, return_inverse=True)
                place = np.minimum(np.searchsorted(vocabulary, y), len(vocabulary) - 1)
                known = vocabulary[place] == y
                yi, yo = place[known], np.repeat(np.arange(len(ny)), ny)[known]
                xo = np.repeat(np.arange(len(nx)), nx)
                shared = np.zeros((len(nx), len(ny)), np.float64)
                for low in range(0, len(vocabulary), 8192):
                    a = np.zeros((len(nx), 8192), np.float32)
                    b = np.zeros((len(ny), 8192), np.float32)
                    s, t = (xi >= low) & (xi < low + 8192), (yi >= low) & (yi < low + 8192)
                    a[xo[s], xi[s] - low] = 1
                    b[yo[t], yi[t] - low] = 1
                    shared += a @ b.T
                union = nx[:, None] + ny[None, :] - shared
                a, b = np.nonzero(100 * shared >= p.percent * union)
                left, right = (z.field("doc").to_numpy(zero_copy_only=False) for z in (few, many))
                ends = left[a], right[b]
                other = ends[0] != ends[1]
                yield pa.record_batch([pa.array(ends[0][other]), pa.array(ends[1][other])], names=["a", "b"])

    return run


def _near_classes(links: DataFrame) -> DataFrame:
    """(doc, class): each document's smallest linked partner, followed twice.

    Members of one class are connected; one component may still have several classes, which costs
    comparisons but no links.
    """
    up = links.groupBy(F.col("b").alias("doc")).agg(F.min("a").alias("class"))
    for _ in range(2):
        next_up = up.select(F.col("doc").alias("class"), F.col("class").alias("further"))
        up = up.join(next_up, "class", "left").select("doc", F.coalesce("further", "class").alias("class"))
    return up


def _stray_links(sets: DataFrame, links: DataFrame, clusters: DataFrame, p: Parameters) -> DataFrame:
    """Links between different classes of one cluster: members outside its largest class against all its members."""
    both = clusters.select(F.col("node").alias("doc"), F.col("component").alias("cluster")).join(_near_classes(links), "doc", "left")
    both = stored(both.withColumn("class", F.coalesce("class", "doc")), "clusters")
    per_class = both.groupBy("cluster", "class").agg(F.count(F.lit(1)).alias("n"))
    shape = per_class.groupBy("cluster").agg(F.max(F.struct("n", "class")).alias("top"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    split = shape.filter("k > 1").select("cluster", F.col("top.class").alias("largest"), "n")
    rows = stored(both.join(split, "cluster").join(sets, "doc"), "members")

    def blocks(part: DataFrame, role: str) -> DataFrame:
        size = part.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / p.block_docs), F.ceil(F.sum(F.array_size("items")) / p.block_shingles)).alias("blocks"))
        dealt = part.join(size, "cluster").withColumn("block", F.pmod(F.xxhash64("doc", F.lit(role)), "blocks"))
        return dealt.groupBy("cluster", "block").agg(F.collect_list(F.struct("doc", "items")).alias(role))

    few = blocks(rows.filter("class <> largest").select("cluster", "doc", "items"), "few")
    many = blocks(rows.select("cluster", "doc", "items"), "many").withColumn("salt", F.pmod("block", F.lit(32)))
    salts = many.select("cluster", "salt").distinct()
    pairs = few.select("cluster", "few").join(salts, "cluster").join(many.select("cluster", "salt", "many"), ["cluster", "salt"])
    return pairs.select("few", "many").mapInArrow(_block_links(p), "a long, b long")


def near_classes(docs: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row for each row of ``docs``.

    The component is the smallest id that links reach, the document itself included.
    """
    signed = stored(signatures(docs.select("doc_id", "text"), p), "signatures")
    usable = signed.filter(F.col("doc").isNotNull() & (F.col("n_shingles") > 0))
    # One document stands for all with the same set.
    firsts = usable.groupBy("f1", "f2").agg(F.min("doc").alias("first"))
    apart = usable.select("doc", "f1", "f2").join(firsts, ["f1", "f2"]).select("doc", "first")
    apart = stored(apart, "firsts")
    own = usable.join(firsts.select("first").distinct(), F.col("doc") == F.col("first"), "left_semi")
    banded = own.select("doc", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("doc").alias("a"), F.max("doc").alias("z")).filter("a < z").select("key", "a")
    star = stored(banded.join(buckets, "key").filter("doc <> a").select("a", F.col("doc").alias("b")).distinct(), "star")
    ends = star.select(F.col("a").alias("doc")).union(star.select("b"))
    sets = stored(shingle_sets(docs, ends, 2 * star.count(), p), "sets")
    left, right = (sets.select(F.col("doc").alias(k), F.col("items").alias(f"s{k}")) for k in "ab")
    shared = F.array_size(F.array_intersect("sa", "sb"))
    compared = star.join(left, "a").join(right, "b").select("a", "b", (100 * shared / (F.array_size("sa") + F.array_size("sb") - shared)).alias("x"), (100 * shared).alias("i"), (F.array_size("sa") + F.array_size("sb") - shared).alias("u"))
    compared = stored(compared.select("a", "b", (F.col("i") >= p.percent * F.col("u")).alias("linked"), (F.col("i") >= p.loose_percent * F.col("u")).alias("loose")), "compared")
    links = compared.filter("linked").select("a", "b")
    loose = compared.filter("loose").select("a", "b")
    found = _stray_links(sets, links, components(loose), p)
    # Rows of one id with different texts belong together.
    several = apart.groupBy("doc").agg(F.min("first").alias("a"), F.max("first").alias("z")).filter("a < z").select("doc", "a")
    through_id = apart.join(several, "doc").select("a", F.col("first").alias("b"))
    classes = components(links.union(found).union(through_id))
    final = classes.select(F.col("node").alias("first"), "component")
    member = apart.join(final, "first", "left").groupBy("doc").agg(F.min(F.coalesce("component", "first")).alias("component"))
    sized = signed.select(F.col("doc").alias("doc_id"), "n_shingles")
    out = sized.join(member, F.col("doc_id") == F.col("doc"), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """The documents without those that another document of their class stands for; columns stay as they are."""
    (dropped,) = free_names(docs.columns, "_dropped")
    gone = near_classes(docs, p).filter(~F.col("kept")).select(F.col("doc_id").alias(dropped)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(dropped), "left_anti")
