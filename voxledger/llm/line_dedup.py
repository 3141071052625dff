"""Line de-duplication over a whole table: later copies of a line go, the first document keeps it.

Lines are hashed once (128 bits), spread by range of (hash, document) and sorted by hash, document
and position inside each range. A stream over a range knows the first document of every hash it
meets. A very common line covers several whole ranges; only its first range sees the true first
document, so a range reports the owner of its first and last run, and rows of the first run
are settled by one small join. The result is a compressed keep bitmap for each document that loses
lines; texts are touched again only where somebody applies it.

Rules: a line's key is the line without blanks at both ends, with A-Z in lower case. Keys shorter
than ``min_chars`` code points never count. Rows of one id are one document. A null or
empty text is one empty line; very long texts are cut like others. Null ids count as one document that comes after all
others. Rows that repeat an id are one document: none of them loses a line to another. Other columns may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxledger.llm.tables import BLANKS, LOWER, UPPER, free_names, stored

MIN_CHARS = 10

DROPPED, OWNER, OPEN = 0, 1, 2


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def keyed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, mark, pos, h1, h2) of every line whose key is long enough; mark tells texts of one id apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = docs.select(
        F.col("doc_id").alias("doc"), F.xxhash64(text).alias("mark"), F.posexplode(F.split(text, "\n")).alias("pos", "line")
    )
    key = line_key(F.col("line"))
    keys = lines.select("doc", "mark", "pos", key.alias("key")).filter(F.char_length("key") >= min_chars)
    return keys.select("doc", "mark", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(17), "key").alias("h2"))


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sorted range: rows that lose their line, the owners of its end runs, and the open first run."""
    first_run = last_run = None  # (h1, h2, owner)
    schema = pa.schema([("kind", pa.int32()), ("doc", pa.int64()), ("mark", pa.int64()), ("pos", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("owner", pa.int64())])

    def out(kind, doc, mark, pos, h1, h2, owner):
        return pa.record_batch([pa.array(np.asarray(x), type=f.type) for x, f in zip((np.full(len(doc), kind), doc, mark, pos, h1, h2, owner), schema, strict=True)], schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        doc, mark, pos, h1, h2 = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("doc", "mark", "pos", "h1", "h2"))
        new = np.ones(len(doc), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        carried = last_run is not None and (h1[0], h2[0]) == last_run[:2]
        new[0] = not carried
        run = np.cumsum(new)  # 0: the run that began in an earlier batch
        owners = np.concatenate([[last_run[2] if carried else doc[0]], doc[new]])
        owner = owners[run]
        if first_run is None:
            first_run = (h1[0], h2[0], doc[0])
        opening = (h1 == first_run[0]) & (h2 == first_run[1])
        gone = doc != owner
        if gone.any():
            yield out(DROPPED, doc[gone], mark[gone], pos[gone], h1[gone], h2[gone], owner[gone])
        wait = opening & ~gone
        if wait.any():
            yield out(OPEN, doc[wait], mark[wait], pos[wait], h1[wait], h2[wait], owner[wait])
        last_run = (h1[-1], h2[-1], owner[-1])
    if first_run is not None:
        ends = [first_run] if first_run[:2] == last_run[:2] else [first_run, last_run]
        zero = np.zeros(len(ends), np.int64)
        yield out(OWNER, zero, zero, zero, *(np.array(x, np.int64) for x in zip(*ends, strict=True)))


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, mark, pos) of all lines that go."""
    absent = (1 << 63) - 1
    lines = stored(keyed_lines(docs, min_chars).withColumn("doc", F.coalesce("doc", F.lit(absent))), "lines")
    ranged = lines.repartitionByRange("h1", "h2", "doc").sortWithinPartitions("h1", "h2", "doc", "pos")
    swept = stored(ranged.mapInArrow(_sweep, "kind int, doc long, mark long, pos int, h1 long, h2 long, owner long"), "swept")
    # At most two owner rows a range: the true first document of a run over several ranges.
    owners = swept.filter(F.col("kind") == OWNER).groupBy("h1", "h2").agg(F.min("owner").alias("first_doc"))
    late = swept.filter(F.col("kind") == OPEN).join(owners, ["h1", "h2"]).filter("doc <> first_doc")
    rows = swept.filter(F.col("kind") == DROPPED).select("doc", "mark", "pos").union(late.select("doc", "mark", "pos"))
    return rows.withColumn("doc", F.when(F.col("doc") != absent, F.col("doc")))


def pack(positions: list[int], n_lines: int) -> bytes:
    """A keep bitmap over the lines, most significant bit first, deflated."""
    bits = np.ones(n_lines, np.uint8)
    bits[positions] = 0
    return zlib.compress(np.packbits(bits).tobytes(), 6)


def unpack(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, mark, n_dropped, top, bitmap) of each document that loses lines.

    ``bitmap`` ends at the last dropped line, ``top``; all later lines stay.
    """
    gone = dropped_lines(docs, min_chars).distinct()
    grouped = gone.groupBy("doc", "mark").agg(F.collect_list("pos").alias("at"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("at").to_pylist()
            tops = [max(x) for x in at]
            yield pa.record_batch(
                [batch.column("doc"), batch.column("mark"), pa.array([len(x) for x in at], pa.int64()), pa.array(tops, pa.int32()), pa.array([pack(x, t + 1) for x, t in zip(at, tops, strict=True)], pa.binary())],
                names=["doc", "mark", "n_dropped", "top", "bitmap"],
            )

    return grouped.mapInArrow(packed, "doc long, mark long, n_dropped long, top int, bitmap binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, *, counts: bool = True) -> DataFrame:
    """``docs`` with their texts cut; all other columns stay as they are.

    With ``counts`` there are two more columns, n_lines and n_dropped; where ``docs`` has a column of such a name, the count's
    name gets an underscore at its end. A text that loses no line stays as it is, null included.
    """
    doc, mark, n, top, bitmap, n_lines, n_dropped = free_names(docs.columns, "_doc", "_mark", "_n", "_top", "_bitmap", "n_lines", "n_dropped")
    text = F.coalesce(F.col("text"), F.lit(""))
    small = bitmaps.select(F.col("doc").alias(doc), F.col("mark").alias(mark), F.col("n_dropped").alias(n), F.col("top").alias(top), F.col("bitmap").alias(bitmap))
    joined = docs.join(small, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64(text) == F.col(mark)), "left")

    @F.pandas_udf("string")
    def cut(texts, bitmap, top):
        def one(t, b, n):
            if b is None:
                return t
            lines = t.split("\n")
            keep = unpack(b, n + 1)
            return "\n".join([x for x, k in zip(lines, keep) if k] + lines[n + 1 :])  # noqa: B905

        import pandas as pd

        return pd.Series([one(*x) for x in zip(texts, bitmap, top, strict=True)], dtype=object)

    kept = F.when(F.col(bitmap).isNull(), F.col("text")).otherwise(cut(F.when(F.col(bitmap).isNotNull(), F.col("text")), bitmap, F.coalesce(top, F.lit(0))))
    added = {n_lines: F.array_size(F.split(text, "\n")).cast("long"), n_dropped: F.coalesce(n, F.lit(0)).cast("long")}
    counted = joined.withColumns(added) if counts else joined
    return counted.withColumn("text", kept).drop(doc, mark, n, top, bitmap)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, *, counts: bool = True) -> DataFrame:
    """The documents with all later copies of their lines removed."""
    return apply_bitmaps(docs, keep_bitmaps(docs.select("doc_id", "text"), min_chars), counts=counts)
