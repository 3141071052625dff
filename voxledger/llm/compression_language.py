"""Language identification by compression: the language whose dictionary makes a text smallest.

For each language a bounded sample of its texts becomes a raw-content zstandard dictionary: at most
``texts`` different texts (in order of a hash of the text, so copies count once, and no source or id has a
say), of each one stretch of ``stretch`` characters from a place that the hash picks. A text is put in small
letters, its whole length is cut into blocks of ``block`` bytes, and every block is encoded with every dictionary
by itself; the language with the smallest sum of sizes is the prediction. Blocks keep a long text from
becoming its own dictionary, and memory does not follow the length of texts.

Languages that give equally small sizes: the one with more rows to learn from, then the first in alphabetical order
(very short texts are stored as they are, in the same size for all).
The margin is the share of bytes that the best language saves against the next one. Below ``least_margin`` the
prediction is not ``accepted``; it is still reported. The score is the weight of the best language when each
surplus byte costs a factor of e^(1/``softness``); with one learned language it is 1.

Defined results: a null text, or one without any letter, is ``und`` with score 0 and not accepted; so is every
text if nothing could be learned. Rows with a null language, a null id or the held-out remainder teach
nothing; null ids count as not held out. Rows with equal ids or texts are rows of their own. Only
doc_id, text and lang are read; further columns may have any name. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxledger.llm.bytetext import slices

UNDETERMINED = "und"
LETTER = r"\p{L}"


@dataclass(frozen=True)
class Parameters:
    texts: int = 128  # different texts a language that may go into its dictionary
    stretch: int = 1_024  # characters of each
    dictionary: int = 65_536  # bytes of a dictionary
    block: int = 2_048  # bytes that are encoded at a time
    level: int = 5
    least_margin: float = 0.01
    softness: float = 2.0  # bytes


@dataclass(frozen=True)
class Model:
    """Languages with their dictionaries, in the order that settles ties."""

    languages: tuple[str, ...]
    dictionaries: tuple[bytes, ...]


def unseen(doc_id: Column) -> Column:
    """Rows that the model must not learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def learnable(docs: DataFrame) -> DataFrame:
    """Rows with an id that is not held out, a language, and a letter in the text."""
    return docs.filter("lang is not null and doc_id is not null").filter(~unseen(F.col("doc_id")) & F.col("text").rlike(LETTER))


def samples(docs: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """(lang, h, piece): at most ``texts`` rows a language, those of the smallest hashes of different texts.

    Each task keeps the smallest hashes of what it reads, so a shuffle moves a bounded number of rows a task.
    """
    h = F.xxhash64("text")
    start = F.pmod(h, F.greatest(F.char_length("text") - p.stretch, F.lit(0)) + 1) + 1
    rows = learnable(docs).select("lang", h.alias("h"), F.lower(F.substr("text", start.cast("int"), F.lit(p.stretch))).alias("piece"))

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, dict[int, str]] = {}
        heaps: dict[str, list[int]] = {}
        for batch in batches:
            for lang, own_h, piece in zip(*(batch.column(k).to_pylist() for k in ("lang", "h", "piece")), strict=True):
                own, heap = kept.setdefault(lang, {}), heaps.setdefault(lang, [])
                if own_h in own:
                    own[own_h] = min(own[own_h], piece)
                elif len(heap) < p.texts:
                    own[own_h] = piece
                    heapq.heappush(heap, -own_h)
                elif own_h < -heap[0]:
                    own[own_h] = piece
                    del own[-heapq.heapreplace(heap, -own_h)]
        for lang, own in kept.items():
            yield pa.record_batch([pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.string())], names=["lang", "h", "piece"])

    few = rows.mapInArrow(smallest, "lang string, h long, piece string")
    return few.groupBy("lang", "h").agg(F.min("piece").alias("piece"))


def fit(docs: DataFrame, p: Parameters = Parameters()) -> Model:
    """Dictionaries of all languages that have a text to learn from.

    At most ``texts`` stretches a language come to the driver; their number grows with that of languages only.
    """
    # The rank limit is applied before the shuffle as well.
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "piece"))
    few = samples(docs, p).withColumn("rank", rank).filter(F.col("rank") <= p.texts)
    counts = {r["lang"]: r["count"] for r in learnable(docs).groupBy("lang").count().collect()}
    pieces: dict[str, list[bytes]] = {}
    for row in sorted(few.collect(), key=lambda r: (r["lang"], r["rank"])):
        pieces.setdefault(row["lang"], []).append(row["piece"].encode("utf-8", "replace"))
    found = []
    for lang, own in pieces.items():
        ends = list(accumulate(len(x) + 1 for x in own))
        enough = sum(end < p.dictionary for end in ends) + 1
        found.append((counts[lang], lang, b"\n".join(own[:enough])[-p.dictionary :]))
    found.sort(key=lambda x: (-x[0], x[1]))
    return Model(tuple(x[1] for x in found), tuple(x[2] for x in found))


def _coders(model: Model, p: Parameters) -> list[zstandard.ZstdCompressor]:
    out = []
    for raw in model.dictionaries:
        own = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own.precompute_compress(level=p.level)
        out.append(zstandard.ZstdCompressor(dict_data=own, level=p.level, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def sizes(text: str, coders: list[zstandard.ZstdCompressor], p: Parameters) -> list[int]:
    """Encoded bytes of the whole text for each dictionary."""
    data = text.lower().encode("utf-8", "replace")
    blocks = [data[i : i + p.block] for i in range(0, len(data), p.block)]
    return [sum(len(coder.compress(block)) for block in blocks) for coder in coders]


def choose(found: list[int], p: Parameters) -> tuple[int, float, float]:
    """Place of the smallest size, score and margin."""
    best = min(range(len(found)), key=lambda k: (found[k], k))
    score = 1 / sum(math.exp((found[best] - x) / p.softness) for x in found)
    rest = found[:best] + found[best + 1 :]
    margin = 1 - found[best] / min(rest) if rest else 1.0
    return best, score, margin


def predict(docs: DataFrame, model: Model, p: Parameters = Parameters()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, margin, accepted) of every row, from the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x 64 KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        coders = _coders(own, p)
        for batch in batches:
            for at, column in slices(batch.column("text")):
                lang, score, margin = [], [], []
                for text in column.to_pylist():
                    if not own.languages or text is None or not any(map(str.isalpha, text)):
                        found = (UNDETERMINED, 0.0, 0.0)
                    else:
                        best, x, m = choose(sizes(text, coders, p), p)
                        found = (own.languages[best], x, m)
                    for to, value in zip((lang, score, margin), found, strict=True):
                        to.append(value)
                out = [batch.column(k).slice(at, len(column)) for k in ("doc_id", "held_out")]
                yield pa.record_batch([*out, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score", "margin"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), unseen(F.col("doc_id")).alias("held_out"), "text")
    told = rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, margin double")
    return told.withColumn("accepted", (F.col("lang_pred") != UNDETERMINED) & (F.col("margin") >= p.least_margin))
