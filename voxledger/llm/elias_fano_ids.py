"""Token ids as binary shards with Elias-Fano document boundaries.

A shard file holds one concatenated id array and two monotone sequences, the documents' ids and the
offsets of their boundaries, as Elias-Fano codes: the low bits of every value packed, the high bits in
unary. A sequence of n values up to u takes about n * (2 + log2(u / n)) bits, and a sparse table of
select samples (one in 64 values) finds any value without reading the others; there is no table of
64-bit offsets.

File layout, little-endian: ids (16 bits each where the vocabulary allows, else 32), boundary code,
document-id code, then a footer of JSON with the sizes, its length as 32 bits, and the magic bytes.

Writing is a range sort by document id; every task streams its range into files of bounded size,
writes under a temporary name and renames, so a repeated task replaces its own files. Ids are encoded by
distinct word: no token of the tokenizer goes over ASCII white space, which its own pattern
drops.

A null text is empty and holds only the end id. Null document ids come last. Equal ids follow each other
in order of a hash of their texts. An empty table writes no file.
"""

from __future__ import annotations

import array
import json
import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxledger.llm.bytetext import buffer, slices
from voxledger.llm.tables import stored
from voxledger.llm.units import Memo, per_worker
from voxledger.session import scratch_path

MAGIC = b"EFIDS001"
SAMPLE = 64
IDS_A_FILE = 1 << 27
DOCS_A_FILE = 1 << 20
SLICE_BYTES = 8_000_000  # of text whose words are coded together; more of them are equal than in a megabyte
BLOCK = 1 << 14  # values that are coded or read at once; a multiple of eight


@dataclass
class EliasFano:
    """A non-decreasing sequence of non-negative integers."""

    n: int
    low_bits: int
    low: np.ndarray  # packed bits
    high: np.ndarray  # packed unary bits
    samples: np.ndarray  # bit position of every SAMPLE-th one

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        shifts = np.arange(low_bits)
        low = [np.packbits(((values[at : at + BLOCK, None] >> shifts) & 1).astype(np.uint8), bitorder="little") for at in range(0, n, BLOCK)]
        ones = (values >> low_bits) + np.arange(n)
        high = np.zeros(int(ones[-1]) // 8 + 1 if n else 0, np.uint8)
        np.bitwise_or.at(high, ones >> 3, np.left_shift(1, ones & 7).astype(np.uint8))
        return cls(n, low_bits, np.concatenate([np.zeros(0, np.uint8), *low]), high, ones[::SAMPLE].astype(np.uint32))

    def block(self, first: int, last: int) -> np.ndarray:
        """Values first..last-1: high bits from the select sample before them to the one after, low bits by their place."""
        if first >= last:
            return np.zeros(0, np.int64)
        sample, after = first // SAMPLE, -(-last // SAMPLE)
        start = int(self.samples[sample])
        stop = int(self.samples[after]) if after < len(self.samples) else 8 * len(self.high)
        byte = start // 8
        ones = np.flatnonzero(np.unpackbits(self.high[byte : (stop + 7) // 8], bitorder="little")) + 8 * byte
        ones = ones[ones >= start][first - sample * SAMPLE :][: last - first]
        bit, size = first * self.low_bits, (last - first) * self.low_bits
        bits = np.unpackbits(self.low[bit // 8 : (bit + size + 7) // 8], bitorder="little")[bit % 8 : bit % 8 + size]
        low = bits.reshape(last - first, self.low_bits).astype(np.int64) << np.arange(self.low_bits)
        return ((ones - np.arange(first, last)) << self.low_bits) + low.sum(axis=1)

    def get(self, i: int) -> int:
        return int(self.block(i, i + 1)[0])

    def pack(self) -> tuple[bytes, list[int]]:
        parts = [self.low.tobytes(), self.high.tobytes(), self.samples.astype("<u4").tobytes()]
        return b"".join(parts), [self.n, self.low_bits, *map(len, parts)]

    @classmethod
    def unpack(cls, data: bytes, shape: list[int]) -> EliasFano:
        n, low_bits, a, b, c = shape
        return cls(n, low_bits, np.frombuffer(data, np.uint8, a), np.frombuffer(data, np.uint8, b, a), np.frombuffer(data, "<u4", c // 4, a + b))


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a path as Spark names it; Arrow knows Hadoop's schemes of S3 as ``s3``."""
    return pafs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


class ShardWriter:
    """One file; ids go out as they come, boundaries and document ids are kept as plain numbers until the end."""

    def __init__(self, folder: str, name: str, id_bytes: int):
        self.fs, root = file_system(folder)
        self.fs.create_dir(root, recursive=True)
        self.final, self.temporary = f"{root}/{name}", f"{root}/_{name}-{uuid.uuid4().hex}"
        self.path = f"{folder}/{name}"
        self.file = self.fs.open_output_stream(self.temporary)
        self.id_bytes, self.bounds, self.docs, self.nulls, self.size = id_bytes, array.array("q", [0]), array.array("q"), 0, 0

    def add(self, doc: int | None, ids: bytes) -> None:
        self.file.write(ids)
        self.size += len(ids) // self.id_bytes
        self.bounds.append(self.size)
        if doc is None:
            self.nulls += 1
        else:
            self.docs.append(doc)

    def close(self) -> tuple[str, int, int]:
        bounds, b_shape = EliasFano.of(np.frombuffer(self.bounds, np.int64)).pack()
        base = self.docs[0] if self.docs else 0
        docs, d_shape = EliasFano.of(np.array(self.docs, np.int64) - base).pack()
        self.file.write(bounds)
        self.file.write(docs)
        foot = json.dumps({"id_bytes": self.id_bytes, "n_ids": self.size, "bounds": b_shape, "docs": d_shape, "base": base, "nulls": self.nulls}).encode()
        self.file.write(foot + len(foot).to_bytes(4, "little") + MAGIC)
        self.file.close()
        self.fs.move(self.temporary, self.final)
        return self.path, len(self.bounds) - 1, self.size


class Shard:
    """Random and streamed access to a file."""

    def __init__(self, path: str):
        fs, inner = file_system(path)
        self.file = fs.open_input_file(inner)
        size = self.file.size()
        self.file.seek(size - 12)
        tail = self.file.read(12)
        if tail[4:] != MAGIC:
            raise ValueError(f"{path} is no shard file")
        length = int.from_bytes(tail[:4], "little")
        self.file.seek(size - 12 - length)
        foot = json.loads(self.file.read(length))
        self.id_bytes, self.n_ids, self.base, self.nulls = foot["id_bytes"], foot["n_ids"], foot["base"], foot["nulls"]
        self.file.seek(self.n_ids * self.id_bytes)
        self.bounds = EliasFano.unpack(self.file.read(sum(foot["bounds"][2:])), foot["bounds"])
        self.docs = EliasFano.unpack(self.file.read(sum(foot["docs"][2:])), foot["docs"])

    def __len__(self) -> int:
        return self.bounds.n - 1

    def ids(self, first: int, last: int) -> np.ndarray:
        self.file.seek(first * self.id_bytes)
        return np.frombuffer(self.file.read((last - first) * self.id_bytes), f"<u{self.id_bytes}")

    def doc_ids(self, first: int, last: int) -> pa.Array:
        known = min(max(first, self.docs.n), last)
        return pa.concat_arrays([pa.array(self.docs.block(first, known) + self.base), pa.nulls(last - known, pa.int64())])

    def document(self, i: int) -> np.ndarray:
        return self.ids(self.bounds.get(i), self.bounds.get(i + 1))


#: Latin-1 letters, then ASCII marks and digits without the apostrophe: the tokenizer's pattern parts the two.
_SIMPLE = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-&(-@\[-`{-~]*)$"
_SMALL = re.compile("[a-zß-öø-ÿ]+")


class WordEncoder:
    """Ids of texts by their distinct words, as bytes of the file's id type.

    Arrow splits the texts of a slice, keeps each word once, and puts the ids of all words together. A simple
    word is its letters, small, and the marks after them; each part is made once, however the words around it
    differ. Small letters go to the tokenizer's model at once, in its byte alphabet. All others go through the
    whole tokenizer.
    """

    def __init__(self, tokenizer: str, id_bytes: int, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.kind = Tokenizer.from_str(tokenizer), "H" if id_bytes == 2 else "I"
        self.tokenize = self.tokenizer.model.tokenize
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        latin = [chr(c) for c in range(0xDF, 0x100)]
        self.alphabet = str.maketrans({c: level.pre_tokenize_str(c)[0][0] for c in latin})
        self.end = self._bytes([end_id])
        self.made = Memo(self._part, 120_000_000)

    def _bytes(self, ids: list[int]) -> bytes:
        return array.array(self.kind, ids).tobytes()

    def _part(self, text: str) -> bytes:
        if not _SMALL.fullmatch(text):
            return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)
        letters = text if text.isascii() else text.translate(self.alphabet)
        return self._bytes([t.id for t in self.tokenize(letters)])

    def _each(self, parts: pa.Array) -> pa.Array:
        """Ids of each part; null has null."""
        coded = parts.dictionary_encode()
        made = map(self.made.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False))
        return pa.array(list(made), pa.large_binary()).take(coded.indices)

    def _words(self, words: pa.Array) -> pa.Array:
        """Ids of each word; the words are distinct."""
        parts = pc.extract_regex(words, _SIMPLE)
        letters, marks = pc.utf8_lower(pc.struct_field(parts, "letters")), pc.struct_field(parts, "marks")
        simple = pc.binary_join_element_wise(self._each(letters), self._each(marks), pa.scalar(b"", pa.large_binary()))
        whole = self._each(pc.if_else(parts.is_null(), words, pa.scalar(None, words.type)))
        return pc.coalesce(simple, whole)

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text and the end id; null is empty."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = split.flatten().dictionary_encode()
        data, at = buffer(self._words(words.dictionary).take(words.indices))
        cuts = at[split.offsets.to_numpy()].tolist()
        return (data[a:b].tobytes() + self.end for a, b in pairwise(cuts))


def write_shards(docs: DataFrame, tokenizer_file: str, end_id: int, folder: str, ids_a_file: int = IDS_A_FILE, docs_a_file: int = DOCS_A_FILE) -> DataFrame:
    """Write all documents in ascending order of doc_id; gives (shard, part, path, n_docs, n_ids), a row a file."""
    with open(tokenizer_file) as f:  # a file of the program, below two megabytes
        tokenizer = docs.sparkSession.sparkContext.broadcast(f.read())
    from tokenizers import Tokenizer

    id_bytes = 2 if max(Tokenizer.from_file(tokenizer_file).get_vocab_size() - 1, end_id) < 1 << 16 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder: WordEncoder = per_worker(("ids", tokenizer_file, end_id), lambda: WordEncoder(tokenizer.value, id_bytes, end_id))
        shard, part, writer, done = TaskContext.get().partitionId(), 0, None, []
        for batch in batches:
            for at, column in slices(batch.column("text"), SLICE_BYTES):
                for doc, ids in zip(batch.column("doc_id").slice(at, len(column)).to_pylist(), coder.encode(column), strict=True):
                    if writer is None:
                        writer = ShardWriter(folder, f"ids-{shard:06d}-{part:04d}.efi", id_bytes)
                    writer.add(doc, ids)
                    if writer.size >= ids_a_file or len(writer.bounds) > docs_a_file:
                        done.append((shard, part, *writer.close()))
                        writer, part = None, part + 1
        if writer is not None:
            done.append((shard, part, *writer.close()))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["shard", "part", "path", "n_docs", "n_ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    order = F.col("doc_id").asc_nulls_last(), F.col("tie")
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(ranged.select("doc_id", "text").mapInArrow(run, "shard long, part long, path string, n_docs long, n_ids long"), "shards")


def read_shards(shards: DataFrame, each: Callable[[np.ndarray], int], column: str) -> DataFrame:
    """(doc_id, start, n_tokens, <column>) of every document, read from the files.

    ``start`` counts the ids of all documents before it; ``each`` makes an integer of a document's ids.
    """
    # One row a file.
    placed = shards.withColumn("start", F.sum("n_ids").over(Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)))
    placed = placed.select("path", F.coalesce("start", F.lit(0)).alias("start"))
    tasks = max(1, shards.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                shard = Shard(path)
                at = 0
                while at < len(shard):
                    bounds = shard.bounds.block(at, min(at + BLOCK, len(shard)) + 1)
                    n = max(1, int(np.searchsorted(bounds, bounds[0] + 2_000_000, side="right")) - 1)
                    cuts = bounds[: n + 1] - bounds[0]
                    ids = shard.ids(bounds[0], bounds[n])
                    values = [each(ids[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                    yield pa.record_batch([shard.doc_ids(at, at + n), pa.array(bounds[:n] + start), pa.array(np.diff(cuts)), pa.array(values, pa.int64())], names=["doc_id", "start", "n_tokens", column])
                    at += n

    return placed.repartitionByRange(tasks, "path").mapInArrow(run, f"doc_id long, start long, n_tokens long, {column} long")


def ids_crc32(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def encode_and_read(docs: DataFrame, tokenizer_file: str, end_id: int) -> DataFrame:
    folder = scratch_path(docs.sparkSession, "ids")
    return read_shards(write_shards(docs, tokenizer_file, end_id, folder), ids_crc32, "ids_crc32")
