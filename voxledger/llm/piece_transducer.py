"""SentencePiece encoding and decoding with weighted transducers over the tropical semiring.

Three machines are compiled from a model file:

* the normaliser, which prepends the dummy blank and writes every blank as U+2581;
* the pieces, a deterministic trie whose final states emit piece ids, with one arc for every code
  point that is no piece: byte fallback;
* the grammar of neighbouring pieces. For a unigram model it is one state and a piece weighs minus
  its score. For a byte-pair model it has a state for each piece, and going from one piece to
  the next weighs 0 if merging the two strings gives just these two pieces, else infinity. A
  segmentation is what the merges give if and only if all its neighbours are such pairs, so the
  shortest path is the only path of finite weight. Arcs of this machine are made when first met.

An input is composed with them on the fly, and the shortest path is relaxed from left to right. For a
byte-pair model one state at a position is enough: the first pieces of an encoding are the
encoding of the text they spell. No piece goes over a boundary between another character and a blank,
so texts are cut there, and the path of every distinct stretch is found once by a worker.

Null and empty texts have no pieces. Decoding undoes both steps; bytes that are no UTF-8 become
U+FFFD one by one.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxledger.llm.bytetext import slices
from voxledger.llm.units import Memo, per_worker

BLANK = "▁"
INFINITE = float("inf")
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6

codecs.register_error("sentencepiece_bytes", lambda e: ("�" * (e.end - e.start), e.end))


class PieceTransducer:
    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only normalisers that keep all characters and escape blanks are compiled")
        if any(p.type == USER for p in proto.pieces) or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("models with user-defined symbols or blanks as suffixes are not compiled")
        self.pairs = proto.trainer_spec.model_type == 2
        self.dummy = BLANK if norm.add_dummy_prefix else ""
        self.score = [p.score for p in proto.pieces]
        self.pieces = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.text = [p.piece if p.type == NORMAL else "" for p in proto.pieces]
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN)
        self.unknown_score = min(p.score for p in proto.pieces if p.type == NORMAL) - 10
        if any(BLANK in p.lstrip(BLANK) for p in self.pieces):
            raise ValueError("a piece goes over a word boundary")
        self.cut = self._stretches()
        self.trie: dict = {}
        for piece, i in self.pieces.items():
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[None] = i
        self.arc = Memo(self._arc)
        self.surface = [p.piece.replace(BLANK, " ").encode() if p.type == NORMAL else b"" for p in proto.pieces]
        for value, i in self.bytes.items():
            self.surface[i] = bytes([value])
        self.surface[self.unknown] = proto.trainer_spec.unk_surface.encode()
        self.paths = Memo(self.path, 112_000_000)

    def _stretches(self) -> re.Pattern:
        """Stretches that no piece goes over: at blanks, at newlines and at word characters where the pieces allow it."""
        inner = [(a, b) for p in self.pieces for a, b in zip(p, p[1:], strict=False)]
        lone = "" if any("\n" in p for p in self.pieces) else "\n"
        marks = r"!-/:-@\[-^`{-~"  # ASCII punctuation without the underscore
        word, mark = re.compile(r"[^\W_]"), re.compile(f"[{marks}]")
        # Characters that a piece joins with punctuation count as neither.
        joined = {a if mark.match(b) else b for a, b in inner if word.match(a) and mark.match(b) or mark.match(a) and word.match(b)}
        letters = rf"[^\W_{re.escape(''.join(sorted(joined)))}]"
        stop = f"{BLANK}{lone}"
        parts = [
            rf"{BLANK}*+{letters}++(?=[{marks}{stop}]|\Z)",
            rf"{BLANK}*+[{marks}]++(?={letters}|[{stop}]|\Z)",
            f"{BLANK}*+[^{stop}]++",
        ]
        return re.compile("|".join([*parts, f"{BLANK}+", *([lone] if lone else [])]))

    def _merged(self, text: str) -> list[str]:
        """Pieces of a short string by its merges; used only to weigh arcs between neighbours."""
        parts = list(text)
        while True:
            best = None
            for k in range(len(parts) - 1):
                i = self.pieces.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best[0]):
                    best = self.score[i], k
            if best is None:
                return parts
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def _arc(self, pair: int) -> float:
        """Weight of going from one piece to the next, packed in one number; 0 stands for the start."""
        before, i = pair >> 20, pair & 0xFFFFF
        both = ([self.text[before - 1]] if before else []) + [self.text[i]]
        return 0.0 if self._merged("".join(both)) == both else INFINITE

    def best(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, id) of the pieces on the shortest path of a stretch; id -1: a code point without a piece."""
        n = len(text)
        cost = [INFINITE] * (n + 1)
        cost[0] = 0.0
        last, came = [-1] * (n + 1), [0] * (n + 1)
        arc, trie, pairs, score = self.arc, self.trie, self.pairs, self.score
        for start in range(n):
            here = cost[start]
            if here == INFINITE:
                continue
            node, at = trie, start
            state = (last[start] + 1) << 20  # nothing merges with a code point that is no piece
            while at < n:
                node = node.get(text[at])
                if node is None:
                    break
                at += 1
                i = node.get(None)
                if i is not None:
                    weight = here + (arc[state | i] if pairs else -score[i])
                    if weight < cost[at]:
                        cost[at], last[at], came[at] = weight, i, start
            if text[start] not in self.pieces:
                weight = here + (0.0 if pairs else -self.unknown_score)
                if weight < cost[start + 1]:
                    cost[start + 1], last[start + 1], came[start + 1] = weight, -1, start
        out = []
        while n:
            out.append((came[n], n, last[n]))
            n = came[n]
        return out[::-1]

    def path(self, text: str) -> bytes:
        """Ids of a stretch as little-endian 32-bit integers."""
        ids: list[int] = []
        unknown = False
        for start, end, i in self.best(text):
            if i >= 0:
                ids.append(i)
            elif self.bytes:
                ids.extend(self.bytes[b] for b in text[start:end].encode())
            elif not unknown:
                ids.append(self.unknown)
            unknown = i < 0
        return np.array(ids, "<i4").tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        return b"".join(map(self.paths.__getitem__, self.cut.findall(self.dummy + text.replace(" ", BLANK))))

    def decode(self, ids: np.ndarray) -> str:
        out = b"".join(map(self.surface.__getitem__, ids.tolist())).decode("utf-8", "sentencepiece_bytes")
        return out[1:] if self.dummy and len(ids) and self.text[ids[0]].startswith(BLANK) else out


def encode(docs: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, ids, decoded): piece ids of every whole text, and the text that they decode to."""

    def rows(machine: PieceTransducer, part: pa.RecordBatch) -> list[pa.Array]:
        coded = [machine.encode(t) for t in part.column("text").to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded])])
        ids = np.frombuffer(b"".join(coded), "<i4")
        decoded = [machine.decode(ids[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())), pa.array(decoded, pa.string())]

    return _mapped(docs, model_file, rows, {"ids": "array<int>", "decoded": "string"})


def digests(docs: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, decoded_sha256, round_trip): what :func:`encode` gives, in few bytes.

    The checksum is over the ids as little-endian 32-bit integers; a null text counts as empty.
    """

    def rows(machine: PieceTransducer, part: pa.RecordBatch) -> list[pa.Array]:
        texts = [t or "" for t in part.column("text").to_pylist()]
        coded = [machine.encode(t) for t in texts]
        decoded = [machine.decode(np.frombuffer(c, "<i4")) for c in coded]
        return [
            pa.array([len(c) // 4 for c in coded], pa.int64()),
            pa.array([zlib.crc32(c) for c in coded], pa.int64()),
            pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string()),
            pa.array([d == t for d, t in zip(decoded, texts, strict=True)], pa.bool_()),
        ]

    return _mapped(docs, model_file, rows, {"n_pieces": "long", "ids_crc32": "long", "decoded_sha256": "string", "round_trip": "boolean"})


def _mapped(docs: DataFrame, model_file: str, rows: Callable[[PieceTransducer, pa.RecordBatch], list[pa.Array]], columns: dict[str, str]) -> DataFrame:
    with open(model_file, "rb") as f:  # a file of the program, below a megabyte
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = per_worker(("pieces", model_file), lambda: PieceTransducer(model.value))
        for batch in batches:
            for at, column in slices(batch.column("text")):
                part = batch.slice(at, len(column))
                yield pa.record_batch([part.column("doc_id"), *rows(machine, part)], names=["doc_id", *columns])

    schema = ", ".join(["doc_id long", *(f"{k} {v}" for k, v in columns.items())])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
