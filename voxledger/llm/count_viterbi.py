"""Token counts under a unigram vocabulary, without making the tokens.

An Aho-Corasick automaton gives, for every end position, all vocabulary entries that end there,
longest first. A dynamic program carries the best score and, beside it, the number of pieces. Ties go
to the candidate met first, that is to the longest last piece, as in the tokenizer. A
character that is no entry costs the least score less 10 and counts its UTF-8 bytes (byte fallback).

Texts are prepared as the tokenizer does it: blanks become U+2581, one is put in front unless there
is one, and every U+2581 begins a word. Words are scored one by one, each distinct word once by
a worker as long as its table holds it. Scores are added as doubles in the same order as the tokenizer.

Null and empty texts count 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxledger.llm.bytetext import slices
from voxledger.llm.units import Memo, per_worker

BLANK = "▁"
UNKNOWN_PENALTY = 10.0  # of the tokenizer


def vocabulary(model_file: str) -> list[tuple[str, float]]:
    """Pieces and scores of a SentencePiece model file, in the order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    def __init__(self, entries: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in entries:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {piece for piece, _ in entries if len(piece) == 1}
        self.unknown = min(score for _, score in entries) - UNKNOWN_PENALTY
        self.words = Memo(self.count_word, 96_000_000)

    def count_word(self, word: str) -> int:
        best: list[float | None] = [0.0] + [None] * len(word)
        count = [0] * (len(word) + 1)
        matches = iter(self.automaton.iter(word))
        last, match = next(matches, (len(word), None))
        for at, c in enumerate(word):
            top, n = None, 0
            while last == at:
                size, score = match
                before = best[at + 1 - size]
                if before is not None and (top is None or before + score > top):
                    top, n = before + score, count[at + 1 - size] + 1
                last, match = next(matches, (len(word), None))
            if c not in self.single:
                weight = best[at] + self.unknown
                if top is None or weight > top:
                    top, n = weight, count[at] + len(c.encode())
            best[at + 1], count[at + 1] = top, n
        return count[-1]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = text.replace(" ", BLANK)
        if text[0] != BLANK:
            text = BLANK + text
        return sum(map(self.words.__getitem__, WORD.findall(text)))


WORD = re.compile(f"{BLANK}[^{BLANK}]*")


def token_counts(docs: DataFrame, entries: list[tuple[str, float]]) -> DataFrame:
    """(doc_id, n_tokens) of every whole text."""
    # A vocabulary: its size does not follow the data.
    shared = docs.sparkSession.sparkContext.broadcast(entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = per_worker(("unigram", hash(tuple(shared.value))), lambda: Counter(shared.value))
        for batch in batches:
            for at, column in slices(batch.column("text")):
                yield pa.record_batch([batch.column("doc_id").slice(at, len(column)), pa.array([counter.count(t) for t in column.to_pylist()], pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long")
