"""Pairs that advance together: against a plain matrix, at the lengths where the method changes."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tests.brute import distance
from voxledger.functions import alignment, bits, bleu
from voxledger.functions import distance as distances

SPACES = (" ", "  ", "\t", "　", "\x1c", "\x85")


def texts(count, lengths, seed):
    rnd = random.Random(seed)
    out = []
    for _ in range(count):
        words = [rnd.choice(rnd.choice(["ab", "abcd", ["é", "xx", *map(str, range(30))]])) for _ in range(rnd.choice(lengths))]
        out.append(None if rnd.random() < 0.05 else rnd.choice(["", " "]) + rnd.choice(SPACES).join(words) + rnd.choice(["", "\n"]))
    return out


def walked(ref, hyp):
    """Counts by the whole matrix: a match first, then a substitution, a deletion, an insertion."""
    cost = np.add.outer(np.arange(len(ref) + 1), np.arange(len(hyp) + 1))
    for i, a in enumerate(ref, 1):
        for j, b in enumerate(hyp, 1):
            cost[i, j] = min(cost[i - 1, j - 1] + (a != b), cost[i - 1, j] + 1, cost[i, j - 1] + 1)
    i, j, subs, dels, ins = len(ref), len(hyp), 0, 0, 0
    while i or j:
        if i and j and cost[i, j] == cost[i - 1, j - 1] + (ref[i - 1] != hyp[j - 1]):
            subs, i, j = subs + (ref[i - 1] != hyp[j - 1]), i - 1, j - 1
        elif i and cost[i, j] == cost[i - 1, j] + 1:
            dels, i = dels + 1, i - 1
        else:
            ins, j = ins + 1, j - 1
    return [subs, dels, ins]


def split(text):
    return (text or "").split()


def test_word_edits_of_all_lengths():
    refs, *hyps = (texts(250, [0, 1, 2, 7, 20, 63, 64, 65, 66, 127, 128, 129], s) for s in (1, 2, 3))
    n, edits = distances.word_edits(pa.array(refs), [pa.array(h) for h in hyps])
    assert n.tolist() == [len(split(r)) for r in refs]
    for k, column in enumerate(hyps):
        assert edits[k].tolist() == [distance(split(r), split(h)) for r, h in zip(refs, column)]


def test_usual_pairs_are_not_scored_one_by_one(monkeypatch):
    def one_by_one(*_):
        raise AssertionError("a pair of its own")

    monkeypatch.setattr(distances, "Reference", one_by_one)
    monkeypatch.setattr(alignment, "Reference", one_by_one)
    monkeypatch.setattr(alignment, "align_counts", one_by_one)
    refs, hyps = (pa.array(texts(40, [1, 9, 64], s)) for s in (4, 5))
    assert len(distances.word_edits(refs, [hyps, hyps])[1]) == 2
    assert len(alignment.align_arrays(refs, hyps)[0]) == 40


@pytest.mark.parametrize("diagonal", [256, 0])
def test_alignments_of_all_lengths(monkeypatch, diagonal):
    """Without diagonals, every pair beyond the usual length goes through long integers."""
    monkeypatch.setattr(alignment, "_DIAGONAL", diagonal)
    refs, hyps = (texts(150, [0, 1, 2, 7, 20, 63, 64, 65, 128, 129], s) for s in (6, 7))
    counts, n = alignment.align_arrays(pa.array(refs), pa.array(hyps))
    assert counts.tolist() == [walked(split(r), split(h)) for r, h in zip(refs, hyps)]
    assert n.tolist() == [len(split(r)) for r in refs]


def test_a_long_alignment_holds_few_columns():
    """A matrix of 6,000 by 6,000 words fits in the root of its columns; diagonals took a minute."""
    import time
    import tracemalloc

    rnd = random.Random(8)
    ref = [rnd.randrange(500) for _ in range(6_000)]
    hyp = [w for w in ref if rnd.random() > 0.1]
    began = time.process_time()
    tracemalloc.start()
    got = alignment.align_arrays(pa.array([" ".join(map(str, ref))]), pa.array([" ".join(map(str, hyp))]))[0]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.tolist() == [[0, len(ref) - len(hyp), 0]]
    assert most < 20e6 and time.process_time() - began < 10


def test_a_text_that_comes_again_is_split_once():
    ref, hyps = pa.array(["a b c"] * 4 + [None, " "]), pa.array(["a b c", "a c", "", None, "x", None])
    words = bits.Words(ref, hyps)
    assert len(words.codes) == 6 and words.lengths.tolist() == [[3, 3, 3, 3, 0, 0], [3, 2, 0, 0, 1, 0]]
    assert distances.word_edits(ref, [hyps])[1].tolist() == [[0, 1, 3, 3, 1, 0]]
    empty = pa.array([], pa.string())
    assert distances.word_edits(empty, [empty])[1].tolist() == [[]] and len(alignment.align_arrays(empty, empty)[0]) == 0
    assert distances.word_edits(pa.array([None], pa.string()), [pa.array([None], pa.string())])[1].tolist() == [[0]]


def test_slices_hold_all_rows():
    a, b = pa.array(["x" * 900_000, None, "y", "z" * 3_000_000, None]), pa.array([None, "x" * 1_500_000, "", "", None])
    assert list(bits.slices(a, b)) == [(0, 1), (1, 2), (3, 1), (4, 1)]
    assert list(bits.slices(pa.array([], pa.string()))) == []


def test_13a_tokens_beside_points_and_commas(spark):
    rnd = random.Random(9)
    made = ["".join(rnd.choice(a) for _ in range(rnd.randrange(14))) for a in (".,5a -", "12.,-a ", "a. b,5-&é٣") for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(made)], "i int, t string")
    expected = [r.w for r in df.orderBy("i").select(bleu.tokenize_13a("t").alias("w")).collect()]
    assert bleu.tokens_13a(made) == expected


def test_plain_texts_need_no_class_of_the_13a_rules(monkeypatch):
    class Never:
        def sub(self, *_):
            raise AssertionError("a pass over all characters")

    monkeypatch.setattr(bleu, "_CLASSES", [(Never(), "")] * 4)
    assert bleu.tokens_13a(["Hello, World 3.5 (x)."]) == [["Hello", ",", "World", "3.5", "(", "x", ")", "."]]
