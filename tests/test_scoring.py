import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.brute import align, bleu, distance
from voxledger.functions import alignment
from voxledger.functions.bleu import add_bleu_counts, ngram_counts, tokenize_13a, tokens_13a
from voxledger.functions.distance import (
    add_char_edits,
    add_word_edits,
    bit_parallel_distance,
)
from voxledger.operators import scoring

PAIRS = [
    ("a b c", "a b c"),
    ("a b c", "a x c"),
    ("a b c d", "b c d e"),
    ("the cat", "THE cat."),
    ("", "extra words"),
    ("gone away", ""),
    ("a b", "b a"),
    ("x x x y", "x y x x y"),
    (None, "h"),
    ("r", None),
    ("é è", "é è"),
    ("नमस्ते दुनिया ।", "नमस्ते दुनिया"),
]


def frame(spark, pairs=PAIRS):
    return spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, ref string, hyp string")


def random_pairs(n, vocabulary, longest, seed):
    rnd = random.Random(seed)

    def words():
        return " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, longest)))

    return [(words(), words()) for _ in range(n)]


MANY = random_pairs(300, "abcd", 12, 1) + random_pairs(20, [f"w{i}" for i in range(400)], 400, 2)


def test_word_edits_and_split(spark):
    pairs = PAIRS + MANY
    scored = alignment.add_alignment_counts(add_word_edits(frame(spark, pairs), "ref", "hyp", ref_words="n"), "ref", "hyp")
    for r in scored.collect():
        ref, hyp = pairs[r.i]
        if ref is None or hyp is None:
            assert r.edits is None and r.subs is None and r.ref_words is None
            continue
        assert (r.subs, r.dels, r.ins) == align(ref.split(), hyp.split())
        assert r.edits == r.subs + r.dels + r.ins
        assert r.n == r.ref_words == len(ref.split())
        assert r.ref_words - r.dels + r.ins == len(hyp.split())


def test_long_word_pairs(spark):
    words = [f"w{i}" for i in range(3000)]
    ref, hyp = " ".join(words), " ".join(words[1:300] + ["x"] + words[301:])
    got = add_word_edits(frame(spark, [(ref, hyp), ("a b", "a")]), "ref", "hyp").orderBy("i").collect()
    assert [(r.edits, r.ref_words) for r in got] == [(2, 3000), (1, 2)]


def test_lopsided_pairs(spark):
    """200,000 words against none, one and a hundred; more distinct words than there are code points."""
    words = [f"w{i}" for i in range(200_000)]
    many = " ".join(str(i) for i in range(1_200_000))
    pairs = [(" ".join(words), ""), (" ".join(words), "w7"), (" ".join(words), " ".join(words[50:150])), (many, "5 x"), ("", many)]
    got = add_word_edits(frame(spark, pairs), "ref", "hyp").orderBy("i").collect()
    assert [(r.edits, r.ref_words) for r in got] == [(200_000, 200_000), (199_999, 200_000), (199_900, 200_000), (1_199_999, 1_200_000), (1_200_000, 0)]


def test_null_texts_add_nothing(spark):
    pairs = [("a b", None), ("c d", "c x"), (None, "y")]
    df = frame(spark, pairs).withColumn("ids", F.array(F.lit(1), F.lit(0), F.lit(2)))
    for ansi in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        try:
            assert scoring.wer_normalized(df, "ref", "hyp").first().wer_pooled == 0.5
            record = scoring.evaluation_record(df, "ref", "hyp", "ids").first()
            assert record.bleu == scoring.language_summary(df, "ref", "hyp").first().bleu and record.gen_len == 2.0
        finally:
            spark.conf.unset("spark.sql.ansi.enabled")


def test_long_character_pairs(spark):
    rnd = random.Random(3)
    a = "".join(rnd.choice("abcde") for _ in range(1200))
    b = "".join(c for c in a if rnd.random() > 0.1)
    assert bit_parallel_distance(a, b) == distance(a, b)
    got = add_char_edits(frame(spark, [(a, b), ("abc", "abd"), (None, "x")]), "ref", "hyp")
    assert sorted((r.i, r.edits) for r in got.collect()) == [(0, distance(a, b)), (1, 1), (2, None)]


def test_wide_fields_equal_narrow_ones(monkeypatch):
    refs, hyps = zip(*random_pairs(50, "abc", 9, 4))
    expected = alignment.align_texts(list(refs), list(hyps))[0].tolist()
    monkeypatch.setattr(alignment, "_NARROW", 1)
    assert alignment.align_texts(list(refs), list(hyps))[0].tolist() == expected


def test_micro_is_ratio_of_sums_and_skips_invalid(spark):
    got = scoring.wer_micro(frame(spark), "ref", "hyp").first()
    valid = [(r, h) for r, h in PAIRS if r and h and r.strip() and h.strip()]
    edits = sum(distance(r.split(), h.split()) for r, h in valid)
    words = sum(len(r.split()) for r, h in valid)
    assert (got.edits, got.ref_words, got.n_pairs) == (edits, words, len(valid))
    assert got.wer == pytest.approx(edits / words)
    assert scoring.wer_micro(frame(spark).filter("false"), "ref", "hyp").first().wer == 0.0


def test_macro_is_mean_of_rows_and_null_without_rows(spark):
    df = frame(spark, [("A, b!", "a b"), ("a b c d", "a b c x")])
    assert scoring.wer_macro(df, "ref", "hyp").first().wer == pytest.approx(0.125)
    assert scoring.wer_macro(df.filter("false"), "ref", "hyp").first().wer is None


def test_normalized_pair(spark):
    df = frame(spark, [("A, b!", "a b"), ("a b c d", "a b c x")])
    got = scoring.wer_normalized(df, "ref", "hyp").first()
    assert (got.wer_pooled, got.wer_mean) == (pytest.approx(1 / 6), pytest.approx(0.125))
    with pytest.raises(Exception, match="cannot be empty"):
        scoring.wer_normalized(df.filter("false"), "ref", "hyp").collect()


def test_alignment_rates(spark):
    got = scoring.alignment_rates(frame(spark, [("a b c d", "a x c"), ("e", "e f")]), "ref", "hyp").first()
    assert (got.subs, got.dels, got.ins, got.ref_words) == (1, 1, 1, 5)
    assert (got.sub_rate, got.del_rate, got.ins_rate, got.wer) == (0.2, 0.2, 0.2, 0.6)
    empty = scoring.alignment_rates(frame(spark, [("", "x")]), "ref", "hyp").first()
    assert (empty.sub_rate, empty.wer) == (0.0, math.inf)


def test_cer(spark):
    got = scoring.cer_mean(frame(spark, [("Abc d", "abd d"), ("xy", "xy")]), "ref", "hyp").first()
    assert (got.edits, got.ref_chars, got.cer) == (1, 7, pytest.approx(0.1))


def test_identical_texts_score_zero(spark):
    df = spark.createDataFrame([(p[0],) for p in MANY if p[0]], "t string")
    assert scoring.row_wer(df, "t", "t").agg(F.max("wer")).first()[0] == 0.0


def test_tokenize_13a(spark):
    df = spark.createDataFrame([("Hello, world! 3.14 - 2-3 &quot;x&amp;y&quot; U.S. a..b 1,000.",)], "t string")
    assert df.select(tokenize_13a("t")).first()[0] == (
        'Hello , world ! 3.14 - 2 - 3 " x & y " U . S . a . . b 1,000 .'.split()
    )


BLEU_PAIRS = [
    ("the cat sat on the mat .", "the the the cat sat on mat"),
    ("a b a b a b c", "a b a b x a b a b"),
    ("It costs 3.50, no?", "it costs 3.50 , no ?"),
    ("short one", "short"),
    ("", "nothing to match here now"),
]


@pytest.mark.parametrize("smooth", [True, False])
def test_bleu_against_counters(spark, smooth):
    pairs = BLEU_PAIRS + MANY
    df = frame(spark, pairs)
    score = scoring.stripped_bleu if smooth else scoring.unsmoothed_bleu
    assert score(df, "ref", "hyp").first().bleu == pytest.approx(bleu(pairs, smooth))


def test_bleu_edges(spark):
    short = frame(spark, [("a b c", "a b c")])
    assert scoring.stripped_bleu(short, "ref", "hyp").first().bleu == 0.0
    no_four = [("a b c d e", "a b c x e f")]
    smoothed = scoring.stripped_bleu(frame(spark, no_four), "ref", "hyp").first().bleu
    assert smoothed == pytest.approx(bleu(no_four)) and smoothed > 0
    assert scoring.unsmoothed_bleu(frame(spark, no_four), "ref", "hyp").first().bleu == 0.0
    assert scoring.corpus_bleu(short.filter("false"), "ref", "hyp").first().bleu == 0.0
    spaced = frame(spark, [("a b c d .", "a b c d.")])
    counts = add_bleu_counts(spaced, "ref", "hyp").first()
    assert counts.match_4 == counts.total_4


def test_summary_and_evaluation_record(spark):
    df = frame(spark, [("A b c d", "a b c d"), ("e f g h", "e f g x")]).withColumn("ids", F.array(F.lit(5), F.lit(0)))
    summary = scoring.language_summary(df, "ref", "hyp").first()
    record = scoring.evaluation_record(df, "ref", "hyp", "ids").first()
    assert summary.wer == record.wer == 0.125
    assert summary.bleu == record.bleu == round(bleu([("A b c d", "a b c d"), ("e f g h", "e f g x")]), 4)
    assert record.gen_len == 1.0
    assert scoring.generated_length(df, "ids").first().gen_len == 1.0


def test_13a_tokens_of_python_and_of_the_engine(spark):
    rnd = random.Random(8)
    letters = list("ab9 .,-'\"&;<>!é漢😀\n\u00a0\x1c") + ["&quot;", "&amp;", "<skipped>", "-\n", "3.5", "1,000", "a.b"]
    texts = ["", ".", "..", "a..b", "9-", "&amp;lt;"] + ["".join(rnd.choices(letters, k=rnd.randrange(1, 30))) for _ in range(3_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    engine = [r.x for r in df.select("i", tokenize_13a("t").alias("x")).orderBy("i").collect()]
    assert tokens_13a(texts) == engine


def test_ngrams_against_counters():
    rnd = random.Random(3)
    sides = [[rnd.choices("abcd", k=rnd.randrange(12)) for _ in range(400)] for _ in range(2)]
    match, total = ngram_counts(*sides)
    for row, (ref, hyp) in enumerate(zip(*sides, strict=True)):
        for n in (1, 2, 3, 4):
            a, b = (Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in (ref, hyp))
            assert match[n - 1, row] == sum((a & b).values()) and total[n - 1, row] == sum(b.values())
    assert ngram_counts([], [])[0].shape == (4, 0) and ngram_counts([[]], [[]])[1].tolist() == [[0]] * 4
