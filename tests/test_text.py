import pytest
from pyspark.sql import functions as F

from voxledger.functions import text

SAMPLES = [
    None,
    "",
    "   ",
    "Hello,  World!",
    "[noise] so [laughs] it-goes [x]",
    "“Quoted” ‘text’… end",
    "यह एक वाक्य है। अच्छा",
    "é vs é",
    "tab\tand\nline nbsp em\x1csep",
    "price $5 + 3 = <8>",
    'a . b , c ! "',
]


def table(spark, values=SAMPLES):
    return spark.createDataFrame(list(enumerate(values)), "i int, t string")


def column(spark, expr, values=SAMPLES):
    return [r[0] for r in table(spark, values).orderBy("i").select(expr).collect()]


def test_tokenize_is_python_split(spark):
    assert column(spark, text.tokenize("t")) == [None if s is None else s.split() for s in SAMPLES]


def test_strip_is_python_strip(spark):
    assert column(spark, text.strip_ws("t")) == [None if s is None else s.strip() for s in SAMPLES]


def test_is_blank(spark):
    assert column(spark, text.is_blank("t")) == [None if s is None else not s.strip() for s in SAMPLES]


def test_normalize_for_wer(spark):
    got = column(spark, text.normalize_for_wer("t"))
    assert got[:4] == [None, "", "", "hello world"]
    assert got[4] == "so itgoes"
    assert got[5] == "quoted text end"
    assert got[6] == "यह एक वाक्य है। अच्छा"  # the danda stays
    assert got[9] == "price 5 3 8"


def test_normalize_unicode_punct_drops_danda_and_keeps_symbols(spark):
    got = column(spark, text.normalize_unicode_punct("t"))
    assert "।" not in got[6]
    assert got[9] == "price $5 + 3 = <8>"


@pytest.mark.parametrize("normalize", [text.normalize_for_wer, text.normalize_unicode_punct])
def test_normalising_twice_changes_words_no_more(spark, normalize):
    once = column(spark, text.tokenize(normalize("t")))
    assert once == column(spark, text.tokenize(normalize(normalize("t"))))


def test_cleaned_text_has_the_words_of_normalised_text(spark):
    for clean, normalize in (
        (text.clean_for_wer, text.normalize_for_wer),
        (text.clean_unicode_punct, text.normalize_unicode_punct),
    ):
        assert column(spark, text.tokenize(clean("t"))) == column(spark, text.tokenize(normalize("t")))


def test_detokenize(spark):
    cases = ["a , b .", "a . . b", 'he said " yes " !', "no change", "x .y"]
    expected = ["a, b.", "a. . b", 'he said" yes" !', "no change", "x .y"]
    assert column(spark, text.detokenize("t"), cases) == expected


def test_paths_and_codes(spark):
    df = spark.createDataFrame(
        [("test/a/b.wav", "hi_in", "r/afri-5/sw_ke_afri.json"), ("b.wav", "en", "r/indic-5/hi_in_indic.json")],
        "p string, c string, f string",
    )
    got = df.select(
        text.strip_prefix("p"), text.base_name("p", F.lit(7)), text.iso1("c"), text.file_language("f"), text.parent_dir("f")
    ).collect()
    assert [tuple(r) for r in got] == [
        ("a/b.wav", "b.wav", "hi", "sw_ke", "afri-5"),
        ("b.wav", "b.wav", "en", "hi_in", "indic-5"),
    ]
    missing = spark.range(1).select(text.base_name(F.lit(None).cast("string"), F.lit(7), ".wav")).first()[0]
    assert missing == "sample_7.wav"


def test_truncate_tokens(spark):
    assert column(spark, text.truncate_tokens(text.tokenize("t"), 1), ["a b c", ""]) == [["a"], []]
