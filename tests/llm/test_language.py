import random
import zlib

import pytest
import zstandard

from voxledger.llm import compression_language as cl
from voxledger.llm.queries_new import op13_compression_language

SYLLABLES = {"aa": "ka to mi ne ru so ha".split(), "bb": "schl ung eim orst anz ger".split(), "cc": "ção lhe ão inha ndo".split()}
SCHEMA = "doc_id long, text string, lang string, source string, score double, margin double, h long, piece string, rank int, lang_pred string"


def words(lang, seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def table(spark):
    return lambda rows: spark.createDataFrame([(*r, "s", 9.0, 9.0, 9, "p", 9, "zz") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def learned():
    return [(i, words(lang, i, 60), lang) for i in range(120) for lang in [list(SYLLABLES)[i % 3]]]


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def by_hand(rows, p):
    """Dictionaries and predictions in one pass over all rows, given Spark's hashes."""
    own, counts = {}, {}
    for i, text, lang, h in rows:
        if i is None or lang is None or text is None or held(i) or not any(map(str.isalpha, text)):
            continue
        counts[lang] = counts.get(lang, 0) + 1
        at = h % (max(len(text) - p.stretch, 0) + 1)
        own.setdefault(lang, {})[h] = text[at : at + p.stretch].lower().encode()
    order = sorted(own, key=lambda x: (-counts[x], x))
    coders = []
    for lang in order:
        raw = b""
        for k, h in enumerate(sorted(own[lang])[: p.texts]):
            if len(raw) + bool(k) < p.dictionary:
                raw += (b"\n" if k else b"") + own[lang][h]
        d = zstandard.ZstdCompressionDict(raw[-p.dictionary :], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        coders.append(zstandard.ZstdCompressor(dict_data=d, level=p.level, write_content_size=False, write_dict_id=False))
    out = []
    for i, text, _, _ in rows:
        if text is None or not any(map(str.isalpha, text)) or not order:
            out.append((i, "und"))
            continue
        data = text.lower().encode()
        total = {lang: sum(len(c.compress(data[a : a + p.block])) for a in range(0, len(data), p.block)) for lang, c in zip(order, coders, strict=True)}
        out.append((i, min(order, key=lambda x: (total[x], order.index(x)))))
    return out


def test_against_one_pass_by_hand(spark, table, learned):
    rows = learned + [(1000 + i, words("aa", 5000 + i, 3000), None) for i in range(4)] + [(2000, "ka", "aa"), (2001, "12 34", "aa"), (2002, "", None), (2003, None, "bb"), (None, words("bb", 9, 40), "cc"), (7, words("cc", 10, 40), "bb")]
    p = cl.Parameters(texts=16, stretch=100, dictionary=900, block=300)
    df = table(rows)
    hashed = [tuple(r) for r in df.selectExpr("doc_id", "text", "lang", "xxhash64(text)").collect()]
    got = [(r.doc_id, r.lang_pred) for r in cl.predict(df, cl.fit(df, p), p).collect()]
    assert sorted(got, key=repr) == sorted(by_hand(hashed, p), key=repr)


def test_odd_rows(table, learned):
    odd = [(500, None, "aa"), (501, "", "aa"), (502, " \n\t 12.5 §$ 😀", "bb"), (503, words("bb", 1, 200_000), None), (None, words("cc", 2, 50), "aa"), (504, "qwx zyv " * 30, ""), (504, "qwx zyv " * 30, "")]
    df = table(learned + odd)
    rows = cl.predict(df, cl.fit(df)).collect()
    assert len(rows) == len(learned) + len(odd)
    told = {r.doc_id: r for r in rows}
    for i in (500, 501, 502):
        assert (told[i].lang_pred, told[i].score, told[i].accepted) == ("und", 0.0, False)
    assert told[503].lang_pred == "bb" and told[503].accepted and told[None].lang_pred == "cc" and not told[None].held_out
    assert all(0 <= r.score <= 1 for r in rows) and all(r.held_out == (r.doc_id is not None and held(r.doc_id)) for r in rows)
    assert all(told[i].lang_pred == lang for i, _, lang in learned)


def test_copies_do_not_fill_a_dictionary(table):
    copies = [(3 * i, words("bb", 77, 50), "aa") for i in range(400)]
    true = [(10_000 + i, words("aa", 8000 + i, 50), "aa") for i in range(60)]
    others = [(20_000 + i, words("bb", 9000 + i, 50), "bb") for i in range(60)]
    df = table(copies + true + others)
    told = {r.doc_id: r.lang_pred for r in cl.predict(df, cl.fit(df)).collect()}
    assert all(told[i] == lang for i, _, lang in true + others)


def test_nothing_to_learn_and_empty_tables(table):
    for rows in ([], [(1, "some text", None)], [(1, None, "aa"), (2, "12", "aa")]):
        df = table(rows)
        got = cl.predict(df, cl.fit(df)).collect()
        assert len(got) == len(rows) and all(r.lang_pred == "und" and r.score == 0 for r in got)


def test_narrow_margins_are_not_accepted(table, learned):
    df = table(learned + [(900, "x", None), (901, words("aa", 1, 30) + " " + words("bb", 1, 30), None)])
    told = {r.doc_id: r for r in cl.predict(df, cl.fit(df), cl.Parameters(least_margin=0.2)).collect()}
    assert not told[900].accepted and not told[901].accepted and told[900].lang_pred in SYLLABLES
    assert sum(told[i].accepted for i, _, _ in learned) >= 0.9 * len(learned)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = [r for r in op13_compression_language(spark, folder).collect() if r.held_out]
    assert sum(langs[r.doc_id] == r.lang_pred for r in rows) >= 0.98 * len(rows)
