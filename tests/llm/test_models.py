import json

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxledger.llm import additive_quality, forest_secrets, mcd_outliers, pu_toxicity
from voxledger.llm.bytetext import windows, words
from voxledger.llm.tables import held_out

FOLDER = "/root/testdata/sf0.1"


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(len(s))
    return (rank[y == 1].mean() - (y.sum() - 1) / 2) / (len(y) - y.sum())


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")


def test_words_and_windows_are_those_of_the_plain_route():
    texts = ["The  cat\tsat", "", None, "x", "a b a b", "\n", "été ok"]
    w = words(pa.array(texts))
    got = [[bytes(w.data[s:e]).decode() for s, e, t in zip(w.start, w.end, w.text, strict=True) if t == i] for i in range(len(texts))]
    assert got == [["the", "cat", "sat"], [], [], ["x"], ["a", "b", "a", "b"], [], ["été", "ok"]]
    value, bounds = windows(w.hash, w.first, 2)
    assert np.diff(bounds).tolist() == [2, 0, 0, 1, 3, 0, 1]
    assert value[3] == value[5] != value[4]


def test_quality_on_held_out_rows(tables):
    docs, labels = tables
    model = additive_quality.fit(docs, labels)
    got = additive_quality.score(docs, model).filter(held_out(F.col("doc_id"))).join(labels, "doc_id").toPandas()
    assert ((got.score >= 0.7) == got.quality).mean() > 0.98 and auc(got.quality.values, got.score.values) > 0.99
    assert model.pairs


def test_toxicity_on_held_out_rows(tables):
    docs, labels = tables
    got = pu_toxicity.score(docs, pu_toxicity.fit(docs, labels)).filter(held_out(F.col("doc_id"))).join(labels, "doc_id").toPandas()
    assert auc(got.toxic.values, got.score.values) > 0.93


def test_held_out_labels_do_not_matter(tables):
    docs, labels = tables
    docs, labels = docs.filter("doc_id < 2000"), labels.filter("doc_id < 2000")
    swapped = labels.select("doc_id", *[F.when(held_out(F.col("doc_id")), 1 - F.col(c)).otherwise(F.col(c)).alias(c) for c in ("quality", "toxic")])
    a, b = additive_quality.fit(docs, labels), additive_quality.fit(docs, swapped)
    assert a.intercept == b.intercept and all((x == y).all() for x, y in zip(a.tables, b.tables, strict=True))
    a, b = pu_toxicity.fit(docs, labels), pu_toxicity.fit(docs, swapped)
    assert a.bias == b.bias and (a.weights == b.weights).all()


def test_messy_rows_and_empty_tables_get_scores(messy, empty, spark):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 12)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for docs, marks in ((messy, labels), (messy, labels.limit(0)), (empty, labels), (messy, labels.filter("toxic = 0"))):
        quality = additive_quality.score(messy, additive_quality.fit(docs, marks)).collect()
        toxic = pu_toxicity.score(messy, pu_toxicity.fit(docs, marks)).collect()
        assert len(quality) == len(toxic) == messy.count()
        assert all(0 <= r.score <= 1 for r in quality + toxic)
    model = pu_toxicity.fit(messy, labels.limit(0))
    assert pu_toxicity.drop_toxic(messy, model).count() == messy.count() and pu_toxicity.drop_toxic(empty, model).count() == 0
    assert additive_quality.score(empty, additive_quality.fit(messy, labels)).count() == 0


def test_negative_clean_risk_goes_back():
    """Confirmed examples alone as unlabelled text: the clean risk would fall below zero without the bound."""
    p = pu_toxicity.Parameters(epochs=5, batch=50)
    index, value, bounds = pu_toxicity.features(pa.array(["bad words here"] * 30 + ["fine text there"] * 170), p)
    rows = pu_toxicity.Sparse(index, value, bounds)
    model = pu_toxicity.train(rows.take(np.arange(30)), rows, 0.15, pu_toxicity.Parameters(least_share=0, most_share=1.0, decay=0.0))
    score = rows.dot(model.weights) + model.bias
    assert score[:30].min() > 0 > score[30:].max()


def toxic_rows(n, rare=0):
    """Texts of ten words in a row of kinds: ``rare`` of a rare toxic kind, a tenth of a common one, clean ones."""
    rng = np.random.default_rng(5)
    kinds = np.repeat([2, 1, 0], [rare, n // 10, n - n // 10 - rare])
    texts = [" ".join([*(f"w{k}" for k in rng.integers(0, 300, 9)), ("fine", "awful", "vile")[kind]]) for kind in kinds]
    return kinds, pu_toxicity.Sparse(*pu_toxicity.features(pa.array(texts), pu_toxicity.Parameters()))


def test_rare_kinds_of_toxic_text_are_learned():
    kinds, rows = toxic_rows(6000, rare=8)
    model = pu_toxicity.train(rows.take(np.flatnonzero(kinds)), rows, float((kinds > 0).mean()), pu_toxicity.Parameters())
    score = rows.dot(model.weights) + model.bias
    assert score[kinds == 2].min() > np.quantile(score[kinds == 0], 0.999)


@pytest.mark.parametrize("n", [300, 4000, 4001, 9000])
def test_steps_do_not_depend_on_the_number_of_rows(n, monkeypatch):
    kinds, rows = toxic_rows(n)
    steps = []
    back = pu_toxicity.Sparse.back
    monkeypatch.setattr(pu_toxicity.Sparse, "back", lambda self, *a: steps.append(1) or back(self, *a))
    pu_toxicity.train(rows.take(np.flatnonzero(kinds)), rows, 0.1, pu_toxicity.Parameters())
    assert len(steps) == 2 * 240  # both samples, each step


def brute_mcd(rows, p):
    """The same estimates by numpy, a group at a time."""
    d = mcd_outliers.DIMENSIONS
    out = {}
    floors = np.array(mcd_outliers.FLOORS)
    for g in {r["g"] for r in rows}:
        x = np.array([[r[n] for n in mcd_outliers.X] for r in rows if r["g"] == g], float)
        if len(x) < p.least_rows:
            continue
        center = np.median(x, axis=0)
        low = np.diag(np.maximum(np.median(np.abs(x - center), axis=0) * 1.4826, floors))

        def distance(center=center, low=low, x=x):
            return (np.linalg.solve(low, (x - center).T) ** 2).sum(axis=0)

        def edge(v, share):
            e = np.floor(np.log2(v + 2.0**-20) * mcd_outliers.CLASSES)
            return e, np.sort(e)[int(np.ceil(len(e) * share)) - 1]

        for _ in range(p.steps):
            e, cut = edge(distance(center, low), p.share)
            inner = x[e <= cut]
            center = inner.mean(axis=0)
            low = np.linalg.cholesky(np.cov(inner.T, bias=True).reshape(d, d) + np.diag(floors**2))
        _, cut = edge(distance(center, low), 0.5)
        out[g] = center, low, max(2.0 ** ((cut + 1) / mcd_outliers.CLASSES), mcd_outliers.CHI2_MEDIAN) * p.cutoff / mcd_outliers.CHI2_MEDIAN
    return out


def test_outliers_against_numpy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source")))
    p = mcd_outliers.Parameters()
    got = mcd_outliers.verdicts(docs, p).collect()
    counted = mcd_outliers.statistics(docs).select("doc_id", "n_words", "n_repeat_words", mcd_outliers.base_failed().alias("failed"), F.concat_ws("|", "lang", "source").alias("g"), *[x.alias(n) for x, n in zip(mcd_outliers.vector(), mcd_outliers.X, strict=True)]).collect()
    found = brute_mcd([r for r in counted if not r.failed], p)
    by_id = {r.doc_id: r for r in got}
    judged = 0
    for r in counted:
        want = not r.failed
        if r.g in found and not r.failed:
            center, low, limit = found[r.g]
            d = (np.linalg.solve(low, np.array([r[n] for n in mcd_outliers.X]) - center) ** 2).sum() / limit
            want, judged = d <= 1, judged + 1
            assert by_id[r.doc_id].distance == pytest.approx(d, rel=1e-6)
        assert by_id[r.doc_id].kept == want
    assert judged > 300


def test_small_groups_take_a_wider_estimate(spark):
    """Every document in a group of its own; one language has rows enough, the other has not."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id < 300").withColumn("source", F.col("doc_id").cast("string"))
    docs = docs.withColumn("lang", F.when(F.col("doc_id") < 10, "xx").otherwise("yy"))
    p = mcd_outliers.Parameters(wider=True)
    counted = mcd_outliers.statistics(docs).select("doc_id", "n_words", "n_repeat_words", "lang", mcd_outliers.base_failed().alias("failed"), *[x.alias(n) for x, n in zip(mcd_outliers.vector(), mcd_outliers.X, strict=True)]).collect()
    passed = [r.asDict() for r in counted if not r.failed]
    found = brute_mcd([r | {"g": g} for r in passed for g in ("*", r["lang"])], p)
    assert set(found) == {"*", "yy"}
    got = {r.doc_id: r for r in mcd_outliers.verdicts(docs, p).collect()}
    assert len(got) == len(counted)
    for r in passed:
        center, low, limit = found["yy" if r["lang"] == "yy" else "*"]
        d = (np.linalg.solve(low, np.array([r[n] for n in mcd_outliers.X]) - center) ** 2).sum() / limit
        assert got[r["doc_id"]].distance == pytest.approx(d, rel=1e-6) and got[r["doc_id"]].kept == (d <= 1)
    assert any(not got[r["doc_id"]].kept for r in passed)
    assert mcd_outliers.verdicts(docs.limit(3), p).filter("not base_failed and distance is null").count() == 0 == mcd_outliers.verdicts(docs.limit(0), p).count()


def test_counts_of_messy_rows(messy, empty):
    got = {(r.doc_id, r.n_words): r for r in mcd_outliers.verdicts(messy).collect()}
    assert mcd_outliers.verdicts(messy).count() == messy.count() and mcd_outliers.verdicts(empty).count() == 0
    assert (got[3, 0].word_chars, got[3, 0].n_dup_lines, got[3, 0].base_failed, got[3, 0].kept) == (0, 0, True, False)
    three = messy.limit(1).withColumn("text", F.lit("a b c a b c x\n\nq\nq\n a b"))
    r = mcd_outliers.verdicts(three).first()
    # Windows abc (twice) and "a b" at the end only as part of no repeated window.
    assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (11, 11, 1, 6)


def test_secrets(spark, messy, empty):
    rng = np.random.default_rng(1)
    hexes = lambda: "".join(rng.choice(list("0123456789abcdef"), 40))
    rows = [(i, f'the word token = "{hexes()}" and', None) for i in range(80)]
    rows += [(100 + i, f"call {rng.integers(10**15, 10**16)} or 10.20.{100 + i % 50}.{110 + i} or user{i}.99@mail{i}.example.com", None) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = forest_secrets.scan(docs).collect()
    assert {r.doc_id for r in got if r.is_secret} == set(range(80)) and len({r.doc_id for r in got}) == 160
    labelled = forest_secrets.candidates(docs).withColumn("label", (F.col("doc_id") >= 100).cast("double"))
    assert {r.doc_id for r in forest_secrets.scan(docs, labelled).collect() if r.is_secret} == set(range(100, 180))
    assert forest_secrets.scan(empty).count() == 0
    assert all(r.probability is None and not r.is_secret for r in forest_secrets.scan(messy).collect())


def test_padded_short_and_letter_only_secrets_are_candidates(spark):
    texts = [
        ('token = "QWxhZGRpbjpvcGVuMTIz=="', "QWxhZGRpbjpvcGVuMTIz=="),
        ("so QWxhZGRpbjpvcGVuMTIz== it is", "QWxhZGRpbjpvcGVuMTIz=="),
        ('{"key":"QWxhZGRpbjpvcGVuMw=="}', "QWxhZGRpbjpvcGVuMw=="),
        ("token=QWxhZGRpbjpvcGVuMTIz==,", "QWxhZGRpbjpvcGVuMTIz=="),
        ('password = "correct-horse-battery"', "correct-horse-battery"),
        ('password = "Abc12345"', "Abc12345"),
        ("password=abc123", "abc123"),
        ("with password: hunter then", "hunter"),
        ("password : hunter then", "hunter"),
        ('secret="AbCdEf"', "AbCdEf"),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)] + [(99, "plain short words: of the text")], "doc_id long, text string")
    got = {(r.doc_id, r.value) for r in forest_secrets.candidates(docs).collect()}
    assert got >= {(i, v) for i, (_, v) in enumerate(texts)} and 99 not in {i for i, _ in got}


def test_ordinary_words_are_no_secrets(spark):
    rng = np.random.default_rng(3)
    rows = [(i, f'password = "{"".join(rng.choice(list("abcdefghkmnp"), 9))}-{"".join(rng.choice(list("ABCDabcd1234"), 9))}" and') for i in range(120)]
    rows += [(200 + i, f"an internationalization of understandings number {rng.integers(10**15, 10**16)}") for i in range(120)]
    got = forest_secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got if r.is_secret} == set(range(120)) and len(got) >= 480


def test_native_operators_run_no_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for df in (mcd_outliers.verdicts(docs), forest_secrets.scan(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_base_counts_against_sql(spark):
    sql = """SELECT doc_id, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols
             FROM (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM '/root/testdata/sf0.01/documents.parquet')"""
    want = sorted(duckdb.sql(sql).fetchall())
    got = mcd_outliers.statistics(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert sorted(tuple(r) for r in got.select("doc_id", "n_words", "word_chars", "n_symbols").collect()) == want
    assert json.dumps(want[0])
