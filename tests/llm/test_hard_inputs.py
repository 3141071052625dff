"""Inputs that once ended a session, lost a label, or took a user's column away."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import prose
from voxledger.llm import additive_quality, forest_secrets, line_dedup, pu_toxicity
from voxledger.llm.tables import held_out, stored

MEGABYTE = 1 << 20


def open_ids(spark, n):
    return [r.id for r in spark.range(n).filter(~held_out(F.col("id"))).collect()]


def test_words_of_a_megabyte(spark):
    shapes = ["a-", "key", "1", "=", "key=", "a'", "-", ":", "A", "é-", "x.", "key:", "=a", '"', "@", "Ab1/", "://"]
    texts = [(s * MEGABYTE)[:MEGABYTE] for s in shapes]
    texts += [t + "!" for t in texts] + ["a@" + "." * MEGABYTE, "password = " + "x1-" * 300_000, "a-" * 3000 + "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    started = time.time()
    got = forest_secrets.features(forest_secrets.candidates(docs)).drop("word", "value", "before", "before2", "after")
    found = got.union(forest_secrets.ordinary_words(forest_secrets.features(forest_secrets.candidates(docs))).select(*got.columns)).count()
    assert found >= len(shapes) and time.time() - started < 120


def test_one_secret_among_look_alikes(spark):
    many = 300_000
    numbers = spark.range(many).select((F.col("id") + 10_000).alias("doc_id"), F.concat(F.lit("call "), F.col("id") + 10**15, F.lit(" now")).alias("text"))
    taught, hidden = open_ids(spark, 40)[0], [r.id for r in spark.range(40).filter(held_out(F.col("id"))).collect()][0]
    planted = spark.createDataFrame([(taught, 'then password="k3J9xQ7b2LmZ" and'), (hidden, 'so password="p0Zr81kWqTtY" but')], "doc_id long, text string")
    got = forest_secrets.scan(numbers.union(planted)).filter("is_secret").collect()
    assert {r.doc_id for r in got} == {taught, hidden}


def by_hand(value):
    """Some features of a value, character by character."""
    kind = ["A" if c.isupper() else "a" if c.islower() else "0" if c.isdigit() else "-" for c in value]
    return {
        "f_length": float(len(value)),
        "f_digits": sum(c in "0123456789" for c in value) / len(value),
        "f_capitals": sum("A" <= c <= "Z" for c in value) / len(value),
        "f_transitions": sum(a != b for a, b in zip(kind, kind[1:])) / len(value),  # noqa: B905
        "f_distinct": len(set(value)) / len(value),
        "f_slashes": float(value.count("/")),
        "f_dots": float(value.count(".")),
        "f_at": float("@" in value),
    }


def test_features_by_hand(spark):
    rng = np.random.default_rng(4)
    letters = list("abcXYZ019/.@-é")
    texts = [(i, " ".join("".join(rng.choice(letters, rng.integers(12, 30))) for _ in range(6))) for i in range(50)]
    rows = forest_secrets.features(forest_secrets.candidates(spark.createDataFrame(texts, "doc_id long, text string"))).collect()
    assert len(rows) > 200
    for r in rows:
        for name, want in by_hand(r.value).items():
            assert r[name] == pytest.approx(want), (name, r.value)


@pytest.mark.parametrize("prior", [0.02, 0.1, 0.4, 0.7])
def test_toxicity_at_any_prior(spark, prior):
    n = 6_000
    toxic = np.random.default_rng(9).random(n) < prior
    ids = spark.range(n).collect()
    rows = [(r.id, prose(r.id, 40) + (" vileword " if toxic[r.id] else " ") + prose(r.id + n, 10), int(toxic[r.id])) for r in ids]
    docs = stored(spark.createDataFrame(rows, "doc_id long, text string, toxic int"), "priors")
    model = pu_toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    got = pu_toxicity.score(docs, model).collect()
    flagged = np.array([r.score >= 0.3 for r in sorted(got, key=lambda r: r.doc_id)])
    assert flagged[toxic].mean() >= 0.9 and (~flagged[~toxic]).mean() >= 0.95


def plain_step(confirmed, unlabelled, weights, bias, prior):
    """Risk on clean texts and gradient, text by text."""
    sig = lambda z: 1 / (1 + np.exp(-z))
    z_p, z_u = confirmed @ weights + bias, unlabelled @ weights + bias
    risk = np.mean([np.log1p(np.exp(z)) for z in z_u]) - prior * np.mean([np.log1p(np.exp(z)) for z in z_p])
    gradient = np.zeros(len(weights))
    if risk >= 0:
        for x in confirmed:
            gradient -= prior * x / len(confirmed)
        for x, z in zip(unlabelled, z_u, strict=True):
            gradient += sig(z) * x / len(unlabelled)
    else:
        for x, z in zip(confirmed, z_p, strict=True):
            gradient += prior * sig(z) * x / len(confirmed)
        for x, z in zip(unlabelled, z_u, strict=True):
            gradient -= sig(z) * x / len(unlabelled)
    return risk, gradient


@pytest.mark.parametrize("prior", [0.1, 0.9])
def test_first_training_step_by_hand(prior):
    rng = np.random.default_rng(2)
    dense_p, dense_u = (rng.random((30, 8)) < 0.5).astype(float), (rng.random((60, 8)) < 0.3).astype(float)

    def sparse(x):
        rows, at = np.nonzero(x)
        return pu_toxicity.Sparse(at.astype(np.int32), x[rows, at].astype(np.float32), np.searchsorted(rows, np.arange(len(x) + 1)))

    p = pu_toxicity.Parameters(bits=3, epochs=1, unlabelled_rows=60, batch=60, scale=1.0, decay=0.0, least_share=0.0, most_share=1.0)
    model = pu_toxicity.train(sparse(dense_p), sparse(dense_u), prior, p)
    _, gradient = plain_step(dense_p, dense_u, np.zeros(8), 0.0, prior)
    # Adam's first step has the length of the rate, against the gradient.
    assert np.allclose(model.weights, -p.rate * gradient / (np.abs(gradient) + 1e-8), atol=1e-6)


def test_repeated_ids_do_not_pass_the_bounds(spark, monkeypatch):
    taught = open_ids(spark, 100)[:20]
    rows = [(taught[0], prose(i, 30)) for i in range(5_000)] + [(i, prose(i, 30)) for i in taught]
    docs = stored(spark.createDataFrame(rows, "doc_id long, text string"), "repeats")
    labels = spark.createDataFrame([(i, k % 2, k % 2) for k, i in enumerate(taught)] * 3, "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(additive_quality, "train", lambda x, y, p: seen.append(len(x)))
    monkeypatch.setattr(pu_toxicity, "train", lambda a, b, prior, p: seen.append(len(a.bounds) + len(b.bounds) - 2))
    additive_quality.fit(docs, labels)
    pu_toxicity.fit(docs, labels)
    assert seen == [20, 10 + 20]


def test_line_dedup_keeps_columns_of_its_own_names(spark):
    names = ["n_lines", "n_dropped", "_doc", "_mark", "_n", "_top", "_bitmap", "__mark", "__top", "__n", "_leaked", "_dropped", "MARK", "pos"]
    rows = [(1, "one shared line\nmy own line", *range(14)), (2, "one shared line\nanother own line", *range(20, 34))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} long" for n in names))
    want = [(1, "one shared line\nmy own line", *range(14)), (2, "another own line", *range(20, 34))]
    assert sorted(map(tuple, line_dedup.dedup_lines(docs, counts=False).collect())) == want
    counted = line_dedup.dedup_lines(docs)
    assert counted.columns == [*docs.columns, "n_lines_", "n_dropped_"]
    assert sorted(map(tuple, counted.collect())) == [(*want[0], 2, 0), (*want[1], 2, 1)]
    folder = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name
    assert sorted(map(tuple, corpus_pipeline.lines(spark, docs, folder).collect())) == want
