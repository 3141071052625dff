import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxledger.operators import inference, mixing, nested, ordering, rollup


def source_rows(spark, sizes):
    data = [(s, i, f"{s}{i}") for s, n in sizes.items() for i in range(n)]
    random.Random(1).shuffle(data)
    return spark.createDataFrame(data, "source string, pos int, v string")


def round_robin(sizes):
    """Take turns; the mix ends once a source has given its last row, or has none to give."""
    taken, at = [], dict.fromkeys(sizes, 0)
    while True:
        for s, n in sizes.items():
            if at[s] == n:
                return taken
            taken.append(f"{s}{at[s]}")
            at[s] += 1
            if at[s] == n:
                return taken


@pytest.mark.parametrize("sizes", [{"a": 2, "b": 3}, {"a": 3, "b": 2}, {"a": 4, "b": 4, "c": 9}, {"a": 3, "b": 0}, {"a": 0, "b": 2}])
def test_interleave(spark, sizes):
    df = source_rows(spark, sizes)
    got = mixing.interleave(df, "source", list(sizes), ["pos"]).orderBy("mix_pos")
    assert [r.v for r in got.collect()] == round_robin(sizes)


def test_interleave_splits_of_one(spark):
    got = mixing.interleave_splits(source_rows(spark, {"a": 3, "b": 2}), "a", ["pos"], column="source")
    assert [r.v for r in got.orderBy("mix_pos").collect()] == ["a0", "a1", "a2"]


def test_repeat_and_cap(spark, rows):
    df = source_rows(spark, {"a": 3})
    repeated = mixing.repeat_to_n(df, 7, ["pos"]).orderBy("repeat_pos")
    assert [r.v for r in repeated.collect()] == ["a0", "a1", "a2", "a0", "a1", "a2", "a0"]
    assert mixing.repeat_to_n(df, 2, ["pos"]).count() == 2
    capped = mixing.cap_per_source(source_rows(spark, {"a": 5, "b": 5, "c": 5}), "source", {"a": 2, "b": None, "c": 9}, ["pos"])
    assert rows(capped.groupBy("source").count()) == [("a", 2), ("b", 5), ("c", 5)]
    assert [r.v for r in mixing.first_rows(df, 2, ["pos"]).collect()] == ["a0", "a1"]


def test_zip_predictions(spark, rows):
    records = spark.createDataFrame([(0, "x"), (1, "y")], "pos int, t string")
    lines = spark.createDataFrame([(0, " one "), (1, " "), (2, "two")], "n int, value string")
    paired = mixing.zip_predictions(records, lines, record_order=["pos"], line_order=["n"])
    assert rows(paired) == [(0, "x", "one"), (1, "y", "two")]
    with pytest.raises(Exception, match="differ"):
        mixing.zip_predictions(records, lines.limit(1), record_order=["pos"], line_order=["n"]).collect()


def test_ordinal_with_one_hot_source(spark):
    df = source_rows(spark, {"hot": 3000, "b": 40, "c": 1})
    got = ordering.with_ordinal(df, ["pos"], ["source"])
    assert got.filter("ordinal <> pos").count() == 0 and got.count() == 3041
    whole = ordering.with_ordinal(df, ["source", "pos"]).orderBy("ordinal").collect()
    assert [r.ordinal for r in whole] == list(range(3041))
    assert [r.v for r in whole] == sorted((r.v for r in whole), key=lambda v: (v.rstrip("0123456789"), int(v.lstrip("abchot"))))


def test_running_values_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(ordering, "BLOCK", 4)
    values = [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8, 9, 7]
    df = spark.createDataFrame(list(enumerate(values)), "i long, v int")
    total = ordering.with_running(df, "v", "sum", "i").orderBy("i").collect()
    assert [r.running for r in total] == [sum(values[: k + 1]) for k in range(len(values))]
    best = ordering.with_running(df, "v", "max", "i", include_current=False).orderBy("i").collect()
    assert [r.running for r in best] == [max(values[:k], default=None) for k in range(len(values))]


def test_pairs(spark, rows):
    df = spark.createDataFrame(
        [("hi_in", "h", "g"), ("yo_ng", None, "g"), ("xx_xx", "h", "g")], "language string, hyp string, gold string"
    )
    built = nested.build_pairs(df, "hyp", "gold")
    assert [r.translation for r in built.collect()] == [{"hi": "h", "hin": "g"}]
    both = nested.read_pairs(built, F.lit("hi"), F.lit("hin"))
    assert rows(both, "source_text", "target_text") == [("h", "g")]
    assert nested.read_pairs(built, F.lit("hi"), F.lit("tam")).count() == 0


def test_label_batches(spark):
    data = [(0, [1, 5, 6]), (0, [1, 7]), (1, [1, 2]), (1, [3]), (2, [1, 1, 1, 1, 1])]
    df = spark.createDataFrame(data, "batch_id int, ids array<int>")
    got = sorted((r.batch_id, r.labels) for r in nested.label_batch(df, "ids", start_id=1, max_length=4).collect())
    assert got == [(0, [5, 6]), (0, [7, -100]), (1, [1, 2]), (1, [3, -100]), (2, [1, 1, 1])]
    whole = nested.label_batch(df.filter("batch_id = 2"), "ids", start_id=1, max_length=None)
    assert whole.first().labels == [1, 1, 1, 1]
    assert df.select(nested.swap_ids("ids", 1, -100)).first()[0] == [-100, 5, 6]


def test_rollups(spark, rows):
    df = spark.createDataFrame([("afri", 1.0), ("afri", 0.5), ("indic", 0.0), (None, 0.5)], "region string, w double")
    assert rows(rollup.region_rollup(df, "w")) == sorted(
        [("afri", 0.75, 2), ("indic", 0.0, 1), (None, 0.5, 1), ("combined", 0.5, 4)], key=repr
    )
    words = spark.createDataFrame([("a b",), (" ",), (None,), ("c",)], "t string")
    assert rows(rollup.words_per_entry(words, "t")) == [(2, 3, 1.5)]
    assert rows(rollup.words_per_entry(words.filter("false"), "t")) == [(0, 0, 0.0)]
    assert rows(rollup.step_budget(df, "region")) == sorted([("afri", 2, 0), ("indic", 1, 0), (None, 1, 0)], key=repr)
    tags = spark.createDataFrame([("hi", 2), ("pa", 1), ("hi", 0)], "tag string, pos int")
    assert rollup.tag_list(tags, "tag", "pos").first().tags == "hi,pa"


def test_audio(spark, rows):
    df = spark.createDataFrame(
        [(i, None if i == 1 else [0.0] * (i + 1), 2) for i in range(5)], "i int, a array<float>, rate int"
    )
    got = rollup.audio_hours(df, "a", "rate").first()
    assert (got.n_total, got.n_decoded, got.total_seconds, got.min_seconds, got.max_seconds) == (5, 4, 6.5, 0.5, 2.5)
    running = rollup.running_hours(df, "a", "rate", ["i"], every=2)
    assert rows(running) == [(2, 0.5 / 3600), (4, 4.0 / 3600)]


def stop_at(values, patience):
    best, since = None, 0
    for i, v in enumerate(values):
        if best is None or v > best:
            best, since = v, 0
        else:
            since += 1
        if since >= patience:
            return i, i + 1, best
    return None, len(values), best


def test_runs(spark):
    rnd = random.Random(2)
    runs = {r: [rnd.randint(0, 9) / 10 for _ in range(n)] for r, n in (("a", 1), ("b", 2), ("c", 12), ("d", 7), ("e", 3))}
    runs["up"] = [0.1, 0.2, 0.3]
    data = [(r, i, v) for r, vs in runs.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(data, "run string, step int, v double")
    got = {r.run: (r.stop_step, r.n_evals, r.best_value) for r in rollup.early_stop(df, "run", "step", "v").collect()}
    assert got == {r: stop_at(vs, 2) for r, vs in runs.items()}
    best = {r.run: (r.best_step, r.best_value) for r in rollup.best_run(df, "run", "step", "v").collect()}
    assert best == {r: (vs.index(max(vs)), max(vs)) for r, vs in runs.items()}
    least = {r.run: r.best_value for r in rollup.best_run(df, "run", "step", "v", greater_is_better=False).collect()}
    assert least == {r: min(vs) for r, vs in runs.items()}
    kept = {(r.run, r.step) for r in rollup.last_checkpoints(df, "run", "step", 2).collect()}
    assert kept == {(r, i) for r, vs in runs.items() for i in range(len(vs))[-2:]}


def shouting():
    def predict(texts):
        if "bad" in texts:
            raise ValueError("cannot")
        return [t.upper() for t in texts]

    return predict


def test_inference(spark, rows):
    df = spark.createDataFrame([("a", None), ("bad", None), (None, None), ("c", "done")], "s string, t string")
    scored = inference.score_rows(df, "s", shouting)
    assert rows(scored, "s", "prediction", "error") == sorted(
        [("a", "A", None), ("bad", None, "ValueError: cannot"), (None, None, None), ("c", "C", None)], key=repr
    )
    good, failed = inference.split_outcomes(scored)
    assert (good.count(), failed.count()) == (3, 1)
    filled = inference.fill_missing(df, "s", "t", shouting)
    assert rows(filled) == sorted([("a", "A"), ("bad", ""), (None, None), ("c", "done")], key=repr)
    new = inference.fill_missing(df.select("s"), "s", "t", shouting)
    assert ("c", "C") in rows(new)


def test_fill_goes_on_after_a_killed_job(spark, tmp_path, rows):
    calls, poison = str(tmp_path / "calls"), str(tmp_path / "poison")

    def load():
        import os
        import time

        def predict(texts):
            if "w7" in texts and not os.path.exists(poison):
                time.sleep(3)  # the other tasks end before
                open(poison, "w").close()
                raise SystemExit("killed")
            with open(calls, "a") as f:
                f.writelines(t + "\n" for t in texts)
            if "bad" in texts:
                raise ValueError("bad")
            return [t.upper() for t in texts]

        return predict

    texts = [(k, f"w{k}", None) for k in range(40)] + [(40, "bad", None), (41, None, None), (42, "z", "done"), (None, "no key", None), (7, "w7x", None)]
    df = spark.createDataFrame(texts, "id long, s string, t string")
    path = str(tmp_path / "outcomes")
    with pytest.raises(Exception):  # noqa: B017
        inference.score_pending(df, "id", "s", "t", load, path, tasks=4)
    first = {r.id for r in inference.stored_outcomes(df, "id", "t", path).collect()}
    assert 0 < len(first) < 41 and 7 not in first
    early = open(calls).read().split()
    inference.score_pending(df, "id", "s", "t", load, path, tasks=4)
    late = open(calls).read().split()[len(early) :]
    assert not {f"w{k}" for k in first} & set(late)
    inference.score_pending(df, "id", "s", "t", load, path, tasks=4)
    stored = inference.stored_outcomes(df, "id", "t", path)
    assert sorted(r.id for r in stored.collect()) == list(range(41))
    want = [(k, f"w{k}", f"W{k}") for k in range(40)] + [(40, "bad", ""), (41, None, None), (42, "z", "done"), (None, "no key", None), (7, "w7x", "W7")]
    assert rows(inference.fill_stored(df, "id", "s", "t", path)) == sorted(want, key=repr)
    inference.score_pending(df, "id", "s", "t", lambda: lambda texts: ["found" for _ in texts], path, retry=True)
    assert (40, "bad", "found") in rows(inference.fill_stored(df, "id", "s", "t", path)) and stored.sparkSession.read.parquet(path).count() == 42


def test_requests(spark):
    df = spark.createDataFrame([(bytearray(range(100)), "fr")], T.StructType().add("a", T.BinaryType()).add("l", T.StringType()))
    request = inference.request_table(df, "a", F.col("l"), model="m").first().request
    import base64
    import json

    body = json.loads(request)
    assert body["text"] == "Translate this audio from fr to English."
    assert base64.b64decode(body["input_audio"]["data"]) == bytes(range(100))
