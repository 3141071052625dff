import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.brute import distance
from voxledger.operators import compare, languages, lookup, records


def test_last_duplicate_wins_and_unmatched_rows_stay(spark, rows):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "file_name string, code int")
    info = spark.createDataFrame(
        [("a", 10, 0), ("a", 11, 2), ("a", 12, 1), (None, 99, 3)], "wav_codes string, codes int, pos int"
    )
    assert rows(lookup.gold_codes(df, info)) == [("a", 11), ("b", 2), (None, 3)]


def test_gold_text_modes(spark, rows):
    df = spark.createDataFrame([(1, "old"), (2, "old")], "code int, gold_transcript string")
    info = spark.createDataFrame([(1, "new", 0)], "codes int, transcript string, pos int")
    assert rows(lookup.gold_text(df, info, "Transcription")) == [(1, "new"), (2, "old")]
    added = lookup.gold_text(df, info, "translation")
    assert rows(added, "code", "gold_translation") == [(1, "new"), (2, None)]
    assert lookup.gold_text(df, info, "other") is df


def test_reference_join_and_default_translation(spark, rows):
    df = spark.createDataFrame([("a", "x"), ("b", None), ("c", "y")], "file_name string, h string")
    info = spark.createDataFrame([("a", "ref", 0), ("b", "ref", 1)], "wav_codes string, transcript string, pos int")
    assert rows(lookup.reference_join(df, info, "h")) == [("a", "x", "ref")]
    ids = spark.createDataFrame([(1,), (2,)], "id int")
    dim = spark.createDataFrame([(1, "t", 0), (1, None, 1)], "codes int, transcript string, pos int")
    assert rows(lookup.translation_lookup(ids, dim)) == [(1, "t"), (2, "")]


def expected_changes(base, systems, worse, min_diff, n):
    """The n records that change most, from (id, text, gold) and {name: [(id, text)]}, by merges of small frames."""
    rows = pd.DataFrame(base, columns=["id", "text", "gold"]).reset_index(names="place").dropna(subset="text")
    rows["place"] = rows.groupby("id").place.transform("min")
    rows = rows.drop_duplicates("id", keep="last").dropna(subset="gold")
    frames = [pd.DataFrame(x, columns=["id", "said"]).dropna().drop_duplicates("id", keep="last").assign(system=s, rank=k) for k, (s, x) in enumerate(systems.items())]
    both = rows.merge(pd.concat(frames), on="id")

    def rate(column):
        return [distance(g.split(), t.split()) / len(g.split()) for g, t in zip(both.gold, both[column], strict=True)]

    both["wer"] = rate("said")
    both["change"] = pd.Series(rate("text"), both.index) - both.wer
    both["key"] = both.change if worse else -both.change
    both = both[(both.key < 0) & (both.change.abs() >= min_diff)].sort_values(["key", "rank"])
    best = both.groupby("id").agg(key=("key", "min"), rank=("rank", "min"), place=("place", "min"))
    picked = best.sort_values(["key", "rank", "place"]).head(n).index
    return [(i, [(m.system, m.wer * 100, m.change * 100) for m in both[both.id == i].itertuples()]) for i in picked]


@pytest.mark.parametrize("worse", [False, True])
def test_comparison_against_dictionaries(spark, worse):
    rnd = random.Random(5)

    def text():
        return " ".join(rnd.choice("abc") for _ in range(rnd.randint(1, 5)))

    ids = [f"r{rnd.randint(0, 60)}" for _ in range(90)]
    base = [(r, text() if rnd.random() > 0.1 else None, text() if rnd.random() > 0.1 else None) for r in ids]
    systems = {
        name: [(rnd.choice(ids), text() if rnd.random() > 0.1 else None) for _ in range(70)] for name in ("s1", "s2", "s3")
    }
    df = spark.createDataFrame([(i, *b) for i, b in enumerate(base)], "pos long, id string, b string, g string")
    frames = [
        (n, spark.createDataFrame([(i, *x) for i, x in enumerate(lines)], "pos long, id string, t string"), "t")
        for n, lines in systems.items()
    ]
    wide = compare.gather_systems(df, frames, id_key="id", baseline_key="b", gold_key="g")
    compared = compare.compare_wide(wide, list(systems), min_diff=0.05, worse=worse)
    got = [
        (r.file_id, [(m.name, round(m.wer, 6), round(m.wer_diff, 6)) for m in r.models])
        for r in compare.top_records(compared, 15).collect()
    ]
    expected = [
        (rec, [(n, round(w, 6), round(d, 6)) for n, w, d in models])
        for rec, models in expected_changes(base, systems, worse, 0.05, 15)
    ]
    assert got == expected and got


def test_report(spark):
    df = spark.createDataFrame(
        [("f", 7, 0, "a b c d e f g h", "a b c d e f g x", "a b c d e f g h")],
        "file_id string, code int, pos int, gold string, baseline string, good string",
    )
    report = compare.comparison_report(compare.compare_wide(df, ["good"])).first().report
    assert report == (
        "File: f (code 7)\nBaseline WER: 12.50%\nGold: a b c d e f g h\nBaseline: a b c d e f g x\n"
        "\nModel improvements:\n  1. good: WER 0.00% (12.50% better)\n     a b c d e f g h"
    )


def test_scores_are_computed_once(spark):
    """The qualifying test must not be pushed below the scores and repeat them."""
    df = spark.createDataFrame([("f", 0, "a", "b", "a")], "file_id string, pos int, gold string, baseline string, s string")
    plan = compare.compare_wide(df, ["s"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1  # one call scores the baseline and all systems


def test_languages(spark, rows):
    df = spark.createDataFrame([("hi_in",), ("ig_ng",), ("xx",), (None,)], "language string")
    mapped = languages.map_language(df, "iso3")
    assert rows(mapped) == [("hi_in", "hin"), ("ig_ng", "ibo"), ("xx", None), (None, None)]
    assert rows(languages.unmapped_languages(df, "iso3", "language"), "language", "n_rows") == [("xx", 1), (None, 1)]
    with pytest.raises(Exception, match="not supported"):
        languages.require_mapped(df, "iso3", "language").collect()
    names = spark.createDataFrame([("Ganda",), ("Igbo",), ("?",)], "language_name string")
    assert rows(languages.resolve_alias(names)) == [("?", None), ("Ganda", "lg_ug"), ("Igbo", "ig_ng")]
    assert languages.hypothesis_column("NLLB") == "nllb_translation_asr"
    with pytest.raises(ValueError):
        languages.hypothesis_column("none")
    assert languages.language_dim(spark).count() == len(languages.LANGUAGES)


def test_records(spark, rows):
    df = spark.createDataFrame(
        [("r", "h"), (None, "h"), ("r", None), ("r", " "), (" ", "h")], "ref string, hyp string"
    )
    assert rows(records.valid_pairs(df, "ref", "hyp")) == [("r", "h")]
    assert rows(records.pair_rejects(df, "ref", "hyp")) == [("blank", 2), ("missing_hyp", 1), ("missing_ref", 1)]
    assert rows(records.run_counts(df, "ref", "hyp")) == [(5, 1, 4)]
    both = spark.createDataFrame([("a", "b"), (None, "c")], "old string, new string")
    assert rows(records.rename_property(both, "old", "new")) == [("a",), ("c",)]
    assert records.rename_property(both, "old", "x").columns == ["x", "new"]
    assert records.rename_property(both, "none", "x") is both
    with pytest.raises(KeyError):
        records.rename_property(both, "none", "x", strict=True)
    stacked = records.stack(both, spark.createDataFrame([(1,)], "extra int"))
    assert stacked.columns == ["old", "new", "extra"] and stacked.count() == 3
    assert records.pending_rows(both, "new", "absent").count() == 2
    assert rows(records.pending_rows(both, "new", "old")) == [(None, "c")]


@pytest.mark.parametrize("n", [999, 1_000, 2_525, 50_000])
def test_top_of_any_size(spark, n):
    rnd = random.Random(n)
    rows = [(rnd.choice(["hot", "hot", "b", None]), -rnd.choice([0.25, 0.5, 300.0, rnd.random()]), rnd.randrange(3), i) for i in range(9_000)]
    df = spark.createDataFrame(rows, "language string, extreme double, first_spec int, pos int")
    top = compare.top_records_by(df, n, "language")
    want = set()
    for g in ("hot", "b", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: r[1:])
        want |= {(*r, k + 1) for k, r in enumerate(own[:n])}
    assert {tuple(r) for r in top.collect()} == want
    if n >= compare.PUSHED_LIMIT:
        # Windows go over one row a bin or a range, or over the rows of one range; no group is sorted in one task.
        plan = compare._survivors(df, n, ["language"])._jdf.queryExecution().optimizedPlan().toString() + top._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.split("\n") if "Window [" in line]
        assert windows and all("_range" in line or "_bin" in line for line in windows)


def test_a_long_top_list_scores_each_record_once(spark):
    scored = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score(i):
        scored.add(1)
        return -(i % 89) / 89

    df = spark.range(3_000).select(F.lit("hot").alias("language"), score("id").alias("extreme"), F.lit(0).alias("first_spec"), F.col("id").alias("pos"))
    top = compare.top_records_by(df, 1_500, "language").collect()
    assert sorted(r["rank"] for r in top) == list(range(1, 1_501)) and scored.value == 3_000


def test_bounds_of_groups_shuffle_no_record(spark):
    df = spark.range(5_000).select((F.col("id") % 2).alias("language"), (-F.col("id") / 5_000).alias("extreme"), F.lit(0).alias("first_spec"), F.col("id").alias("pos"))
    survivors = compare._survivors(df, 1_000, ["language"])
    assert survivors.groupBy("language").count().count() == 2 and survivors.count() < 2_100
    assert "BroadcastHashJoin" in survivors._jdf.queryExecution().sparkPlan().toString()
