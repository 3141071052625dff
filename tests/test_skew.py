"""One key holds a third or more of all rows: the work must still be split."""

import pytest
from pyspark.sql import functions as F

from voxledger.operators import lookup, mixing, nested, ordering

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
    "spark.sql.shuffle.partitions": "8",
}


@pytest.fixture
def small_thresholds(spark):
    old = {k: spark.conf.get(k) for k in SETTINGS if spark.conf.get(k, None) is not None}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield spark
    for k in SETTINGS:
        spark.conf.set(k, old[k]) if k in old else spark.conf.unset(k)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_lookup_key_is_split(small_thresholds):
    spark = small_thresholds
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string"))
    facts = spark.range(0, 60_000, 1, 8).select(F.col("id"), key.alias("file_name"), F.sha2(F.col("id").cast("string"), 256).alias("t"))
    info = facts.select(F.col("file_name").alias("wav_codes"), F.col("id").alias("codes"), F.col("id").alias("pos"))
    out = lookup.gold_codes(facts, info)
    assert "skew=true" in final_plan(out)
    assert out.filter("file_name = 'hot' AND code <> 59997").count() == 0
    assert out.count() == 60_000


def test_hot_batch_is_split(small_thresholds):
    spark = small_thresholds
    batch = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id"))
    df = spark.range(0, 60_000, 1, 8).select("id", batch.alias("batch_id"), F.array(F.lit(1), F.col("id").cast("int")).alias("ids"))
    out = nested.label_batch(df, "ids", start_id=1)
    assert "skew=true" in final_plan(out)
    assert out.filter("labels[0] <> id").count() == 0


def test_hot_source_is_numbered_in_ranges(small_thresholds):
    spark = small_thresholds
    source = F.when(F.col("id") % 3 == 0, F.lit("b")).otherwise(F.lit("a"))
    df = spark.range(0, 30_000, 1, 8).select("id", source.alias("source"))
    mixed = mixing.interleave(df, "source", ["a", "b"], ["id"])
    assert mixed.count() == 2 * 10_000 + 0
    assert mixed.agg(F.max("mix_pos")).first()[0] == 2 * 10_000 - 1


def jobs(spark):
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))


def test_positions_run_no_job_and_store_nothing(small_thresholds):
    spark = small_thresholds
    df = spark.range(0, 30_000, 1, 8).select("id", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 5).alias("g"), F.sha2(F.col("id").cast("string"), 256).alias("t"))
    before = jobs(spark)
    numbered = ordering.with_ordinal(df, ["t"], ["g"], "n")
    plans = [numbered, mixing.cap_per_source(df, "g", {1: 10, 2: 4_000}, ["t"]), mixing.interleave(df, "g", [1, 2], ["t"]), mixing.repeat_to_n(df, F.lit(50_000), ["t"])]
    assert jobs(spark) == before
    assert all("Checkpoint" not in p._jdf.queryExecution().toString() and "ExistingRDD" not in p._jdf.queryExecution().toString() for p in plans)
    expected = {}
    for r in sorted(df.collect(), key=lambda r: r.t):
        expected.setdefault(r.g, []).append(r.id)
    got = {}
    for r in sorted(numbered.collect(), key=lambda r: r.n):
        got.setdefault(r.g, []).append(r.id)
        assert len(got[r.g]) == r.n + 1
    assert got == expected


def test_a_hot_source_is_spread_over_ranges(small_thresholds):
    """No range holds more than a small part of a source with a third of all rows."""
    spark = small_thresholds
    df = spark.range(0, 90_000, 1, 8).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("g"))
    sizes = ordering.with_range(df, ["g", "id"], "r").groupBy("g", "r").count()
    assert sizes.agg(F.max("count")).first()[0] < 90_000 / 20


def test_positions_of_empty_and_tied_tables(small_thresholds):
    spark = small_thresholds
    df = spark.createDataFrame([("a", 1)] * 50 + [(None, None)] * 3, "g string, k int")
    assert sorted((str(r.g), r.n) for r in ordering.with_ordinal(df, ["k"], ["g"], "n").collect()) == sorted([("a", i) for i in range(50)] + [("None", i) for i in range(3)])
    assert ordering.with_ordinal(df.limit(0), ["k"], out="n").count() == 0
    assert mixing.repeat_to_n(df, 0, ["k"]).count() == 0 and mixing.repeat_to_n(df, 130, ["g", "k"]).count() == 130
    assert mixing.repeat_to_n(spark.range(7), 250_001, ["id"]).agg(F.count("*"), F.max("repeat_pos"), F.sum("id")).first()[:] == (250_001, 250_000, sum(i % 7 for i in range(250_001)))
