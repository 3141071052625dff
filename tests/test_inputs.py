import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxledger.operators import inference, mixing
from voxledger.sources import readers

SCHEMA = T.StructType([T.StructField("wav_codes", T.StringType()), T.StructField("codes", T.LongType()), T.StructField("transcript", T.StringType())])


def put(path, text):
    path.write_text(text)
    return str(path)


def test_csv_columns_go_by_their_names(spark, tmp_path, rows):
    path = put(tmp_path / "a.csv", "codes,extra,wav_codes,transcript\n1679.0,q,a.wav,hello\n7,q,b.wav\n8,q,c.wav,t,more\n")
    assert rows(readers.read_csv(spark, path, SCHEMA, skip_long_rows=True)) == [("a.wav", 1679, "hello"), ("b.wav", 7, None)]
    assert rows(readers.read_csv(spark, path, SCHEMA)) == [("a.wav", 1679, "hello"), ("b.wav", 7, None), ("c.wav", 8, "t")]
    with pytest.raises(Exception, match="more fields"):
        readers.read_csv(spark, path, SCHEMA, strict=True).collect()


def test_strict_csv_fails_on_values_of_another_type(spark, tmp_path, rows):
    path = put(tmp_path / "a.csv", "wav_codes,codes\na,x1\n")
    assert rows(readers.read_csv(spark, path, SCHEMA, multi_line=False)) == [("a", None, None)]
    with pytest.raises(Exception, match="codes is no bigint"):
        readers.read_csv(spark, path, SCHEMA, strict=True).collect()


def test_json_numbers_with_a_point_are_codes(spark, tmp_path, rows):
    path = put(tmp_path / "a.json", '[{"wav_codes": "a", "codes": 1679.0}, {"wav_codes": "b", "codes": 2}]')
    assert rows(readers.read_json_array(spark, path, SCHEMA), "wav_codes", "codes") == [("a", 1679), ("b", 2)]


def test_one_mistyped_record_loses_itself_only(spark, tmp_path, rows):
    path = put(tmp_path / "a.json", '[{"wav_codes": "a", "codes": 1}, {"wav_codes": "b", "codes": "zzz"}, {"wav_codes": "c", "codes": 3}]')
    good, skipped = readers.read_optional(spark, {"x": path, "gone": str(tmp_path / "none.json")}, SCHEMA)
    assert rows(good, "input", "wav_codes", "codes") == [("x", "a", 1), ("x", "b", None), ("x", "c", 3)]
    assert rows(skipped, "input", "reason") == [("gone", "missing"), ("x", "bad value")]


def test_a_model_that_loses_texts_is_an_error(spark, rows):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(9)], "i int, s string")

    def load():
        return lambda texts: [t.upper() for t in texts if t != "t4"]

    got = inference.score_rows(df, "s", load).orderBy("i").collect()
    assert [r.prediction for r in got] == [None if i == 4 else f"T{i}" for i in range(9)]
    assert [i for i, r in enumerate(got) if r.error] == [4]


def test_repeats_are_made_in_many_tasks(spark):
    df = spark.createDataFrame([(i,) for i in range(7)], "i int")
    out = mixing.repeat_to_n(df, 1000, ["i"])
    assert [r.i for r in out.orderBy("repeat_pos").collect()] == [k % 7 for k in range(1000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = mixing.repeat_to_n(df, 1000, ["i"])
        assert out.withColumn("task", F.spark_partition_id()).select("task").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_large_caps_need_no_whole_source_in_a_task(spark):
    df = spark.range(9000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("s"))
    out = mixing.cap_per_source(df, "s", {"a": 1750, "b": None}, ["id"])
    assert out.groupBy("s").count().orderBy("s").collect() == [("a", 1750), ("b", 3000)]
    # A window goes over one row a range, never over the rows of a source.
    windows = [line for line in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window [" in line]
    assert all("_range" in line for line in windows)
    assert out.filter("s = 'a'").agg(F.max("id")).first()[0] == 2624
