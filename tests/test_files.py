import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxledger.operators import languages, mixing
from voxledger.schemas import LANGUAGE_INFO, result_record
from voxledger.sources import readers, writers
from voxledger.streaming import streams

SCHEMA = result_record("whisper_l")


def put(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content, encoding="utf-8")
    return str(path)


def test_json_arrays_with_tags_and_empty_file(spark, rows, tmp_path):
    put(tmp_path / "afri-5" / "sw_ke_afri.json", json.dumps([{"file_name": "a", "whisper_l": "é"}, {"code": 3}]))
    put(tmp_path / "indic-5" / "hi_in_indic.json", "[]")
    put(tmp_path / "indic-5" / "ta_in.json", json.dumps([{"file_name": "b"}]))
    df = readers.read_tagged(spark, f"{tmp_path}/*/*.json", SCHEMA)
    assert rows(df, "file_name", "code", "whisper_l", "language", "data_name") == sorted(
        [("a", None, "é", "sw_ke", "afri-5"), (None, 3, None, "sw_ke", "afri-5"), ("b", None, None, "ta_in", "indic-5")],
        key=repr,
    )
    assert readers.read_json_array(spark, f"{tmp_path}/indic-5/hi_in_indic.json", SCHEMA).count() == 0


def test_csv_keeps_short_and_quoted_rows_and_drops_long_ones(spark, rows, tmp_path):
    path = put(tmp_path / "i.csv", 'wav_codes,codes,transcript\na,1,"x, ""y""\nz"\nb,2\nc,3,t,extra\nd,4,t,\ne,,\n')
    kept = readers.read_csv(spark, path, LANGUAGE_INFO, skip_long_rows=True)
    assert rows(kept) == [("a", 1, 'x, "y"\nz'), ("b", 2, None), ("e", None, None)]


def test_splits_and_extensions(spark, tmp_path):
    train = put(tmp_path / "a.json", '{"file_name": "x"}\n{"file_name": "y"}\n')
    test = put(tmp_path / "b.jsonl", '{"file_name": "z"}\n')
    df = readers.read_splits(spark, {"train": train, "test": test}, SCHEMA)
    assert {(r.split, r.file_name) for r in df.collect()} == {("train", "x"), ("train", "y"), ("test", "z")}
    with pytest.raises(ValueError):
        readers.read_splits(spark, {"train": "a.csv"}, SCHEMA)


def test_prediction_lines_keep_file_order(spark, tmp_path):
    lines = [f" line {i} " if i % 4 else "   " for i in range(2000)]
    path = put(tmp_path / "p.txt", "\n".join(lines))
    got = readers.read_prediction_lines(spark, path).orderBy("line").collect()
    assert [r.value for r in got] == [s.strip() for s in lines if s.strip()]
    assert [r.line for r in got] == list(range(len(got)))


def test_optional_inputs(spark, tmp_path):
    good = put(tmp_path / "good.json", '[{"file_name": "a"}]')
    bad = put(tmp_path / "bad.json", '[{"file_name": ')
    df, skipped = readers.read_optional(spark, {"g": good, "b": bad, "m": f"{tmp_path}/none.json"}, SCHEMA)
    assert [(r.input, r.file_name) for r in df.collect()] == [("g", "a")]
    assert {(r.input, r.reason) for r in skipped.collect()} == {("b", "bad json"), ("m", "missing")}
    nothing, missing = readers.read_optional(spark, {"m": f"{tmp_path}/none.json"}, SCHEMA)
    assert nothing.count() == 0 and missing.count() == 1


def test_json_array_files_are_arrays(spark, tmp_path):
    df = spark.createDataFrame([(i, f"ü{i}") for i in range(50)], "i int, t string").repartition(3)
    path = f"{tmp_path}/out"
    writers.write_json_array(df, path)
    seen = []
    for part in (tmp_path / "out").glob("part-*"):
        seen += json.loads(part.read_text(encoding="utf-8"))
    assert sorted(r["i"] for r in seen) == list(range(50)) and seen[0]["t"].startswith("ü")
    writers.write_json_array(spark.range(9).coalesce(1).filter("id > 10"), f"{tmp_path}/none")
    assert [json.loads(p.read_text()) for p in (tmp_path / "none").glob("part-*")] == [[]]


def test_a_task_writes_its_records_as_several_arrays(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "ARRAY_CHARS", 1_000)
    df = spark.createDataFrame([(f"f{i}", i, "é" * 40) for i in range(200)], "file_name string, code long, whisper_l string").coalesce(1)
    path = f"{tmp_path}/out"
    writers.write_json_array(df, path)
    parts = [p.read_text(encoding="utf-8") for p in (tmp_path / "out").glob("part-*")]
    assert len(parts) > 10 and all(len(p) < 1_200 for p in parts) and sum(len(json.loads(p)) for p in parts) == 200
    assert rows(readers.read_json_array(spark, path, df.schema)) == rows(df)


def test_numbers_of_an_array_file_are_read_once(spark, tmp_path):
    path = put(tmp_path / "n.json", json.dumps([{"file_name": "a" * 50, "code": i} for i in range(2_000)]))

    def read():
        return sum(s.getBytesRead() for s in spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics())

    before = read()
    assert readers.read_json_array(spark, path, SCHEMA).agg({"code": "sum"}).first()[0] == 1_999_000
    assert read() - before < 3 * (tmp_path / "n.json").stat().st_size


def test_odd_whole_numbers_of_an_array_file(spark, tmp_path):
    odd = '1679.0, "7.00", " 8", 9.5, 1e3, "x", true, null, [1], {"a": 2}, 99999999999999999999, -0.0, -3, "", 1.5e0, 2147483648'
    path = put(tmp_path / "o.json", "[" + ", ".join(f'{{"code": {v}}}' for v in odd.split(", ")) + "]")
    df = readers.read_json_array(spark, path, T.StructType().add("code", T.IntegerType()))
    assert [r.code for r in df.collect()] == [1679, 7, 8, None, None, None, None, None, None, None, None, 0, -3, None, None, None]


def test_other_sinks(spark, rows, tmp_path):
    df = spark.createDataFrame([("a", 'x "q", y', "r1"), ("b", None, "r2")], "k string, t string, region string")
    writers.write_csv(df.select("k", "t"), f"{tmp_path}/csv")
    schema = T.StructType().add("k", T.StringType()).add("t", T.StringType())
    assert rows(readers.read_csv(spark, f"{tmp_path}/csv", schema)) == [("a", 'x "q", y'), ("b", None)]
    writers.write_partitioned(df, f"{tmp_path}/parts", "region", gather=True)
    assert rows(spark.read.json(f"{tmp_path}/parts"), "k", "region") == [("a", "r1"), ("b", "r2")]
    writers.write_text(df, "t", f"{tmp_path}/text")
    assert rows(spark.read.text(f"{tmp_path}/text")) == [("",), ('x "q", y',)]
    writers.write_json_lines(df, f"{tmp_path}/lines")
    assert spark.read.json(f"{tmp_path}/lines").count() == 2


def test_corpus_source(spark, rows, tmp_path):
    audio = F.struct(F.array(F.lit(1.0)).alias("array"), F.lit(16000).alias("sampling_rate"))
    df = spark.createDataFrame([("s1", "other"), ("s2", "validated")], "sentence string, split string")
    tagged = df.withColumns({"audio": audio, "corpus": F.lit("common_voice"), "config": F.lit("ig")})
    tagged.write.partitionBy("corpus", "config", "split").parquet(f"{tmp_path}/c")
    got = readers.read_corpus(spark, f"{tmp_path}/c", "common_voice", "ig", "validated")
    assert rows(got) == [([1.0], 16000, "s1")]
    assert readers.effective_split("common_voice", "sw", "validated") == "validated"


def test_streams_equal_batch(spark, rows, tmp_path):
    data = spark.createDataFrame([(i, "hi_in" if i % 3 else "yo_ng") for i in range(60)], "id int, language string")
    data.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = streams.file_stream(spark, f"{tmp_path}/in", data.schema, files_per_trigger=1)
    streams.run_to_files(languages.map_language(stream, "iso3"), f"{tmp_path}/out", f"{tmp_path}/s1")
    assert rows(spark.read.parquet(f"{tmp_path}/out")) == rows(languages.map_language(data, "iso3"))
    totals = streams.file_stream(spark, f"{tmp_path}/in", data.schema, files_per_trigger=1).groupBy("language").count()
    streams.run_totals(totals, f"{tmp_path}/totals", f"{tmp_path}/s2")
    assert rows(streams.read_totals(spark, f"{tmp_path}/totals")) == rows(data.groupBy("language").count())
    dim = spark.createDataFrame([(1, "one", 2), (1, "old", 1)], "k int, v string, p int")
    joined = streams.lookup_static(
        streams.file_stream(spark, f"{tmp_path}/in", data.schema), dim, "id", "k", "v", position="p", out="t"
    )
    streams.run_to_files(joined.filter("id < 3"), f"{tmp_path}/j", f"{tmp_path}/s3")
    assert rows(spark.read.parquet(f"{tmp_path}/j"), "id", "t") == [(0, ""), (1, "one"), (2, "")]


def test_a_cap_holds_over_triggers_and_restarts(spark, rows, tmp_path):
    table = [(i, ["a", "b", "c", None][i % 4], None if i % 5 == 0 else f"é{i}", 2**60 + i) for i in range(400)]
    data = spark.createDataFrame(table, "id long, s string, t string, big long")
    caps = {"a": 55, "b": 1_000, "c": None}
    for k in range(4):
        data.filter((F.col("id") >= 100 * k) & (F.col("id") < 100 * k + 100)).repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
        stream = streams.file_stream(spark, f"{tmp_path}/in", data.schema)
        streams.run_capped(streams.cap_stream(stream, "s", caps, ["id"]), f"{tmp_path}/out", f"{tmp_path}/state")
        so_far = data.filter(F.col("id") < 100 * k + 100)
        assert rows(spark.read.parquet(f"{tmp_path}/out")) == rows(mixing.cap_per_source(so_far, "s", caps, ["id"]))
    assert streams.cap_stream(data, "s", {"a": None}, ["id"]) is data


def test_a_task_passes_on_the_first_rows_only():
    batches = [pa.record_batch([pa.array(["a"] * 9_000), pa.array([(i * 7919 + k) % 50_021 if i % 100 else None for i in range(9_000)])], names=["s", "k"]) for k in range(6)]
    out = pa.Table.from_batches(streams._first_of_task("s", {"a": 700}, ["k"])(iter(batches)))
    every = sorted((v is not None, v or 0) for b in batches for v in b.column("k").to_pylist())
    assert [(v is not None, v or 0) for v in out.column("k").to_pylist()] == every[:700]


def test_totals_that_die_half_way_are_replayed(spark, rows, tmp_path):
    path = f"{tmp_path}/totals"
    first, second = (spark.createDataFrame([("a", n)], "k string, n long") for n in (1, 2))
    with pytest.raises(FileNotFoundError):
        streams.read_totals(spark, path)
    streams.store_totals(first, path, 0)
    # Dead in the middle of writing: files without the mark of a whole version.
    second.write.parquet(f"{path}/v{1:019d}")
    (tmp_path / "totals" / f"v{1:019d}" / "_SUCCESS").unlink()
    assert rows(streams.read_totals(spark, path)) == [("a", 1)]
    # Dead before the pointer was renamed: the version before counts.
    second.write.mode("overwrite").parquet(f"{path}/v{1:019d}")
    assert rows(streams.read_totals(spark, path)) == [("a", 1)]
    for _ in range(2):  # the batch is replayed
        streams.store_totals(second, path, 1)
        assert rows(streams.read_totals(spark, path)) == [("a", 2)]
    for k in (2, 3):
        streams.store_totals(first, path, k)
    assert streams._versions(spark, path) == [f"v{k:019d}" for k in (2, 3)]
    (tmp_path / "totals" / streams.POINTER).unlink()  # a rename under way on a file system without atomic renames
    assert rows(streams.read_totals(spark, path)) == [("a", 1)]


def test_tagged_files_and_directories(spark, rows, tmp_path):
    put(tmp_path / "afri-5" / "sw_ke_afri.json", json.dumps([{"file_name": "a", "code": 1}, {"file_name": "b"}]))
    put(tmp_path / "indic-5" / "hi_in_indic.json", json.dumps([{"file_name": "c", "code": "x"}]))
    schema = T.StructType().add("file_name", T.StringType()).add("code", T.LongType())
    got = readers.read_tagged(spark, f"{tmp_path}/*-5/*.json", schema)
    want = [("a", 1, "sw_ke", "afri-5"), ("b", None, "sw_ke", "afri-5"), ("c", None, "hi_in", "indic-5")]
    assert rows(got, "file_name", "code", "language", "data_name") == want
    odd = spark.createDataFrame([*want, ("d", 4, None, "a/b=c d"), ("e", 5, "é 漢", None)], "file_name string, code long, language string, data_name string")
    writers.write_partitioned(odd, f"{tmp_path}/parts", "data_name", "language")
    again = readers.read_tagged(spark, f"{tmp_path}/parts", schema, partitioned=True)
    assert rows(again, *odd.columns) == rows(odd)
    one = again.filter("language = 'sw_ke'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(language" in one
