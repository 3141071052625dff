"""Readers.  Schemas are always explicit: no inference pass, and an empty array is fine."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxledger.functions import text
from voxledger.operators.ordering import numbered_in_ranges

CORRUPT = "_corrupt_record"


WHOLE = (T.LongType, T.IntegerType, T.ShortType, T.ByteType)


def _loose(schema: T.StructType) -> T.StructType:
    """Whole numbers as text, since files may write them as ``1679.0``."""
    return T.StructType([T.StructField(f.name, T.StringType()) if isinstance(f.dataType, WHOLE) else f for f in schema])


def _open(schema: T.StructType) -> T.StructType:
    """Whole numbers as variants: as text, each number of a multi-line file would be read from the file once more."""
    return T.StructType([T.StructField(f.name, T.VariantType()) if isinstance(f.dataType, WHOLE) else f for f in schema])


def _shown(c: Column) -> Column:
    """The text of a variant; null for a number with an exponent, which is no whole number."""
    return F.when(F.schema_of_variant(c) != "DOUBLE", F.try_variant_get(c, "$", "string"))


def _typed(c: Column, kind: T.DataType) -> Column:
    """Text as ``kind``; ``1679.0`` is a whole number, and what is no value of the kind is null."""
    whole = F.regexp_replace(c, r"^\s*([+-]?\d+)\.0*\s*$", "$1") if isinstance(kind, WHOLE) else c
    return whole.try_cast(kind)


def _narrow(schema: T.StructType, shown: Callable[[Column], Column] = lambda c: c) -> list[Column]:
    return [(_typed(shown(F.col(f.name)), f.dataType) if isinstance(f.dataType, WHOLE) else F.col(f.name)).alias(f.name) for f in schema]


def read_json_array(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """Files that each hold one JSON array of records (``[]`` gives no rows).

    A JSON array cannot be split, so one task reads each file; keep large data in many files, as
    :func:`voxledger.sources.writers.write_json_array` does.
    """
    return _json_array(spark, path, schema).select(*schema.names)


def _json_array(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    raw = spark.read.schema(_open(schema)).option("multiLine", True).json(path)
    return raw.select(*_narrow(schema, _shown), F.col("_metadata.file_path").alias("_path"))


def read_tagged(spark: SparkSession, glob: str, schema: T.StructType, *, partitioned: bool = False) -> DataFrame:
    """All files of a glob, tagged with language (file stem) and data name (parent directory).

    ``partitioned`` reads JSON lines below directories ``data_name=.../language=...``, as
    :func:`voxledger.sources.writers.write_partitioned` lays them out: splittable, and a filter on a tag reads its directories only.
    """
    if partitioned:
        tags = [T.StructField(c, T.StringType()) for c in ("data_name", "language")]
        raw = spark.read.schema(T.StructType([*_loose(schema).fields, *tags])).json(glob)
        return raw.select(*_narrow(schema), "language", "data_name")
    path = F.col("_path")
    return _json_array(spark, glob, schema).select(
        *schema.names, text.file_language(path).alias("language"), text.parent_dir(path).alias("data_name")
    )


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType,
    *,
    skip_long_rows: bool = False,
    strict: bool = False,
    multi_line: bool = True,
) -> DataFrame:
    """CSV with a header, columns by the header's names; a column that no file has is null.

    Short rows are filled with nulls; long rows are dropped on request, and else lose their last fields.
    ``strict`` fails on long rows and on values that are not of their type. Without ``multi_line`` no
    value may hold a line break, and files can be split over tasks. All files have one header.

    Everything is read as text with one column more than the header.  A row with exactly one
    field too many fits and is not marked; rows of any other size are marked as corrupt, and of
    those the long ones have text in the extra column.
    """
    extra = "_extra"
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("quote", '"').option("escape", '"')
    names = reader.csv(path).columns  # reads the header only
    wide = T.StructType([T.StructField(c, T.StringType()) for c in (*names, extra, CORRUPT)])
    raw = reader.schema(wide).option("enforceSchema", True).option("emptyValue", "").option("columnNameOfCorruptRecord", CORRUPT).csv(path)
    fits = F.col(CORRUPT).isNotNull() & F.col(extra).isNull()
    if skip_long_rows:
        raw = raw.filter(fits)
    elif strict:
        long_row = F.raise_error(F.concat(F.lit("a row has more fields than the header: "), F.coalesce(F.col(extra), F.lit(""))))
        raw = raw.withColumn(CORRUPT, F.when(fits, F.col(CORRUPT)).otherwise(long_row)).filter(F.col(CORRUPT).isNotNull())

    def value(f: T.StructField) -> Column:
        if f.name not in names:
            return F.lit(None).cast(f.dataType)
        given = F.nullif(F.col(f.name), F.lit(""))
        typed = _typed(given, f.dataType)
        if strict:
            bad = F.raise_error(F.concat(F.lit(f"{f.name} is no {f.dataType.simpleString()}: "), given)).cast(f.dataType)
            typed = F.when(given.isNotNull() & typed.isNull(), bad).otherwise(typed)
        return typed

    return raw.select(*[value(f).alias(f.name) for f in schema])


VALID_EXTENSIONS = ("json", "jsonl")


def read_splits(spark: SparkSession, files: Mapping[str, str], schema: T.StructType, *, array: bool = False) -> DataFrame:
    """Named splits from json or jsonl files, stacked with a ``split`` column."""
    for path in files.values():
        if path.rsplit(".", 1)[-1] not in VALID_EXTENSIONS:
            raise ValueError(f"not a json or jsonl file: {path}")
    parts = [
        spark.read.schema(schema).option("multiLine", array).json(path).withColumn("split", F.lit(split))
        for split, path in files.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines with a sort key that restores their order: file, block offset, row in the block."""
    return spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row_in_block"),
    )


LINE_ORDER = ("file_path", "block", "row_in_block")


def read_prediction_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Predictions, stripped, without blank lines, with their 0-based ``line`` in each file.

    The blocks in which a file is read are the ranges that its lines are numbered in.
    """
    stripped = read_lines(spark, path).withColumn("value", text.strip_ws("value")).filter(F.col("value") != "")
    numbered = numbered_in_ranges(stripped, LINE_ORDER[2:], LINE_ORDER[:1], LINE_ORDER[1:2], "line")
    return numbered.select("file_path", "line", "value")


# The text column of each corpus.
CORPUS_TEXT = {
    "fleurs": "transcription",
    "common_voice": "sentence",
    "naijavoices": "text",
    "yo_speech": "transcript",
}
# Fixed value: Igbo has no validated split in this corpus.
SPLIT_SUBSTITUTES = {("common_voice", "ig", "validated"): "other"}


def effective_split(corpus: str, config: str, split: str) -> str:
    return SPLIT_SUBSTITUTES.get((corpus, config, split), split)


def normalize_corpus(df: DataFrame, corpus: str, *, audio: str = "audio", keep: Sequence[str] = ()) -> DataFrame:
    """Any corpus to ``audio_array, sampling_rate, sentence``; but for ``keep`` other columns are not read."""
    return df.select(
        *keep,
        F.col(f"{audio}.array").alias("audio_array"),
        F.col(f"{audio}.sampling_rate").alias("sampling_rate"),
        F.col(CORPUS_TEXT[corpus]).alias("sentence"),
    )


def read_corpus(spark: SparkSession, base: str, corpus: str, config: str, split: str) -> DataFrame:
    """Normalised rows of one (corpus, config, split) of a partitioned Parquet table.

    The table is partitioned by corpus, config and split, so only that directory is listed.
    """
    split = effective_split(corpus, config, split)
    table = spark.read.option("basePath", base).parquet(f"{base}/corpus={corpus}/config={config}/split={split}")
    return normalize_corpus(table, corpus)


def path_exists(spark: SparkSession, path: str) -> bool:
    """True when the path or glob matches something, on any Hadoop file system."""
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop_path)
    return found is not None and len(found) > 0


def read_optional(
    spark: SparkSession, inputs: Mapping[str, str], schema: T.StructType
) -> tuple[DataFrame, DataFrame]:
    """Read the inputs that exist; report the missing ones, files that do not parse, and records with a mistyped number.

    Gives (records with an ``input`` column, skipped inputs with the reason).  A mistyped number is null in its record;
    the other records of its file are not touched.
    """
    present = {name: path for name, path in inputs.items() if path_exists(spark, path)}
    missing = [(name, path, "missing") for name, path in inputs.items() if name not in present]
    skipped = spark.createDataFrame(missing, "input string, path string, reason string")
    with_corrupt = T.StructType([*_open(schema).fields, T.StructField(CORRUPT, T.StringType())])
    empty = spark.createDataFrame([], with_corrupt).withColumns({"input": F.lit(""), "path": F.lit("")})
    parts = [
        spark.read.schema(with_corrupt)
        .option("multiLine", True)
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
        .withColumns({"input": F.lit(name), "path": F.col("_metadata.file_path")})
        for name, path in present.items()
    ]
    rows = reduce(DataFrame.unionByName, parts, empty)
    # Spark refuses to read the corrupt-record column alone, so the whole record is read.
    whole = F.length(F.to_json(F.struct(*schema.names))) >= 0
    mistyped = F.lit(False)
    for f in schema:
        if isinstance(f.dataType, WHOLE):
            given = F.col(f.name)
            mistyped = mistyped | (given.isNotNull() & ~F.is_variant_null(given) & _typed(_shown(given), f.dataType).isNull())
    bad = rows.filter(F.col(CORRUPT).isNotNull() & whole).select("input", "path", F.lit("bad json").alias("reason")).distinct()
    odd = rows.filter(F.col(CORRUPT).isNull() & mistyped).select("input", "path", F.lit("bad value").alias("reason"))
    good = rows.filter(F.col(CORRUPT).isNull() & whole).select(*_narrow(schema, _shown), "input")
    return good, skipped.unionByName(bad).unionByName(odd)
