"""The distributed job around a model: score rows, fill gaps, prepare requests.

A model is any ``load() -> predict`` where ``predict(list[str]) -> list[str]``.  ``load`` runs
once per task; only the input text crosses into Python, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxledger.operators.records import pending_rows

Predict = Callable[[list[str]], list[str]]

# The instruction texts sent with each recording.
TRANSLATE_PROMPT = "Translate this audio from {} to English."
EXACT_PROMPT = "Given this audio in {}, provide the exact English translation:"

OUTCOME = T.StructType([T.StructField("prediction", T.StringType()), T.StructField("error", T.StringType())])


def _outcomes(predict: Predict, texts: list[str]) -> list[tuple[str | None, str | None]]:
    """Predict a batch; when it fails or gives another number of texts, each half by itself.

    So one failing row costs a few more calls, and only failing rows are lost.
    """
    try:
        got = list(predict(texts))
        if len(got) != len(texts):
            raise ValueError(f"the model gave {len(got)} texts for {len(texts)}")
        return [(p, None) for p in got]
    except Exception as e:
        if len(texts) == 1:
            return [(None, f"{type(e).__name__}: {e}")]
        middle = len(texts) // 2
        return _outcomes(predict, texts[:middle]) + _outcomes(predict, texts[middle:])


def model_udf(load: Callable[[], Predict]):
    """Arrow UDF text -> (prediction, error); null text is not sent to the model."""

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predict = load()
        for texts in batches:
            out = pd.DataFrame({"prediction": None, "error": None}, index=range(len(texts)), dtype=object)
            known = [i for i, t in enumerate(texts) if t is not None]
            for i, (p, e) in zip(known, _outcomes(predict, [texts.iat[i] for i in known]) if known else []):
                out.iat[i, 0], out.iat[i, 1] = p, e
            yield out

    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(score, OUTCOME)


def score_rows(df: DataFrame, source: str, load: Callable[[], Predict], *, out: str = "prediction") -> DataFrame:
    """Add the model output and, for rows where the model failed, the error text."""
    scored = df.withColumn("_outcome", model_udf(load)(F.col(source)))
    kept = [c for c in df.columns if c not in (out, "error")]
    return scored.select(*kept, F.col("_outcome.prediction").alias(out), F.col("_outcome.error").alias("error"))


def split_outcomes(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that were scored, and rows that failed.  Store the scored table before splitting it."""
    return scored.filter(F.col("error").isNull()).drop("error"), scored.filter(F.col("error").isNotNull())


def fill_missing(df: DataFrame, source: str, target: str, load: Callable[[], Predict]) -> DataFrame:
    """Complete the target of pending rows; a failing row gets the empty text, done rows stay."""
    done = F.col(target) if target in df.columns else F.lit(None).cast("string")
    pending = done.isNull() & F.col(source).isNotNull()
    asked = df.withColumn("_outcome", model_udf(load)(F.when(pending, F.col(source))))
    value = F.when(pending, F.coalesce("_outcome.prediction", F.lit(""))).otherwise(done)
    return asked.select(*[c for c in df.columns if c != target], value.alias(target))


def stored_outcomes(df: DataFrame, key: str, target: str, path: str) -> DataFrame:
    """(key, target, error) of the rows scored so far; empty before the first run."""
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    schema = T.StructType([df.schema[key], T.StructField(target, T.StringType()), T.StructField("error", T.StringType())])
    return spark.read.schema(schema).parquet(path)


def score_pending(
    df: DataFrame, key: str, source: str, target: str, load: Callable[[], Predict], path: str, *, retry: bool = False, tasks: int | None = None
) -> None:
    """Score the pending rows whose key has no outcome below ``path`` and append what comes out.

    Each task's file is renamed into place when the task ends (version 2 of the output committer), so a job that
    dies loses only the tasks that were running; the next run scores the rest. ``tasks`` sets their number, and so the
    work that can be lost. Failed rows are stored with their error and scored again only with ``retry``. Of rows
    with one key the one with the least source text is scored; rows without a key stay pending. One run at a time.
    """
    waiting = pending_rows(df, source, target).filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(source).alias(source))
    done = stored_outcomes(df, key, target, path)
    done = done.filter(F.col("error").isNull()) if retry else done
    new = waiting.join(done.select(key), key, "left_anti")
    # By a hash of its own: a partitioning that equals the join's would be merged with it, and its tasks with each other.
    new = new.repartition(tasks, F.xxhash64(key)) if tasks else new
    scored = score_rows(new, source, load, out=target).select(key, target, "error")
    scored.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)


def fill_stored(df: DataFrame, key: str, source: str, target: str, path: str) -> DataFrame:
    """Complete the target of pending rows from the stored outcomes; done rows stay.

    A failed row gets the empty text; a pending row without an outcome stays null. A later success replaces an error.
    """
    outcomes = stored_outcomes(df, key, target, path).groupBy(F.col(key).alias("_key"))
    outcomes = outcomes.agg(F.coalesce(F.max(target), F.lit("")).alias("_filled"))
    done = F.col(target) if target in df.columns else F.lit(None).cast("string")
    value = F.coalesce(done, F.when(F.col(source).isNotNull(), F.col("_filled")))
    joined = df.join(outcomes, F.col(key) == F.col("_key"), "left")
    return joined.select(*[c for c in df.columns if c != target], value.alias(target))


def prompt(template: str, language: Column) -> Column:
    before, after = template.split("{}")
    return F.concat(F.lit(before), language, F.lit(after))


def request_table(
    df: DataFrame, audio: str, language: Column, *, model: str, template: str = TRANSLATE_PROMPT, out: str = "request"
) -> DataFrame:
    """One JSON request per row: instruction text and the recording in base64."""
    one_line = F.translate(F.base64(audio), "\r\n", "")
    body = F.struct(
        F.lit(model).alias("model"),
        prompt(template, language).alias("text"),
        F.struct(one_line.alias("data"), F.lit("wav").alias("format")).alias("input_audio"),
    )
    return df.withColumn(out, F.to_json(body))
