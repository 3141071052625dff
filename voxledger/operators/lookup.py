"""Key lookups.  A dictionary built from a file keeps the last value of a repeated key; here
that rule is explicit: the row with the greatest position wins.

The reduction runs as a partial aggregate, so a key with many copies is folded map-side.  No
dimension is broadcast by hint: its size is not known to this code, so the optimiser decides
from statistics.  Where it decides on a shuffle, a fact key with a third of all rows is split
by adaptive skew handling (see :func:`skew_ready`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_wins(dim: DataFrame, key: str, position: str, *values: str) -> DataFrame:
    """One row per non-null key: the values at its greatest position."""
    return (
        dim.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max_by(F.struct(*values), F.col(position)).alias("_v"))
        .select(key, *[F.col(f"_v.{v}").alias(v) for v in values])
    )


def skew_ready(dim: DataFrame, key: str) -> DataFrame:
    """Give an aggregated dimension a shuffle of its own below the join on ``key``.

    Adaptive execution splits a skewed join partition only when both inputs of the join come
    straight from a shuffle; an aggregate on the join key would sit in between.  The dimension
    is one row per key, so moving it once more is cheap next to one task with the hot key.
    """
    return dim.repartition(F.xxhash64(key))


def _joined(df: DataFrame, dim: DataFrame, key: str, dim_key: str, value: str, position: str, how: str) -> DataFrame:
    table = last_wins(dim, dim_key, position, value).select(
        F.col(dim_key).alias("_key"), F.col(value).alias("_value"), F.lit(True).alias("_found")
    )
    return df.join(skew_ready(table, "_key"), F.col(key) == F.col("_key"), how)


def gold_codes(
    df: DataFrame,
    info: DataFrame,
    *,
    file_name: str = "file_name",
    wav_codes: str = "wav_codes",
    codes: str = "codes",
    position: str = "pos",
    out: str = "code",
) -> DataFrame:
    """Recording to sentence code.  Records without a match keep the code they had."""
    joined = _joined(df, info, file_name, wav_codes, codes, position, "left")
    old = F.col(out) if out in df.columns else F.lit(None)
    value = F.when(F.col("_found"), F.col("_value")).otherwise(old)
    return joined.select(*[c for c in df.columns if c != out], value.alias(out))


GOLD_COLUMNS = {"translation": "gold_translation", "transcription": "gold_transcript"}


def gold_text(
    df: DataFrame,
    info: DataFrame,
    mode: str,
    *,
    code: str = "code",
    codes: str = "codes",
    transcript: str = "transcript",
    position: str = "pos",
) -> DataFrame:
    """Sentence code to gold text; the mode names the column to fill, any other mode is a no-op."""
    out = GOLD_COLUMNS.get(mode.lower())
    if out is None:
        return df
    joined = _joined(df, info, code, codes, transcript, position, "left")
    old = F.col(out) if out in df.columns else F.lit(None)
    value = F.when(F.col("_found"), F.col("_value")).otherwise(old)
    return joined.select(*[c for c in df.columns if c != out], value.alias(out))


def reference_join(
    df: DataFrame,
    info: DataFrame,
    hyp: str,
    *,
    file_name: str = "file_name",
    wav_codes: str = "wav_codes",
    transcript: str = "transcript",
    position: str = "pos",
    out: str = "reference",
) -> DataFrame:
    """Pairs to score: records with a hypothesis whose recording has a reference."""
    joined = _joined(df.filter(F.col(hyp).isNotNull()), info, file_name, wav_codes, transcript, position, "inner")
    return joined.select(*df.columns, F.col("_value").alias(out))


def translation_lookup(
    df: DataFrame,
    translations: DataFrame,
    *,
    key: str = "id",
    codes: str = "codes",
    transcript: str = "transcript",
    position: str = "pos",
    out: str = "translation",
) -> DataFrame:
    """Translation by sentence id; the empty string where there is none.

    Null translations are dropped before the last one is chosen.
    """
    joined = _joined(df, translations.na.drop(subset=[transcript]), key, codes, transcript, position, "left")
    return joined.select(*[c for c in df.columns if c != out], F.coalesce("_value", F.lit("")).alias(out))
