"""Record-level clean-up: renames, prefixes, null handling, pair validity, stacking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxledger.functions import text


def rename_property(df: DataFrame, old: str, new: str, *, strict: bool = False) -> DataFrame:
    """Rename a property.  Where both exist, the old value wins on the records that have it.

    A missing property leaves a list of records as it is; ``strict`` (a single object) raises.
    """
    if old not in df.columns:
        if strict:
            raise KeyError(f"property {old!r} not found")
        return df
    if new not in df.columns:
        return df.withColumnRenamed(old, new)
    return df.withColumn(new, F.coalesce(F.col(old), F.col(new))).drop(old)


def strip_file_prefix(df: DataFrame, *, column: str = "file_name", prefix: str = "test/") -> DataFrame:
    return df.withColumn(column, text.strip_prefix(column, prefix))


def drop_any_null(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def drop_null_in(df: DataFrame, *columns: str) -> DataFrame:
    return df.na.drop(subset=list(columns))


def pair_status(ref: str, hyp: str) -> Column:
    """``ok``, or why a pair cannot be scored: ``missing_ref``, ``missing_hyp``, ``blank``."""
    return (
        F.when(F.col(ref).isNull(), "missing_ref")
        .when(F.col(hyp).isNull(), "missing_hyp")
        .when(text.is_blank(ref) | text.is_blank(hyp), "blank")
        .otherwise("ok")
    )


def valid_pairs(df: DataFrame, ref: str, hyp: str) -> DataFrame:
    """Rows with both sides present and not blank."""
    return df.filter(F.col(ref).isNotNull() & F.col(hyp).isNotNull()).filter(
        ~text.is_blank(ref) & ~text.is_blank(hyp)
    )


def pair_rejects(df: DataFrame, ref: str, hyp: str, *group: str) -> DataFrame:
    """Rejected rows counted by reason."""
    return (
        df.withColumn("reason", pair_status(ref, hyp))
        .filter(F.col("reason") != "ok")
        .groupBy(*group, "reason")
        .agg(F.count("*").alias("n_rows"))
    )


def by_language(df: DataFrame, language: str, *, column: str = "language") -> DataFrame:
    return df.filter(F.col(column) == language)


def tag_language(df: DataFrame, config: str, *, out: str = "lang_code") -> DataFrame:
    return df.withColumn(out, F.lit(config))


def stack(*frames: DataFrame) -> DataFrame:
    """Bag union by name; columns that a frame lacks become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def pending_rows(df: DataFrame, source: str, target: str) -> DataFrame:
    """Rows with a source text and no target yet (absent and null are the same)."""
    if target not in df.columns:
        return df.filter(F.col(source).isNotNull())
    return df.filter(F.col(source).isNotNull() & F.col(target).isNull())


def run_counts(df: DataFrame, ref: str, hyp: str, *group: str) -> DataFrame:
    """Rows read, processed and skipped."""
    ok = pair_status(ref, hyp) == "ok"
    return df.groupBy(*group).agg(
        F.count("*").alias("n_read"),
        F.count_if(ok).alias("n_processed"),
        F.count_if(~ok).alias("n_skipped"),
    )
