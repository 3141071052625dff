"""Nested records: translation pairs, label batches, id masks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxledger.functions.text import iso1, truncate_tokens
from voxledger.operators.languages import code_map, literal_map
from voxledger.operators.lookup import skew_ready

IGNORE_INDEX = -100


def build_pairs(
    df: DataFrame,
    hyp: str,
    gold: str,
    *,
    language: str = "language",
    target_keys: Mapping[str, str] | None = None,
    out: str = "translation",
) -> DataFrame:
    """``{two-letter code: hypothesis, three-letter code: gold}`` of each row.

    Rows of a language without a target key, or with a missing side, give no pair.
    """
    target = F.element_at(literal_map(dict(target_keys or code_map("iso3"))), F.col(language))
    complete = target.isNotNull() & F.col(hyp).isNotNull() & F.col(gold).isNotNull()
    return df.filter(complete).withColumn(
        out, F.create_map(iso1(language), F.col(hyp).cast("string"), target, F.col(gold).cast("string"))
    )


def read_pairs(
    df: DataFrame, source_key: Column, target_key: Column, *, pair: str = "translation"
) -> DataFrame:
    """Both sides of each pair; a row that lacks either key is dropped whole."""
    sides = df.withColumns(
        {"source_text": F.element_at(pair, source_key), "target_text": F.element_at(pair, target_key)}
    )
    return sides.filter(F.col("source_text").isNotNull() & F.col("target_text").isNotNull()).drop(pair)


def label_batch(
    df: DataFrame,
    ids: str,
    *,
    batch_id: str = "batch_id",
    start_id: int,
    max_length: int | None = 448,
    out: str = "labels",
) -> DataFrame:
    """Truncate, pad to the longest of the batch with -100, drop a start token all rows share.

    The batch's length and start flag come from a partial aggregate joined back, and adaptive
    execution splits a hot batch in that join, so a batch of any size is spread over tasks.
    """
    cut = df.withColumn("_ids", truncate_tokens(ids, max_length) if max_length else F.col(ids))
    stats = cut.groupBy(F.col(batch_id).alias("_batch")).agg(
        F.max(F.array_size("_ids")).alias("_longest"),
        F.bool_and(F.coalesce(F.get("_ids", F.lit(0)) == start_id, F.lit(False))).alias("_started"),
    )
    joined = cut.join(skew_ready(stats, "_batch"), F.col(batch_id).eqNullSafe(F.col("_batch")))
    padding = F.array_repeat(F.lit(IGNORE_INDEX).cast("int"), F.col("_longest") - F.array_size("_ids"))
    padded = F.concat("_ids", padding)
    labels = F.when(F.col("_started"), F.slice(padded, F.lit(2), F.col("_longest"))).otherwise(padded)
    return joined.select(*[c for c in df.columns if c != out], labels.alias(out))


def swap_ids(ids: Column | str, old: int, new: int) -> Column:
    """Replace one id by another (padding to -100 before the loss, -100 to padding before decoding)."""
    return F.transform(ids, lambda x: F.when(x == old, F.lit(new)).otherwise(x))
