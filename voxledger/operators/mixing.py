"""Mixing and sampling sources: interleave, cycle, cap, pair by position."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxledger.functions import text
from voxledger.operators.ordering import with_ordinal

#: Runs of positions in :func:`repeat_to_n`: so many, or more of at most this length.
RUNS, RUN = 256, 100_000


def interleave(
    df: DataFrame, source: str, sources: Sequence, order: Sequence[str], *, out: str = "mix_pos"
) -> DataFrame:
    """Round-robin over the listed sources, ending when one of them runs out.

    A source is out once its last row was taken, so shorter sources end the mix in their own
    turn.  ``out`` is the 0-based place in the mix.
    """
    index = F.array_position(F.array(*[F.lit(s) for s in sources]), F.col(source)).cast("bigint") - 1
    listed = df.filter(F.col(source).isin(list(sources)))
    numbered = with_ordinal(listed, order, (source,), "_round").withColumn("_index", index)

    sizes = listed.groupBy(index.alias("_index")).agg(F.count("*").alias("_size"))
    present = sizes.agg(
        F.min(F.struct("_size", "_index")).alias("_end"), F.collect_set("_index").alias("_seen")
    )  # at most one entry per listed source
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(len(sources) - 1).cast("bigint"))
    absent = F.array_min(F.array_except(every, F.col("_seen")))
    # An empty source ends the mix in the first round, before its own turn.
    end = present.select(
        F.when(absent.isNull(), F.struct((F.col("_end._size") - 1).alias("r"), F.col("_end._index").alias("i")))
        .otherwise(F.struct(F.lit(0).cast("bigint").alias("r"), (absent - 1).alias("i")))
        .alias("e")
    )
    place = F.struct(F.col("_round").alias("r"), F.col("_index").alias("i"))
    kept = numbered.filter(place <= end.scalar())
    return kept.select(*df.columns, (F.col("_round") * len(sources) + F.col("_index")).alias(out))


def interleave_splits(
    df: DataFrame, splits: str, order: Sequence[str], *, column: str = "split", out: str = "mix_pos"
) -> DataFrame:
    """``a+b`` interleaves splits a and b; a single name is that split in its own order."""
    return interleave(df, column, splits.split("+"), order, out=out)


def repeat_to_n(df: DataFrame, n: int | Column, order: Sequence[str], *, out: str = "repeat_pos") -> DataFrame:
    """Cycle through the table in order until ``n`` rows are produced."""
    spark = df.sparkSession
    n = (n if isinstance(n, Column) else F.lit(n)).cast("bigint")
    numbered = with_ordinal(df, order, out="_at")
    size = df.agg(F.count("*").alias("n")).scalar()
    # Runs of positions are dealt to many tasks, which list them; each takes its row by the rest of its division.
    length = F.least(F.lit(RUN), F.greatest(F.lit(1), F.ceil(F.col("_n") / RUNS))).cast("bigint")
    runs = spark.range(1).select(n.alias("_n")).filter((F.col("_n") > 0) & (size > 0)).withColumn("_length", length)
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0), F.col("_n") - 1), F.col("_length")))
    runs = runs.select("_n", "_length", starts.alias("_start")).repartition("_start")
    ends = F.least(F.col("_n"), F.col("_start") + F.col("_length")) - 1
    places = runs.select(F.explode(F.sequence("_start", ends)).alias("_place"))
    places = places.withColumn("_of", F.col("_place") % size)
    # Every place has its row; as a left join it is the places that stay spread over tasks.
    return places.join(numbered, F.col("_of") == F.col("_at"), "left").select(*df.columns, F.col("_place").alias(out))


def cap_per_source(
    df: DataFrame, source: str, caps: Mapping[str, int | None], order: Sequence[str]
) -> DataFrame:
    """First n rows of each source with a cap; sources without one pass through whole.

    Ranks are positions from range partitions, so a source of any size, and caps of any size, are
    spread over tasks; uncapped sources are not ranked.
    """
    limits = {k: v for k, v in caps.items() if v is not None}
    if not limits:
        return df
    capped = F.coalesce(F.col(source).isin(list(limits)), F.lit(False))
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]), F.col(source))
    ranked = with_ordinal(df.filter(capped), order, (source,), "_rank")
    return ranked.filter(F.col("_rank") < limit).drop("_rank").unionByName(df.filter(~capped))


def first_rows(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def zip_predictions(
    records: DataFrame,
    lines: DataFrame,
    *,
    record_order: Sequence[str],
    line_order: Sequence[str],
    line: str = "value",
    group: Sequence[str] = (),
    out: str = "asr_corrector_pred",
) -> DataFrame:
    """Pair records with prediction lines by position (within ``group``).

    Lines are stripped and blank lines dropped before pairing, so a blank line shifts every
    later one.  Unequal counts fail the job, as the pairing would be wrong.
    """
    predictions = lines.select(*group, *[c for c in line_order if c not in group], text.strip_ws(line).alias("_line"))
    predictions = with_ordinal(predictions.filter(F.col("_line") != ""), line_order, group, "_at")
    numbered = with_ordinal(records, record_order, group, "_at")
    right = predictions.select(
        *[F.col(g).alias(f"_g_{g}") for g in group], F.col("_at").alias("_at_line"), F.col("_line")
    )
    condition = numbered["_at"] == right["_at_line"]
    for g in group:
        condition = condition & (numbered[g] == right[f"_g_{g}"])
    paired = numbered.join(right, condition, "full")
    mismatch = F.raise_error(F.lit("the numbers of records and predictions differ")).cast("string")
    value = F.when(F.col("_at").isNull() | F.col("_at_line").isNull(), mismatch).otherwise(F.col("_line"))
    return paired.select(*[c for c in records.columns if c != out], value.alias(out))
