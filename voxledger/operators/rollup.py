"""Roll-ups: region means, word and audio totals, budgets, run selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxledger.functions.distance import error_rate
from voxledger.functions.text import is_blank, word_count
from voxledger.operators.ordering import with_ordinal, with_running


def region_rollup(df: DataFrame, value: str, *, region: str = "region") -> DataFrame:
    """Mean over rows of each region and of all rows together, from one aggregate.

    The combined mean weighs rows, so it is not the mean of the region means.
    """
    df = df.withColumn("_region", F.col(region))
    rolled = df.groupingSets([[F.col("_region")], []], F.col("_region")).agg(
        F.avg(value).alias("mean_wer"), F.count(value).alias("n_rows"), F.grouping("_region").alias("_all")
    )
    return rolled.select(
        F.when(F.col("_all") == 1, "combined").otherwise(F.col("_region")).alias("dataset"), "mean_wer", "n_rows"
    )


def words_per_entry(df: DataFrame, column: str, *group: str) -> DataFrame:
    """Entries, words and words per entry over texts that are not blank; 0.0 without any."""
    words = F.when(~is_blank(column), word_count(column))
    grouped = df.groupBy(*group).agg(
        F.count(words).alias("n_entries"), F.coalesce(F.sum(words), F.lit(0)).alias("n_words")
    )
    return grouped.withColumn("words_per_entry", F.coalesce(error_rate("n_words", "n_entries"), F.lit(0.0)))


def seconds_of(array: str, sampling_rate: str):
    """Duration of a decoded recording; null where it does not decode."""
    return F.try_divide(F.array_size(array).cast("double"), F.col(sampling_rate).cast("double"))


def audio_hours(df: DataFrame, array: str, sampling_rate: str, *group: str) -> DataFrame:
    """Totals and extremes of recording lengths.  ``n_total`` also counts undecodable rows."""
    timed = df.withColumn("_s", F.when(F.col(array).isNotNull(), seconds_of(array, sampling_rate)))
    total = F.coalesce(F.sum("_s"), F.lit(0.0))
    return timed.groupBy(*group).agg(
        F.count("*").alias("n_total"),
        F.count("_s").alias("n_decoded"),
        total.alias("total_seconds"),
        (total / 60).alias("total_minutes"),
        (total / 3600).alias("total_hours"),
        F.coalesce(F.avg("_s"), F.lit(0.0)).alias("avg_seconds"),
        F.coalesce(F.min("_s"), F.lit(0.0)).alias("min_seconds"),
        F.coalesce(F.max("_s"), F.lit(0.0)).alias("max_seconds"),
    )


def running_hours(
    df: DataFrame, array: str, sampling_rate: str, order: Sequence[str], partition: Sequence[str] = (), *, every: int = 100
) -> DataFrame:
    """Hours so far after each ``every`` rows of a source."""
    numbered = with_ordinal(df, order, partition, "_at")
    blocks = (
        numbered.withColumns({"_step": F.floor(F.col("_at") / every), "_s": seconds_of(array, sampling_rate)})
        .groupBy(*partition, "_step")
        .agg(F.sum("_s").alias("_s"), F.count("*").alias("_n"))
        .filter(F.col("_n") == every)
    )
    summed = with_running(blocks, "_s", "sum", "_step", partition, "_total")
    return summed.select(
        *partition, ((F.col("_step") + 1) * every).alias("n_processed"), (F.col("_total") / 3600).alias("hours")
    )


def step_budget(df: DataFrame, *group: str, epochs: int = 10, batch_size: int = 32) -> DataFrame:
    """Optimiser steps that cover each group ``epochs`` times."""
    return df.groupBy(*group).agg(
        F.count("*").alias("n_rows"), F.floor(F.count("*") * epochs / batch_size).alias("max_steps")
    )


def tag_list(df: DataFrame, tag: str, position: str, *, out: str = "tags") -> DataFrame:
    """Comma-separated distinct tags in order of first appearance.

    Repeats are folded before the one row that lists the tags is built.
    """
    first = df.filter(F.col(tag).isNotNull()).groupBy(tag).agg(F.min(position).alias("_at"))
    ordered = F.sort_array(F.collect_list(F.struct(F.col("_at"), F.col(tag).alias("_tag"))))
    return first.agg(F.array_join(F.transform(ordered, lambda x: x["_tag"]), ",").alias(out))


def best_run(df: DataFrame, run: str, step: str, value: str, *, greater_is_better: bool = True) -> DataFrame:
    """Best evaluation of each run; the earliest step among equals."""
    signed = F.col(value) if greater_is_better else -F.col(value)
    best = df.filter(F.col(value).isNotNull()).groupBy(run).agg(
        F.max_by(F.struct(step, value), F.struct(signed.alias("v"), (-F.col(step)).alias("s"))).alias("_best"),
        F.count("*").alias("n_evals"),
    )
    return best.select(
        run, F.col(f"_best.{step}").alias("best_step"), F.col(f"_best.{value}").alias("best_value"), "n_evals"
    )


def early_stop(
    df: DataFrame, run: str, step: str, value: str, *, patience: int = 2, greater_is_better: bool = True
) -> DataFrame:
    """Where each run stops: the first of ``patience`` evaluations in a row without a new best.

    ``stop_step`` is null for runs that never stop; ``best_value`` is the best up to the stop.
    """
    signed = F.col(value) if greater_is_better else -F.col(value)
    evals = with_ordinal(df.select(run, step, signed.alias("_v")), (step,), (run,), "_at")
    seen = with_running(evals, "_v", "max", "_at", (run,), "_best", include_current=False)
    improved = F.col("_best").isNull() | (F.col("_v") > F.col("_best"))
    marked = seen.withColumn("_improved_at", F.when(improved, F.col("_at")))
    gaps = with_running(marked, "_improved_at", "max", "_at", (run,), "_last")
    stopped = F.col("_at") - F.col("_last") >= patience
    result = gaps.groupBy(run).agg(
        F.min_by(F.struct(step, "_best", "_at"), F.when(stopped, F.col("_at"))).alias("_stop"),
        F.max("_v").alias("_overall"),
        F.count("*").alias("_n"),
    )
    best = F.coalesce("_stop._best", "_overall")
    return result.select(
        run,
        F.col(f"_stop.{step}").alias("stop_step"),
        F.coalesce(F.col("_stop._at") + 1, F.col("_n")).alias("n_evals"),
        (best if greater_is_better else -best).alias("best_value"),
    )


def last_checkpoints(df: DataFrame, run: str, step: str, keep: int) -> DataFrame:
    """The ``keep`` latest checkpoints of each run; the rank filter is pushed below the shuffle."""
    window = Window.partitionBy(run).orderBy(F.col(step).desc())
    return df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= keep).drop("_rank")


def cross_language_grid(
    df: DataFrame, languages: Sequence[str], *, model: str = "model_lang", test: str = "test_lang", value: str
) -> DataFrame:
    """Mean value of every ordered pair of different languages, test languages as columns.

    The grid has languages x languages cells whatever the data; pairs without rows are null.
    """
    codes = F.array(*[F.lit(c) for c in languages])
    spark = df.sparkSession
    models = spark.range(1).select(F.explode(codes).alias(model))
    scored = df.filter((F.col(model) != F.col(test)) & F.col(test).isin(list(languages)))
    cells = scored.groupBy(model).pivot(test, list(languages)).agg(F.avg(value))
    return models.join(cells, model, "left")


def match_by_language(
    left: DataFrame, right: DataFrame, mapping: Mapping[str, str], *, left_code: str, right_code: str
) -> DataFrame:
    """Pair file listings by language when one side uses another code system.

    ``mapping`` leads from the left code to the right one; codes must be equal, not contained.
    """
    code = F.element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), F.col(left_code))
    mapped = left.withColumn("_code", code)
    return mapped.join(right, mapped["_code"] == right[right_code]).drop("_code")
