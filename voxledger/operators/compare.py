"""Baseline against several systems: largest improvements or degradations per record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxledger.functions.distance import add_word_edits_of, error_rate
from voxledger.operators.ordering import with_ordinal
from voxledger.session import store


def gather_systems(
    baseline: DataFrame,
    systems: Sequence[tuple[str, DataFrame, str]],
    *,
    id_key: str,
    baseline_key: str,
    gold_key: str,
    code: str = "code",
    position: str = "pos",
) -> DataFrame:
    """One row per record id with the text of every system in a column of its own.

    ``systems`` holds (name, frame, transcription column).  All frames are stacked and folded in
    a single aggregate on the id: one shuffle whatever the number of systems, folded map-side
    first.  Rows without id or transcription do not count; the last row of a repeated id wins,
    while its place among the records is where the id first appeared.
    """

    def tagged(df: DataFrame, spec: int, trans: str, gold: Column, code_col: Column) -> DataFrame:
        return df.filter(F.col(id_key).isNotNull() & F.col(trans).isNotNull()).select(
            F.col(id_key).alias("file_id"),
            F.lit(spec).alias("_spec"),
            F.col(position).alias("_pos"),
            F.struct(F.col(trans).alias("text"), gold.alias("gold"), code_col.alias("code")).alias("_rec"),
        )

    code_type = baseline.schema[code].dataType if code in baseline.columns else T.IntegerType()
    code_col = F.col(code) if code in baseline.columns else F.lit(None).cast(code_type)
    stacked = tagged(baseline, -1, baseline_key, F.col(gold_key), code_col)
    for i, (_, df, trans) in enumerate(systems):
        stacked = stacked.unionAll(tagged(df, i, trans, F.lit(None).cast("string"), F.lit(None).cast(code_type)))

    def last_of(spec: int) -> Column:
        return F.max_by("_rec", F.when(F.col("_spec") == spec, F.col("_pos")))

    folded = stacked.groupBy("file_id").agg(
        last_of(-1).alias("_base"),
        F.min(F.when(F.col("_spec") == -1, F.col("_pos"))).alias("pos"),
        *[last_of(i).alias(f"_s{i}") for i in range(len(systems))],
    )
    return folded.filter(F.col("_base.gold").isNotNull()).select(
        "file_id",
        F.col("_base.code").alias("code"),
        "pos",
        F.col("_base.gold").alias("gold"),
        F.col("_base.text").alias("baseline"),
        *[F.col(f"_s{i}.text").alias(name) for i, (name, _, _) in enumerate(systems)],
    )


def compare_wide(
    df: DataFrame,
    systems: Sequence[str],
    *,
    gold: str = "gold",
    baseline: str = "baseline",
    min_diff: float = 0.0,
    worse: bool = False,
) -> DataFrame:
    """Compare system columns with the baseline column, inside the row (no shuffle).

    Keeps records with at least one system that improves on the baseline (or falls behind it,
    with ``worse``) by ``min_diff`` or more.  ``models`` lists those systems, most extreme
    first, ties in system order; rates and differences are percentages.  ``extreme`` and
    ``first_spec`` carry the ordering for :func:`top_records`.
    """
    kept = df.columns
    edits = ["_eb", *[f"_e{i}" for i in range(len(systems))]]
    scored = add_word_edits_of(df, gold, [baseline, *systems], edits, ref_words="_n")
    scored = scored.withColumn("_wb", error_rate("_eb", "_n"))

    def entry(i: int, name: str) -> Column:
        rate = error_rate(f"_e{i}", "_n")
        diff = F.col("_wb") - rate
        return F.struct(
            (diff if worse else -diff).alias("rank"),
            F.lit(i).alias("spec"),
            F.lit(name).alias("name"),
            F.col(name).alias("transcription"),
            (rate * 100).alias("wer"),
            (diff * 100).alias("wer_diff"),
        )

    entries = F.array(*[entry(i, name) for i, name in enumerate(systems)])
    qualifying = F.filter(entries, lambda x: (x["rank"] < 0) & (F.abs(x["rank"]) >= min_diff))
    ranked = scored.withColumn("_ranked", F.sort_array(qualifying))
    outcome = F.struct(
        F.transform(
            "_ranked",
            lambda x: F.struct(
                x["name"].alias("name"),
                x["transcription"].alias("transcription"),
                x["wer"].alias("wer"),
                x["wer_diff"].alias("wer_diff"),
            ),
        ).alias("models"),
        F.get("_ranked", F.lit(0))["rank"].alias("extreme"),
        F.array_min(F.transform("_ranked", lambda x: x["spec"])).alias("first_spec"),
    )
    # A plain filter on the scores would be pushed below them and score every row twice; a
    # filter on a generated column stays above its generator.
    generated = ranked.select(
        *[c for c in kept if c not in systems],
        (F.col("_wb") * 100).alias("wer_base"),
        F.explode_outer(F.when(F.array_size("_ranked") > 0, F.array(outcome))).alias("_outcome"),
    )
    return generated.filter(F.col("_outcome").isNotNull()).select(
        *[c for c in kept if c not in systems], "wer_base", "_outcome.*"
    )


RECORD_ORDER = ("extreme", "first_spec", "pos")


def top_records(compared: DataFrame, n: int) -> DataFrame:
    """The ``n`` records with the most extreme difference, in order.

    Ties keep the order in which records first qualified: by system, then by position.
    """
    return compared.orderBy(*RECORD_ORDER).limit(n)


#: Up to here Spark applies a rank limit before the shuffle (``spark.sql.optimizer.windowGroupLimitThreshold``).
PUSHED_LIMIT = 1_000
#: Bins of a unit of difference, and the largest difference that is told apart.
BINS, FARTHEST = 4_096, 256.0


def _survivors(compared: DataFrame, n: int, group: Sequence[str]) -> DataFrame:
    """The records that can be among the ``n`` most extreme of their group.

    Counts by group and bin of the difference are exact; the last bin that begins before rank n bounds the group. The
    bounds are stored, so that their size is known when the join is planned and the records need not be shuffled by group.
    """
    binned = compared.withColumn("_bin", F.floor(F.greatest(F.col("extreme"), F.lit(-FARTHEST)) * BINS))
    counts = binned.groupBy(*group, "_bin").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    last = begins.filter(F.col("_before") < n).groupBy(*group).agg(F.max("_bin").alias("_last"))
    bounds = store(last.select(*[F.col(g).alias(f"_g_{g}") for g in group], "_last"), "bounds")
    same = F.lit(True)
    for g in group:
        same = same & binned[g].eqNullSafe(bounds[f"_g_{g}"])
    return binned.join(bounds, same).filter(F.col("_bin") <= F.col("_last")).select(*compared.columns)


def top_records_by(compared: DataFrame, n: int, *group: str) -> DataFrame:
    """The ``n`` most extreme records of each group with their rank, for any ``n``; null is a group.

    A small limit is applied below the shuffle. For a larger one the records are stored once, so that none is scored
    again, and the survivors of a histogram are numbered in ranges, so no task holds a group.
    """
    if n < PUSHED_LIMIT:
        window = Window.partitionBy(*group).orderBy(*RECORD_ORDER)
        return compared.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= n)
    ranked = with_ordinal(_survivors(store(compared, "compared"), n, group), RECORD_ORDER, group, "_rank")
    return ranked.filter(F.col("_rank") < n).select(*compared.columns, (F.col("_rank") + 1).cast("int").alias("rank"))


def unnest_models(compared: DataFrame) -> DataFrame:
    """One row per (record, system), with the place of the system in its record."""
    kept = [c for c in compared.columns if c != "models"]
    long = compared.select(*kept, F.posexplode("models").alias("place", "_m"))
    return long.select(*kept, (F.col("place") + 1).alias("place"), "_m.*")


def _two_digits(c: Column) -> Column:
    return F.format_string("%.2f", F.bround(c, 2))


def comparison_report(compared: DataFrame, *, worse: bool = False, out: str = "report") -> DataFrame:
    """Readable text of one comparison record."""
    title = "\nModel degradations:" if worse else "\nModel improvements:"

    def lines(m: Column, i: Column) -> Column:
        return F.concat(
            F.lit("  "),
            (i + 1).cast("string"),
            F.lit(". "),
            m["name"],
            F.lit(": WER "),
            _two_digits(m["wer"]),
            F.lit("% ("),
            _two_digits(F.abs(m["wer_diff"])),
            F.when(m["wer_diff"] < 0, "% worse)").otherwise("% better)"),
            F.lit("\n     "),
            m["transcription"],
        )

    head = F.concat_ws(
        "\n",
        F.concat(F.lit("File: "), "file_id", F.lit(" (code "), F.coalesce(F.col("code").cast("string"), F.lit("None")), F.lit(")")),
        F.concat(F.lit("Baseline WER: "), _two_digits(F.col("wer_base")), F.lit("%")),
        F.concat(F.lit("Gold: "), F.col("gold")),
        F.concat(F.lit("Baseline: "), F.col("baseline")),
        F.lit(title),
    )
    return compared.withColumn(out, F.concat(head, F.lit("\n"), F.array_join(F.transform("models", lines), "\n")))
