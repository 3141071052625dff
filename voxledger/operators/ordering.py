"""Row positions and running values that no single task has to see whole.

``row_number`` over a partition sorts that whole partition in one task, which fails once one
source holds a third of a large table.  Here the keys (partition, order) are cut into ranges, rows are
numbered inside each range, and shifted by the sizes of the ranges before: one row per range
and group is all that the second step looks at.

The bounds of the ranges come from a mergeable sketch: of the distinct keys in each cell of a hash, the one with
the smallest hash.  They are a scalar subquery, so building a plan runs no job, and the range of a row is a
function of its key alone: the sizes and the numbers agree whichever task is run again, and no rows are stored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 65_536
#: Sketched keys a range, and the share of keys that the sketch looks at (one of so many).
KEYS_A_RANGE, ONE_OF = 16, 16
RANGES_A_PARTITION, MOST_RANGES = 8, 1 << 16


def _same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    condition = F.lit(True)
    for k in keys:
        condition = condition & a[k].eqNullSafe(b[f"_k_{k}"])
    return condition


def range_bounds(df: DataFrame, keys: Sequence[str], ranges: int) -> DataFrame:
    """One row ``bounds``: at most ``ranges`` keys in order that cut the distinct keys into ranges of about one size."""
    key, h = _key(keys), F.xxhash64(*keys)
    some = df.select(key.alias("_key"), h.alias("_h")).filter(F.pmod("_h", F.lit(ONE_OF)) == 0)
    cell = F.pmod(F.shiftright("_h", ONE_OF.bit_length() - 1), F.lit(ranges * KEYS_A_RANGE))
    picked = some.groupBy(cell.alias("_cell")).agg(F.min_by("_key", "_h").alias("_key"))
    listed = picked.agg(F.sort_array(F.collect_list("_key")).alias("_all"))
    return listed.select(F.filter("_all", lambda _, i: i % KEYS_A_RANGE == KEYS_A_RANGE - 1).alias("bounds"))


def _key(keys: Sequence[str]) -> Column:
    return F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)])


def with_range(df: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """Add the number of the range in which a row's key lies, found by halving."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(max(RANGES_A_PARTITION * partitions, 64), MOST_RANGES)
    bounds, key = range_bounds(df, keys, ranges).scalar(), _key(keys)
    at = F.col(out)
    df = df.withColumn(out, F.lit(0))
    for j in reversed(range(ranges.bit_length())):
        df = df.withColumn(out, F.when(F.get(bounds, at + ((1 << j) - 1)) <= key, at + (1 << j)).otherwise(at))
    return df


def numbered_in_ranges(df: DataFrame, order: Sequence[str], partition: Sequence[str], ranges: Sequence[str], out: str) -> DataFrame:
    """Add the 0-based position of each row, given columns whose values are ranges of the order one after the other.

    Each range is headed by a row with the number of rows in the ranges before it, and counted on from there: the rows are
    shuffled and sorted once and joined with nothing.
    """
    sizes = df.groupBy(*partition, *ranges).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*(partition or [F.lit(0)])).orderBy(*ranges).rowsBetween(Window.unboundedPreceding, -1)
    heads = sizes.withColumn("_n", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    kept = {*partition, *ranges}
    headed = df.withColumns({"_n": F.lit(1).cast("bigint"), "_row": F.lit(True)}).unionByName(
        heads.select(*kept, *[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema if f.name not in kept], "_n", F.lit(False).alias("_row"))
    )
    here = Window.partitionBy(*partition, *ranges).orderBy("_row", *order).rowsBetween(Window.unboundedPreceding, 0)
    # A range without a head would mean that the two scans saw different ranges.
    lost = F.raise_error(F.lit("the ranges of the two scans differ")).cast("bigint")
    counted = headed.withColumns({out: F.sum("_n").over(here) - 1, "_headed": ~F.min("_row").over(here)})
    return counted.filter("_row").select(*df.columns, F.when(F.col("_headed"), F.col(out)).otherwise(lost).alias(out))


def with_ordinal(df: DataFrame, order: Sequence[str], partition: Sequence[str] = (), out: str = "ordinal") -> DataFrame:
    """Add the 0-based position of each row in its partition under a total order."""
    ranged = with_range(df, [*partition, *order], "_range")
    return numbered_in_ranges(ranged, order, partition, ["_range"], out).drop("_range")


def with_running(
    df: DataFrame,
    value: str,
    function: str,
    ordinal: str,
    partition: Sequence[str] = (),
    out: str = "running",
    *,
    include_current: bool = True,
) -> DataFrame:
    """Running ``sum`` or ``max`` along a dense ordinal, in blocks of bounded size.

    Each block is scanned by itself; the value carried into a block comes from the aggregates
    of the blocks before it.
    """
    aggregate = {"sum": F.sum, "max": F.max}[function]
    blocked = df.withColumn("_block", F.floor(F.col(ordinal) / BLOCK))
    totals = blocked.groupBy(*partition, "_block").agg(aggregate(value).alias("_total"))
    earlier = Window.partitionBy(*partition).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in (*partition, "_block")],
        aggregate("_total").over(earlier).alias("_carry"),
    )
    here = Window.partitionBy(*partition, "_block").orderBy(ordinal)
    here = here.rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    local = blocked.withColumn("_local", aggregate(value).over(here))
    joined = local.join(carried, _same_keys(local, carried, (*partition, "_block")))
    if function == "max":
        combined = F.greatest("_local", "_carry")
    else:
        combined = F.coalesce("_local", F.lit(0)) + F.coalesce("_carry", F.lit(0))
    return joined.select(*df.columns, combined.alias(out))
