"""Quality rules: robust multivariate outliers by minimum covariance determinant, per language and source.

Every text gets counts (see :func:`statistics`), taken row by row with built-in functions. Five
transformed statistics make a vector, in steps of 1/1024, so that sums are exact integers and results
do not depend on the order of rows. For every (lang, source) group:

1. Start: medians and median absolute deviations, distances with the diagonal matrix alone.
2. Concentration, ``steps`` times: keep the rows up to the ``share`` quantile of the distance, take
   their mean and covariance, measure all rows again. The determinant never grows.
3. The covariance is scaled so that the median squared distance is that of a chi-squared variable with
   five degrees of freedom (it is never shrunk); rows beyond ``cutoff`` are rejected.

Only moments of groups are shuffled: a dozen partial sums, however large a group is. Quantiles are
exact, as edges of logarithmic classes of the distance (32 to a doubling), which partial
aggregates count. The vectors are joined with the group table, which grows with the number of groups;
Spark picks the join by its size and can split a hot group.

Rules: null texts have no words. A null lang or source is a group of its own. Groups with fewer than
``least_rows`` rows that pass the base rules have no verdict and keep what the base rules keep; with ``wider`` they are
measured by the estimate of their language, or of all rows if the language has fewer as well. Variances have floors
(``FLOORS``), so a statistic that is constant in a group rejects no row for a small difference. ``base_failed``: fewer than 50 words, or more than half of
them in repeated windows of three.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxledger.llm.tables import BLANKS, blank_words, stored

SYMBOLS = "#*$%&|<>"
SCALE = 1024
DIMENSIONS = 5
CHI2_MEDIAN = 4.351460191  # median of chi-squared with 5 degrees of freedom
CLASSES = 32  # of distances, to a doubling


@dataclass(frozen=True)
class Parameters:
    share: float = 0.75
    steps: int = 4
    cutoff: float = 45.0  # chi-squared, 5 degrees of freedom: 1.5e-8
    least_rows: int = 20
    wider: bool = False  # small groups take the estimate of the next wider level


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long).

    Windows of three words are compared by 64-bit hashes inside one text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    made = docs.withColumn("__w", blank_words(F.col("text"))).withColumn("__n", F.array_size("__w"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    # Sorted (hash, place) of all windows; equal hashes stand side by side.
    spots = F.when(
        F.col("__n") >= 3,
        F.array_sort(F.transform(F.sequence(F.lit(1), F.col("__n") - 2), lambda i: F.struct(F.xxhash64(F.element_at("__w", i), F.element_at("__w", i + 1), F.element_at("__w", i + 2)).alias("h"), i.alias("i")))),
    )
    made = made.withColumn("__s", spots)
    size = F.array_size("__s")
    twice = F.filter(
        F.transform(
            F.col("__s"),
            lambda x, k: F.when(
                ((k > 0) & (F.get("__s", k - 1)["h"] == x["h"])) | ((k < size - 1) & (F.get("__s", k + 1)["h"] == x["h"])), x["i"]
            ),
        ),
        lambda i: i.isNotNull(),
    )
    made = made.withColumn("__at", F.array_sort(twice))
    # A window covers three words, or as many as there are up to the next repeated window.
    covered = F.aggregate(
        F.transform(F.col("__at"), lambda i, k: F.least(F.lit(3), F.coalesce(F.get("__at", k + 1) - i, F.lit(3)))), F.lit(0), lambda a, x: a + x
    )
    return made.withColumns(
        {
            "n_words": F.col("__n").cast("long"),
            "word_chars": F.char_length(F.translate(text, BLANKS, "")).cast("long"),
            "n_symbols": (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.array_size(lines) - F.array_size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        }
    ).drop("__w", "__n", "__s", "__at")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vector() -> list[Column]:
    """Five statistics in whole steps: word length, symbols, repeated words, repeated lines, length."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    raw = [
        F.log(F.col("word_chars") / n + 1),
        F.log(F.col("n_symbols") / n + F.lit(0.02)),
        F.sqrt(F.col("n_repeat_words") / n),
        F.log(F.col("n_dup_lines") + F.lit(1.0)),
        F.log(n + F.lit(10.0)) / 4,
    ]
    return [F.round(x * SCALE).cast("long") for x in raw]


#: Least standard deviations, in steps: word length, symbols, repeated words, repeated lines, length.
FLOORS = [x * SCALE for x in (0.08, 0.4, 0.1, 0.5, 0.1)]

X = [f"x{i}" for i in range(DIMENSIONS)]
PAIRS = [(i, j) for i in range(DIMENSIONS) for j in range(i + 1)]


def _distance(inverse: list[list[Column]], center: list[Column]) -> Column:
    """Squared length of the whitened vector: forward substitution with a lower triangular matrix."""
    total = F.lit(0.0)
    done: list[Column] = []
    for i in range(DIMENSIONS):
        y = F.col(X[i]) - center[i]
        for j in range(i):
            y = y - inverse[i][j] * done[j]
        done.append(y / inverse[i][i])
        total = total + done[i] * done[i]
    return total


def _measured(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows with ``d``, their squared distance under the center and triangle of their group."""
    own = rows.join(groups.withColumnRenamed("g", "__g"), F.col("g") == F.col("__g"))
    triangle = [[F.col(f"l{i}{j}") for j in range(i + 1)] for i in range(DIMENSIONS)]
    return own.withColumn("d", _distance(triangle, [F.col(f"c{i}") for i in range(DIMENSIONS)])).select("g", *X, "d")


def _edge() -> Column:
    """Class of a distance; the same classes for all groups."""
    return F.floor(F.log2(F.col("d") + F.lit(2.0**-20)) * CLASSES)


def _quantile(measured: DataFrame, share: float) -> DataFrame:
    """(g, edge): the class up to which at least ``share`` of a group's rows lie."""
    counts = measured.groupBy("g", _edge().alias("e")).agg(F.count(F.lit(1)).alias("n"))
    # A group has a few thousand classes at the most, whatever its rows.
    packed = counts.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("e", "n"))).alias("s"), F.sum("n").alias("all"))
    walked = F.aggregate(
        "s",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("e")),
        lambda a, x: F.struct((a["n"] + x["n"]).alias("n"), F.when(a["n"] < F.ceil(F.col("all") * share), x["e"]).otherwise(a["e"]).alias("e")),
    )
    return packed.select("g", walked["e"].alias("edge"))


def _triangle(moments: DataFrame) -> DataFrame:
    """Cholesky factor of the covariance of each group, with the floors' squares added to its diagonal.

    Without them a statistic that is constant in a group, such as no repeated line, would make every other value an outlier.
    """
    n = F.col("n").cast("double")
    made = moments.select("g", *[(F.col(f"s{i}") / n).alias(f"c{i}") for i in range(DIMENSIONS)], *[(F.col(f"s{i}{j}").cast("double") / n).alias(f"m{i}{j}") for i, j in PAIRS])
    for i in range(DIMENSIONS):
        for j in range(i + 1):
            value = F.col(f"m{i}{j}") - F.col(f"c{i}") * F.col(f"c{j}") + F.lit(FLOORS[i] ** 2 if i == j else 0.0)
            for k in range(j):
                value = value - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            made = made.withColumn(f"l{i}{j}", F.sqrt(F.greatest(value, F.lit(FLOORS[i] ** 2))) if i == j else value / F.col(f"l{j}{j}"))
    return made.drop(*[f"m{i}{j}" for i, j in PAIRS])


def _moments(rows: DataFrame) -> DataFrame:
    sums = [F.sum(F.col(X[i])).alias(f"s{i}") for i in range(DIMENSIONS)]
    squares = [F.sum((F.col(X[i]) * F.col(X[j])).cast("decimal(38,0)")).alias(f"s{i}{j}") for i, j in PAIRS]
    return rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *sums, *squares)


def estimates(rows: DataFrame, p: Parameters, least: int | None = None) -> DataFrame:
    """(g, n, centers, triangle, limit) of every group with ``least`` rows (``p.least_rows``): all that a verdict needs."""
    # Exact medians: the vectors have a bounded number of distinct steps.
    center = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n_rows"), *[F.percentile(x, 0.5).alias(f"c{i}") for i, x in enumerate(X)]).filter(F.col("n_rows") >= (p.least_rows if least is None else least))
    center = stored(center, "medians")
    away = rows.join(center.withColumnRenamed("g", "__g"), F.col("g") == F.col("__g"))
    spread = away.groupBy("g").agg(*[F.percentile(F.abs(F.col(x) - F.col(f"c{i}")), 0.5).alias(f"d{i}") for i, x in enumerate(X)])
    start = center.join(spread, "g")
    for i, j in PAIRS:
        start = start.withColumn(f"l{i}{j}", F.greatest(F.col(f"d{i}") * 1.4826, F.lit(FLOORS[i])) if i == j else F.lit(0.0))
    groups = stored(start.select("g", *[f"c{i}" for i in range(DIMENSIONS)], *[f"l{i}{j}" for i, j in PAIRS]), "mcd")
    for _ in range(p.steps):
        measured = _measured(rows, groups)
        edges = _quantile(measured, p.share).withColumnRenamed("g", "__g")
        inner = measured.join(edges, F.col("g") == F.col("__g")).filter(_edge() <= F.col("edge"))
        groups = stored(_triangle(_moments(inner)), "mcd")
    middle = _quantile(_measured(rows, groups), 0.5)
    # Consistency: the median distance stands for the median of chi-squared.
    limit = F.greatest(F.pow(F.lit(2.0), (F.col("edge") + 1) / CLASSES), F.lit(CHI2_MEDIAN)) * (p.cutoff / CHI2_MEDIAN)
    return groups.join(middle.select("g", limit.alias("limit")), "g")


def _wider(rows: DataFrame, p: Parameters) -> DataFrame | None:
    """The estimates of small groups, those of their language ``k`` or of all rows; None if no group is small."""
    counts = stored(rows.groupBy("g", "k").agg(F.count(F.lit(1)).alias("n")), "counts")
    small = F.col("n") < p.least_rows
    languages = counts.groupBy("k").agg(F.sum("n").alias("m"), F.max(small).alias("any_small")).filter("any_small")
    languages = stored(languages.withColumn("enough", F.col("m") >= p.least_rows).select("k", "enough"), "languages")
    kinds = {r["enough"] for r in languages.select("enough").distinct().collect()}
    if not kinds:
        return None
    wide = rows.join(languages.filter("enough").select("k"), "k", "left_semi").withColumn("g", F.col("k")).select("g", *X)
    if False in kinds:
        wide = wide.union(rows.select(F.lit("*").alias("g"), *X))
    found = estimates(wide, p, 1).withColumnRenamed("g", "level")
    level = F.when(F.col("enough"), F.col("k")).otherwise(F.lit("*")).alias("level")
    return counts.filter(small).join(languages, "k").select("g", level).join(found, "level").drop("level")


def verdicts(docs: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """(doc_id, n_words, the statistics, base_failed, kept, distance): a row for each row of ``docs``.

    ``distance`` is the squared Mahalanobis distance over the group's limit; null without a verdict.
    """
    counted = statistics(docs.select("doc_id", "text", "lang", "source")).drop("text")
    group = F.to_json(F.struct(F.coalesce("lang", F.lit("\x00")).alias("a"), F.coalesce("source", F.lit("\x00")).alias("b")))
    language = F.to_json(F.struct(F.coalesce("lang", F.lit("\x00")).alias("a")))
    rows = counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", group.alias("g"), language.alias("k"), *[x.alias(n) for x, n in zip(vector(), X, strict=True)])
    rows = stored(rows, "statistics")
    passed = rows.filter(~base_failed())
    found = estimates(passed, p)
    small = _wider(passed, p) if p.wider else None
    if small is not None:
        found = found.unionByName(small)
    found = found.withColumnRenamed("g", "__g")
    joined = rows.join(found, F.col("g") == F.col("__g"), "left")
    triangle = [[F.col(f"l{i}{j}") for j in range(i + 1)] for i in range(DIMENSIONS)]
    distance = _distance(triangle, [F.col(f"c{i}") for i in range(DIMENSIONS)]) / F.col("limit")
    out = joined.withColumn("base_failed", base_failed()).withColumn("distance", distance)
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= 1, F.lit(True))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")
