"""Utterance tables derived from the given tables, in Spark and in SQL.

Every document is cut whole into utterances (sentences and lines).  Four recognition systems
are text edits of the gold utterance: a baseline without capitals and full stops, one that
drops words and sometimes gives nothing, one that inserts words, one that garbles spelling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxledger.session import spread

SYSTEMS = ("sys_base", "sys_uni", "sys_plus", "sys_multi")
# The language whose model each system column stands for in cross-language tables.
MODEL_LANGUAGE = {"sys_base": "es", "sys_uni": "en", "sys_plus": "fr", "sys_multi": "de"}
ISO3 = {"en": "eng", "fr": "fra", "de": "deu", "es": "spa"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    pieces = F.split(F.replace("text", F.lit(". "), F.lit(".\n")), "\n")
    return (
        spread(documents, "doc_id")
        .select("doc_id", "lang", "source", F.posexplode(pieces).alias("utt", "piece"))
        .select("doc_id", F.col("utt").cast("bigint").alias("utt"), "lang", "source", F.trim("piece").alias("gold"))
        .filter(F.col("gold") != "")
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = F.col("gold")
    mark = F.col("doc_id") + F.col("utt")
    shortened = F.replace(F.replace(gold, F.lit(" the "), F.lit(" ")), F.lit(" de "), F.lit(" "))
    return utterances(spark, sf_dir).select(
        "doc_id",
        "utt",
        (F.col("doc_id") * 1_000_000 + F.col("utt")).alias("pos"),
        F.concat(F.lit("test/"), "doc_id", F.lit("_"), "utt", F.lit(".wav")).alias("file_name"),
        F.col("doc_id").alias("code"),
        F.col("lang").alias("language"),
        F.when(F.col("lang").isin("en", "de"), "germanic").otherwise("romance").alias("region"),
        F.col("source").alias("data_name"),
        gold.alias("gold_transcript"),
        F.lower(F.regexp_replace(gold, "[.,]", "")).alias("sys_base"),
        F.when(mark % 17 == 0, None).when(mark % 19 == 0, " ").otherwise(shortened).alias("sys_uni"),
        F.replace(gold, F.lit("on"), F.lit("an o")).alias("sys_plus"),
        F.replace(F.lower(gold), F.lit("er"), F.lit("re")).alias("sys_multi"),
    )


def systems_long(df: DataFrame, *kept: str) -> DataFrame:
    """One row per (utterance, system): a narrow generator, no shuffle."""
    entries = [F.struct(F.lit(s).alias("system"), F.col(s).alias("hyp")) for s in SYSTEMS]
    return df.select(*kept, "gold_transcript", F.explode(F.array(*entries)).alias("_e")).select(
        *kept, F.col("gold_transcript").alias("ref"), "_e.system", "_e.hyp"
    )


UTTERANCES_SQL = r"""u AS (
  SELECT doc_id, i - 1 AS utt, lang, source, trim(piece) AS gold FROM (
    SELECT doc_id, lang, source,
      unnest(string_split(replace(text, '. ', E'.\n'), E'\n')) AS piece,
      generate_subscripts(string_split(replace(text, '. ', E'.\n'), E'\n'), 1) AS i
    FROM documents)
  WHERE trim(piece) <> '')"""

PAIRS_SQL = (
    "WITH "
    + UTTERANCES_SQL
    + r""", pairs AS (
  SELECT doc_id, utt, doc_id * 1000000 + utt AS pos, concat('test/', doc_id, '_', utt, '.wav') AS file_name,
    doc_id AS code, lang AS language,
    CASE WHEN lang IN ('en', 'de') THEN 'germanic' ELSE 'romance' END AS region, source AS data_name,
    gold AS gold_transcript,
    lower(regexp_replace(gold, '[.,]', '', 'g')) AS sys_base,
    CASE WHEN (doc_id + utt) % 17 = 0 THEN NULL WHEN (doc_id + utt) % 19 = 0 THEN ' '
      ELSE replace(replace(gold, ' the ', ' '), ' de ', ' ') END AS sys_uni,
    replace(gold, 'on', 'an o') AS sys_plus,
    replace(lower(gold), 'er', 're') AS sys_multi
  FROM u)"""
)

LONG_SQL = """sys_long AS (
  SELECT pos, doc_id, language, region, gold_transcript AS ref, 'sys_base' AS system, sys_base AS hyp FROM pairs UNION ALL
  SELECT pos, doc_id, language, region, gold_transcript, 'sys_uni', sys_uni FROM pairs UNION ALL
  SELECT pos, doc_id, language, region, gold_transcript, 'sys_plus', sys_plus FROM pairs UNION ALL
  SELECT pos, doc_id, language, region, gold_transcript, 'sys_multi', sys_multi FROM pairs)"""


def words_sql(text: str) -> str:
    return rf"list_filter(regexp_split_to_array({text}, '\s+'), lambda w: w <> '')"


def strip_sql(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


def norm_wer_sql(text: str) -> str:
    spans = strip_sql(rf"regexp_replace({text}, '\s*\[[^\]]+\]\s*', ' ', 'g')")
    marks = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~‘’“”…"
    plain = f"lower(translate({spans}, '{marks}', ''))"
    return strip_sql(rf"regexp_replace({plain}, '\s+', ' ', 'g')")


def norm_punct_sql(text: str) -> str:
    spaced = strip_sql(rf"regexp_replace(lower({text}), '\s+', ' ', 'g')")
    return rf"regexp_replace({spaced}, '\p{{P}}', '', 'g')"


def detokenize_sql(text: str) -> str:
    return rf"""regexp_replace({text}, '\s([?.!,"](?:\s|$))', '\1', 'g')"""


def blank_sql(text: str) -> str:
    return rf"({strip_sql(text)} = '')"


# Word edit distance of word lists r and h with distinct words v: a list-based dynamic program
# for short pairs; DuckDB's byte-wise levenshtein over one-byte word codes for long ones.
_DP = """list_reduce(h, lambda prev, w: list_reduce(range(1, len(r) + 1), lambda cur, i: list_append(cur,
  least(cur[i] + 1, prev[i + 1] + 1, prev[i] + (CASE WHEN r[i] = w THEN 0 ELSE 1 END))), [prev[1] + 1]),
  range(0, len(r) + 1))[len(r) + 1]"""
_CODED = """levenshtein(array_to_string(list_transform(r, lambda w: chr(list_position(v, w)::INTEGER)), ''),
  array_to_string(list_transform(h, lambda w: chr(list_position(v, w)::INTEGER)), ''))"""
_EDITS = f"""CASE WHEN r IS NULL OR h IS NULL THEN NULL WHEN r = h THEN 0
  WHEN len(r) = 0 THEN len(h) WHEN len(h) = 0 THEN len(r)
  WHEN len(r) * len(h) > 900 AND len(v) <= 126 THEN {_CODED} ELSE {_DP} END"""


def edits_sql(source: str, ref: str, hyp: str, name: str = "scored") -> str:
    """CTE with the columns of ``source`` plus ``edits`` and ``ref_words``."""
    return f"""{name} AS (
  SELECT * EXCLUDE (r, h, v), CAST({_EDITS} AS BIGINT) AS edits, CAST(len(r) AS BIGINT) AS ref_words FROM (
    SELECT *, list_distinct(list_concat(r, h)) AS v FROM (
      SELECT *, {words_sql(ref)} AS r, {words_sql(hyp)} AS h FROM {source})))"""


# Alignment counts of word lists r and h, one anti-diagonal per step.  A cell holds the cost from
# bit 42, the rank of the step (match or substitution, deletion, insertion) in two bits, then
# substitutions from bit 20, then deletions; the rank is cleared once the cell is chosen.
_FAR = "2305843009213693952::BIGINT"
_ALIGN = f"""list_reduce(range(1, len(r) + len(h) + 1), lambda a, s: [a[2], list_transform(range(0, len(r) + 1), lambda i:
    CASE WHEN s < i OR s - i > len(h) THEN {_FAR} ELSE least(
      CASE WHEN s > i THEN a[2][i + 1] + {(1 << 42) + (2 << 40)} ELSE {_FAR} END,
      CASE WHEN i > 0 THEN a[2][i] + {(1 << 42) + (1 << 40) + 1} ELSE {_FAR} END,
      CASE WHEN i > 0 AND s > i THEN a[1][i] + (CASE WHEN r[i] = h[s - i] THEN 0 ELSE {(1 << 42) + (1 << 20)} END)
        ELSE {_FAR} END) & {~(3 << 40)} END)],
  [list_transform(range(0, len(r) + 1), lambda i: {_FAR}),
   list_transform(range(0, len(r) + 1), lambda i: CASE WHEN i = 0 THEN 0 ELSE {_FAR} END)])[2][len(r) + 1]"""


def alignment_sql(source: str, ref: str, hyp: str, name: str = "aligned") -> str:
    """CTE with the columns of ``source`` plus subs, dels, ins and ref_words."""
    return f"""{name} AS (
  SELECT * EXCLUDE (r, h, x), (x >> 20) & 1048575 AS subs, x & 1048575 AS dels,
    (x >> 42) - ((x >> 20) & 1048575) - (x & 1048575) AS ins, CAST(len(r) AS BIGINT) AS ref_words FROM (
    SELECT *, CASE WHEN r = h THEN 0 ELSE {_ALIGN} END AS x FROM (
      SELECT *, {words_sql(ref)} AS r, {words_sql(hyp)} AS h FROM {source})))"""


# The 13a scheme in RE2 syntax.
def tokens_13a_sql(text: str) -> str:
    t = f"replace(replace(replace({text}, '<skipped>', ''), E'-\\n', ''), E'\\n', ' ')"
    t = f"""replace(replace(replace(replace({t}, '&quot;', '"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>')"""
    t = f"concat(' ', {t}, ' ')"
    t = rf"regexp_replace({t}, '([{{-~\[-` -&(-+:-@/])', ' \1 ', 'g')"
    t = rf"regexp_replace({t}, '([^0-9])([.,])', '\1 \2 ', 'g')"
    t = rf"regexp_replace({t}, '([.,])([^0-9])', ' \1 \2', 'g')"
    t = rf"regexp_replace({t}, '([0-9])(-)', '\1 \2 ', 'g')"
    return words_sql(t)


def bleu_sql(source: str, ref: str, hyp: str, group: str, name: str = "pooled") -> str:
    """CTEs that end in one row per group with match_1..4, total_1..4, hyp_len, ref_len.

    ``source`` needs a unique ``pos``.
    """

    def grams(side: str) -> str:
        return " UNION ALL ".join(
            f"SELECT pos, {n} AS n, unnest(list_transform(range(1, greatest(len({side}) - {n - 1}, 0) + 1), "
            f"lambda i: array_to_string({side}[i:i + {n - 1}], ' '))) AS g FROM {name}_t"
            for n in (1, 2, 3, 4)
        )

    sums = ", ".join(
        f"CAST(coalesce(sum(m.c) FILTER (WHERE m.n = {n}), 0) AS BIGINT) AS match_{n}" for n in (1, 2, 3, 4)
    )
    totals = ", ".join(
        f"CAST(coalesce(sum(greatest(len(t_h) - {n - 1}, 0)), 0) AS BIGINT) AS total_{n}" for n in (1, 2, 3, 4)
    )
    return f"""{name}_t AS (SELECT *, {tokens_13a_sql(ref)} AS t_r, {tokens_13a_sql(hyp)} AS t_h FROM {source}),
{name}_h AS (SELECT pos, n, g, count(*) AS c FROM ({grams('t_h')}) GROUP BY ALL),
{name}_r AS (SELECT pos, n, g, count(*) AS c FROM ({grams('t_r')}) GROUP BY ALL),
{name}_m AS (SELECT pos, n, sum(least({name}_h.c, {name}_r.c)) AS c FROM {name}_h JOIN {name}_r USING (pos, n, g) GROUP BY ALL),
{name}_a AS (SELECT {group}, {sums} FROM {name}_t t JOIN {name}_m m USING (pos) GROUP BY ALL),
{name}_b AS (SELECT {group}, {totals}, CAST(sum(len(t_h)) AS BIGINT) AS hyp_len, CAST(sum(len(t_r)) AS BIGINT) AS ref_len
  FROM {name}_t GROUP BY ALL),
{name} AS (SELECT * FROM {name}_b JOIN {name}_a USING ({group}))"""


def bleu_score_sql(smooth: bool = True) -> str:
    zeros = "+".join(f"(match_{n} = 0)::INT" for n in (1, 2, 3, 4))
    dead = "match_1 = 0 OR " + " OR ".join(f"total_{n} = 0" for n in (1, 2, 3, 4))
    if not smooth:
        dead = f"({zeros}) > 0 OR {dead}"
    logs = []
    for n in (1, 2, 3, 4):
        missed = "+".join(f"(match_{k} = 0)::INT" for k in range(1, n + 1))
        m = f"(CASE WHEN match_{n} = 0 THEN pow(0.5, {missed}) ELSE match_{n}::DOUBLE END)"
        logs.append(f"ln({m} / nullif(total_{n}, 0))")
    penalty = "(CASE WHEN hyp_len >= ref_len THEN 1.0 ELSE exp(1 - ref_len::DOUBLE / nullif(hyp_len, 0)) END)"
    scale = "100.0" if smooth else "1.0"
    return f"CASE WHEN {dead} THEN 0.0 ELSE {scale} * {penalty} * exp(({' + '.join(logs)}) / 4) END"
