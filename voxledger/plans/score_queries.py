"""Registered queries: error rates, BLEU, comparisons, roll-ups of scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxledger.functions import text
from voxledger.functions.alignment import add_alignment_counts
from voxledger.operators import compare, records, rollup, scoring
from voxledger.plans.registry import query
from voxledger.plans.workload import (
    LONG_SQL,
    MODEL_LANGUAGE,
    PAIRS_SQL,
    SYSTEMS,
    alignment_sql,
    bleu_score_sql,
    bleu_sql,
    detokenize_sql,
    edits_sql,
    norm_punct_sql,
    norm_wer_sql,
    pairs,
    strip_sql,
    systems_long,
)

GOLD = "gold_transcript"


def _src(ref: str, hyp: str, where: str = "TRUE", keys: str = "pos, language, region") -> str:
    return f"src AS (SELECT {keys}, {ref} AS ref, {hyp} AS hyp FROM pairs WHERE {where})"


_VALID_UNI = f"sys_uni IS NOT NULL AND {strip_sql('sys_uni')} <> ''"


@query(
    "wer_micro",
    f"""{PAIRS_SQL}, {LONG_SQL}, src AS (SELECT * FROM sys_long WHERE hyp IS NOT NULL AND {strip_sql('hyp')} <> ''),
    {edits_sql('src', 'ref', 'hyp')}
    SELECT language, system, CAST(sum(edits) AS BIGINT) AS edits, CAST(sum(ref_words) AS BIGINT) AS ref_words,
      count(*) AS n_pairs, round(sum(edits) / sum(ref_words), 6) AS wer FROM scored GROUP BY ALL""",
)
def wer_micro(spark, d):
    long = systems_long(pairs(spark, d), "pos", "language")
    return scoring.wer_micro(long, "ref", "hyp", "language", "system").withColumn("wer", F.round("wer", 6))


@query(
    "word_distance",
    f"{PAIRS_SQL}, {_src('gold_transcript', 'sys_plus')}, {edits_sql('src', 'ref', 'hyp')} SELECT pos, edits, ref_words FROM scored",
)
def word_distance(spark, d):
    df = pairs(spark, d).select("pos", F.col(GOLD).alias("ref"), F.col("sys_plus").alias("hyp"))
    return scoring.add_word_edits(df, "ref", "hyp").select("pos", "edits", "ref_words")


@query(
    "wer_row",
    f"""{PAIRS_SQL}, {_src('gold_transcript', 'sys_multi')}, {edits_sql('src', 'ref', 'hyp')}
    SELECT pos, round(edits / nullif(ref_words, 0), 6) AS wer FROM scored""",
)
def wer_row(spark, d):
    return scoring.row_wer(pairs(spark, d), GOLD, "sys_multi").select("pos", F.round("wer", 6).alias("wer"))


@query(
    "wer_macro",
    f"""{PAIRS_SQL}, {_src(norm_punct_sql('gold_transcript'), norm_punct_sql('sys_uni'), 'sys_uni IS NOT NULL')},
    {edits_sql('src', 'ref', 'hyp')}
    SELECT language, count(w) AS n_pairs, round(avg(w), 6) AS wer
    FROM (SELECT language, edits / nullif(ref_words, 0) AS w FROM scored) GROUP BY ALL""",
)
def wer_macro(spark, d):
    return scoring.wer_macro(pairs(spark, d), GOLD, "sys_uni", "language").withColumn("wer", F.round("wer", 6))


@query(
    "wer_norm_pair",
    f"""{PAIRS_SQL}, {_src(norm_wer_sql('gold_transcript'), norm_wer_sql('sys_uni'), 'sys_uni IS NOT NULL')}, {edits_sql('src', 'ref', 'hyp')}
    SELECT language, CAST(sum(edits) AS BIGINT) AS edits, CAST(sum(ref_words) AS BIGINT) AS ref_words,
      count(*) AS n_pairs, round(avg(edits / nullif(ref_words, 0)), 6) AS wer_mean,
      round(sum(edits) / sum(ref_words), 6) AS wer_pooled FROM scored GROUP BY ALL""",
)
def wer_norm_pair(spark, d):
    out = scoring.wer_normalized(pairs(spark, d), GOLD, "sys_uni", "language")
    return out.withColumns({c: F.round(c, 6) for c in ("wer_mean", "wer_pooled")})


@query(
    "base_wer",
    f"""{PAIRS_SQL}, {_src(norm_wer_sql('gold_transcript'), norm_wer_sql('sys_plus'))}, {edits_sql('src', 'ref', 'hyp')}
    SELECT pos, round(edits / nullif(ref_words, 0), 6) AS base_wer FROM scored""",
)
def base_wer(spark, d):
    df = pairs(spark, d).select("pos", GOLD, "sys_plus")
    return scoring.row_base_wer(df, GOLD, "sys_plus").select("pos", F.round("base_wer", 6).alias("base_wer"))


@query(
    "region_rollup",
    f"""{PAIRS_SQL}, {_src(norm_wer_sql('gold_transcript'), norm_wer_sql('sys_uni'), 'sys_uni IS NOT NULL')},
    {edits_sql('src', 'ref', 'hyp')}
    SELECT CASE WHEN grouping(region) = 1 THEN 'combined' ELSE region END AS dataset,
      round(avg(edits / nullif(ref_words, 0)), 6) AS mean_wer, count(edits / nullif(ref_words, 0)) AS n_rows
    FROM scored GROUP BY GROUPING SETS ((region), ())""",
)
def region_rollup(spark, d):
    complete = records.drop_any_null(pairs(spark, d).select("region", GOLD, "sys_uni"))
    scored = scoring.row_base_wer(complete, GOLD, "sys_uni")
    return rollup.region_rollup(scored, "base_wer").withColumn("mean_wer", F.round("mean_wer", 6))


@query(
    "sdi_row",
    f"{PAIRS_SQL}, {_src('gold_transcript', 'sys_plus')}, {alignment_sql('src', 'ref', 'hyp')} SELECT pos, subs, dels, ins, ref_words FROM aligned",
)
def sdi_row(spark, d):
    df = pairs(spark, d).select("pos", GOLD, "sys_plus")
    return add_alignment_counts(df, GOLD, "sys_plus").select("pos", "subs", "dels", "ins", "ref_words")


@query(
    "sdi_corpus",
    f"""{PAIRS_SQL}, {LONG_SQL}, src AS (SELECT * FROM sys_long WHERE hyp IS NOT NULL), {alignment_sql('src', 'ref', 'hyp')}
    SELECT language, system, subs, dels, ins, ref_words, round(subs / ref_words, 3) AS sub_rate, round(dels / ref_words, 3) AS del_rate,
      round(ins / ref_words, 3) AS ins_rate, round((subs + dels + ins) / ref_words, 3) AS wer FROM (
      SELECT language, system, CAST(sum(subs) AS BIGINT) AS subs, CAST(sum(dels) AS BIGINT) AS dels,
        CAST(sum(ins) AS BIGINT) AS ins, CAST(sum(ref_words) AS BIGINT) AS ref_words FROM aligned GROUP BY ALL)""",
)
def sdi_corpus(spark, d):
    long = systems_long(pairs(spark, d), "language")
    return scoring.alignment_rates(long, "ref", "hyp", "language", "system")


# Accented letters of the tables to free ASCII, as DuckDB's levenshtein counts bytes.
def _one_byte(t: str) -> str:
    return f"translate({t}, 'éóèñçüêäößí', 'ABCDEFGHIJK')"


@query(
    "cer",
    f"""{PAIRS_SQL}, {_src(norm_wer_sql('gold_transcript'), norm_wer_sql('sys_plus'))},
    e AS (SELECT language, levenshtein({_one_byte('ref')}, {_one_byte('hyp')}) AS edits, length(ref) AS ref_chars FROM src)
    SELECT language, CAST(sum(edits) AS BIGINT) AS edits, CAST(sum(ref_chars) AS BIGINT) AS ref_chars,
      round(avg(edits / nullif(ref_chars, 0)), 6) AS cer FROM e GROUP BY ALL""",
)
def cer(spark, d):
    return scoring.cer_mean(pairs(spark, d), GOLD, "sys_plus", "language").withColumn("cer", F.round("cer", 6))


_COUNTS = "match_1, match_2, match_3, match_4, total_1, total_2, total_3, total_4, hyp_len, ref_len"


def _bleu_query(src: str, smooth: bool = True) -> str:
    return f"""{PAIRS_SQL}, {src}, {bleu_sql('src', 'ref', 'hyp', 'language')}
    SELECT language, {_COUNTS}, round({bleu_score_sql(smooth)}, 6) AS bleu FROM pooled"""


@query("bleu_corpus", _bleu_query(_src(detokenize_sql("gold_transcript"), detokenize_sql("sys_uni"), _VALID_UNI)))
def bleu_corpus(spark, d):
    return scoring.corpus_bleu(pairs(spark, d), GOLD, "sys_uni", "language").withColumn("bleu", F.round("bleu", 6))


@query("bleu_by_lang", _bleu_query(_src(strip_sql("gold_transcript"), strip_sql("sys_multi"))))
def bleu_by_lang(spark, d):
    return scoring.stripped_bleu(pairs(spark, d), GOLD, "sys_multi", "language").withColumn("bleu", F.round("bleu", 6))


@query("bleu_unsmoothed", _bleu_query(_src("gold_transcript", "sys_plus"), smooth=False))
def bleu_unsmoothed(spark, d):
    return scoring.unsmoothed_bleu(pairs(spark, d), GOLD, "sys_plus", "language").withColumn("bleu", F.round("bleu", 6))


# Token ids stand-in: word lengths, with zero as padding.
_IDS_SQL = r"list_transform(list_filter(regexp_split_to_array(sys_multi, '\s+'), lambda w: w <> ''), lambda w: length(w) % 5)"


def _ids():
    return F.transform(text.tokenize("sys_multi"), lambda w: F.char_length(w) % 5)


@query(
    "gen_len",
    f"""{PAIRS_SQL} SELECT language, n_tokens, n_rows, round(n_tokens / n_rows, 6) AS gen_len FROM (
      SELECT language, CAST(sum(len(list_filter({_IDS_SQL}, lambda x: x <> 0))) AS BIGINT) AS n_tokens, count(*) AS n_rows
      FROM pairs GROUP BY ALL)""",
)
def gen_len(spark, d):
    out = scoring.generated_length(pairs(spark, d).withColumn("ids", _ids()), "ids", "language")
    return out.withColumn("gen_len", F.round("gen_len", 6))


_NORM_EDITS = edits_sql("norm", "nref", "nhyp")


@query(
    "eval_record",
    f"""{PAIRS_SQL}, src AS (SELECT pos, language, {strip_sql('gold_transcript')} AS ref, {strip_sql('sys_uni')} AS hyp FROM pairs WHERE sys_uni IS NOT NULL),
    norm AS (SELECT pos, language, {norm_wer_sql('gold_transcript')} AS nref, {norm_wer_sql('sys_uni')} AS nhyp,
      len(list_filter({_IDS_SQL}, lambda x: x <> 0)) AS n FROM pairs WHERE sys_uni IS NOT NULL),
    {_NORM_EDITS},
    w AS (SELECT language, round(avg(edits / nullif(ref_words, 0)), 4) AS wer, round(avg(n), 4) AS gen_len FROM scored GROUP BY ALL),
    {bleu_sql('src', 'ref', 'hyp', 'language')}
    SELECT language, round({bleu_score_sql()}, 4) AS bleu, wer, gen_len FROM pooled JOIN w USING (language)""",
)
def eval_record(spark, d):
    return scoring.evaluation_record(pairs(spark, d).withColumn("ids", _ids()), GOLD, "sys_uni", "ids", "language")


@query(
    "per_lang_summary",
    f"""{PAIRS_SQL}, src AS (SELECT pos, language, {strip_sql('gold_transcript')} AS ref, {strip_sql('sys_base')} AS hyp FROM pairs),
    norm AS (SELECT pos, language, {norm_wer_sql('gold_transcript')} AS nref, {norm_wer_sql('sys_base')} AS nhyp FROM pairs),
    {_NORM_EDITS},
    w AS (SELECT language, round(avg(edits / nullif(ref_words, 0)), 4) AS wer FROM scored GROUP BY ALL),
    {bleu_sql('src', 'ref', 'hyp', 'language')}
    SELECT language, round({bleu_score_sql()}, 4) AS bleu, wer FROM pooled JOIN w USING (language)""",
)
def per_lang_summary(spark, d):
    return scoring.language_summary(pairs(spark, d), GOLD, "sys_base", "language")


# Comparison: two neighbouring utterances share a record id, so the last one wins.
_REC_SQL = "concat(doc_id, '_', utt // 2)"


def _gathered(spark, d):
    df = pairs(spark, d).withColumn("rec_id", F.concat("doc_id", F.lit("_"), F.floor(F.col("utt") / 2)))
    systems = [(s, df.select("rec_id", "pos", s), s) for s in SYSTEMS[1:]]
    return compare.gather_systems(
        df, systems, id_key="rec_id", baseline_key="sys_base", gold_key=GOLD
    )


def _gathered_sql() -> str:
    def last(system: str) -> str:
        return (
            f"SELECT rec_id, {system} FROM recs WHERE {system} IS NOT NULL "
            "QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY pos DESC) = 1"
        )

    return f"""recs AS (SELECT *, {_REC_SQL} AS rec_id FROM pairs),
    base AS (SELECT rec_id AS file_id, code, gold_transcript AS gold, sys_base AS baseline, first_pos AS pos FROM (
      SELECT *, min(pos) OVER (PARTITION BY rec_id) AS first_pos FROM recs)
      QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY recs.pos DESC) = 1),
    sys AS (SELECT 0 AS spec, 'sys_uni' AS name, * FROM ({last('sys_uni')}) UNION ALL
      SELECT 1, 'sys_plus', * FROM ({last('sys_plus')}) UNION ALL SELECT 2, 'sys_multi', * FROM ({last('sys_multi')}))""".replace(
        "recs.pos DESC", "pos DESC"
    )


def _compare_sql(worse: bool, keys: str = "file_id, code, pos") -> str:
    """CTEs up to ``q``: qualifying (record, system) rows with place, extreme and first_spec."""
    sign = "<" if worse else ">"
    rank = "diff" if worse else "-diff"
    return f"""b0 AS (SELECT *, gold AS ref, baseline AS hyp FROM base), {edits_sql('b0', 'ref', 'hyp', 'b1')},
    s0 AS (SELECT {', '.join('base.' + k.strip() for k in keys.split(','))}, gold, spec, name, sys_uni AS transcription FROM base JOIN sys ON rec_id = file_id),
    {edits_sql('s0', 'gold', 'transcription', 's1')},
    d AS (SELECT s1.*, b1.edits / nullif(b1.ref_words, 0) AS wb, s1.edits / nullif(s1.ref_words, 0) AS ws,
      b1.edits / nullif(b1.ref_words, 0) - s1.edits / nullif(s1.ref_words, 0) AS diff FROM s1 JOIN b1 USING (file_id)),
    q AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY {rank}, spec) AS place,
      min({rank}) OVER (PARTITION BY file_id) AS extreme, min(spec) OVER (PARTITION BY file_id) AS first_spec
      FROM d WHERE diff {sign} 0 AND abs(diff) >= 0.001)"""


def _flat(compared):
    return compare.unnest_models(compared).select(
        "file_id",
        "code",
        "place",
        "name",
        "transcription",
        F.round("wer_base", 6).alias("wer_base"),
        F.round("wer", 6).alias("wer"),
        F.round("wer_diff", 6).alias("wer_diff"),
    )


_FLAT_SQL = """SELECT file_id, code, CAST(place AS INTEGER) AS place, name, transcription, round(wb * 100, 6) AS wer_base,
    round(ws * 100, 6) AS wer, round(diff * 100, 6) AS wer_diff FROM q"""


@query("compare_better", f"{PAIRS_SQL}, {_gathered_sql()}, {_compare_sql(False)} {_FLAT_SQL}")
def compare_better(spark, d):
    return _flat(compare.compare_wide(_gathered(spark, d), SYSTEMS[1:], min_diff=0.001))


@query("compare_worse", f"{PAIRS_SQL}, {_gathered_sql()}, {_compare_sql(True)} {_FLAT_SQL}")
def compare_worse(spark, d):
    return _flat(compare.compare_wide(_gathered(spark, d), SYSTEMS[1:], min_diff=0.001, worse=True))


@query("unnest_models", f"{PAIRS_SQL}, {_gathered_sql()}, {_compare_sql(False)} SELECT name, CAST(place AS INTEGER) AS place, count(*) AS n_records, CAST(sum(len(transcription)) AS BIGINT) AS n_chars FROM q GROUP BY ALL")
def unnest_models(spark, d):
    compared = compare.compare_wide(_gathered(spark, d), SYSTEMS[1:], min_diff=0.001)
    return compare.unnest_models(compared).groupBy("name", "place").agg(
        F.count("*").alias("n_records"), F.sum(F.char_length("transcription")).alias("n_chars")
    )


_BY_LANG_BASE = """base AS (SELECT file_name AS file_id, language, pos, gold_transcript AS gold, sys_base AS baseline FROM pairs),
    sys AS (SELECT 0 AS spec, 'sys_uni' AS name, file_name AS rec_id, sys_uni FROM pairs WHERE sys_uni IS NOT NULL UNION ALL
      SELECT 1, 'sys_plus', file_name, sys_plus FROM pairs UNION ALL SELECT 2, 'sys_multi', file_name, sys_multi FROM pairs)"""


def _wide(spark, d):
    return pairs(spark, d).select(
        F.col("file_name").alias("file_id"),
        "code",
        "language",
        "pos",
        F.col(GOLD).alias("gold"),
        F.col("sys_base").alias("baseline"),
        *SYSTEMS[1:],
    )


@query(
    "top_n_by_lang",
    f"""{PAIRS_SQL}, {_BY_LANG_BASE}, {_compare_sql(True, 'file_id, language, pos')}
    SELECT language, CAST(rank AS INTEGER) AS rank, file_id, round(extreme * 100, 6) AS extreme FROM (
      SELECT *, row_number() OVER (PARTITION BY language ORDER BY extreme, first_spec, pos) AS rank FROM q WHERE place = 1)
    WHERE rank <= 15""",
)
def top_n_by_lang(spark, d):
    compared = compare.compare_wide(_wide(spark, d), SYSTEMS[1:], min_diff=0.001, worse=True)
    top = compare.top_records_by(compared, 15, "language")
    return top.select("language", "rank", "file_id", F.round(F.col("extreme") * 100, 6).alias("extreme"))


@query(
    "top_2525_by_lang",
    f"""{PAIRS_SQL}, {_BY_LANG_BASE}, {_compare_sql(True, 'file_id, language, pos')}
    SELECT language, CAST(rank AS INTEGER) AS rank, file_id, round(extreme * 100, 6) AS extreme FROM (
      SELECT *, row_number() OVER (PARTITION BY language ORDER BY extreme, first_spec, pos) AS rank FROM q WHERE place = 1)
    WHERE rank <= 2525""",
)
def top_2525_by_lang(spark, d):
    """A limit past the one that Spark pushes below a shuffle."""
    compared = compare.compare_wide(_wide(spark, d), SYSTEMS[1:], min_diff=0.001, worse=True)
    top = compare.top_records_by(compared, 2525, "language")
    return top.select("language", "rank", "file_id", F.round(F.col("extreme") * 100, 6).alias("extreme"))


def _report_sql() -> str:
    model = r"""concat('  ', place, '. ', name, ': WER ', format('{:.2f}', ws * 100), '% (',
      format('{:.2f}', abs(diff) * 100), CASE WHEN diff < 0 THEN '% worse)' ELSE '% better)' END, E'\n     ', transcription)"""
    return f"""SELECT file_id, concat('File: ', file_id, ' (code ', any_value(code), E')\nBaseline WER: ',
      format('{{:.2f}}', any_value(wb) * 100), E'%\nGold: ', any_value(gold), E'\nBaseline: ', any_value(baseline),
      E'\n\nModel improvements:\n', string_agg({model}, E'\n' ORDER BY place)) AS report
    FROM q JOIN (SELECT file_id, baseline FROM base) USING (file_id)
    WHERE file_id IN (SELECT file_id FROM q WHERE place = 1 ORDER BY extreme, first_spec, pos LIMIT 15)
    GROUP BY file_id"""


@query("comparison_report", f"{PAIRS_SQL}, {_gathered_sql()}, {_compare_sql(False)} {_report_sql()}")
def comparison_report(spark, d):
    compared = compare.compare_wide(_gathered(spark, d), SYSTEMS[1:], min_diff=0.001)
    return compare.comparison_report(compare.top_records(compared, 15)).select("file_id", "report")


_GRID_LANGS = ("de", "en", "es", "fr")
_GRID_CELLS = ", ".join(f"round(avg(w) FILTER (WHERE test_lang = '{c}'), 6) AS {c}" for c in _GRID_LANGS)
_MODEL_CASE = "CASE system " + " ".join(f"WHEN '{s}' THEN '{m}'" for s, m in MODEL_LANGUAGE.items()) + " END"


@query(
    "cross_lang_grid",
    f"""{PAIRS_SQL}, {LONG_SQL}, src AS (SELECT *, {_MODEL_CASE} AS model_lang, language AS test_lang FROM sys_long
      WHERE hyp IS NOT NULL), {edits_sql('src', 'ref', 'hyp')}
    SELECT model_lang, {_GRID_CELLS} FROM (
      SELECT *, edits / nullif(ref_words, 0) AS w FROM scored WHERE model_lang <> test_lang) GROUP BY ALL""",
)
def cross_lang_grid(spark, d):
    long = systems_long(pairs(spark, d), "language")
    model = F.element_at(F.create_map(*[F.lit(x) for kv in MODEL_LANGUAGE.items() for x in kv]), F.col("system"))
    other = long.select(model.alias("model_lang"), F.col("language").alias("test_lang"), "ref", "hyp")
    scored = scoring.row_wer(other.filter("model_lang <> test_lang AND hyp IS NOT NULL"), "ref", "hyp")
    grid = rollup.cross_language_grid(scored, _GRID_LANGS, value="wer")
    return grid.select("model_lang", *[F.round(c, 6).alias(c) for c in _GRID_LANGS])
