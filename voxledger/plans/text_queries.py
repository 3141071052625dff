"""Registered queries: text functions, record clean-up, language codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxledger.functions import text
from voxledger.operators import languages, records
from voxledger.plans.registry import query
from voxledger.plans.workload import (
    PAIRS_SQL,
    UTTERANCES_SQL,
    detokenize_sql,
    norm_punct_sql,
    norm_wer_sql,
    pairs,
    spread,
    strip_sql,
    table,
    utterances,
    words_sql,
)

DOC = "documents"


def documents(spark, d, *columns):
    return spread(table(spark, d, DOC).select("doc_id", "text", *columns), "doc_id")


@query("norm_wer", f"SELECT doc_id, {norm_wer_sql('text')} AS normalized FROM documents")
def norm_wer(spark, d):
    return documents(spark, d).select("doc_id", text.normalize_for_wer("text").alias("normalized"))


@query("norm_jiwer", f"SELECT doc_id, {norm_punct_sql('text')} AS normalized FROM documents")
def norm_jiwer(spark, d):
    return documents(spark, d).select("doc_id", text.normalize_unicode_punct("text").alias("normalized"))


_SPACED = r"""regexp_replace(text, '([?.!,"])', ' \1', 'g')"""


@query("detokenize", f"SELECT doc_id, {detokenize_sql(_SPACED)} AS detokenized FROM documents")
def detokenize(spark, d):
    spaced = F.regexp_replace("text", r'([?.!,"])', " $1")
    return documents(spark, d).select("doc_id", text.detokenize(spaced).alias("detokenized"))


@query(
    "tokenize",
    f"""SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, array_to_string(w, '|') AS words
    FROM (SELECT doc_id, {words_sql('text')} AS w FROM documents)""",
)
def tokenize(spark, d):
    words = documents(spark, d).select("doc_id", text.tokenize("text").alias("w"))
    return words.select("doc_id", F.array_size("w").cast("bigint").alias("n_words"), F.array_join("w", "|").alias("words"))


@query("strip_ws", f"SELECT doc_id, {strip_sql(chr(39) + '  ' + chr(39) + ' || text || chr(10) || chr(9)')} AS stripped FROM documents")
def strip_ws(spark, d):
    padded = F.concat(F.lit("  "), "text", F.lit("\n\t"))
    return documents(spark, d).select("doc_id", text.strip_ws(padded).alias("stripped"))


@query(
    "truncate_tokens",
    f"""SELECT doc_id, CAST(least(len(w), 128) AS BIGINT) AS n_kept, array_to_string(w[1:128], ' ') AS kept
    FROM (SELECT doc_id, {words_sql('text')} AS w FROM documents)""",
)
def truncate_tokens(spark, d):
    cut = documents(spark, d).select("doc_id", text.truncate_tokens(text.tokenize("text"), 128).alias("w"))
    return cut.select("doc_id", F.array_size("w").cast("bigint").alias("n_kept"), F.array_join("w", " ").alias("kept"))


@query("source_prefix", "SELECT doc_id, 'translate: ' || text AS input FROM documents")
def source_prefix(spark, d):
    return table(spark, d, DOC).select("doc_id", text.with_source_prefix("text", "translate: ").alias("input"))


@query(
    "strip_prefix",
    PAIRS_SQL + " SELECT pos, concat(doc_id, '_', utt, '.wav') AS file_name FROM pairs",
)
def strip_prefix(spark, d):
    return records.strip_file_prefix(pairs(spark, d)).select("pos", "file_name")


@query("iso1", "SELECT doc_id, lang AS iso1 FROM documents")
def iso1(spark, d):
    code = F.concat("lang", F.lit("_"), "source")
    return table(spark, d, DOC).select("doc_id", text.iso1(code).alias("iso1"))


@query(
    "base_name",
    """SELECT page_id, CASE WHEN page_id % 5 = 0 THEN concat('sample_', page_id)
    ELSE list_last(string_split(url, '/')) END AS file_name FROM pages""",
)
def base_name(spark, d):
    path = F.when(F.col("page_id") % 5 != 0, F.col("url"))
    return table(spark, d, "pages").select("page_id", text.base_name(path, "page_id").alias("file_name"))


@query("rename_property", PAIRS_SQL + " SELECT pos, coalesce(sys_uni, sys_plus) AS transcript FROM pairs")
def rename_property(spark, d):
    df = pairs(spark, d).select("pos", F.col("sys_uni").alias("old_text"), F.col("sys_plus").alias("transcript"))
    return records.rename_property(df, "old_text", "transcript")


@query("tag_lang", "SELECT doc_id, 'hi_in' AS lang_code FROM documents")
def tag_lang(spark, d):
    return records.tag_language(table(spark, d, DOC).select("doc_id"), "hi_in")


_LABELLED_SQL = """SELECT d.doc_id, d.source, CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE d.lang END AS lang, l.quality
    FROM documents d LEFT JOIN labels l USING (doc_id)"""


def _labelled(spark, d):
    docs = table(spark, d, DOC).select(
        "doc_id", "source", F.when(F.col("doc_id") % 11 != 0, F.col("lang")).alias("lang")
    )
    return docs.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")


@query("dropna_any", f"SELECT * FROM ({_LABELLED_SQL}) WHERE lang IS NOT NULL AND quality IS NOT NULL AND source IS NOT NULL")
def dropna_any(spark, d):
    return records.drop_any_null(_labelled(spark, d))


@query("dropna_subset", f"SELECT * FROM ({_LABELLED_SQL}) WHERE quality IS NOT NULL")
def dropna_subset(spark, d):
    return records.drop_null_in(_labelled(spark, d), "quality")


_VALID = rf"sys_uni IS NOT NULL AND {strip_sql('sys_uni')} <> '' AND {strip_sql('gold_transcript')} <> ''"


@query("valid_pairs", PAIRS_SQL + f" SELECT pos, gold_transcript, sys_uni FROM pairs WHERE {_VALID}")
def valid_pairs(spark, d):
    return records.valid_pairs(pairs(spark, d), "gold_transcript", "sys_uni").select("pos", "gold_transcript", "sys_uni")


@query(
    "pair_rejects",
    PAIRS_SQL
    + """ SELECT language, CASE WHEN sys_uni IS NULL THEN 'missing_hyp' ELSE 'blank' END AS reason, count(*) AS n_rows
    FROM pairs WHERE sys_uni IS NULL OR trim(sys_uni) = '' GROUP BY ALL""",
)
def pair_rejects(spark, d):
    return records.pair_rejects(pairs(spark, d), "gold_transcript", "sys_uni", "language")


@query("by_language", PAIRS_SQL + " SELECT pos, gold_transcript FROM pairs WHERE language = 'fr'")
def by_language(spark, d):
    return records.by_language(pairs(spark, d), "fr").select("pos", "gold_transcript")


@query(
    "hyp_by_mode",
    PAIRS_SQL + " SELECT pos, sys_plus AS hypothesis FROM pairs",
)
def hyp_by_mode(spark, d):
    renamed = pairs(spark, d).withColumnsRenamed({"sys_plus": "nllb_translation_asr", "sys_uni": "translation"})
    return languages.hypothesis_by_mode(renamed, "NLLB").select("pos", "hypothesis")


_CODES = [row[0] for row in languages.LANGUAGES] + ["xx_xx"]
_CODES_SQL = "[" + ", ".join(f"'{c}'" for c in _CODES) + "]"
_DOC_LANG_SQL = f"SELECT doc_id, {_CODES_SQL}[doc_id % {len(_CODES)} + 1] AS language FROM documents"


def _doc_languages(spark, d):
    at = (F.col("doc_id") % len(_CODES) + 1).cast("int")
    return table(spark, d, DOC).select("doc_id", F.element_at(F.array(*[F.lit(c) for c in _CODES]), at).alias("language"))


def _case_sql(column: str, mapping: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


@query(
    "lang_map",
    f"""SELECT doc_id, language, {_case_sql('language', languages.code_map('script_code'))} AS script_code,
    {_case_sql('language', {**languages.code_map('model_name'), **languages.OVERRIDES})} AS model_name,
    {_case_sql('language', languages.code_map('iso3'))} AS iso3 FROM ({_DOC_LANG_SQL})""",
)
def lang_map(spark, d):
    df = languages.map_language(_doc_languages(spark, d), "script_code", out="script_code")
    df = languages.map_language(df, "model_name", out="model_name", overrides=languages.OVERRIDES)
    return languages.map_language(df, "iso3", out="iso3")


_NAMES = [*languages.ALIASES, "Klingon"]
_NAMES_SQL = "[" + ", ".join(f"'{c}'" for c in _NAMES) + "]"


@query(
    "lang_alias",
    f"""SELECT doc_id, language_name, {_case_sql('language_name', languages.ALIASES)} AS language
    FROM (SELECT doc_id, {_NAMES_SQL}[doc_id % {len(_NAMES)} + 1] AS language_name FROM documents)""",
)
def lang_alias(spark, d):
    at = (F.col("doc_id") % len(_NAMES) + 1).cast("int")
    named = table(spark, d, DOC).select("doc_id", F.element_at(F.array(*[F.lit(c) for c in _NAMES]), at).alias("language_name"))
    return languages.resolve_alias(named)


@query(
    "lang_unmapped",
    f"""SELECT 'language' AS role, language, count(*) AS n_rows FROM ({_DOC_LANG_SQL})
    WHERE language IN ('en', 'xx_xx') GROUP BY ALL""",
)
def lang_unmapped(spark, d):
    return languages.unmapped_languages(_doc_languages(spark, d), "hf_code", "language")


@query(
    "words_per_entry",
    "WITH " + UTTERANCES_SQL + f""" SELECT language, n_entries, n_words, round(n_words / n_entries, 6) AS words_per_entry FROM (
      SELECT lang AS language, count(*) AS n_entries, CAST(sum(len({words_sql('gold')})) AS BIGINT) AS n_words
      FROM u GROUP BY ALL)""",
)
def words_per_entry(spark, d):
    from voxledger.operators import rollup

    counted = rollup.words_per_entry(utterances(spark, d).withColumnRenamed("lang", "language"), "gold", "language")
    return counted.withColumn("words_per_entry", F.round("words_per_entry", 6))


@query(
    "run_counts",
    PAIRS_SQL
    + """ SELECT language, count(*) AS n_read, count(*) FILTER (WHERE ok) AS n_processed,
      count(*) FILTER (WHERE NOT ok) AS n_skipped
    FROM (SELECT language, coalesce(trim(sys_uni) <> '', false) AS ok FROM pairs) GROUP BY ALL""",
)
def run_counts(spark, d):
    return records.run_counts(pairs(spark, d), "gold_transcript", "sys_uni", "language")


@query(
    "stack",
    """SELECT doc_id AS id, text, lang, NULL::BIGINT AS turn FROM documents UNION ALL
    SELECT item_id, text, NULL, NULL FROM benchmark UNION ALL
    SELECT conv_id, text, NULL, turn FROM conversations""",
)
def stack(spark, d):
    return records.stack(
        table(spark, d, DOC).select(F.col("doc_id").alias("id"), "text", "lang"),
        table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"),
        table(spark, d, "conversations").select(F.col("conv_id").alias("id"), "text", "turn"),
    )


@query("pending_rows", PAIRS_SQL + " SELECT pos, sys_plus FROM pairs WHERE sys_plus IS NOT NULL AND sys_uni IS NULL")
def pending_rows(spark, d):
    return records.pending_rows(pairs(spark, d), "sys_plus", "sys_uni").select("pos", "sys_plus")
