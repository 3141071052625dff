"""Language codes: one small dimension, its aliases, and checks against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Code, model language name, two-letter code, script code, speech code, ISO-3 key.
LANGUAGES = (
    ("hi_in", "Hindi", "hi", "hin_Deva", "hin", "hin"),
    ("pa_in", "Punjabi", "pa", "pan_Guru", "pan", "pan"),
    ("ta_in", "Tamil", "ta", "tam_Taml", "tam", "tam"),
    ("te_in", "Telugu", "te", "tel_Telu", "tel", "tel"),
    ("ml_in", "Malayalam", "ml", "mal_Mlym", "mal", "mlm"),
    ("sw_ke", "Swahili", "sw", "swh_Latn", "swh", "swa"),
    ("ha_ng", "Hausa", "ha", "hau_Latn", "hau", "hau"),
    ("yo_ng", "Yoruba", "yo", "yor_Latn", "yor", "yor"),
    ("ig_ng", "Lingala", "ig", "ibo_Latn", "ibo", "ibo"),
    ("lg_ug", "Shona", "lg", "lug_Latn", "lug", "lug"),
    ("fr_fr", "French", "fr", "fra_Latn", "fra", None),
    ("en", None, None, "eng_Latn", None, None),
)
# Languages the model has no token for borrow a relative's.
OVERRIDES = {"lg_ug": "Shona", "ig_ng": "Lingala"}
# Several names lead to one code.
ALIASES = {
    "Hindi": "hi_in",
    "Punjabi": "pa_in",
    "Tamil": "ta_in",
    "Telugu": "te_in",
    "Malayalam": "ml_in",
    "Swahili": "sw_ke",
    "Yoruba": "yo_ng",
    "Hausa": "ha_ng",
    "Lingala": "ig_ng",
    "Shona": "lg_ug",
    "Igbo": "ig_ng",
    "Luganda": "lg_ug",
    "Ganda": "lg_ug",
}
# The languages of the two regions.
REGIONS = {
    "afri": ("ig_ng", "lg_ug", "sw_ke", "yo_ng", "ha_ng"),
    "indic": ("hi_in", "pa_in", "ta_in", "te_in", "ml_in"),
}
# Columns that hold the hypothesis of each mode.
MODE_COLUMNS = {
    "seamless": "seamless_translation",
    "seamless_indic": "translation",
    "nllb": "nllb_translation_asr",
    "gemini": "translation",
    "openai": "translation",
}
CODE_SYSTEMS = ("model_name", "hf_code", "script_code", "speech_code", "iso3")


def language_dim(spark: SparkSession) -> DataFrame:
    """One row per language with its code in each system and its region."""
    region = {code: name for name, codes in REGIONS.items() for code in codes}
    rows = [(*row, region.get(row[0])) for row in LANGUAGES]
    return spark.createDataFrame(rows, "language string, " + ", ".join(f"{c} string" for c in CODE_SYSTEMS) + ", region string")


def literal_map(mapping: dict[str, str]) -> Column:
    """A constant map expression; folded into the plan, so the lookup needs no join."""
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def code_map(system: str) -> dict[str, str]:
    at = CODE_SYSTEMS.index(system) + 1
    return {row[0]: row[at] for row in LANGUAGES if row[at] is not None}


def map_language(df: DataFrame, system: str, *, language: str = "language", out: str = "mapped", overrides: dict[str, str] | None = None) -> DataFrame:
    """Translate a language code into another code system; unknown codes give null.

    ``overrides`` take precedence (see ``OVERRIDES``).
    """
    return df.withColumn(out, F.element_at(literal_map({**code_map(system), **(overrides or {})}), F.col(language)))


def resolve_alias(df: DataFrame, *, name: str = "language_name", out: str = "language", aliases: dict[str, str] | None = None) -> DataFrame:
    """Language name (any of its aliases) to code; unknown names give null."""
    return df.withColumn(out, F.element_at(literal_map(aliases or ALIASES), F.col(name)))


def unmapped_languages(df: DataFrame, system: str, *columns: str) -> DataFrame:
    """Distinct codes in the given columns that the code system lacks, with their row counts."""
    known = list(code_map(system))
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("role"), F.col(c).alias("language")) for c in columns])).alias("x"))
    return (
        long.select("x.role", "x.language")
        .filter(F.col("language").isNull() | ~F.col("language").isin(known))
        .groupBy("role", "language")
        .agg(F.count("*").alias("n_rows"))
    )


def require_mapped(df: DataFrame, system: str, *columns: str) -> DataFrame:
    """Strict variant: the job fails on the first row with an unsupported language."""
    out = df
    for c in columns:
        supported = F.coalesce(F.col(c).isin(list(code_map(system))), F.lit(False))
        message = F.concat(F.lit(f"{c} not supported for {system}: "), F.coalesce(F.col(c), F.lit("null")))
        out = out.withColumn(c, F.when(supported, F.col(c)).otherwise(F.raise_error(message).cast("string")))
    return out


def region_of(language: Column | str) -> Column:
    language = F.col(language) if isinstance(language, str) else language
    return F.element_at(literal_map({code: name for name, codes in REGIONS.items() for code in codes}), language)


def hypothesis_column(mode: str) -> str:
    """Column that holds the hypothesis of a mode (case-insensitive)."""
    try:
        return MODE_COLUMNS[mode.lower()]
    except KeyError:
        raise ValueError(f"unknown mode {mode!r}; choose from {sorted(MODE_COLUMNS)}") from None


def hypothesis_by_mode(df: DataFrame, mode: str, *, out: str = "hypothesis") -> DataFrame:
    return df.withColumn(out, F.col(hypothesis_column(mode)))
