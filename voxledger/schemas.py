"""Schemas of the records that the operators read and write."""

from __future__ import annotations

from pyspark.sql import types as T

TEXT = T.StringType()

# System columns that result records may carry.
SYSTEM_COLUMNS = (
    "whisper_transcript",
    "whisper_l",
    "whisper_l_ft",
    "whisper_m_ft",
    "seamless_translation",
    "translation",
    "asr_corrector_pred",
    "nllb_translation_asr",
)


def result_record(*systems: str) -> T.StructType:
    """A result record with one text column per system; every column may be absent."""
    names = systems or SYSTEM_COLUMNS
    return T.StructType(
        [T.StructField("file_name", TEXT), T.StructField("code", T.IntegerType())]
        + [T.StructField(name, TEXT) for name in names]
        + [T.StructField("gold_transcript", TEXT), T.StructField("gold_translation", TEXT)]
    )


LANGUAGE_INFO = T.StructType(
    [T.StructField("wav_codes", TEXT), T.StructField("codes", T.IntegerType()), T.StructField("transcript", TEXT)]
)

TRANSLATIONS = T.StructType([T.StructField("codes", T.IntegerType()), T.StructField("transcript", TEXT)])

TRANSLATION_PAIR = T.StructType([T.StructField("translation", T.MapType(TEXT, TEXT))])

AUDIO = T.StructType(
    [
        T.StructField("array", T.ArrayType(T.FloatType())),
        T.StructField("sampling_rate", T.IntegerType()),
        T.StructField("path", TEXT),
    ]
)

COMPARED_MODEL = T.StructType(
    [
        T.StructField("name", TEXT),
        T.StructField("transcription", TEXT),
        T.StructField("wer", T.DoubleType()),
        T.StructField("wer_diff", T.DoubleType()),
    ]
)

COMPARISON = T.StructType(
    [
        T.StructField("file_id", TEXT),
        T.StructField("code", T.IntegerType()),
        T.StructField("gold", TEXT),
        T.StructField("baseline", TEXT),
        T.StructField("wer_base", T.DoubleType()),
        T.StructField("models", T.ArrayType(COMPARED_MODEL)),
    ]
)
