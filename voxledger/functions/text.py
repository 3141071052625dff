"""Text scalar functions (Column in, Column out), all on the JVM.

White space means what Python's ``str.isspace`` means: the Unicode White_Space set plus the
four ASCII separator controls, hence the explicit class below instead of a bare ``\\s``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\x1c-\x1f]"

# The marks that the scoring clean-up removes.
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
EXTRA_PUNCTUATION = "‘’“”…"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c: Column | str) -> Column:
    """Remove leading and trailing (Unicode) white space."""
    return F.regexp_replace(_col(c), rf"(?U)^{WS}+|{WS}+$", "")


def collapse_ws(c: Column | str) -> Column:
    """Replace each run of white space by one space."""
    return F.regexp_replace(_col(c), rf"(?U){WS}+", " ")


def is_blank(c: Column | str) -> Column:
    """True for text of white space only; null stays null."""
    return ~_col(c).rlike(rf"(?U)[^\s\x1c-\x1f]")


def tokenize(c: Column | str) -> Column:
    """Words separated by white space, without empty words."""
    return F.array_remove(F.split(_col(c), rf"(?U){WS}+"), "")


def word_count(c: Column | str) -> Column:
    return F.array_size(tokenize(c)).cast("bigint")


def detokenize(c: Column | str) -> Column:
    """Drop the one white-space character before ``? . ! , "`` that ends a word."""
    return F.regexp_replace(_col(c), rf'(?U){WS}([?.!,"](?:{WS}|$))', "$1")


def clean_for_wer(c: Column | str) -> Column:
    """:func:`normalize_for_wer` without its white-space passes: the same words, cheaper.

    Marks outside the two punctuation lists (a danda, an inverted question mark) stay.
    """
    c = _col(c)
    unbracketed = F.regexp_replace(c, rf"(?U){WS}*\[[^\]]+\]{WS}*", " ")
    spans = F.when(F.contains(c, F.lit("[")), unbracketed).otherwise(c)
    return F.lower(F.translate(spans, ASCII_PUNCTUATION + EXTRA_PUNCTUATION, ""))


def normalize_for_wer(c: Column | str) -> Column:
    """Scoring clean-up: bracketed spans, ASCII and typographic punctuation, case, spaces."""
    return strip_ws(collapse_ws(clean_for_wer(c)))


def clean_unicode_punct(c: Column | str) -> Column:
    """:func:`normalize_unicode_punct` without its white-space passes: the same words, cheaper."""
    return F.regexp_replace(F.lower(_col(c)), r"\p{P}", "")


def normalize_unicode_punct(c: Column | str) -> Column:
    """Lower case, single spaces, and no character of a Unicode punctuation category.

    ASCII symbols outside those categories (dollar, plus, less, equals, greater, caret,
    backtick, bar, tilde) stay, unlike in :func:`normalize_for_wer`.
    """
    spaced = strip_ws(collapse_ws(F.lower(_col(c))))
    return F.regexp_replace(spaced, r"\p{P}", "")


def truncate_tokens(tokens: Column | str, limit: int) -> Column:
    """Keep the first ``limit`` tokens of a token array."""
    return F.slice(_col(tokens), 1, limit)


def strip_prefix(c: Column | str, prefix: str = "test/") -> Column:
    """Remove a literal prefix where present."""
    c = _col(c)
    return F.when(F.startswith(c, F.lit(prefix)), F.substring(c, len(prefix) + 1, 2**31 - 1)).otherwise(c)


def base_name(path: Column | str, index: Column | str, suffix: str = "") -> Column:
    """Last path component, or ``sample_<index>`` where the path is absent."""
    default = F.concat(F.lit("sample_"), _col(index).cast("string"), F.lit(suffix))
    return F.coalesce(F.substring_index(_col(path), "/", -1), default)


def iso1(code: Column | str) -> Column:
    """``hi_in`` -> ``hi``."""
    return F.substring_index(_col(code), "_", 1)


def with_source_prefix(c: Column | str, prefix: str | None) -> Column:
    """Prepend a task prefix to each input text; null text stays null."""
    return F.concat(F.lit(prefix or ""), _col(c))


def file_language(path: Column | str) -> Column:
    """File stem without a region suffix: ``.../afri-5/sw_ke_afri.json`` -> ``sw_ke``."""
    return F.regexp_replace(F.substring_index(_col(path), "/", -1), r"(_afri|_indic)?\.json$", "")


def parent_dir(path: Column | str) -> Column:
    """Name of the directory that holds the file."""
    return F.substring_index(F.substring_index(_col(path), "/", -2), "/", 1)
