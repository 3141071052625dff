"""Word and character error rates and BLEU, per row and pooled.

Four word error rates live side by side and the names keep them apart: per row on raw words,
``micro`` (pooled edits over pooled words), ``macro`` (mean of rows on Unicode-cleaned text)
and the normalised pair (pooled and mean on scoring-cleaned text).  Groups are few and hot, so
every corpus figure is a ratio of sums that partial aggregation builds map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxledger.functions import bleu, text
from voxledger.functions.alignment import add_alignment_counts
from voxledger.functions.distance import add_char_edits, add_word_edits, error_rate
from voxledger.operators.records import valid_pairs


def _grouped(df: DataFrame, group: tuple[str, ...], *aggregates) -> DataFrame:
    return df.groupBy(*group).agg(*aggregates) if group else df.agg(*aggregates)


def row_wer(df: DataFrame, ref: str, hyp: str, *, out: str = "wer") -> DataFrame:
    """Word error rate of each row on raw words; null where the reference is empty."""
    return add_word_edits(df, ref, hyp).withColumn(out, error_rate("edits", "ref_words"))


def row_base_wer(df: DataFrame, ref: str, hyp: str, *, out: str = "base_wer") -> DataFrame:
    """Word error rate of each row on scoring-cleaned text."""
    scored = add_word_edits(df, text.clean_for_wer(ref), text.clean_for_wer(hyp), edits="_e", ref_words="_n")
    return scored.withColumn(out, error_rate("_e", "_n")).drop("_e", "_n")


def wer_micro(df: DataFrame, ref: str, hyp: str, *group: str) -> DataFrame:
    """Pooled edits over pooled reference words of the valid pairs; 0.0 without any."""
    scored = add_word_edits(valid_pairs(df, ref, hyp), ref, hyp)
    pooled = _grouped(
        scored,
        group,
        F.coalesce(F.sum("edits"), F.lit(0)).alias("edits"),
        F.coalesce(F.sum("ref_words"), F.lit(0)).alias("ref_words"),
        F.count("*").alias("n_pairs"),
    )
    return pooled.withColumn("wer", F.coalesce(error_rate("edits", "ref_words"), F.lit(0.0)))


def wer_macro(df: DataFrame, ref: str, hyp: str, *group: str) -> DataFrame:
    """Mean of row rates on Unicode-cleaned text; null without any pair."""
    present = df.filter(F.col(ref).isNotNull() & F.col(hyp).isNotNull())
    scored = add_word_edits(present, text.clean_unicode_punct(ref), text.clean_unicode_punct(hyp))
    return _grouped(
        scored.withColumn("_wer", error_rate("edits", "ref_words")),
        group,
        F.count("_wer").alias("n_pairs"),
        F.avg("_wer").alias("wer"),
    )


def wer_normalized(df: DataFrame, ref: str, hyp: str, *group: str) -> DataFrame:
    """Pooled rate and mean of row rates on scoring-cleaned text, over rows with both texts.  No such row at all is an error."""
    present = df.filter(F.col(ref).isNotNull() & F.col(hyp).isNotNull())
    scored = add_word_edits(present, text.clean_for_wer(ref), text.clean_for_wer(hyp))
    pooled = _grouped(
        scored.withColumn("_wer", error_rate("edits", "ref_words")),
        group,
        F.sum("edits").alias("edits"),
        F.sum("ref_words").alias("ref_words"),
        F.count("*").alias("n_pairs"),
        F.avg("_wer").alias("wer_mean"),
    )
    empty = F.raise_error(F.lit("the list of predictions and references cannot be empty")).cast("double")
    pooled_wer = F.when(F.col("n_pairs") == 0, empty).otherwise(error_rate("edits", "ref_words"))
    return pooled.withColumn("wer_pooled", pooled_wer)


def alignment_rates(df: DataFrame, ref: str, hyp: str, *group: str, digits: int = 3) -> DataFrame:
    """Pooled substitutions, deletions, insertions and their rates per reference word.

    Without reference words the three rates are 0 and the word error rate is infinite.
    """
    present = df.filter(F.col(ref).isNotNull() & F.col(hyp).isNotNull())
    pooled = _grouped(
        add_alignment_counts(present, ref, hyp),
        group,
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("subs", "dels", "ins", "ref_words")],
    )
    total = F.col("subs") + F.col("dels") + F.col("ins")

    def rate(c, default):
        return F.coalesce(F.round(error_rate(c, "ref_words"), digits), F.lit(default))

    return pooled.withColumns(
        {
            "sub_rate": rate("subs", 0.0),
            "del_rate": rate("dels", 0.0),
            "ins_rate": rate("ins", 0.0),
            "wer": rate(total, float("inf")),
        }
    )


def cer_mean(df: DataFrame, ref: str, hyp: str, *group: str) -> DataFrame:
    """Mean of row character error rates on scoring-cleaned text, with the pooled parts."""
    present = df.filter(F.col(ref).isNotNull() & F.col(hyp).isNotNull())
    scored = add_char_edits(present, text.normalize_for_wer(ref), text.normalize_for_wer(hyp))
    return _grouped(
        scored.withColumn("_cer", error_rate("edits", "ref_chars")),
        group,
        F.sum("edits").alias("edits"),
        F.sum("ref_chars").alias("ref_chars"),
        F.avg("_cer").alias("cer"),
    )


def corpus_bleu(
    df: DataFrame, ref: str, hyp: str, *group: str, detokenized: bool = False, smooth: bool = True
) -> DataFrame:
    """Corpus BLEU of the valid pairs with its pooled counts; 0.0 without any.

    Texts are detokenised first unless they already are.
    """
    pairs = valid_pairs(df, ref, hyp)
    sides = [F.col(ref), F.col(hyp)] if detokenized else [text.detokenize(ref), text.detokenize(hyp)]
    pooled = _grouped(bleu.add_bleu_counts(pairs, *sides), group, *bleu.pooled_counts())
    return pooled.withColumn("bleu", bleu.bleu_from_counts(smooth))


def stripped_bleu(df: DataFrame, ref: str, hyp: str, *group: str) -> DataFrame:
    """Corpus BLEU of stripped texts, one reference each."""
    present = df.filter(F.col(ref).isNotNull() & F.col(hyp).isNotNull())
    counts = bleu.add_bleu_counts(present, text.strip_ws(ref), text.strip_ws(hyp))
    return _grouped(counts, group, *bleu.pooled_counts()).withColumn("bleu", bleu.bleu_from_counts())


def unsmoothed_bleu(df: DataFrame, ref: str, hyp: str, *group: str) -> DataFrame:
    """BLEU between 0 and 1 without smoothing."""
    present = df.filter(F.col(ref).isNotNull() & F.col(hyp).isNotNull())
    counts = bleu.add_bleu_counts(present, ref, hyp)
    return _grouped(counts, group, *bleu.pooled_counts()).withColumn("bleu", bleu.bleu_from_counts(smooth=False))


def language_summary(df: DataFrame, ref: str, hyp: str, *group: str, digits: int = 4) -> DataFrame:
    """BLEU of stripped texts and mean normalised word error rate, from one pass over the rows."""
    present = df.filter(F.col(ref).isNotNull() & F.col(hyp).isNotNull())
    sides = text.strip_ws(ref), text.strip_ws(hyp), text.clean_for_wer(ref), text.clean_for_wer(hyp)
    counted = bleu.add_bleu_counts_and_edits(present, *sides).withColumn("_wer", error_rate("edits", "ref_words"))
    pooled = _grouped(counted, group, *bleu.pooled_counts(), F.avg("_wer").alias("_wer"))
    return pooled.select(
        *group,
        F.round(bleu.bleu_from_counts(), digits).alias("bleu"),
        F.round("_wer", digits).alias("wer"),
    )


def generated_length(df: DataFrame, ids: str, *group: str, pad: int = 0) -> DataFrame:
    """Mean number of tokens that are not padding."""
    kept = df.withColumn("_n", F.array_size(F.array_remove(ids, pad)).cast("bigint"))
    pooled = _grouped(kept, group, F.sum("_n").alias("n_tokens"), F.count("_n").alias("n_rows"))
    return pooled.withColumn("gen_len", error_rate("n_tokens", "n_rows"))


def evaluation_record(
    df: DataFrame, ref: str, hyp: str, ids: str, *group: str, pad: int = 0, digits: int = 4
) -> DataFrame:
    """BLEU, mean word error rate and mean generated length of rows with both texts, in one aggregate."""
    present = df.filter(F.col(ref).isNotNull() & F.col(hyp).isNotNull())
    sides = text.strip_ws(ref), text.strip_ws(hyp), text.clean_for_wer(ref), text.clean_for_wer(hyp)
    present = present.withColumn("_len", F.array_size(F.array_remove(ids, pad)).cast("double"))
    counted = bleu.add_bleu_counts_and_edits(present, *sides).withColumn("_wer", error_rate("edits", "ref_words"))
    pooled = _grouped(
        counted, group, *bleu.pooled_counts(), F.avg("_wer").alias("_wer"), F.avg("_len").alias("_len")
    )
    return pooled.select(
        *group,
        F.round(bleu.bleu_from_counts(), digits).alias("bleu"),
        F.round("_wer", digits).alias("wer"),
        F.round("_len", digits).alias("gen_len"),
    )
