"""Secret scans: a random forest tells secrets from look-alikes, with DataFrame functions and Spark ML only.

Candidates are words of at least ``least_chars`` bytes, words with an assignment in them, and words of any length
after a key word or an assignment. Their value is what stands after an assignment sign (the padding of base64 is
none), without quotes and punctuation around it; words without a value are no candidates. A candidate has features of
these kinds:

* length, and shares of digits, capitals, small letters and hexadecimal digits;
* transitions between kinds of characters, for each character, and the number of distinct characters;
* the share of its letters that dictionary words cover;
* path signs: slashes, dots, at signs, and a scheme or file name ending;
* the words before and after: key words, assignment, quotes, and hashed previous words.

The forest is trained on labelled findings, at most ``train_rows`` of each label in order of a hash, so a rare label is
never lost among the other; both labels weigh the same. A finding
is a candidate with a label 0 or 1. Where nobody has labelled findings, :func:`labelled_by_format` labels those
that are of a known kind: issued key formats and quoted or assigned credentials are secrets; card numbers,
telephone numbers, addresses, mail addresses and ordinary words are none. Ordinary words are so many that they are a
sample of their own, of at most ``word_rows``. All candidates of all texts are then scored,
also those of no known kind.

Candidates are found row by row; no text is shuffled and no group is formed. Null and empty texts have none.
If the findings have labels of one kind only, every candidate gets that label's probability (0 or 1); without any
findings it is null.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxledger.llm.tables import blank_words, held_out, stored

KEY_WORDS = "token|secret|passw|pwd|api|key|auth|bearer|credential|private|access|login"
#: Fixed dictionary for the coverage feature: common words and parts of identifiers.
DICTIONARY = (
    "password user admin example test mail http https www com org net file path index page image data name value "
    "the and for with this that from have not are was were you your all can has had one two new old "
    "der die das und mit von den les des une que pour dans est los las del por con para esta "
    "tion ment keit heit lich ung able ing ness less ción mente"
).split()


#: Name and sign of an assignment inside a word: a quoted name or a key word before a colon, or anything before an
#: equals sign that more than padding and punctuation follows. All repeats are possessive, so a word of any length is
#: read once and nothing is put on a stack.
ASSIGNMENT = (
    rf"""^(?:[^=:]*+(?<=["'`]):++|(?i:(?:(?!{KEY_WORDS})[^=:])*+(?:{KEY_WORDS})[^=:]*+:++)(?!//)"""
    r"""|[^=]*+=++(?=[^<\p{L}\p{N}]*+[\p{L}\p{N}]))"""
)
ORDINARY = r"^\p{Lu}?+\p{Ll}++(?:[-'’]\p{Lu}?+\p{Ll}++)*+$"
#: What is no part of a value, at its beginning and end.
AROUND = r"^[^\p{L}\p{N}+/]++|(?<![^\p{L}\p{N}=/])[^\p{L}\p{N}=/]++$"


@dataclass(frozen=True)
class Parameters:
    least_chars: int = 12
    train_rows: int = 10_000  # findings of each label
    word_rows: int = 5_000  # ordinary words, besides the findings
    least_copies: int = 100  # a label with fewer findings is repeated up to so many rows, so that every tree sees it
    trees: int = 40
    depth: int = 8
    buckets: int = 8  # of hashed previous words
    threshold: float = 0.5


def _near() -> Column:
    """The two words before and the name that the word itself assigns to, in lower case."""
    return F.lower(F.concat_ws(" ", F.col("before2"), F.col("before"), F.regexp_extract("word", ASSIGNMENT, 0)))


def candidates(docs: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """(doc_id, pos, word, before2, before, after, value) of every candidate."""
    rows = docs.select("doc_id", blank_words(F.col("text")).alias("w"))

    def named(i: Column) -> Column:
        before, before2 = F.get("w", i - 1), F.get("w", i - 2)
        key = before.rlike(f"(?i)=$|{KEY_WORDS}") | (before.isin(":", "is") & before2.rlike(f"(?i){KEY_WORDS}"))
        return F.coalesce(key, F.lit(False))

    found = F.filter(
        F.transform(
            "w",
            lambda x, i: F.when(
                (F.octet_length(x) >= p.least_chars) | (x.rlike("[=:]") & x.rlike(ASSIGNMENT)) | named(i),
                F.struct(i.alias("pos"), x.alias("word"), F.get("w", i - 2).alias("before2"), F.get("w", i - 1).alias("before"), F.get("w", i + 1).alias("after")),
            ),
        ),
        lambda s: s.isNotNull(),
    )
    flat = rows.select("doc_id", F.explode(found).alias("c")).select("doc_id", "c.*")
    bare = F.regexp_replace(F.regexp_replace("word", ASSIGNMENT, ""), AROUND, "")
    return flat.withColumn("value", bare).filter(F.col("value").rlike(r"[\p{L}\p{N}]"))


def features(found: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """``found`` with the feature columns f_*; none of them is null."""
    v, size = F.col("value"), F.char_length("value").cast("double")

    def share(kind: str) -> Column:
        return F.char_length(F.regexp_replace(v, f"[^{kind}]", "")) / size

    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, r"\p{Lu}", "A"), r"[^A\d\W_]|\p{Ll}", "a"), r"\d", "0"), r"[^Aa0]", "-")
    runs = F.char_length(F.regexp_replace(kinds, r"(.)\1+", "$1"))
    letters = F.regexp_replace(F.lower(v), r"[^\p{L}]", "")
    left = F.regexp_replace(letters, "|".join(sorted(DICTIONARY, key=lambda x: (-len(x), x))), "")
    near = _near()
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    made = {
        "length": size,
        "digits": share("0-9"),
        "capitals": share("A-Z"),
        "small": share("a-z"),
        "hex": share("0-9a-f"),
        "transitions": (runs - 1) / size,
        "distinct": F.array_size(F.array_distinct(F.split(v, ""))) / size,
        "coverage": F.when(F.char_length(letters) > 0, 1 - F.char_length(left) / F.char_length(letters)).otherwise(0.0),
        "slashes": F.char_length(F.regexp_replace(v, "[^/]", "")).cast("double"),
        "dots": F.char_length(F.regexp_replace(v, "[^.]", "")).cast("double"),
        "at": flag(v.contains("@")),
        "url": flag(F.lower(v).rlike(r"^[a-z]+:/|\.[a-z]{2,4}$")),
        "key_word": flag(near.rlike(KEY_WORDS)),
        "assigned": flag(F.col("word").rlike(ASSIGNMENT) | F.col("before").isin("=", ":", ":=") | F.col("before").rlike("[=:]$")),
        "quoted": flag(F.col("word").rlike("[\"'`]")),
        "next_digit": flag(F.col("after").rlike("[0-9]")),
        "before_digit": flag(F.col("before").rlike("[0-9]")),
    }
    bucket = F.pmod(F.xxhash64(F.lower(F.coalesce("before", F.lit("")))), F.lit(p.buckets))
    made |= {f"before_{k}": (bucket == k).cast("double") for k in range(p.buckets)}
    return found.select("*", *[c.alias(f"f_{n}") for n, c in made.items()])


def labelled_by_format(found: DataFrame) -> DataFrame:
    """Candidates of a known kind with column ``label``."""
    v = F.col("value")
    credential = (F.octet_length(v) >= 6) & (v.rlike(r"[0-9]") | F.col("word").rlike("[\"'`]"))
    secret = v.rlike(r"^(AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{36}$|^sk-[A-Za-z0-9_-]{20,}$|^xox[abp]-[A-Za-z0-9-]{10,}$") | (
        _near().rlike(KEY_WORDS) & (F.col("word").rlike(ASSIGNMENT) | (F.col("before") == "=")) & credential
    )
    harmless = v.rlike(r"^\d[\d.,:/ -]*$|^\+?[\d() -]{8,}$|^[^@\s]+@[^@\s]+\.[a-z]+$|^\d{1,3}(\.\d{1,3}){3}$|^https?://")
    label = F.when(secret, 1.0).when(harmless, 0.0)
    return found.withColumn("label", label).filter(F.col("label").isNotNull())


def ordinary_words(found: DataFrame) -> DataFrame:
    """Candidates that are words of small letters, neither assigned nor quoted, with column ``label`` 0."""
    before = F.coalesce("before", F.lit(""))
    given = F.col("word").rlike(ASSIGNMENT) | F.col("word").rlike("[\"'`]") | before.rlike("=$") | (before.rlike(":$") & _near().rlike(KEY_WORDS))
    return found.filter(F.col("value").rlike(ORDINARY) & ~given).withColumn("label", F.lit(0.0))


def scan(docs: DataFrame, findings: DataFrame | None = None, p: Parameters = Parameters()) -> DataFrame:
    """(doc_id, pos, n_chars, value_sha256, probability, is_secret): a row for each candidate.

    ``findings`` has the columns of :func:`candidates` and ``label``; by default formats label the candidates of
    documents that no model holds out. Values leave the scan as digests only.
    """
    found = stored(features(candidates(docs.select("doc_id", "text"), p), p), "candidates")
    names = [c for c in found.columns if c.startswith("f_")]
    if findings is None:
        known = labelled_by_format(found.filter(~held_out(F.col("doc_id"))))
    else:
        known = features(findings, p).filter("label is not null")
    order = F.xxhash64("value", "doc_id", "pos"), F.col("doc_id"), F.col("pos")
    parts = [known.filter(F.col("label") == y).orderBy(*order).limit(p.train_rows).select("label", *names) for y in (1.0, 0.0)]
    if findings is None:
        plain = ordinary_words(found.filter(~held_out(F.col("doc_id"))))
        parts.append(plain.orderBy(*order).limit(p.word_rows).select("label", *names))
    train = stored(reduce(DataFrame.union, parts), "findings")
    sizes = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}  # 0, 1
    kinds = list(sizes)
    digest = F.sha2("value", 256).alias("value_sha256")
    columns = ["doc_id", F.col("pos").cast("long").alias("pos"), F.char_length("value").cast("long").alias("n_chars"), digest]
    if len(kinds) < 2:
        only = F.lit(float(kinds[0]) if kinds else None).cast("double")
        return found.select(*columns, only.alias("probability"), F.coalesce(only >= p.threshold, F.lit(False)).alias("is_secret"))
    copies = {y: -(-p.least_copies // n) for y, n in sizes.items()}
    of = F.when(F.col("label") == 1.0, F.lit(copies[1.0])).otherwise(F.lit(copies[0.0]))
    weight = F.when(F.col("label") == 1.0, F.lit(1 / sizes[1.0])).otherwise(F.lit(1 / sizes[0.0])) * sum(sizes.values()) / of
    train = train.withColumn("weight", weight).withColumn("copy", F.explode(F.sequence(F.lit(1), of)))
    put = VectorAssembler(inputCols=names, outputCol="vector")
    forest = RandomForestClassifier(featuresCol="vector", labelCol="label", weightCol="weight", numTrees=p.trees, maxDepth=p.depth, seed=11, featureSubsetStrategy="sqrt")
    model = forest.fit(put.transform(train))
    scored = model.transform(put.transform(found)).withColumn("probability", vector_to_array("probability")[1])
    return scored.select(*columns, "probability", (F.col("probability") >= p.threshold).alias("is_secret"))
