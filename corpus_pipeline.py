"""A corpus pipeline over ``documents``: each stage works on what its predecessor kept.

Toxic documents go, later copies of lines go, one document of each near-copy class stays, documents
that leak benchmark items go, and what is left is encoded as SentencePiece ids and decoded again.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from voxledger.llm import line_dedup, minmax_dedup, piece_transducer, pu_toxicity, template_decontam  # noqa: E402
from voxledger.llm.queries_text import PIECE_MODEL  # noqa: E402
from voxledger.llm.tables import stored, table  # noqa: E402
from voxledger.plans.registry import query  # noqa: E402


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3."""
    model = pu_toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return pu_toxicity.drop_toxic(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of lines; a document whose lines are all gone stays, with an empty text."""
    return line_dedup.dedup_lines(docs, counts=False)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class at similarity 0.8 of five-word shingles."""
    return minmax_dedup.drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return template_decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"), template_decontam.WHOLE)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids, decoded) of every document."""
    coded = piece_transducer.encode(docs, PIECE_MODEL)
    return coded.select("doc_id", F.array_size("ids").cast("long").alias("n_pieces"), "ids", "decoded")


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", lines),
    ("near_dedup", near_copies),
    ("decontamination", decontamination),
    ("sentencepiece", pieces),
]

#: A learned score and merges of a vocabulary file are nothing that SQL can express.
ORACLE_SQL = None


@query("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return stored(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
