"""Queries of the operators that learn: toxicity and quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxledger.llm import additive_quality, pu_toxicity
from voxledger.llm.tables import held_out, table
from voxledger.plans.registry import query


@query("op4_pu_toxicity")
def op4_pu_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = pu_toxicity.fit(docs, table(spark, folder, "labels"))
    scored = pu_toxicity.score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op2_additive_quality")
def op2_additive_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = additive_quality.score(docs, additive_quality.fit(docs, table(spark, folder, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
