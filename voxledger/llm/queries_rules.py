"""Queries of the rules that run without Python on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxledger.llm import forest_secrets, mcd_outliers
from voxledger.llm.tables import table
from voxledger.plans.registry import query


@query("op5_mcd_outliers")
def op5_mcd_outliers(spark: SparkSession, folder: str) -> DataFrame:
    return mcd_outliers.verdicts(table(spark, folder, "documents"), mcd_outliers.Parameters(wider=True))


@query("op6_forest_secrets")
def op6_forest_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return forest_secrets.scan(table(spark, folder, "documents"))
