"""The corpus pipeline: STAGES of the training-data operators, each written and reread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fringelake.llm import pipeline as stages

STAGES = stages.STAGES
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, on `documents`."""
    return stages.run(spark, sf_dir)
