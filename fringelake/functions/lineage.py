"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only on one machine where none is set."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="fringelake-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def materialised(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder, and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
