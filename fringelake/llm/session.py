"""Session helpers: reading tables and cutting lineage in the shared folder."""

from __future__ import annotations

import tempfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, set first if need be."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="fringelake-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Writes `df` to the shared checkpoint folder and returns the written copy.

    The folder comes from ``spark.checkpoint.dir``; only where that is unset
    (tests, one machine with master local) a folder of our own is used.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bitmap(hashes: DataFrame, most_bits: int) -> tuple[int, np.ndarray]:
    """(bits, bytes): which hashes modulo 2**bits stand in the only column; 2**most_bits bits at most, however many there are."""
    n = hashes.count()
    bits = min(most_bits, max(16, (64 * n).bit_length()))
    at = hashes.select((F.pmod(F.col(hashes.columns[0]), F.lit(1 << bits)) + 1).alias("at"))
    rows = at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("map")).collect()
    out = np.zeros(max(1 << bits, 1 << 15) // 8, np.uint8)
    for r in rows:
        out[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(r["map"], np.uint8)
    return bits, out
