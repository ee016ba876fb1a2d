"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns a DataFrame.

All but the last return the columns of `documents`; the last adds the rate that
a document is to be drawn with.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontam, mixing, pii, quality, simhash
from .session import checkpoint_folder, checkpointed, table

#: Rows are told apart by a hash of all their columns: ids may be null or shared by unlike texts.
#: Copies are rows that agree in a second hash as well, so two documents of one key may share a verdict, but both stay.
KEY, CHECK = "__row_key", "__row_check"


def free(name: str, taken: list[str]) -> str:
    """`name`, with underscores after it while it is taken (case does not count)."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def _keyed(docs: DataFrame) -> DataFrame:
    """`docs` with a key of the row's content; rows of one key are copies in all columns."""
    nulls = F.array(*[F.col(f"`{c}`").isNull() for c in docs.columns])  # the hash skips nulls
    return docs.withColumn(KEY, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns], nulls))


def _judged(docs: DataFrame) -> DataFrame:
    """Keyed `docs` with the key as doc_id, for operators that tell rows apart by it alone."""
    return docs.withColumn("doc_id", F.col(KEY))


def _of(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows of the keyed `docs` whose key is among the verdicts' doc_ids."""
    return docs.join(verdicts.select(F.col("doc_id").alias(KEY)).distinct(), KEY, "left_semi")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    keyed = _keyed(docs)
    return _of(keyed, quality.quality(_judged(keyed)).where("kept")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row of the smallest doc_id stays (a null one counts as larger than all others)."""
    keyed = _keyed(docs)
    groups = simhash.near_duplicates(_judged(keyed)).select(F.col("doc_id").alias(KEY), "component_id").distinct()
    ids = keyed.select(KEY, F.col("doc_id").cast("long").alias("id")).distinct()
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col(KEY))
    first = groups.join(ids, KEY).groupBy("component_id").agg(F.min(order)[KEY].alias("doc_id"))
    check = F.xxhash64(F.lit(1), *[F.col(f"`{c}`") for c in docs.columns])
    return _of(keyed.withColumn(CHECK, check), checkpointed(first)).dropDuplicates([KEY, CHECK]).select(*docs.columns)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    keyed = _keyed(docs)
    return _of(keyed, decontam.decontaminate(_judged(keyed), table(spark, sf_dir, "benchmark")).where("not contaminated")).select(*docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it become placeholders; n_chars follows."""
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds n_tokens, the posteriors and the rate of each document; a name that `docs` has already gets an underscore more."""
    keyed = _keyed(docs)
    rates = mixing.mix_rates(keyed, table(spark, sf_dir, "labels"), key=KEY).dropDuplicates(["doc_id"]).withColumnRenamed("doc_id", KEY)
    for name in [c for c in rates.columns if c != KEY]:
        rates = rates.withColumnRenamed(name, free(name, docs.columns))
    return keyed.join(rates, KEY).drop(KEY)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_free),
    ("personal data", without_personal_data),
    ("mixing", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; what each keeps is written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
