"""Experiment metadata (JSON) with a fixed schema; unknown keys are not read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Field names and types of the metadata format.
SCHEMA = """file_type string, name string, version string, raw_filename string, voltage double, conv_angle double, defocus double,
camera_length double, diff_step double, scan_rotation double, scan_shape array<int>, scan_fov array<double>, scan_step array<double>,
exposure_time double, post_exposure_time double, beam_current double, adu double, scan_correction array<array<double>>,
scan_positions array<array<double>>, crop array<int>, author string, time string, time_unix double, bg_unix double, has_bg boolean, orig_path string, notes string"""
VERSION = "2.0"


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row a file, with the folder it is in; another version is an error."""
    found = spark.read.schema(SCHEMA).option("multiLine", True).json(path).withColumn("folder", F.regexp_replace(F.input_file_name(), "[^/]*$", ""))
    wrong = F.raise_error(F.concat(F.lit(f"metadata version must be {VERSION}, not "), F.coalesce("version", F.lit("null"))))
    return found.withColumn("version", F.when(F.col("version") == VERSION, F.col("version")).otherwise(wrong.cast("string")))
