"""Preparing scans and patterns: crops, scaling, noise, checks and overlays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def crop_scan(px: DataFrame, y: slice, x: slice, ny: int, nx: int) -> DataFrame:
    """Positions of a scan rectangle with Python slice meaning (None, negatives), renumbered from zero."""
    (y0, y1, _), (x0, x1, _) = y.indices(ny), x.indices(nx)
    kept = px.where((F.col("iy") >= y0) & (F.col("iy") < y1) & (F.col("ix") >= x0) & (F.col("ix") < x1))
    return kept.withColumns({"iy": F.col("iy") - y0, "ix": F.col("ix") - x0}).withColumn("pos_id", F.col("iy") * (x1 - x0) + F.col("ix"))


def scale_patterns(px: DataFrame, factor: float) -> DataFrame:
    return px.withColumn("v", F.col("v") * factor)


def clip_counts(px: DataFrame) -> DataFrame:
    return px.withColumn("v", F.greatest("v", F.lit(0.0)))


def poisson_noise(px: DataFrame, factor: float, seed: int = 0, gaussian: float = 1e-3) -> DataFrame:
    """Counts drawn for each pixel after scaling; the stream depends on pixel and seed only, not on partitions."""
    schema = px.schema

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
            v = [
                (g := np.random.Generator(np.random.PCG64([seed, int(p), int(y), int(x)]))).poisson(max(0.0, m) * factor) + g.normal(0.0, gaussian)
                for p, y, x, m in zip(get("pos_id"), get("ky"), get("kx"), get("v"))
            ]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.float64()) if n == "v" else c for n, c in zip(batch.schema.names, batch.columns)], batch.schema.names)

    return px.mapInArrow(draw, schema)


def drop_sparse(px: DataFrame, absent: str, threshold: float) -> DataFrame:
    """(pos_id) of positions whose share of absent pixels is at most the threshold."""
    return px.groupBy("pos_id").agg(F.avg(F.expr(absent).cast("int")).alias("share")).where(F.col("share") <= threshold).select("pos_id")


def count_check(px: DataFrame, scan: DataFrame) -> DataFrame:
    """(positions, expected, agrees): one row."""
    a = px.agg(F.countDistinct("pos_id").alias("positions"))
    return a.crossJoin(scan.agg(F.count(F.lit(1)).alias("expected"))).withColumn("agrees", F.col("positions") == F.col("expected"))


def not_finite(df: DataFrame, *cols: str) -> DataFrame:
    bad = F.lit(False)
    for c in cols:
        bad = bad | F.isnan(c) | (F.abs(c) == float("inf"))
    return df.where(bad)


def shift_index(df: DataFrame, axes: dict[str, int], inverse: bool = False) -> DataFrame:
    """fftshift (or ifftshift) by index arithmetic; no rows move."""
    return df.withColumns({a: F.pmod(F.col(a) + ((n + 1) // 2 if inverse else n // 2), F.lit(n)).cast("long") for a, n in axes.items()})


def split_image(img: DataFrame, ny: int, nx: int) -> DataFrame:
    """The four strided sub-images of the even part of an image, as (part_y, part_x, y, x, v)."""
    even = img.where((F.col("y") < ny // 2 * 2) & (F.col("x") < nx // 2 * 2))
    return even.select(F.pmod("y", F.lit(2)).alias("part_y"), F.pmod("x", F.lit(2)).alias("part_x"), F.floor(F.col("y") / 2).alias("y"), F.floor(F.col("x") / 2).alias("x"), "v")


def indexed_update(base: DataFrame, changes: DataFrame, key: list[str], op: str) -> DataFrame:
    """`base` (key, v) with changes (key, u) applied: set, add, subtract, multiply, divide, power, min or max."""
    v, u = F.col("v"), F.col("u")
    new = {"set": u, "add": v + u, "subtract": v - u, "multiply": v * u, "divide": F.try_divide(v, u), "power": F.pow(v, u), "min": F.least(v, u), "max": F.greatest(v, u)}[op]
    return base.join(changes, key, "left").select(*key, F.when(u.isNull(), v).otherwise(new).alias("v"))


def overlay(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Settings (key, value) of `left` with those of `right` over them; the union of keys."""
    r = right.withColumnRenamed("value", "over")
    return left.join(r, key, "full").select(key, F.coalesce("over", "value").alias("value"))


def isclose(a: str, b: str, rtol: float = 1e-5, atol: float = 1e-8):
    return F.abs(F.col(a) - F.col(b)) <= atol + rtol * F.abs(F.col(b))
