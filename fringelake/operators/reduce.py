"""Reductions over patterns and images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ranks import exact_quantiles


def known(c: str = "v") -> Column:
    """NaN as null, so that aggregates skip it."""
    return F.when(~F.isnan(c), F.col(c))


def pacbed(px: DataFrame) -> DataFrame:
    return px.groupBy("ky", "kx").agg(F.sum(known()).alias("v"))


def virtual_detector(px: DataFrame, mask: DataFrame) -> DataFrame:
    """Sum of pattern times mask at each position; the mask is one detector's pixels."""
    return px.join(F.broadcast(mask), ["ky", "kx"]).groupBy("iy", "ix").agg(F.sum(known() * F.col("m")).alias("v"))


def mean_pattern(px: DataFrame, mask: DataFrame) -> DataFrame:
    return px.join(F.broadcast(mask), ["ky", "kx"]).groupBy("ky", "kx").agg(F.avg(known() * F.col("m")).alias("v"))


def center_of_mass(px: DataFrame, *by: str) -> DataFrame:
    total = F.sum(known())
    return px.groupBy(*by).agg(total.alias("total"), F.try_divide(F.sum(F.col("ky") * known()), total).alias("com_y"), F.try_divide(F.sum(F.col("kx") * known()), total).alias("com_x"))


def mean_intensity(px: DataFrame) -> DataFrame:
    return px.groupBy("pos_id").agg(F.sum(known()).alias("total")).agg(F.avg("total").alias("mean_intensity"))


def radial_bins(px: DataFrame, center: tuple[float, float], step: float, *by: str) -> DataFrame:
    """Sum and count of the values by floor(radius / step)."""
    r = F.floor(F.sqrt((F.col("ky") - center[0]) ** 2 + (F.col("kx") - center[1]) ** 2) / step).cast("long")
    return px.groupBy(*by, r.alias("r")).agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("n"))


def encircled_radius(bins: DataFrame, share: float) -> DataFrame:
    """First radius bin where the running sum passes `share` of all; the bins of an image are few."""
    running = bins.withColumn("cum", F.sum("v").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, 0)))
    total = bins.agg(F.sum("v").alias("total"))
    return running.crossJoin(F.broadcast(total)).where(F.col("cum") > share * F.col("total")).agg(F.min("r").alias("radius"))


def ring_correlation(rings: DataFrame) -> DataFrame:
    """(r, frc, ratio) from (r, re1, im1, re2, im2) pixels."""
    num_re = F.sum(F.col("re1") * F.col("re2") + F.col("im1") * F.col("im2"))
    num_im = F.sum(F.col("im1") * F.col("re2") - F.col("re1") * F.col("im2"))
    p1, p2 = F.sum(F.col("re1") ** 2 + F.col("im1") ** 2), F.sum(F.col("re2") ** 2 + F.col("im2") ** 2)
    return rings.groupBy("r").agg(F.try_divide(F.sqrt(num_re**2 + num_im**2), F.sqrt(p1 * p2)).alias("frc"), F.sqrt(F.try_divide(p1, p2)).alias("ratio"))


def first_crossing(curve: DataFrame, threshold: float) -> DataFrame:
    """Interpolated r where the curve first falls below the threshold (a curve is one short series)."""
    w = Window.orderBy("r")
    d = curve.withColumn("d", F.col("frc") - threshold)
    d = d.select("r", "d", F.lag("r").over(w).alias("r0"), F.lag("d").over(w).alias("d0")).where("d < 0 and d0 >= 0")
    at = F.col("r0") + (F.col("r") - F.col("r0")) * F.col("d0") / (F.col("d0") - F.col("d"))
    return d.select("r", at.alias("at")).agg(F.min_by("at", "r").alias("crossing"))


def robust_scale(img: DataFrame, bits: int, low: float = 0.001, high: float = 0.999, min_range: float = 0.0, within: Column | None = None) -> DataFrame:
    """`img` (…, v) as integers of `bits` bits between the exact quantiles of the pixels `within` (all, by default).

    Quantiles less than `min_range` apart are moved apart to it, about their middle. What lies beyond them takes the end
    of the range, a NaN is null, and an image of one value is zero.
    """
    ends = exact_quantiles(img if within is None else img.where(within), "v", [low, high], [])
    q = ends.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    wider = F.greatest(F.lit(min_range) - (F.col("hi") - F.col("lo")), F.lit(0.0)) / 2
    q = q.select((F.col("lo") - wider).alias("lo"), (F.col("hi") + wider).alias("hi"))
    scaled = F.coalesce(F.try_divide(F.lit(2.0**bits), F.col("hi") - F.col("lo")), F.lit(0.0)) * (F.col("v") - F.col("lo"))
    kind, exact = ("long", "double") if bits < 63 else ("decimal(20, 0)", "decimal(30, 6)")
    top = F.lit(str(2**bits - 1)).cast(kind)
    level = F.when(scaled >= 2.0**bits - 1, top).otherwise(F.floor(F.greatest(scaled, F.lit(0.0)).cast(exact)).cast(kind))
    return img.crossJoin(F.broadcast(q)).select(*[c for c in img.columns if c != "v"], F.when(~F.isnan("v"), level).alias("v"))


def remove_ramp(img: DataFrame, *by: str, within: Column | None = None) -> DataFrame:
    """Residual of the least-squares plane 1, x, y of each image, from its moments; fitted to the pixels `within` (all, by default)."""
    x, y, v = F.col("x").cast("double"), F.col("y").cast("double"), F.col("v")
    m = (img if within is None else img.where(within)).groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(v).alias("mv"), F.covar_pop(x, x).alias("sxx"), F.covar_pop(x, y).alias("sxy"), F.covar_pop(y, y).alias("syy"), F.covar_pop(x, v).alias("sxv"), F.covar_pop(y, v).alias("syv"))
    det = F.col("sxx") * F.col("syy") - F.col("sxy") ** 2
    m = m.withColumn("a", F.try_divide(F.col("sxv") * F.col("syy") - F.col("syv") * F.col("sxy"), det)).withColumn("b", F.try_divide(F.col("syv") * F.col("sxx") - F.col("sxv") * F.col("sxy"), det))
    m = m.select(*by, "mx", "my", "mv", "a", "b")
    flat = v - F.col("mv") - F.col("a") * (x - F.col("mx")) - F.col("b") * (y - F.col("my"))
    return img.join(m, list(by)).select(*by, "y", "x", flat.alias("v"))


def differences(img: DataFrame, axis: str, *by: str) -> DataFrame:
    """First difference along one axis; the last pixel has none."""
    nxt = F.lead("v").over(Window.partitionBy(*by).orderBy(axis))
    return img.withColumn("d", nxt - F.col("v")).where("d is not null")


def gradients(img: DataFrame, *by: str) -> DataFrame:
    """Adds gy and gx, forward differences with the edge replicated."""
    out = img
    for name, axis, other in (("gy", "y", "x"), ("gx", "x", "y")):
        w = Window.partitionBy(*by, other).orderBy(axis)
        out = out.withColumn(name, F.coalesce(F.lead("v").over(w), F.col("v")) - F.col("v"))
    return out


def unwrap(img: DataFrame, axis: str, *by: str) -> DataFrame:
    """Phase unwrapped along one axis of each line."""
    w = Window.partitionBy(*by).orderBy(axis)
    d = F.coalesce(F.col("v") - F.lag("v").over(w), F.lit(0.0))
    two_pi = 2 * 3.141592653589793
    turns = -F.floor((d + 3.141592653589793) / two_pi)
    step = img.withColumn("turns", turns)
    return step.withColumn("v", F.col("v") + two_pi * F.sum("turns").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("turns")
