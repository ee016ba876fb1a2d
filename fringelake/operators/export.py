"""Images of an object as they leave a reconstruction: phases and magnitudes, of each slice or of all together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import reduce

#: Fixed value: least distance of the quantiles that a magnitude is scaled between.
MAGNITUDE_RANGE = 0.2


def _cut(obj: DataFrame, roi: Column | None, crop: bool) -> tuple[DataFrame, Column | None]:
    """The pixels to show, and those of them that fits and scales go by."""
    if roi is None:
        return obj, None
    return (obj.where(roi), None) if crop else (obj, roi)


def phase_image(obj: DataFrame, roi: Column | None = None, crop: bool = True, stack: bool = False, unwrap: bool = True, bits: int | None = None) -> DataFrame:
    """(z, y, x, v) for a stack, else (y, x, v), of an object (z, y, x, re, im): angles, unwrapped along x, then y, summed over
    slices unless it is a stack, without their best plane, scaled to integers of `bits` bits if these are given.

    With `crop` only pixels in `roi` (a condition on y and x) remain; without, all do, but plane and scale go by the roi.
    A window of the unwrapping holds one line of one slice.
    """
    shown, within = _cut(obj, roi, crop)
    v = shown.select("z", "y", "x", F.atan2("im", "re").alias("v"))
    if unwrap:
        v = reduce.unwrap(reduce.unwrap(v, "x", "z", "y"), "y", "z", "x")
    if not stack:
        v = v.groupBy("y", "x").agg(F.sum("v").alias("v")).withColumn("z", F.lit(0))
    flat = reduce.remove_ramp(v, "z", within=within)
    return _scaled(flat if stack else flat.select("y", "x", "v"), bits, within, 0.0)


def magnitude_image(obj: DataFrame, roi: Column | None = None, crop: bool = True, stack: bool = False, bits: int | None = None) -> DataFrame:
    """(z, y, x, v) for a stack, else (y, x, v): squared moduli, multiplied over slices unless it is a stack, scaled if `bits` are given."""
    shown, within = _cut(obj, roi, crop)
    v = shown.select("z", "y", "x", (F.col("re") ** 2 + F.col("im") ** 2).alias("v"))
    if not stack:
        v = v.groupBy("y", "x").agg(F.product("v").alias("v"))
    return _scaled(v, bits, within, MAGNITUDE_RANGE)


def _scaled(img: DataFrame, bits: int | None, within: Column | None, min_range: float) -> DataFrame:
    if bits is None:
        return img
    return reduce.robust_scale(img.withColumn("v", F.round("v", 9)), bits, min_range=min_range, within=within)  # rounded: sums come in any order
