"""Bringing diffraction patterns to the middle of the detector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .reduce import known


def _place(axis: str, n: int, corner: bool) -> Column:
    """Index along the axis with the zero frequency at n // 2."""
    return F.pmod(F.col(axis) + n // 2, F.lit(n)).cast("long") if corner else F.col(axis).cast("long")


def centre(px: DataFrame, mask: DataFrame, shape: tuple[int, int], corner: bool = False, middle: tuple[float, float] | None = None) -> DataFrame:
    """One row (dy, dx): how far the centre of mass of the masked mean pattern lies from `middle` (by default that of the zero
    frequency), in pixels. NaN pixels are left out; both are null where nothing was measured. The mask is one detector's pixels.

    The mean over positions drops out of the ratio, so one aggregate over all pixels does; no pixel is exchanged.
    """
    seen = px.join(F.broadcast(mask), ["ky", "kx"])
    v = known() * F.col("m")
    middle = middle or (shape[0] // 2, shape[1] // 2)
    at = lambda axis, k: F.try_divide(F.sum(v * (_place(axis, shape[k], corner) - F.lit(middle[k]))), F.sum(v))
    return seen.agg(at("ky", 0).alias("dy"), at("kx", 1).alias("dx"))


def shifted(px: DataFrame, by: tuple[float, float], shape: tuple[int, int], keys: list[str], corner: bool = False, value: str = "v") -> DataFrame:
    """(keys, ky, kx, value): each pixel reads its image at its place plus `by`, linear between pixels, zero outside.

    The shift is one for all, so each pixel knows the at most four pixels that it becomes part of, without a join.
    All pixels of the shape remain; a NaN makes NaN of all that it becomes part of.
    """
    taps = []
    whole = [int(b // 1) for b in by]
    part = [b - w for b, w in zip(by, whole)]
    for e in (0, 1):
        for f in (0, 1):
            weight = (part[0] if e else 1 - part[0]) * (part[1] if f else 1 - part[1])
            if weight > 0:
                taps.append((-whole[0] - e, -whole[1] - f, weight))
    spread = F.explode(F.array(*[F.struct(F.lit(y).cast("long").alias("y"), F.lit(x).cast("long").alias("x"), F.lit(float(w)).alias("w")) for y, x, w in [*taps, (0, 0, 0.0)]])).alias("t")
    moved = px.select(*keys, _place("ky", shape[0], corner).alias("ky"), _place("kx", shape[1], corner).alias("kx"), F.col(value).cast("double").alias(value), spread)
    at = {"ky": F.col("ky") + F.col("t.y"), "kx": F.col("kx") + F.col("t.x")}
    moved = moved.select(*keys, at["ky"].alias("ky"), at["kx"].alias("kx"), F.when(F.col("t.w") > 0, F.col(value) * F.col("t.w")).otherwise(0.0).alias(value))
    moved = moved.where(F.col("ky").between(0, shape[0] - 1) & F.col("kx").between(0, shape[1] - 1))
    out = moved.groupBy(*keys, "ky", "kx").agg(F.sum(value).alias(value))
    if corner:  # back from the middle
        out = out.withColumns({a: F.pmod(F.col(a) - n // 2, F.lit(n)).cast("long") for a, n in zip(("ky", "kx"), shape)})
    return out
