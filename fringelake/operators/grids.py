"""Coordinate grids, scans and slice lists as generated tables."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


@dataclass(frozen=True)
class Sampling:
    """A regular two-dimensional grid; the extent follows from shape and step."""

    ny: int
    nx: int
    sy: float
    sx: float

    @property
    def extent(self) -> tuple[float, float]:
        return self.ny * self.sy, self.nx * self.sx

    @property
    def corner(self) -> tuple[float, float]:
        return (self.sy - self.ny * self.sy) / 2, (self.sx - self.nx * self.sx) / 2

    @property
    def k_max(self) -> tuple[float, float]:
        return 0.5 / self.sy, 0.5 / self.sx

    @property
    def bwlim(self) -> float:
        return 2 / 3 * min(self.k_max)


def index_grid(spark: SparkSession, ny: int, nx: int, y: str = "y", x: str = "x") -> DataFrame:
    i = F.col("id")
    return spark.range(ny * nx).select(F.floor(i / nx).cast("long").alias(y), F.pmod(i, F.lit(nx)).cast("long").alias(x))


def real_grid(spark: SparkSession, s: Sampling) -> DataFrame:
    """(y, x, yy, xx): centred coordinates, the far edge left out."""
    return index_grid(spark, s.ny, s.nx).select("y", "x", (F.lit(s.corner[0]) + F.col("y") * s.sy).alias("yy"), (F.lit(s.corner[1]) + F.col("x") * s.sx).alias("xx"))


def frequency(i: Column, n: int, step: float) -> Column:
    """Sample frequency of index i with the origin in the corner."""
    return F.when(i < (n + 1) // 2, i).otherwise(i - n) / F.lit(n * step)


def recip_grid(spark: SparkSession, s: Sampling, centered: bool = False) -> DataFrame:
    """(ky, kx, fy, fx)."""
    grid = index_grid(spark, s.ny, s.nx, "ky", "kx")
    if centered:
        return grid.select("ky", "kx", ((F.col("ky") - s.ny // 2) / F.lit(s.ny * s.sy)).alias("fy"), ((F.col("kx") - s.nx // 2) / F.lit(s.nx * s.sx)).alias("fx"))
    return grid.select("ky", "kx", frequency(F.col("ky"), s.ny, s.sy).alias("fy"), frequency(F.col("kx"), s.nx, s.sx).alias("fx"))


def raster_scan(spark: SparkSession, ny: int, nx: int, step: tuple[float, float], rotation: float = 0.0, affine: tuple[tuple[float, float], tuple[float, float]] | None = None) -> DataFrame:
    """(pos_id, iy, ix, y, x): a raster about n/2, rotated (degrees), stepped, then times an affine matrix."""
    c, s = math.cos(math.radians(rotation)), math.sin(math.radians(rotation))
    grid = index_grid(spark, ny, nx, "iy", "ix").withColumn("pos_id", F.col("iy") * nx + F.col("ix"))
    v, u = F.col("iy") - ny / 2, F.col("ix") - nx / 2
    y, x = (v * c - u * s) * step[0], (v * s + u * c) * step[1]
    if affine:
        (a, b), (d, e) = affine
        y, x = y * a + x * d, y * b + x * e
    return grid.select("pos_id", "iy", "ix", y.alias("y"), x.alias("x"))


def scan_bbox(scan: DataFrame) -> DataFrame:
    """One row: least and largest coordinates; NaN and null positions are left out."""
    ok = lambda c: F.when(~F.isnan(c), F.col(c))
    return scan.agg(F.min(ok("y")).alias("min_y"), F.min(ok("x")).alias("min_x"), F.max(ok("y")).alias("max_y"), F.max(ok("x")).alias("max_x"))


def object_grid_from_scan(scan: DataFrame, step: tuple[float, float], pad: float) -> DataFrame:
    """One row: shape and corner of the object grid that covers the scan and its padding."""
    size = lambda a, s: (F.ceil((F.col(f"max_{a}") - F.col(f"min_{a}") + 2 * pad) / s) + 1).cast("long")
    return scan_bbox(scan).select(size("y", step[0]).alias("ny"), size("x", step[1]).alias("nx"), (F.col("min_y") - pad).alias("corner_y"), (F.col("min_x") - pad).alias("corner_x"))


def expand_to_scan(grid: DataFrame, scan: DataFrame, step: tuple[float, float], pad: float) -> DataFrame:
    """The one-row grid grown by whole pixels until it covers the scan."""
    g = grid.crossJoin(F.broadcast(scan_bbox(scan)))  # one row each
    out = []
    for a, s in (("y", step[0]), ("x", step[1])):
        low = F.ceil(F.greatest(F.lit(0.0), F.col(f"corner_{a}") - (F.col(f"min_{a}") - pad)) / s)
        top = F.col(f"corner_{a}") + (F.col(f"n{a}") - 1) * s
        high = F.ceil(F.greatest(F.lit(0.0), F.col(f"max_{a}") + pad - top) / s)
        out += [(F.col(f"n{a}") + low + high).cast("long").alias(f"n{a}"), (F.col(f"corner_{a}") - low * s).alias(f"corner_{a}")]
    return g.select(*out)


def slices(spark: SparkSession, thicknesses: list[float]) -> DataFrame:
    """(z, thickness, depth): depth is where a slice begins."""
    rows = spark.range(len(thicknesses)).select(F.col("id").alias("z"), F.element_at(F.array(*[F.lit(t) for t in thicknesses]), (F.col("id") + 1).cast("int")).alias("thickness"))
    return depths(rows)


def depths(table: DataFrame) -> DataFrame:
    """Adds the running sum of the thickness before each slice (a slice list is short)."""
    before = Window.orderBy("z").rowsBetween(Window.unboundedPreceding, -1)
    return table.withColumn("depth", F.coalesce(F.sum("thickness").over(before), F.lit(0.0)))


def cutout_index(scan: DataFrame, corner: tuple[float, float], step: tuple[float, float], shape: tuple[int, int]) -> DataFrame:
    """(pos_id, start_y, start_x, sub_y, sub_x): window start of each position, half to even, and what is left of a pixel."""
    out = [F.col("pos_id")]
    for a, c, s, n in zip("yx", corner, step, shape):
        u = (F.col(a) - c) / s - (n - 1) / 2
        out += [F.rint(u).cast("long").alias(f"start_{a}"), ((u - F.rint(u)) * s).alias(f"sub_{a}")]
    return scan.select(*out)


def outside(scan: DataFrame, corner: tuple[float, float], step: tuple[float, float], shape: tuple[int, int], pad: float) -> DataFrame:
    """Positions whose padding leaves the object grid."""
    bad = F.lit(False)
    for a, c, s, n in zip("yx", corner, step, shape):
        bad = bad | (F.col(a) - pad < c) | (F.col(a) + pad > c + (n - 1) * s)
    return scan.where(bad)


def region_crop(corner: tuple[float, float], step: tuple[float, float], shape: tuple[int, int], low: tuple[float, float], high: tuple[float, float]) -> tuple[int, int, int, int]:
    """Pixel bounds (y0, y1, x0, x1) of a region of interest, ends exclusive."""
    out = []
    for c, s, n, a, b in zip(corner, step, shape, low, high):
        out += [max(0, math.ceil((a - c) / s)), min(n, math.floor((b - c) / s) + 1)]
    return tuple(out)
