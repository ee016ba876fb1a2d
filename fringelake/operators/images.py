"""Image operators: resampling, colour, slice interpolation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .grids import index_grid


Matrix = tuple[tuple[float, float], tuple[float, float]]
MODES = ("grid-constant", "nearest", "reflect", "mirror", "grid-wrap")


def scaling(y: float, x: float) -> Matrix:
    return ((y, 0.0), (0.0, x))


def rotation(degrees: float) -> Matrix:
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return ((c, s), (-s, c))


def composed(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(sum(a[i][k] * b[k][j] for k in (0, 1)) for j in (0, 1)) for i in (0, 1))


def about(matrix: Matrix, centre: tuple[float, float], shift: tuple[float, float] = (0.0, 0.0)) -> tuple[float, float]:
    """Offset with which `matrix` keeps `centre` in place, then moves by `shift`."""
    return tuple(centre[i] - sum(matrix[i][k] * centre[k] for k in (0, 1)) + shift[i] for i in (0, 1))


def _inside(i: Column, n: int, mode: str) -> Column:
    """Index of the pixel that stands for index i of n."""
    if mode == "nearest":
        return F.least(F.greatest(i, F.lit(0)), F.lit(n - 1)).cast("long")
    if mode == "grid-wrap":
        return F.pmod(i, F.lit(n)).cast("long")
    period = 2 * n if mode == "reflect" else max(1, 2 * (n - 1))
    p = F.pmod(i, F.lit(period))
    return F.when(p < n, p).otherwise((period - 1 if mode == "reflect" else period) - p).cast("long")


def resample(img: DataFrame, shape: tuple[int, int], matrix: Matrix, offset: tuple[float, float], cval: float = 0.0, by: list[str] | None = None, order: int = 1, mode: str = "grid-constant", source: tuple[int, int] | None = None) -> DataFrame:
    """Output pixel o reads input at matrix @ o + offset: the nearest pixel (order 0) or the four around (order 1).

    Pixels outside are `cval` (grid-constant), or the image goes on by one of
    the other MODES, for which `source` is its shape. Each output pixel meets
    its neighbours through one equi-join.
    """
    if order not in (0, 1) or mode not in MODES or (mode != "grid-constant" and source is None):
        raise ValueError(f"order {order}, mode {mode}: order is 0 or 1, mode one of {MODES}; all but the first need the source's shape")
    by = by or []
    out = index_grid(img.sparkSession, *shape, "oy", "ox")
    (a, b), (c, d) = matrix
    u = out.select("oy", "ox", (a * F.col("oy") + b * F.col("ox") + offset[0]).alias("u"), (c * F.col("oy") + d * F.col("ox") + offset[1]).alias("w"))
    if order == 0:
        near = u.select("oy", "ox", F.floor(F.col("u") + 0.5).cast("long").alias("y"), F.floor(F.col("w") + 0.5).cast("long").alias("x"), F.lit(1.0).alias("weight"))
    else:
        fy, fx = F.col("u") - F.floor("u"), F.col("w") - F.floor("w")
        corner = lambda dy, dx: F.struct((F.floor("u") + dy).cast("long").alias("y"), (F.floor("w") + dx).cast("long").alias("x"), ((fy if dy else 1 - fy) * (fx if dx else 1 - fx)).alias("weight"))
        near = u.select("oy", "ox", F.explode(F.array(corner(0, 0), corner(0, 1), corner(1, 0), corner(1, 1))).alias("n")).select("oy", "ox", "n.*").where("weight > 0")
    if mode != "grid-constant":
        near = near.withColumn("y", _inside(F.col("y"), source[0], mode)).withColumn("x", _inside(F.col("x"), source[1], mode))
    if by:
        near = near.crossJoin(F.broadcast(img.select(*by).distinct()))
    got = near.join(img, [*by, "y", "x"], "left")
    return got.groupBy(*by, F.col("oy").alias("y"), F.col("ox").alias("x")).agg(F.sum(F.col("weight") * F.coalesce("v", F.lit(cval))).alias("v"))


def slice_weights(old: list[float], new: list[float], align: str = "middle", pad: str = "vacuum") -> list[tuple[int, int, float]]:
    """(new slice, old slice, weight): the new slices' log potential from the old ones', linear between slice centres."""
    if align not in ("middle", "top", "bottom") or pad not in ("edge", "vacuum", "average"):
        raise ValueError(f"align {align}: middle, top or bottom; pad {pad}: edge, vacuum or average")
    centres = lambda t: [sum(t[:k]) + t[k] / 2 for k in range(len(t))]
    shift = {"top": 0.0, "bottom": 1.0, "middle": 0.5}[align] * (sum(old) - sum(new))
    z = centres(old)
    knots = [z[0] - old[0], *z, z[-1] + old[-1]]
    outer = {"edge": [{0: 1.0}, {len(old) - 1: 1.0}], "vacuum": [{}, {}], "average": [{k: 1 / len(old) for k in range(len(old))}] * 2}[pad]
    parts = [outer[0], *[{k: 1.0} for k in range(len(old))], outer[1]]
    out = []
    for n, at in enumerate(centres(new)):
        at = min(max(at + shift, knots[0]), knots[-1])
        i = max(k for k in range(len(knots) - 1) if knots[k] <= at)
        t = (at - knots[i]) / (knots[i + 1] - knots[i])
        weights: dict[int, float] = {}
        for part, share in ((parts[i], 1 - t), (parts[i + 1], t)):
            for k, w in part.items():
                weights[k] = weights.get(k, 0.0) + w * share * new[n] / old[k]
        out += [(n, k, w) for k, w in sorted(weights.items())] or [(n, 0, 0.0)]
    return out


def reslicing(old: list[float], new: list[float], align: str = "middle", pad: str = "vacuum") -> list[tuple[int, int, float]]:
    """(new slice, old slice, weight of its logarithm), also from or to a single slice."""
    if len(new) < 2:
        return [(0, k, 1.0) for k in range(len(old))]
    if len(old) == 1:
        return [(n, 0, t / sum(new)) for n, t in enumerate(new)]
    return slice_weights(old, new, align, pad)


def resample_slices(obj: DataFrame, old: list[float], new: list[float], align: str = "middle", pad: str = "vacuum") -> DataFrame:
    """(z, y, x, re, im) at the new thicknesses, the average potential conserved.

    The logarithm is summed with weights that the thicknesses alone give, a few
    numbers: one join on z and one sum. One slice from many is their product,
    many from one share its logarithm by thickness.
    """
    table = obj.sparkSession.createDataFrame(reslicing(old, new, align, pad), "nz long, z long, weight double")
    log, angle = 0.5 * F.log(F.col("re") ** 2 + F.col("im") ** 2), F.atan2("im", "re")
    sums = obj.join(F.broadcast(table), "z").groupBy("nz", "y", "x").agg(F.sum(F.col("weight") * log).alias("a"), F.sum(F.col("weight") * angle).alias("p"))
    return sums.select(F.col("nz").alias("z"), "y", "x", (F.exp("a") * F.cos("p")).alias("re"), (F.exp("a") * F.sin("p")).alias("im"))


def colorize(re: Column, im: Column, top: Column) -> dict[str, Column]:
    """RGB of complex values: hue from the angle, value from the modulus over `top`."""
    h = (F.atan2(im, re) + math.pi) / (2 * math.pi) * 6
    s, v = 0.85, F.try_divide(F.sqrt(re * re + im * im), top)
    k = lambda n: F.pmod(h + n, F.lit(6.0))
    part = lambda n: v - v * s * F.greatest(F.lit(0.0), F.least(k(n), 4 - k(n), F.lit(1.0)))
    return {"r": part(5), "g": part(3), "b": part(1)}


def interpolate_z(old: DataFrame, new: DataFrame) -> DataFrame:
    """Values of `old` (z, y, x, v) at the depths of `new` (z), linear between and clamped at the ends."""
    pairs = new.select(F.col("z").alias("nz")).crossJoin(F.broadcast(old.select("z").distinct()))  # slices are few
    low = pairs.groupBy("nz").agg(F.max(F.when(F.col("z") <= F.col("nz"), F.col("z"))).alias("z0"), F.min(F.when(F.col("z") > F.col("nz"), F.col("z"))).alias("z1"))
    low = low.select("nz", F.coalesce("z0", "z1").alias("z0"), F.coalesce("z1", "z0").alias("z1"))
    a = old.select(F.col("z").alias("z0"), "y", "x", F.col("v").alias("v0"))
    b = old.select(F.col("z").alias("z1"), "y", "x", F.col("v").alias("v1"))
    t = F.coalesce(F.try_divide(F.col("nz") - F.col("z0"), F.col("z1") - F.col("z0")), F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return a.join(F.broadcast(low), "z0").join(b, ["z1", "y", "x"]).select(F.col("nz").alias("z"), "y", "x", (F.col("v0") + t * (F.col("v1") - F.col("v0"))).alias("v"))


def smooth_slices(img: DataFrame, n: int, sigma: float, weight: float) -> DataFrame:
    """Gaussian blur across n slices with edges replicated, blended by `weight`."""
    radius = math.ceil(2 * sigma)
    offsets = [(o, math.exp(-(o * o) / (2 * sigma * sigma))) for o in range(-radius, radius + 1)]
    total = sum(w for _, w in offsets)
    taps = F.explode(F.array(*[F.struct(F.lit(o).alias("o"), F.lit(w / total).alias("w")) for o, w in offsets])).alias("t")
    spread = img.select("z", "y", "x", "v", taps)
    near = spread.select("y", "x", F.col("z"), F.least(F.greatest(F.col("z") + F.col("t.o"), F.lit(0)), F.lit(n - 1)).alias("from_z"), F.col("t.w").alias("w"), F.col("v").alias("own"))
    source = img.select(F.col("z").alias("from_z"), "y", "x", "v")
    blurred = near.join(source, ["from_z", "y", "x"]).groupBy("z", "y", "x").agg(F.sum(F.col("w") * F.col("v")).alias("b"), F.first("own").alias("own"))
    return blurred.select("z", "y", "x", ((1 - weight) * F.col("own") + weight * F.col("b")).alias("v"))


def window_order(*cols: str):
    return Window.orderBy(*cols)
