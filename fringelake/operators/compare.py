"""Comparing images: structural similarity, alignment with a ground truth, Fourier correlation.

Images are long tables (keys, y, x, v) on whole grids; a line of an image is bounded,
so that windows are taken along lines: two exchanges, whatever the window.
"""

from __future__ import annotations

import math
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import shifts


def box_sums(img: DataFrame, radius: int, names: list[str], by: list[str]) -> DataFrame:
    """`names` summed over the square of `radius` around each pixel that has it whole, from prefix sums along both axes."""
    out = img
    for axis, other in (("y", "x"), ("x", "y")):
        line = Window.partitionBy(*by, other).orderBy(axis)
        run = line.rowsBetween(Window.unboundedPreceding, 0)
        out = out.select(*by, "y", "x", *[F.sum(n).over(run).alias(n) for n in names], F.row_number().over(line).alias("__k"))
        last = lambda n: F.lead(n, radius).over(line)
        before = lambda n: F.when(F.col("__k") > radius + 1, F.lag(n, radius + 1).over(line)).otherwise(0.0)
        out = out.select(*by, "y", "x", *[F.when(F.col("__k") > radius, last(n) - before(n)).alias(n) for n in names]).where(F.col(names[0]).isNotNull())
    return out


def gauss_sums(img: DataFrame, radius: int, sigma: float, names: list[str], by: list[str]) -> DataFrame:
    """As box_sums, with Gaussian weights that sum to one."""
    taps = [math.exp(-(o * o) / (2 * sigma * sigma)) for o in range(-radius, radius + 1)]
    weights = F.array(*[F.lit(t / sum(taps)) for t in taps])
    out = img
    for axis, other in (("y", "x"), ("x", "y")):
        line = Window.partitionBy(*by, other).orderBy(axis).rowsBetween(-radius, radius)
        lists = out.select(*by, "y", "x", *[F.collect_list(n).over(line).alias(n) for n in names]).where(F.size(names[0]) == 2 * radius + 1)
        dot = lambda n: F.aggregate(F.zip_with(n, weights, lambda a, w: a * w), F.lit(0.0), lambda s, x: s + x)
        out = lists.select(*by, "y", "x", *[dot(n).alias(n) for n in names])
    return out


def ssim_map(pairs: DataFrame, by: list[str], radius: int = 3, sigma: float | None = None, k1: float = 0.01, k2: float = 0.03) -> DataFrame:
    """(by, y, x, ssim) of `pairs` (by, y, x, a, b), b being the truth whose range sets the constants.

    Pixels nearer to the border than `radius` have none. Variances are those of a
    sample. Means are taken off first, so that prefix sums lose no digits.
    """
    whole = pairs.groupBy(*by).agg(F.avg("a").alias("ma"), F.avg("b").alias("mb"), (F.max("b") - F.min("b")).alias("range"))
    a, b = F.col("a") - F.col("ma"), F.col("b") - F.col("mb")
    centred = pairs.join(F.broadcast(whole) if not by else whole, by) if by else pairs.crossJoin(F.broadcast(whole))
    moments = centred.select(*by, "y", "x", a.alias("sa"), b.alias("sb"), (a * a).alias("saa"), (b * b).alias("sbb"), (a * b).alias("sab"))
    names = ["sa", "sb", "saa", "sbb", "sab"]
    n = float((2 * radius + 1) ** 2)
    sums = box_sums(moments, radius, names, by) if sigma is None else gauss_sums(moments, radius, sigma, names, by)
    d = n if sigma is None else 1.0
    sums = sums.join(whole, by) if by else sums.crossJoin(F.broadcast(whole))
    ea, eb = F.col("sa") / d, F.col("sb") / d
    sample = n / (n - 1)
    va, vb, vab = (sample * (F.col(m) / d - p * q) for m, p, q in (("saa", ea, ea), ("sbb", eb, eb), ("sab", ea, eb)))
    ma, mb = ea + F.col("ma"), eb + F.col("mb")
    c1, c2 = (k1 * F.col("range")) ** 2, (k2 * F.col("range")) ** 2
    value = (2 * ma * mb + c1) * (2 * vab + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))
    return sums.select(*by, "y", "x", value.alias("ssim"))


def ssim(pairs: DataFrame, by: list[str], radius: int = 3, sigma: float | None = None) -> DataFrame:
    """(by, ssim): the mean of each image's map."""
    return ssim_map(pairs, by, radius, sigma).groupBy(*by).agg(F.avg("ssim").alias("ssim"))


def _halved(img: DataFrame, times: int) -> DataFrame:
    """Means of squares of 2**times pixels."""
    size = 1 << times
    return img.groupBy(F.floor(F.col("y") / size).cast("long").alias("y"), F.floor(F.col("x") / size).cast("long").alias("x")).agg(F.avg("v").alias("v"))


Range = tuple[int, int]


def shift_scores(img: DataFrame | shifts.Image, truth: DataFrame, dys: Range, dxs: Range, overlap: int) -> DataFrame:
    """(dy, dx, n, score): correlation of img at (y, x) with truth at (y + dy, x + dx), first to last shift of each axis, where `overlap` pixels at least meet.

    Blocks meet, not pixels: an exchange has each pixel about once, whatever the number of shifts.
    """
    img = img if isinstance(img, shifts.Image) else shifts.plain(img)
    return shifts.scores(img, truth, dys, dxs).where(F.col("n") >= overlap)


def best_shift(img: DataFrame | shifts.Image, truth: DataFrame, most: int, levels: int = 0, share: float = 0.5) -> tuple[int, int]:
    """The whole shift of at most `most` pixels along each axis with the largest correlation, `share` of the image's pixels overlapping.

    Searched on images of means of 2**levels pixels first, all shifts there, then
    among the neighbours on each finer level; of equal scores the least shift.
    """
    at, reach, blocks = (0, 0), -(-most >> levels) if most else 0, isinstance(img, shifts.Image)
    for level in range(levels, -1, -1):
        size = 1 << level
        a, b = (_halved(shifts.pixels(img) if blocks else img, level), _halved(truth, level)) if level else (img, truth)
        n = shifts.count(a) if isinstance(a, shifts.Image) else a.count()
        around = reach if level == levels else 2
        centre = at if level == levels else (2 * at[0], 2 * at[1])
        limit = -(-most // size)
        dys, dxs = ((max(c - around, -limit), min(c + around, limit)) for c in centre)
        scores = shift_scores(a, b, dys, dxs, math.ceil(share * n))
        first = scores.where(~F.isnan("score")).orderBy(F.desc(F.round("score", 12)), F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx"), "dy", "dx").first()
        if first is None:
            raise ValueError("no shift has enough pixels in common: the truth is smaller than the image")
        at = (first["dy"], first["dx"])
    return at


def subpixel(scores: DataFrame, at: tuple[int, int]) -> DataFrame:
    """(dy, dx, score): the peak of a parabola through the scores around `at` on each axis (itself where a neighbour is missing)."""
    pick = lambda p, q: F.max(F.when((F.col("dy") == at[0] + p) & (F.col("dx") == at[1] + q), F.col("score")))
    s = scores.agg(pick(0, 0).alias("o"), pick(-1, 0).alias("u"), pick(1, 0).alias("d"), pick(0, -1).alias("l"), pick(0, 1).alias("r"))
    peak = lambda low, high: F.coalesce(F.try_divide(F.col(low) - F.col(high), 2 * (F.col(low) - 2 * F.col("o") + F.col(high))), F.lit(0.0))
    return s.select((F.lit(float(at[0])) + peak("u", "d")).alias("dy"), (F.lit(float(at[1])) + peak("l", "r")).alias("dx"), F.col("o").alias("score"))


def _gridded(obj: DataFrame, shape: tuple[int, int], step: tuple[float, float], truth_step: tuple[float, float], corner: tuple[float, float], truth_corner: tuple[float, float], order: int = 1, last: tuple[int, int] | None = None) -> shifts.Image:
    scale = (truth_step[0] / step[0], truth_step[1] / step[1])
    return shifts.gridded(obj, shape, scale, tuple((truth_corner[i] - corner[i]) / step[i] for i in (0, 1)), order, last)


def on_truth_grid(obj: DataFrame, shape: tuple[int, int], step: tuple[float, float], truth_step: tuple[float, float], corner: tuple[float, float] = (0.0, 0.0), truth_corner: tuple[float, float] = (0.0, 0.0), order: int = 1) -> DataFrame:
    """`obj` (y, x, v), sampled by `step` from `corner` on, at the truth's pixels; those outside have no row."""
    return shifts.pixels(_gridded(obj, shape, step, truth_step, corner, truth_corner, order))


def aligned_difference(obj: DataFrame, truth: DataFrame, shape: tuple[int, int], step: tuple[float, float], truth_step: tuple[float, float], most: int, levels: int = 0) -> DataFrame:
    """(y, x, object, truth, d) on the truth's grid, cropped to what both have, after the object is moved to where it fits best.

    `obj` and `truth` are (y, x, v); `shape` is the truth's; `most`: truth pixels of the shift at most.
    A pixel that the object lacks before its last line and column is 0, if one beside it is there.
    The object is read on that grid in the tasks that hold its blocks, so no exchange has it at the truth's pixels.
    """
    last = tuple(obj.agg(F.max("y"), F.max("x")).first())
    seen = _gridded(obj, shape, step, truth_step, (0.0, 0.0), (0.0, 0.0), last=None if None in last else last)
    dy, dx = best_shift(seen, truth, most, levels)
    return shifts.met(seen, truth, dy, dx).withColumn("d", F.col("object") - F.col("truth"))


def hann(i: Column, n: int) -> Column:
    """The periodic Hann window of n points."""
    return 0.5 - 0.5 * F.cos(2 * math.pi * i / n)


def windowed(px: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """(.., y, x, v) times a Hann window of both axes."""
    return px.withColumn("v", F.col("v") * hann(F.col("y"), shape[0]) * hann(F.col("x"), shape[1]))


def normalised_cross(a: DataFrame, b: DataFrame, by: list[str], tiny: float = 1e-24) -> DataFrame:
    """(by, y, x, re, im): a * conj(b) over the moduli of two spectra (by, y, x, re, im); where either has no power it is 1."""
    both = a.join(b.select(*by, "y", "x", F.col("re").alias("br"), F.col("im").alias("bi")), [*by, "y", "x"])
    re, im = F.col("re") * F.col("br") + F.col("im") * F.col("bi"), F.col("im") * F.col("br") - F.col("re") * F.col("bi")
    power = (F.col("re") ** 2 + F.col("im") ** 2) * (F.col("br") ** 2 + F.col("bi") ** 2)
    return both.select(*by, "y", "x", F.when(power > tiny, re / F.sqrt(power)).otherwise(1.0).alias("re"), F.when(power > tiny, im / F.sqrt(power)).otherwise(0.0).alias("im"))
