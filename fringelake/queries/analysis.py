"""Queries over reductions, images, optics, losses and optimiser steps."""

from __future__ import annotations

import math

from pyspark.sql import Window, functions as F

from ..functions.complexcol import c_mul
from ..operators import align, export, images, losses, optics, preprocess, ranks, reduce
from . import bridge
from .bridge import N, query, rounded

PI = repr(math.pi)
LAM = optics.wavelength(200e3)


@query("px", sql="SELECT ky, kx, round(sum(v), 6) AS v FROM px GROUP BY ky, kx")
def pacbed(spark, d):
    return rounded(reduce.pacbed(bridge.px(spark, d)))


@query("px", "mask", sql="SELECT iy, ix, round(sum(v * m), 6) AS v FROM px JOIN mask USING (ky, kx) GROUP BY iy, ix")
def virtual_detector(spark, d):
    return rounded(reduce.virtual_detector(bridge.px(spark, d), bridge.mask(spark)))


@query("px", "mask", sql="SELECT ky, kx, round(avg(v * m), 6) AS v FROM px JOIN mask USING (ky, kx) GROUP BY ky, kx")
def mean_pattern(spark, d):
    return rounded(reduce.mean_pattern(bridge.px(spark, d), bridge.mask(spark)))


@query("px", "mask", sql="SELECT pos_id, iy, ix, round(sum(v), 6) AS total, round(sum(ky * v) / sum(v), 6) AS com_y, round(sum(kx * v) / sum(v), 6) AS com_x, round(sum(v * m), 6) AS detector FROM px JOIN mask USING (ky, kx) GROUP BY pos_id, iy, ix")
def center_of_mass(spark, d):
    px = bridge.px(spark, d).join(F.broadcast(bridge.mask(spark)), ["ky", "kx"])
    total = F.sum("v")
    return rounded(px.groupBy("pos_id", "iy", "ix").agg(total.alias("total"), F.try_divide(F.sum(F.col("ky") * F.col("v")), total).alias("com_y"), F.try_divide(F.sum(F.col("kx") * F.col("v")), total).alias("com_x"), F.sum(F.col("v") * F.col("m")).alias("detector")))


@query("px", sql="SELECT round(avg(t), 6) AS mean_intensity FROM (SELECT sum(v) AS t FROM px GROUP BY pos_id)")
def mean_intensity(spark, d):
    return rounded(reduce.mean_intensity(bridge.px(spark, d)))


@query("px", sql="SELECT pos_id, CAST(floor(sqrt((ky - 3.5) * (ky - 3.5) + (kx - 3.5) * (kx - 3.5)) / 0.7) AS BIGINT) AS r, round(sum(v), 6) AS v, count(*) AS n FROM px GROUP BY 1, 2")
def radial_bins(spark, d):
    return rounded(reduce.radial_bins(bridge.px(spark, d), (3.5, 3.5), 0.7, "pos_id"))


@query("px", sql=", b AS (SELECT CAST(floor(sqrt((ky - 3.5) * (ky - 3.5) + (kx - 3.5) * (kx - 3.5)) / 0.7) AS BIGINT) AS r, sum(v) AS v FROM px GROUP BY 1), c AS (SELECT r, sum(v) OVER (ORDER BY r) AS cum, sum(v) OVER () AS total FROM b) SELECT min(r) AS radius FROM c WHERE cum > 0.8 * total")
def encircled_energy(spark, d):
    return reduce.encircled_radius(reduce.radial_bins(bridge.px(spark, d), (3.5, 3.5), 0.7), 0.8)


_RINGS = ", ra AS (SELECT a.pos_id, CAST(floor(sqrt((a.y - 3.5) * (a.y - 3.5) + (a.x - 3.5) * (a.x - 3.5))) AS BIGINT) AS r, a.re AS re1, a.im AS im1, b.re AS re2, b.im AS im2 FROM cx a JOIN cx b ON b.pos_id = a.pos_id + 1 AND a.y = b.y AND a.x = b.x), rc AS (SELECT r, sqrt(power(sum(re1 * re2 + im1 * im2), 2) + power(sum(im1 * re2 - re1 * im2), 2)) / sqrt(sum(re1 * re1 + im1 * im1) * sum(re2 * re2 + im2 * im2)) AS frc, sqrt(sum(re1 * re1 + im1 * im1) / sum(re2 * re2 + im2 * im2)) AS ratio FROM ra GROUP BY r)"


def _rings(spark, d):
    a = bridge.cx(spark, d).select("pos_id", "y", "x", F.col("re").alias("re1"), F.col("im").alias("im1"))
    b = bridge.cx(spark, d).select((F.col("pos_id") - 1).alias("pos_id"), "y", "x", F.col("re").alias("re2"), F.col("im").alias("im2"))
    r = F.floor(F.sqrt((F.col("y") - 3.5) ** 2 + (F.col("x") - 3.5) ** 2)).cast("long").alias("r")
    return a.join(b, ["pos_id", "y", "x"]).select(r, "re1", "im1", "re2", "im2")


@query("cx", sql=_RINGS + " SELECT r, round(frc, 6) AS frc FROM rc")
def ring_correlation(spark, d):
    return rounded(reduce.ring_correlation(_rings(spark, d)).select("r", "frc"))


@query("cx", sql=_RINGS + " SELECT r, round(ratio, 6) AS ratio FROM rc")
def contrast_ratio(spark, d):
    return rounded(reduce.ring_correlation(_rings(spark, d)).select("r", "ratio"))


@query("cx", sql=_RINGS + ", d AS (SELECT r, round(frc, 9) - avg(round(frc, 9)) OVER () AS d FROM rc), e AS (SELECT r, d, lag(d) OVER (ORDER BY r) AS d0 FROM d) SELECT round(r - 1 + d0 / (d0 - d), 4) AS crossing FROM e WHERE d < 0 AND d0 >= 0 ORDER BY r LIMIT 1")
def frc_crossing(spark, d):
    curve = rounded(reduce.ring_correlation(_rings(spark, d)).select("r", "frc"), 9)
    mean = curve.agg(F.avg("frc").alias("mean"))  # the threshold, one row
    return rounded(reduce.first_crossing(curve.crossJoin(F.broadcast(mean)).select("r", (F.col("frc") - F.col("mean")).alias("frc")), 0.0), 4)


_SCALE = "SELECT z, y, x, CAST(floor(least(greatest(256 / (hi - lo) * (v - lo), 0), 255)) AS BIGINT) AS v FROM img, (SELECT quantile_cont(v, 0.001) AS lo, quantile_cont(v, 0.999) AS hi FROM img)"


@query("img", sql=_SCALE)
def robust_scale(spark, d):
    return reduce.robust_scale(bridge.img(spark, d), 8)


_RAMP = """, m AS (SELECT z, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(v) AS mv, covar_pop(CAST(x AS DOUBLE), CAST(x AS DOUBLE)) AS sxx, covar_pop(CAST(x AS DOUBLE), CAST(y AS DOUBLE)) AS sxy, covar_pop(CAST(y AS DOUBLE), CAST(y AS DOUBLE)) AS syy, covar_pop(CAST(x AS DOUBLE), v) AS sxv, covar_pop(CAST(y AS DOUBLE), v) AS syv FROM {img} GROUP BY z),
r AS (SELECT z, y, x, v - mv - (sxv * syy - syv * sxy) / (sxx * syy - sxy * sxy) * (x - mx) - (syv * sxx - sxv * sxy) / (sxx * syy - sxy * sxy) * (y - my) AS v FROM {img} JOIN m USING (z))"""


@query("img", sql=_RAMP.format(img="img") + " SELECT z, y, x, round(v, 6) + 0.0 AS v FROM r")
def remove_ramp(spark, d):
    return rounded(reduce.remove_ramp(bridge.img(spark, d), "z"))


@query("stack", sql=", ph AS (SELECT z, y, x, atan2(im, re) AS v FROM stack)" + _RAMP.format(img="ph") + " SELECT z, y, x, round(sqrt(re * re + im * im) * cos(r.v), 6) + 0.0 AS re, round(sqrt(re * re + im * im) * sin(r.v), 6) + 0.0 AS im FROM stack JOIN r USING (z, y, x)")
def remove_phase_ramp(spark, d):
    s = bridge.stack(spark, d)
    flat = reduce.remove_ramp(s.select("z", "y", "x", F.atan2("im", "re").alias("v")), "z")
    a = F.sqrt(F.col("re") ** 2 + F.col("im") ** 2)
    return rounded(s.join(flat, ["z", "y", "x"]).select("z", "y", "x", (a * F.cos("v")).alias("re"), (a * F.sin("v")).alias("im")))


_DIFF = "SELECT {by}lead(v) OVER (PARTITION BY {part} ORDER BY {axis}) - v AS d FROM img"


@query("img", sql=", g AS (SELECT coalesce(lead(v) OVER (PARTITION BY z, x ORDER BY y), v) - v AS gy, coalesce(lead(v) OVER (PARTITION BY z, y ORDER BY x), v) - v AS gx FROM img) SELECT round(sum(sqrt(gy * gy + gx * gx + 1e-8)), 6) AS cost FROM g")
def tv_cost(spark, d):
    return rounded(reduce.gradients(bridge.img(spark, d), "z").agg(F.sum(F.sqrt(F.col("gy") ** 2 + F.col("gx") ** 2 + 1e-8)).alias("cost")))


@query("img", sql=", dd AS (SELECT lead(v) OVER (PARTITION BY z, x ORDER BY y) - v AS d FROM img UNION ALL SELECT lead(v) OVER (PARTITION BY z, y ORDER BY x) - v AS d FROM img) SELECT round(sum(d * d), 6) AS cost FROM dd")
def tikhonov_cost(spark, d):
    i = bridge.img(spark, d)
    both = reduce.differences(i, "y", "z", "x").select("d").unionByName(reduce.differences(i, "x", "z", "y").select("d"))
    return rounded(both.agg(F.sum(F.col("d") ** 2).alias("cost")))


@query("img", sql=", dd AS (SELECT lead(v) OVER (PARTITION BY y, x ORDER BY z) - v AS d FROM img) SELECT round(sum(abs(d)), 6) AS cost FROM dd")
def layers_tv(spark, d):
    return rounded(reduce.differences(bridge.img(spark, d), "z", "y", "x").agg(F.sum(F.abs("d")).alias("cost")))


@query("img", sql=", dd AS (SELECT lead(v) OVER (PARTITION BY y, x ORDER BY z) - v AS d FROM img) SELECT round(sum(d * d), 6) AS cost FROM dd")
def layers_tikhonov(spark, d):
    return rounded(reduce.differences(bridge.img(spark, d), "z", "y", "x").agg(F.sum(F.col("d") ** 2).alias("cost")))


@query("stack", sql="SELECT round(sum(sqrt((re - 1) * (re - 1) + im * im)), 6) AS cost FROM stack")
def l1_cost(spark, d):
    return rounded(bridge.stack(spark, d).agg(F.sum(F.sqrt((F.col("re") - 1) ** 2 + F.col("im") ** 2)).alias("cost")))


@query("stack", sql="SELECT round(sum((re - 1) * (re - 1) + im * im), 6) AS cost FROM stack")
def l2_cost(spark, d):
    return rounded(bridge.stack(spark, d).agg(F.sum((F.col("re") - 1) ** 2 + F.col("im") ** 2).alias("cost")))


@query("stack", sql="SELECT round(sum(abs(atan2(im, re))), 6) AS cost FROM stack")
def phase_l1(spark, d):
    return rounded(bridge.stack(spark, d).agg(F.sum(F.abs(F.atan2("im", "re"))).alias("cost")))


_AMP = "m * power(sqrt(greatest(measured, 0) + {c}) - sqrt(model + {c}) - 0.001, 2)"


@query("pairs", sql=f"SELECT round(sum({_AMP.format(c='0.0')}) * 2.0, 5) AS loss FROM pairs")
def amplitude_loss(spark, d):
    return rounded(losses.amplitude_loss(bridge.pairs(spark, d)), 5)


@query("pairs", sql=f"SELECT round(sum({_AMP.format(c='0.375')}) * 2.0, 5) AS loss FROM pairs")
def anscombe_loss(spark, d):
    return rounded(losses.amplitude_loss(bridge.pairs(spark, d), offset=0.375), 5)


@query("pairs", sql="SELECT round(sum(m * (model + greatest(measured, 0) * (ln(greatest(measured, 0) + 0.001) - ln(model + 0.001) - 1))), 5) AS loss FROM pairs")
def poisson_loss(spark, d):
    return rounded(losses.poisson_loss(bridge.pairs(spark, d)), 5)


@query("pairs", "cx", sql="SELECT p.pos_id, ky, kx, round(((sqrt(greatest(measured, 0) + 0.375) / (sqrt(model + 0.375) + 0.001) - 1) * m) * re, 6) + 0.0 AS re, round(((sqrt(greatest(measured, 0) + 0.375) / (sqrt(model + 0.375) + 0.001) - 1) * m) * im, 6) + 0.0 AS im FROM pairs p JOIN cx ON p.pos_id = cx.pos_id AND ky = y AND kx = x")
def wave_update(spark, d):
    psi = bridge.cx(spark, d).select("pos_id", F.col("y").alias("ky"), F.col("x").alias("kx"), "re", "im")
    f = losses.wave_factor(0.375, 1e-3)
    return rounded(bridge.pairs(spark, d).join(psi, ["pos_id", "ky", "kx"]).select("pos_id", "ky", "kx", (f * F.col("re")).alias("re"), (f * F.col("im")).alias("im")))


@query("pairs", sql="SELECT round(avg(e), 6) AS error FROM (SELECT sqrt(sum((model - measured) * (model - measured))) AS e FROM pairs GROUP BY pos_id)")
def detector_error(spark, d):
    return rounded(losses.detector_error(bridge.pairs(spark, d)))


@query("pairs", sql="SELECT round(avg(f), 6) AS factor FROM (SELECT sum(measured * m) / nullif(sum(model * m), 0) AS f FROM pairs GROUP BY pos_id)")
def rescale_factor(spark, d):
    return rounded(losses.rescale_factor(bridge.pairs(spark, d)))


_CLAMP = "SELECT z, y, x, round(re * least(a, 1.05) / a, 6) + 0.0 AS re, round(im * least(a, 1.05) / a, 6) + 0.0 AS im FROM (SELECT *, sqrt(re * re + im * im) AS a FROM stack)"


@query("stack", sql=_CLAMP)
def clamp_amplitude(spark, d):
    re, im = losses.clamp_amplitude(F.col("re"), F.col("im"), 1.05)
    return rounded(bridge.stack(spark, d).select("z", "y", "x", re.alias("re"), im.alias("im")))


def _channel(n):
    k = f"((h + {n}) - 6 * floor((h + {n}) / 6))"
    return f"v - v * 0.85 * greatest(0.0, least({k}, 4 - {k}, 1.0))"


@query("stack", sql=f"SELECT z, y, x, round({_channel(5)}, 5) AS r, round({_channel(3)}, 5) AS g, round({_channel(1)}, 5) AS b FROM (SELECT z, y, x, (atan2(im, re) + {PI}) / (2 * {PI}) * 6 AS h, sqrt(re * re + im * im) / (SELECT max(sqrt(re * re + im * im)) FROM stack) AS v FROM stack)")
def colorize(spark, d):
    s = bridge.stack(spark, d)
    top = s.agg(F.max(F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))).alias("top"))
    rgb = images.colorize(F.col("re"), F.col("im"), F.col("top"))
    return rounded(s.crossJoin(F.broadcast(top)).select("z", "y", "x", *[c.alias(n) for n, c in rgb.items()]), 5)


@query("stack", sql="SELECT y, x, round(product(re * re + im * im), 6) AS v FROM stack GROUP BY y, x")
def mag_stack_product(spark, d):
    return rounded(bridge.stack(spark, d).groupBy("y", "x").agg(F.product(F.col("re") ** 2 + F.col("im") ** 2).alias("v")))


_UNWRAP = f""", a AS (SELECT z, y, x, 3 * v AS v, coalesce(3 * v - lag(3 * v) OVER (PARTITION BY z, y ORDER BY x), 0.0) AS d FROM img),
b AS (SELECT z, y, x, v + 2 * {PI} * sum(0 - floor((d + {PI}) / (2 * {PI}))) OVER (PARTITION BY z, y ORDER BY x) AS v FROM a),
c AS (SELECT z, y, x, v, coalesce(v - lag(v) OVER (PARTITION BY z, x ORDER BY y), 0.0) AS d FROM b),
u AS (SELECT z, y, x, v + 2 * {PI} * sum(0 - floor((d + {PI}) / (2 * {PI}))) OVER (PARTITION BY z, x ORDER BY y) AS v FROM c)"""


@query("img", sql=_UNWRAP + " SELECT z, y, x, round(v, 6) + 0.0 AS v FROM u")
def phase_unwrap(spark, d):
    i = bridge.img(spark, d).withColumn("v", 3 * F.col("v"))
    return rounded(reduce.unwrap(reduce.unwrap(i, "x", "z", "y"), "y", "z", "x"))


_TAPS = ", ".join(f"({o}, {math.exp(-o * o / 2.0) / sum(math.exp(-q * q / 2.0) for q in range(-2, 3))!r})" for o in range(-2, 3))
_SMOOTH = f"SELECT a.z, a.y, a.x, round(0.7 * min(a.v) + 0.3 * sum(w * b.v), 6) AS v FROM img a, (VALUES {_TAPS}) AS t(o, w), img b WHERE b.y = a.y AND b.x = a.x AND b.z = least(greatest(a.z + o, 0), 9) GROUP BY a.z, a.y, a.x"


@query("img", sql=_SMOOTH)
def layer_smooth(spark, d):
    return rounded(images.smooth_slices(bridge.img(spark, d), 10, 1.0, 0.3))


@query(sql="WITH p AS (SELECT k // 6 AS oy, k % 6 AS ox, (k // 6) * 1.3 + 0.2 AS u, (k % 6) * 1.1 - 0.4 AS w FROM range(36) AS t(k)), " + bridge.CTE["cx"] + ", " + bridge.CTE["stack"] + """, n AS (SELECT oy, ox, CAST(floor(u) AS BIGINT) + dy AS y, CAST(floor(w) AS BIGINT) + dx AS x, (CASE WHEN dy = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END) * (CASE WHEN dx = 1 THEN w - floor(w) ELSE 1 - (w - floor(w)) END) AS weight FROM p, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS c(dy, dx)),
  zs AS (SELECT DISTINCT z FROM stack) SELECT zs.z, oy AS y, ox AS x, round(sum(weight * coalesce(re, 1.0)), 6) AS v FROM n CROSS JOIN zs LEFT JOIN stack s ON s.z = zs.z AND s.y = n.y AND s.x = n.x GROUP BY zs.z, oy, ox""")
def resample_bilinear(spark, d):
    return rounded(images.resample(bridge.img(spark, d), (6, 6), ((1.3, 0.0), (0.0, 1.1)), (0.2, -0.4), 1.0, ["z"]))


@query("img", sql=", nz AS (SELECT CAST(z AS DOUBLE) AS nz FROM (VALUES (-1.0), (0.4), (3.0), (4.75), (12.0)) AS t(z)), b AS (SELECT nz, coalesce(max(CASE WHEN z <= nz THEN z END), min(z)) AS z0, coalesce(min(CASE WHEN z > nz THEN z END), max(z)) AS z1 FROM nz, (SELECT DISTINCT z FROM img) GROUP BY nz) SELECT nz AS z, p.y, p.x, round(p.v + coalesce(least(greatest((nz - z0) / nullif(z1 - z0, 0), 0), 1), 0) * (q.v - p.v), 6) AS v FROM b JOIN img p ON p.z = z0 JOIN img q ON q.z = z1 AND q.y = p.y AND q.x = p.x")
def z_interpolate(spark, d):
    new = spark.createDataFrame([(z,) for z in (-1.0, 0.4, 3.0, 4.75, 12.0)], "z double")
    return rounded(images.interpolate_z(bridge.img(spark, d).withColumn("z", F.col("z").cast("double")), new))


@query("stack", sql="SELECT CAST(p AS BIGINT) AS part, y, x, round(exp(sum(ln(sqrt(re * re + im * im)))), 6) AS v FROM stack JOIN (SELECT k AS z, k // 4 AS p FROM range(10) AS t(k)) USING (z) GROUP BY p, y, x")
def reslice_real(spark, d):
    s = bridge.stack(spark, d).withColumn("part", F.floor(F.col("z") / 4))
    return rounded(s.groupBy("part", "y", "x").agg(F.exp(F.sum(F.ln(F.sqrt(F.col("re") ** 2 + F.col("im") ** 2)))).alias("v")))


_SHIFT = """, c AS (SELECT sum(ky * v * m) / sum(v * m) - 3.5 AS dy, sum(kx * v * m) / sum(v * m) - 3.5 AS dx FROM px JOIN {mask} USING (ky, kx)),
  o AS (SELECT k // 8 AS oy, k % 8 AS ox, k // 8 + dy AS u, k % 8 + dx AS w FROM range(64) AS t(k), c),
  n AS (SELECT oy, ox, CAST(floor(u) AS BIGINT) + e AS ky, CAST(floor(w) AS BIGINT) + f AS kx, (CASE WHEN e = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END) * (CASE WHEN f = 1 THEN w - floor(w) ELSE 1 - (w - floor(w)) END) AS wt FROM o, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS q(e, f))"""
_ALL_SEEN = "(SELECT k // 8 AS ky, k % 8 AS kx, 1.0 AS m FROM range(64) AS t(k)) AS a"
_MIDDLE = (3.5, 3.5)


@query("px", sql=_SHIFT.format(mask=_ALL_SEEN) + " SELECT px.pos_id, oy AS ky, ox AS kx, round(sum(wt * v), 5) AS v FROM n JOIN px ON px.ky = n.ky AND px.kx = n.kx WHERE wt > 0 GROUP BY px.pos_id, oy, ox")
def diffraction_align(spark, d):
    px = bridge.px(spark, d)
    seen = bridge.mask(spark).withColumn("m", F.lit(1.0))
    by = align.centre(px, seen, (N, N), middle=_MIDDLE).first()  # one row
    return rounded(align.shifted(px, (by["dy"], by["dx"]), (N, N), ["pos_id"]), 5)


@query("px", "mask", sql=_SHIFT.format(mask="mask") + " SELECT oy AS ky, ox AS kx, round(sum(CASE WHEN wt > 0 THEN wt * coalesce(m, 0) ELSE 0 END), 6) AS m FROM n LEFT JOIN mask ON mask.ky = n.ky AND mask.kx = n.kx GROUP BY oy, ox")
def diffraction_align_mask(spark, d):
    """The mask moves with the patterns, whose centre is that of what it leaves."""
    mask = bridge.mask(spark)
    by = align.centre(bridge.px(spark, d), mask, (N, N), middle=_MIDDLE).first()  # one row
    return rounded(align.shifted(mask, (by["dy"], by["dx"]), (N, N), [], value="m"))


def _dft_sql(inverse):
    sign, a, out = ("", "{}", "((b + 4) % 8)") if inverse else ("-", "(({} + 4) % 8)", "b")
    angle = lambda c: f"{sign}2 * {PI} / 8 * (({a.format(c)} * b) % 8)"
    return f""", t AS (SELECT k AS b FROM range(8) AS r(k)), r1 AS (SELECT pos_id, y, {out} AS kx, sum(re * cos({angle('x')}) - im * sin({angle('x')})) / sqrt(8) AS re, sum(re * sin({angle('x')}) + im * cos({angle('x')})) / sqrt(8) AS im FROM cx, t GROUP BY 1, 2, 3)
  SELECT pos_id, {out} AS ky, kx, round(sum(re * cos({angle('y')}) - im * sin({angle('y')})) / sqrt(8), 6) + 0.0 AS re, round(sum(re * sin({angle('y')}) + im * cos({angle('y')})) / sqrt(8), 6) + 0.0 AS im FROM r1, t GROUP BY 1, 2, 3"""


@query("cx", sql=_dft_sql(False))
def dft2_small(spark, d):
    return rounded(optics.dft2(bridge.cx(spark, d), spark.range(8).withColumnRenamed("id", "b"), 8))


@query("cx", sql=_dft_sql(True))
def idft2_small(spark, d):
    return rounded(optics.dft2(bridge.cx(spark, d), spark.range(8).withColumnRenamed("id", "b"), 8, inverse=True))


@query("scan", "grid", sql=f"SELECT pos_id, ky, kx, round(cos(-2 * {PI} * (y * fy + x * fx)), 6) + 0.0 AS re, round(sin(-2 * {PI} * (y * fy + x * fx)), 6) + 0.0 AS im FROM scan, grid")
def shift_filter(spark, d):
    return rounded(optics.shift_filter(bridge.recip(spark), bridge.scan(spark, d).select("pos_id", "y", "x")))


_FRES = f"-{PI} * 10.0 * ({LAM!r} * (fy * fy + fx * fx) - 2 * (fx * tan(5.0 * 0.001) + fy * tan(8.0 * 0.001)))"


@query("grid", sql=f"SELECT ky, kx, round(cos({_FRES}), 6) + 0.0 AS re, round(sin({_FRES}), 6) + 0.0 AS im FROM grid")
def fresnel(spark, d):
    return rounded(optics.fresnel(bridge.recip(spark), LAM, 10.0, (8.0, 5.0)))


_FR0 = f"-{PI} * 10.0 * ({LAM!r} * (fy * fy + fx * fx))"
_RMP = f"2 * {PI} * 10.0 * (fx * tan(x * 0.001) + fy * tan(y * 0.001))"


@query("scan", "grid", sql=f"SELECT pos_id, ky, kx, round(cos({_FR0}) * cos({_RMP}) - sin({_FR0}) * sin({_RMP}), 6) + 0.0 AS re, round(cos({_FR0}) * sin({_RMP}) + sin({_FR0}) * cos({_RMP}), 6) + 0.0 AS im FROM scan, grid")
def tilt_ramp(spark, d):
    g = bridge.recip(spark)
    tilts = bridge.scan(spark, d).select("pos_id", F.col("y").alias("ty"), F.col("x").alias("tx"))
    return rounded(optics.tilt_propagators(optics.fresnel(g, LAM, 10.0), g, tilts, 10.0))


@query(sql=f"SELECT dz, round(cos(-{PI} * round(dz, 5) * {LAM!r} * 0.25), 6) AS re, round(sin(-{PI} * round(dz, 5) * {LAM!r} * 0.25), 6) + 0.0 AS im FROM (VALUES (4.0), (2.5), (4.000001), (3.0)) AS t(d0), (SELECT 0), LATERAL (SELECT CAST(d0 AS DOUBLE) AS dz)")
def propagator_lookup(spark, d):
    z = spark.createDataFrame([(4.0,), (2.5,), (4.000001,), (3.0,)], "dz double").withColumn("key", F.round("dz", 5))
    g = spark.range(1).select(F.lit(0.5).alias("fy"), F.lit(0.0).alias("fx"))
    re, im = optics.fresnel_pair(LAM, F.col("key"))
    props = z.select("key").distinct().crossJoin(g).select("key", re.alias("re"), im.alias("im"))
    return rounded(z.join(props, "key").select("dz", "re", "im"), 6, "re", "im")


@query("grid", sql=f", p AS (SELECT ky, kx, fy, fx, (fy * fy + fx * fx) * {LAM!r} * {LAM!r} AS t2 FROM grid), q AS (SELECT ky, kx, CASE WHEN sqrt(t2) <= 0.03 THEN 1.0 ELSE 0.0 END AS m, -2 * {PI} * (200.0 / (2 * {LAM!r})) * t2 AS ph FROM p) SELECT ky, kx, round(cos(ph) * m / sqrt((SELECT sum(m) FROM q)), 6) + 0.0 AS re, round(sin(ph) * m / sqrt((SELECT sum(m) FROM q)), 6) + 0.0 AS im FROM q")
def aperture_kspace(spark, d):
    return rounded(optics.aperture(bridge.recip(spark), LAM, 30.0, 200.0))


@query(sql=f"""SELECT energy, total, round(total / 510999.06, 9) AS gamma, round(p, 4) AS momentum, round(p / total, 9) AS beta, round(p / total * 299792458.0, 3) AS velocity, round(12398.4244 / nullif(p, 0), 9) AS wavelength, round(2 * {PI} * total / nullif(12398.4244 / nullif(p, 0) * energy * (total + 510999.06), 0), 12) AS sigma
  FROM (SELECT energy, energy + 510999.06 AS total, sqrt(energy * (energy + 2 * 510999.06)) AS p FROM (SELECT CAST(e AS DOUBLE) AS energy FROM (VALUES (0.0), (30000.0), (80000.0), (200000.0), (300000.0)) AS t(e)))""")
def electron_props(spark, d):
    c = optics.electron_columns(F.col("energy"))
    e = spark.createDataFrame([(v,) for v in (0.0, 3e4, 8e4, 2e5, 3e5)], "energy double")
    digits = {"gamma": 9, "momentum": 4, "beta": 9, "velocity": 3, "wavelength": 9, "sigma": 12}
    return e.select("energy", c["total"].alias("total"), *[F.round(c[n], k).alias(n) for n, k in digits.items()])


@query("scan", sql=f"SELECT pos_id, round(r, 6) AS probe_radius, round({LAM!r} / (0.8 * 0.001), 6) AS fov, round(1 - step / nullif(2 * r, 0), 6) AS linear_overlap, round({PI} * r * r / (step * step), 5) AS areal_oversamp, round(25.0 / nullif(0.8 * r, 0), 5) AS ronchi_mag FROM (SELECT pos_id, abs(y) + 100 AS def, (abs(y) + 100) * tan(25 * 0.001) AS r, 0.6 AS step FROM scan)")
def sampling_metrics(spark, d):
    s = bridge.scan(spark, d)
    m = optics.sampling_metrics(F.lit(LAM), F.lit(25.0), F.abs("y") + 100, F.lit(0.6), F.lit(0.8))
    return s.select("pos_id", *[F.round(m[n], k).alias(n) for n, k in (("probe_radius", 6), ("fov", 6), ("linear_overlap", 6), ("areal_oversamp", 5), ("ronchi_mag", 5))])


@query("scan", sql="SELECT pos_id, round(window_ / step, 6) AS fund_samp, round(window_ / (2 * r), 6) AS probe_samp, round(2 * r / step, 6) AS linear_oversamp, round(acos(-1) * r * r / (step * step), 5) AS areal_oversamp, round(20.0 / (0.8 * r), 6) AS ronchi_mag FROM (SELECT pos_id, (100 + abs(y)) * tan(0.02) AS r, 0.025 / 0.0008 AS window_, 0.4 + abs(x) / 10 AS step FROM scan)")
def sampling_metrics_full(spark, d):
    s = bridge.scan(spark, d)
    m = optics.sampling_metrics(F.lit(0.025), F.lit(20.0), 100 + F.abs("y"), 0.4 + F.abs("x") / 10, F.lit(0.8))
    return s.select("pos_id", *[F.round(m[n], 5 if n == "areal_oversamp" else 6).alias(n) for n in ("fund_samp", "probe_samp", "linear_oversamp", "areal_oversamp", "ronchi_mag")])


_QDA = """
, q AS (SELECT pos_id, log10(1 + abs(y)) - 0.49027803 AS u0, log10(10 + abs(x)) - 1.82918678 AS w0, log10(1 + abs(y)) - 0.80980859 AS u1, log10(10 + abs(x)) - 2.00158048 AS w1 FROM scan),
s AS (SELECT pos_id, -0.5 * (power(u0 * -0.2316652028331075 + w0 * 0.972795576571098, 2) / 0.56440416 + power(u0 * 0.972795576571098 + w0 * 0.2316652028331075, 2) / 0.07769331 + ln(0.56440416) + ln(0.07769331)) AS s0,
  -0.5 * (power(u1 * -0.26985970170864165 + w1 * 0.9628996528162853, 2) / 0.4110058 + power(u1 * 0.9628996528162853 + w1 * 0.26985970170864165, 2) / 0.06621369 + ln(0.4110058) + ln(0.06621369)) AS s1 FROM q)
SELECT pos_id, round(exp(s1) / (exp(s0) + exp(s1)), 6) AS p FROM s"""


@query("scan", sql=_QDA)
def success_probability(spark, d):
    return rounded(bridge.scan(spark, d).select("pos_id", optics.success_probability(1 + F.abs("y"), 10 + F.abs("x")).alias("p")))


_MODES = """
, o AS (SELECT mode, ord, oy, ox, 1.3 * oy * 0.8 - 0.6 * ox - 2.213 AS u, 0.6 * oy + 1.1 * ox - 3.709 AS w FROM range(9) AS a(oy), range(9) AS b(ox), (VALUES ('nearest'), ('reflect'), ('mirror'), ('grid-wrap')) AS m(mode), (VALUES (0), (1)) AS q(ord) WHERE ord = 1 OR mode = 'reflect'),
c AS (SELECT mode, ord, oy, ox, CAST(floor(u + 0.5) AS BIGINT) AS iy, CAST(floor(w + 0.5) AS BIGINT) AS ix, 1.0 AS f FROM o WHERE ord = 0 UNION ALL
  SELECT mode, ord, oy, ox, CAST(floor(u) AS BIGINT) + dy, CAST(floor(w) AS BIGINT) + dx, (CASE WHEN dy = 1 THEN u - floor(u) ELSE 1 - u + floor(u) END) * (CASE WHEN dx = 1 THEN w - floor(w) ELSE 1 - w + floor(w) END) FROM o, range(2) AS e(dy), range(2) AS g(dx) WHERE ord = 1),
n AS (SELECT mode, ord, oy, ox, f, list_transform([iy, ix], lambda i: CASE mode WHEN 'nearest' THEN least(greatest(i, 0), 7) WHEN 'grid-wrap' THEN ((i % 8) + 8) % 8
  WHEN 'reflect' THEN CASE WHEN ((i % 16) + 16) % 16 < 8 THEN ((i % 16) + 16) % 16 ELSE 15 - ((i % 16) + 16) % 16 END ELSE CASE WHEN ((i % 14) + 14) % 14 < 8 THEN ((i % 14) + 14) % 14 ELSE 14 - ((i % 14) + 14) % 14 END END) AS yx FROM c)
SELECT mode, CAST(ord AS BIGINT) AS ord, z, oy AS y, ox AS x, round(sum(f * v), 6) AS v FROM n JOIN img ON img.y = yx[1] AND img.x = yx[2] GROUP BY 1, 2, 3, 4, 5"""


@query("img", sql=_MODES)
def resample_modes(spark, d):
    out = None
    for mode, order in [(m, 1) for m in images.MODES[1:]] + [("reflect", 0)]:
        got = images.resample(bridge.img(spark, d), (9, 9), ((1.3 * 0.8, -0.6), (0.6, 1.1)), (-2.213, -3.709), by=["z"], order=order, mode=mode, source=(N, N))
        got = got.select(F.lit(mode).alias("mode"), F.lit(order).cast("long").alias("ord"), "z", "y", "x", "v")
        out = got if out is None else out.unionByName(got)
    return rounded(out)


@query(sql="SELECT event_id, round(cos(t) * value + sin(t) * 2 * event_id + 3.5 - (cos(t) * 3.5 + sin(t) * 2 * 4.5), 5) AS u, round(-sin(t) * value + cos(t) * 2 * event_id + 4.5 - (-sin(t) * 3.5 + cos(t) * 2 * 4.5) + 1, 5) AS w FROM events, (SELECT radians(30) AS t)")
def affine_points(spark, d):
    m = images.composed(images.rotation(30.0), images.scaling(1.0, 2.0))
    o = images.about(m, (3.5, 4.5), (0.0, 1.0))
    e = bridge.table(spark, d, "events")
    at = [m[i][0] * F.col("value") + m[i][1] * F.col("event_id") + o[i] for i in (0, 1)]
    return rounded(e.select("event_id", at[0].alias("u"), at[1].alias("w")), 5)


_SLICES = """
, p AS (SELECT y, x, z, 0.5 * ln(re * re + im * im) / 4 AS a, atan2(im, re) / 4 AS p FROM stack),
e AS (SELECT y, x, avg(a) AS ma, avg(p) AS mp, arg_min(a, z) AS fa, arg_min(p, z) AS fp, arg_max(a, z) AS la, arg_max(p, z) AS lp, count(*) AS n FROM p GROUP BY 1, 2),
m AS (SELECT * FROM (VALUES ('edge', 'top', 0.0), ('vacuum', 'middle', 0.5), ('average', 'bottom', 1.0)) AS s(pad, align, f)),
k AS (SELECT pad, align, y, x, -1 AS z, CASE pad WHEN 'edge' THEN fa WHEN 'average' THEN ma ELSE 0 END AS a, CASE pad WHEN 'edge' THEN fp WHEN 'average' THEN mp ELSE 0 END AS p FROM e, m UNION ALL
  SELECT pad, align, y, x, n, CASE pad WHEN 'edge' THEN la WHEN 'average' THEN ma ELSE 0 END, CASE pad WHEN 'edge' THEN lp WHEN 'average' THEN mp ELSE 0 END FROM e, m UNION ALL SELECT pad, align, y, x, z, a, p FROM p, m),
w AS (SELECT pad, align, i AS nz, least(greatest((5.0 * i + 2.5 + f * (40 - 60) - 2) / 4, -1), 10) AS zz FROM m, range(12) AS r(i)),
j AS (SELECT w.pad, w.align, nz, y, x, sum(a * greatest(0, 1 - abs(zz - z))) * 5 AS a, sum(p * greatest(0, 1 - abs(zz - z))) * 5 AS p FROM w JOIN k ON w.pad = k.pad AND w.align = k.align GROUP BY 1, 2, 3, 4, 5)
SELECT pad, align, nz AS z, y, x, round(exp(a) * cos(p), 6) + 0.0 AS re, round(exp(a) * sin(p), 6) + 0.0 AS im FROM j"""


@query("stack", sql=_SLICES)
def resample_slices(spark, d):
    out = None
    for pad, align in (("edge", "top"), ("vacuum", "middle"), ("average", "bottom")):
        got = images.resample_slices(bridge.stack(spark, d), [4.0] * 10, [5.0] * 12, align, pad)
        got = got.select(F.lit(pad).alias("pad"), F.lit(align).alias("align"), "z", "y", "x", "re", "im")
        out = got if out is None else out.unionByName(got)
    return rounded(out)


@query("scan", sql="SELECT pos_id, round(0 - ln(1 + exp(b - a)), 6) AS log_p FROM (SELECT pos_id, 0 - (y - 3) * (y - 3) / 2 AS a, 0 - (x - 5) * (x - 5) / 4 AS b FROM scan)")
def log_softmax(spark, d):
    a, b = -((F.col("y") - 3) ** 2) / 2, -((F.col("x") - 5) ** 2) / 4
    return rounded(bridge.scan(spark, d).select("pos_id", (-F.ln(1 + F.exp(b - a))).alias("log_p")))


@query("stack", sql=", r AS MATERIALIZED (SELECT a.pos_id, m.z AS mode, a.y, a.x, round(a.re * m.re - a.im * m.im, 6) AS re, round(a.re * m.im + a.im * m.re, 6) AS im FROM cx a JOIN stack m ON a.y = m.y AND a.x = m.x) SELECT * FROM r")
def mode_product(spark, d):
    """Every pattern times every label's mean as a mode."""
    modes = bridge.stack(spark, d).select(F.col("z").alias("mode"), "y", "x", F.col("re").alias("mr"), F.col("im").alias("mi"))
    re, im = c_mul((F.col("re"), F.col("im")), (F.col("mr"), F.col("mi")))
    return rounded(bridge.cx(spark, d).join(F.broadcast(modes), ["y", "x"]).select("pos_id", "mode", "y", "x", re.alias("re"), im.alias("im")))


@query("cx", sql="SELECT pos_id // 4 AS grp, y, x, round(sum(re * re + im * im), 6) AS v FROM cx GROUP BY 1, 2, 3")
def incoherent_sum(spark, d):
    return rounded(bridge.cx(spark, d).groupBy(F.floor(F.col("pos_id") / 4).alias("grp"), "y", "x").agg(F.sum(F.col("re") ** 2 + F.col("im") ** 2).alias("v")))


@query("cx", sql="SELECT pos_id, y, x, round(re * re + im * im, 6) AS v FROM cx")
def abs2(spark, d):
    return rounded(bridge.cx(spark, d).select("pos_id", "y", "x", (F.col("re") ** 2 + F.col("im") ** 2).alias("v")))


@query("px", sql=", a AS (SELECT ky, sum(v) AS v FROM px GROUP BY ky), b AS (SELECT kx, sum(v) AS v FROM px GROUP BY kx) SELECT ky, kx, round(a.v * b.v, 3) AS v FROM a, b")
def outer_product(spark, d):
    p = bridge.px(spark, d)
    return rounded(p.groupBy("ky").agg(F.sum("v").alias("a")).crossJoin(F.broadcast(p.groupBy("kx").agg(F.sum("v").alias("b")))).select("ky", "kx", (F.col("a") * F.col("b")).alias("v")), 3)


@query("pairs", sql="SELECT pos_id, ky, kx, round(model - 0.1 * (0.9 * measured + (model - measured)), 6) AS p, round(0.9 * measured + (model - measured), 6) AS velocity FROM pairs")
def sgd_step(spark, d):
    p, v = losses.sgd_step(F.col("model"), F.col("model") - F.col("measured"), F.col("measured"), 0.1, 0.9)
    return rounded(bridge.pairs(spark, d).select("pos_id", "ky", "kx", p.alias("p"), v.alias("velocity")))


@query("pairs", sql="SELECT pos_id, ky, kx, round(model - 0.1 * ((0.9 * 0.1 + 0.1 * g) / (1 - power(0.9, 3))) / (sqrt((0.999 * 0.2 + 0.001 * g * g) / (1 - power(0.999, 3))) + 1e-8), 6) AS p FROM (SELECT *, model - measured AS g FROM pairs)")
def adam_step(spark, d):
    p, _, _ = losses.adam_step(F.col("model"), F.col("model") - F.col("measured"), F.lit(0.1), F.lit(0.2), 3, 0.1)
    return rounded(bridge.pairs(spark, d).select("pos_id", "ky", "kx", p.alias("p")))


@query("pairs", sql="SELECT pos_id, ky, kx, round(model - least(0.5, 0.8 * (measured - 0.1) / nullif(g * g + 1, 0)) * g, 6) AS p FROM (SELECT *, model - measured AS g FROM pairs)")
def polyak_step(spark, d):
    g = F.col("model") - F.col("measured")
    return rounded(bridge.pairs(spark, d).select("pos_id", "ky", "kx", losses.polyak_step(F.col("model"), g, F.col("measured"), g * g + 1, 0.1, 0.8, 0.5).alias("p")))


@query("scan", sql="SELECT pos_id, round(y * 0.3 * least(1.0, 1.5 / nullif(0.3 * sqrt(y * y + x * x), 0)), 6) AS uy, round(x * 0.3 * least(1.0, 1.5 / nullif(0.3 * sqrt(y * y + x * x), 0)), 6) AS ux FROM scan")
def steepest_position(spark, d):
    uy, ux = losses.steepest_position(F.col("y"), F.col("x"), 0.3, 1.5)
    return rounded(bridge.scan(spark, d).select("pos_id", uy.alias("uy"), ux.alias("ux")))


@query("scan", sql="SELECT pos_id, round(uy * least(1.0, 2.0 / nullif(sqrt(uy * uy + ux * ux), 0)), 6) AS uy, round(ux * least(1.0, 2.0 / nullif(sqrt(uy * uy + ux * ux), 0)), 6) AS ux FROM (SELECT pos_id, 0.9 * 0.1 + 0.3 * y AS uy, 0.9 * 0.2 + 0.3 * x AS ux FROM scan)")
def momentum_position(spark, d):
    uy, ux = losses.momentum_position(F.col("y"), F.col("x"), F.lit(0.1), F.lit(0.2), 0.3, 0.9, 2.0)
    return rounded(bridge.scan(spark, d).select("pos_id", uy.alias("uy"), ux.alias("ux")))


@query("scan", sql="SELECT pos_id, round(y - (SELECT avg(y) FROM scan), 6) + 0.0 AS uy, round(x - (SELECT avg(x) FROM scan), 6) + 0.0 AS ux FROM scan")
def mean_subtract(spark, d):
    return rounded(losses.mean_subtract(bridge.scan(spark, d).select("pos_id", F.col("y").alias("uy"), F.col("x").alias("ux"))))


@query("px", sql="SELECT round(avg(l), 6) AS mean_loss FROM (SELECT pos_id % 16 AS g, sum(v) AS l FROM px GROUP BY 1)")
def mean_loss(spark, d):
    return rounded(bridge.px(spark, d).groupBy((F.col("pos_id") % 16).alias("g")).agg(F.sum("v").alias("l")).agg(F.avg("l").alias("mean_loss")))


@query("img", sql="SELECT round(sum(q), 6) AS spread FROM (SELECT quantile_cont(v, 0.99) - quantile_cont(v, 0.01) AS q FROM img GROUP BY z)")
def projected_spread(spark, d):
    q = ranks.exact_quantiles(bridge.img(spark, d), "v", [0.01, 0.99], ["z"])
    return rounded(q.agg(F.sum(F.when(F.col("share") > 0.5, F.col("v")).otherwise(-F.col("v"))).alias("spread")))


@query("pairs", sql="SELECT round(sqrt(avg((measured - model) * (measured - model))), 6) AS rms FROM pairs")
def rms_error(spark, d):
    return rounded(bridge.pairs(spark, d).agg(F.sqrt(F.avg((F.col("measured") - F.col("model")) ** 2)).alias("rms")))


_ROI = "y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6"
_PHASE = f""", p AS (SELECT z, y, x, atan2(im, re) AS v FROM stack WHERE {{where}}), pa AS (SELECT z, y, x, v, coalesce(v - lag(v) OVER (PARTITION BY z, y ORDER BY x), 0.0) AS d FROM p),
pb AS (SELECT z, y, x, v + 2 * {PI} * sum(0 - floor((d + {PI}) / (2 * {PI}))) OVER (PARTITION BY z, y ORDER BY x) AS v FROM pa),
pc AS (SELECT z, y, x, v, coalesce(v - lag(v) OVER (PARTITION BY z, x ORDER BY y), 0.0) AS d FROM pb),
ph AS (SELECT z, y, x, v + 2 * {PI} * sum(0 - floor((d + {PI}) / (2 * {PI}))) OVER (PARTITION BY z, x ORDER BY y) AS v FROM pc)"""
_FLAT_SUM = _PHASE + ", s0 AS (SELECT 0 AS z, y, x, sum(v) AS v FROM ph GROUP BY y, x)" + _RAMP.format(img="s0")
#: A plane fitted to the region alone.
_RAMP_ROI = _RAMP.replace("FROM {img} GROUP BY z)", f"FROM {{img}} WHERE {_ROI} GROUP BY z)")


def _level_sql(source: str, cols: str, bits: int, least: float, where: str = "true") -> str:
    """SQL of `source` (cols, v) scaled to integers between quantiles."""
    top = 2**bits
    return f""", e0 AS (SELECT {cols}, round(v, 9) AS v FROM {source}), q0 AS (SELECT quantile_cont(v, 0.001) AS lo, quantile_cont(v, 0.999) AS hi FROM e0 WHERE {where}),
  q1 AS (SELECT lo - greatest({least} - (hi - lo), 0) / 2 AS lo, hi + greatest({least} - (hi - lo), 0) / 2 AS hi FROM q0)
  SELECT {cols}, CAST(floor(least(greatest({top} / (hi - lo) * (v - lo), 0), {top - 1})) AS BIGINT) AS v FROM e0, q1"""


@query("stack", sql=_FLAT_SUM.format(where=_ROI, img="s0") + " SELECT y, x, round(v, 6) + 0.0 AS v FROM r")
def export_phase_sum(spark, d):
    return rounded(export.phase_image(bridge.stack(spark, d), F.expr(_ROI)))


@query("stack", sql=_PHASE.format(where=_ROI) + _RAMP.format(img="ph") + _level_sql("r", "z, y, x", 16, 0.0))
def export_phase_stack(spark, d):
    return export.phase_image(bridge.stack(spark, d), F.expr(_ROI), stack=True, bits=16)


@query("stack", sql=_PHASE.format(where="true") + _RAMP_ROI.format(img="ph") + _level_sql("r", "z, y, x", 8, 0.0, _ROI))
def export_phase_whole(spark, d):
    """The whole stack; plane and scale go by the region of interest."""
    return export.phase_image(bridge.stack(spark, d), F.expr(_ROI), crop=False, stack=True, bits=8)


@query("stack", sql=f", g AS (SELECT z, y, x, re * re + im * im AS v FROM stack WHERE {_ROI})" + _level_sql("g", "z, y, x", 8, 0.2))
def export_mag_stack(spark, d):
    return export.magnitude_image(bridge.stack(spark, d), F.expr(_ROI), stack=True, bits=8)


@query("stack", sql=", g AS (SELECT y, x, product(re * re + im * im) AS v FROM stack GROUP BY y, x)" + _level_sql("g", "y, x", 16, 0.2, _ROI))
def export_mag_product(spark, d):
    """The product over slices, whole, scaled by the region of interest."""
    return export.magnitude_image(bridge.stack(spark, d), F.expr(_ROI), crop=False, bits=16)


@query("cx", sql=", p AS (SELECT y, x, round(avg(re * re + im * im), 9) AS v FROM cx GROUP BY 1, 2) SELECT y, x, CAST(floor(least(greatest(65536 / (hi - lo) * (v - lo), 0), 65535)) AS BIGINT) AS v FROM p, (SELECT quantile_cont(v, 0.001) AS lo, quantile_cont(v, 0.999) AS hi FROM p)")
def export_probe_mag(spark, d):
    return reduce.robust_scale(bridge.cx(spark, d).groupBy("y", "x").agg(F.round(F.avg(F.col("re") ** 2 + F.col("im") ** 2), 9).alias("v")), 16)


@query("px", sql="SELECT pos_id, ky, kx, v FROM (SELECT pos_id, ky, kx, round(v, 6) AS v, row_number() OVER (PARTITION BY pos_id ORDER BY v DESC, ky, kx) AS n FROM px WHERE ky > 1) WHERE n = 1")
def masked_argmax(spark, d):
    best = bridge.px(spark, d).where("ky > 1").groupBy("pos_id").agg(F.max(F.struct(F.col("v"), (-F.col("ky")).alias("a"), (-F.col("kx")).alias("b"))).alias("m"))
    return rounded(best.select("pos_id", (-F.col("m.a")).alias("ky"), (-F.col("m.b")).alias("kx"), F.col("m.v").alias("v")))


@query("scan", sql="SELECT pos_id, row_number() OVER (PARTITION BY iy ORDER BY y * y + x * x, pos_id) AS rank FROM scan")
def argsort_rank(spark, d):
    w = Window.partitionBy("iy").orderBy(F.col("y") * F.col("y") + F.col("x") * F.col("x"), "pos_id")
    return bridge.scan(spark, d).select("pos_id", F.row_number().over(w).cast("long").alias("rank"))


@query(sql="SELECT k AS mode, CAST(ceil((sqrt(8.0 * k + 9) - 3) / 2) AS BIGINT) AS ord FROM range(40) AS t(k)")
def mode_orders(spark, d):
    return spark.range(40).select(F.col("id").alias("mode"), optics.hermite_order(F.col("id")).alias("ord"))


def _resample_sql(u: str, w: str, prelude: str) -> str:
    """SQL of an order-1 resampling of img (z, y, x, v) on an 8 x 8 grid of (oy, ox)."""
    return f"""WITH {bridge.CTE["cx"]}, {bridge.CTE["stack"]}, {prelude}, p AS (SELECT oy, ox, {u} AS u, {w} AS w FROM (SELECT k // 8 AS oy, k % 8 AS ox FROM range(64) AS t(k))),
  n AS (SELECT oy, ox, CAST(floor(u) AS BIGINT) + dy AS y, CAST(floor(w) AS BIGINT) + dx AS x, (CASE WHEN dy = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END) * (CASE WHEN dx = 1 THEN w - floor(w) ELSE 1 - (w - floor(w)) END) AS weight FROM p, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS c(dy, dx)),
  zs AS (SELECT DISTINCT z FROM stack), o AS (SELECT zs.z, oy AS y, ox AS x, sum(weight * coalesce(v, 1.0)) AS v FROM n CROSS JOIN zs LEFT JOIN i s ON s.z = zs.z AND s.y = n.y AND s.x = n.x GROUP BY zs.z, oy, ox)"""


_C, _S = math.cos(math.radians(30)), math.sin(math.radians(30))


@query(sql=_resample_sql(f"{_C!r} * oy - {_S!r} * ox + {3.5 - 3.5 * _C + 3.5 * _S!r}", f"{_S!r} * oy + {_C!r} * ox + {3.5 - 3.5 * _S - 3.5 * _C!r}", "i AS (SELECT z, y, x, re AS v FROM stack)") + " SELECT z, y, x, round(v, 5) AS v FROM o")
def object_rotate(spark, d):
    """The object turned by 30 degrees about its centre; vacuum (1) comes in from outside."""
    return rounded(images.resample(bridge.img(spark, d), (N, N), ((_C, -_S), (_S, _C)), (3.5 - 3.5 * _C + 3.5 * _S, 3.5 - 3.5 * _S - 3.5 * _C), 1.0, ["z"]), 5)


@query(sql=_resample_sql("0.8 * oy + 0.7", "0.8 * ox + 0.7", "i AS (SELECT z, (y + 4) % 8 AS y, (x + 4) % 8 AS x, re AS v FROM stack)") + " SELECT z, (y + 4) % 8 AS y, (x + 4) % 8 AS x, round(v, 5) AS v FROM o")
def recip_resample(spark, d):
    """Resampling of a corner-origin image: shift, resample about the middle, shift back."""
    centred = preprocess.shift_index(bridge.img(spark, d), {"y": N, "x": N})
    out = images.resample(centred, (N, N), ((0.8, 0.0), (0.0, 0.8)), (0.7, 0.7), 1.0, ["z"])
    return rounded(preprocess.shift_index(out, {"y": N, "x": N}, inverse=True), 5)


@query("stack", sql="SELECT y, x, round(exp(sum(ln(sqrt(re * re + im * im)))) * cos(sum(atan2(im, re))), 5) + 0.0 AS re, round(exp(sum(ln(sqrt(re * re + im * im)))) * sin(sum(atan2(im, re))), 5) + 0.0 AS im FROM stack GROUP BY y, x")
def project_object(spark, d):
    """The product over slices of the complex object, as the exponential of summed logarithms."""
    a, p = F.sum(F.ln(F.sqrt(F.col("re") ** 2 + F.col("im") ** 2))), F.sum(F.atan2("im", "re"))
    return rounded(bridge.stack(spark, d).groupBy("y", "x").agg(a.alias("a"), p.alias("p")).select("y", "x", (F.exp("a") * F.cos("p")).alias("re"), (F.exp("a") * F.sin("p")).alias("im")), 5)


@query("stack", sql="SELECT z, y, x, round(exp(ln(sqrt(re * re + im * im)) * 0.25) * cos(atan2(im, re) * 0.25), 6) AS re, round(exp(ln(sqrt(re * re + im * im)) * 0.25) * sin(atan2(im, re) * 0.25), 6) + 0.0 AS im FROM stack")
def split_slice(spark, d):
    """A slice's share of a thicker one: its logarithm scaled by the share of the thickness."""
    a, p = F.ln(F.sqrt(F.col("re") ** 2 + F.col("im") ** 2)) * 0.25, F.atan2("im", "re") * 0.25
    return rounded(bridge.stack(spark, d).select("z", "y", "x", (F.exp(a) * F.cos(p)).alias("re"), (F.exp(a) * F.sin(p)).alias("im")))
