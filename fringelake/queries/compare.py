"""Queries over pairs of images, exact ranks, spatial search and groups."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..operators import compare, fourier, groups, nearest, ranks
from . import bridge
from .bridge import N, query, rounded, table

_PAIRS = ", ab AS (SELECT p.z, p.y, p.x, p.v AS a, q.v AS b FROM img p JOIN img q ON q.z = p.z + 1 AND q.y = p.y AND q.x = p.x), wh AS (SELECT z, max(b) - min(b) AS span FROM ab GROUP BY z)"
_SSIM = """(2 * ma * mb + power(0.01 * span, 2)) * (2 * f * (ab - ma * mb) + power(0.03 * span, 2)) / ((ma * ma + mb * mb + power(0.01 * span, 2)) * (f * (aa - ma * ma) + f * (bb - mb * mb) + power(0.03 * span, 2)))"""


def _label_pairs(spark, d) -> DataFrame:
    a = bridge.img(spark, d).select("z", "y", "x", F.col("v").alias("a"))
    b = bridge.img(spark, d).select((F.col("z") - 1).alias("z"), "y", "x", F.col("v").alias("b"))
    return a.join(b, ["z", "y", "x"])


@query("img", sql=_PAIRS + f", m AS (SELECT c.z, c.y, c.x, avg(o.a) AS ma, avg(o.b) AS mb, avg(o.a * o.a) AS aa, avg(o.b * o.b) AS bb, avg(o.a * o.b) AS ab, 25.0 / 24 AS f FROM ab c JOIN ab o ON o.z = c.z AND abs(o.y - c.y) <= 2 AND abs(o.x - c.x) <= 2 GROUP BY 1, 2, 3 HAVING count(*) = 25) SELECT z, round(avg({_SSIM}), 6) AS ssim FROM m JOIN wh USING (z) GROUP BY z")
def ssim(spark, d):
    """Structural similarity of each label's mean image with the next label's, windows of 5 x 5 pixels."""
    return rounded(compare.ssim(_label_pairs(spark, d), ["z"], radius=2))


_TAPS = [math.exp(-(o * o) / 2.0) for o in (-2, -1, 0, 1, 2)]
_W = f"(list_value({', '.join(repr(t / sum(_TAPS)) for t in _TAPS)})[o.y - c.y + 3] * list_value({', '.join(repr(t / sum(_TAPS)) for t in _TAPS)})[o.x - c.x + 3])"


@query("img", sql=_PAIRS + f", m AS (SELECT c.z, c.y, c.x, sum({_W} * o.a) AS ma, sum({_W} * o.b) AS mb, sum({_W} * o.a * o.a) AS aa, sum({_W} * o.b * o.b) AS bb, sum({_W} * o.a * o.b) AS ab, 25.0 / 24 AS f FROM ab c JOIN ab o ON o.z = c.z AND abs(o.y - c.y) <= 2 AND abs(o.x - c.x) <= 2 GROUP BY 1, 2, 3 HAVING count(*) = 25) SELECT z, y, x, round({_SSIM}, 6) + 0.0 AS ssim FROM m JOIN wh USING (z)")
def ssim_gaussian(spark, d):
    """The map of it with Gaussian weights."""
    return rounded(compare.ssim_map(_label_pairs(spark, d), ["z"], radius=2, sigma=1.0))


#: The whole table as one image: each pattern is a square of 8 x 8 pixels of a mosaic 20 patterns wide.
_MOSAIC = "mosaic AS MATERIALIZED (SELECT (pos_id // 20) * 8 + ky AS y, (pos_id % 20) * 8 + kx AS x, a AS v FROM px)"
#: What was seen of it: every second pixel, from pixel (10, 6) on.
_SEEN = "seen AS MATERIALIZED (SELECT (y - 10) // 2 AS y, (x - 6) // 2 AS x, v FROM mosaic WHERE y >= 10 AND x >= 6 AND (y - 10) % 2 = 0 AND (x - 6) % 2 = 0 AND x < 140)"


def _mosaic(spark, d) -> DataFrame:
    return bridge.px(spark, d).select((F.col("iy") * N + F.col("ky")).alias("y"), (F.col("ix") * N + F.col("kx")).alias("x"), F.col("a").alias("v"))


def _seen(spark, d) -> DataFrame:
    m = _mosaic(spark, d).where("y >= 10 and x >= 6 and x < 140 and pmod(y - 10, 2) = 0 and pmod(x - 6, 2) = 0")
    return m.select(F.floor((F.col("y") - 10) / 2).alias("y"), F.floor((F.col("x") - 6) / 2).alias("x"), "v")


_ON = "ont AS (SELECT 2 * y AS y, 2 * x AS x, v FROM seen)"


@query("px", sql=f", {_MOSAIC}, {_SEEN}, {_ON}, sh AS (SELECT p.k - 12 AS dy, q.k - 12 AS dx FROM range(25) p(k), range(25) q(k)), mo AS MATERIALIZED (SELECT o.y + dy AS y, o.x + dx AS x, o.v AS a, dy, dx FROM ont o, sh), sc AS MATERIALIZED (SELECT dy, dx, count(*) AS n, corr(mo.a, m.v) AS score FROM mo JOIN mosaic m USING (y, x) GROUP BY 1, 2 HAVING count(*) >= 0.5 * (SELECT count(*) FROM ont)) SELECT dy, dx, n, round(score, 6) AS score FROM sc ORDER BY score DESC LIMIT 25")
def ground_truth_shift(spark, d):
    """The 25 best shifts of what was seen against the whole mosaic (a top-k report): the planted one is first."""
    seen = _seen(spark, d).select((2 * F.col("y")).alias("y"), (2 * F.col("x")).alias("x"), "v")
    scores = compare.shift_scores(seen, _mosaic(spark, d), (-12, 12), (-12, 12), math.ceil(0.5 * seen.count()))
    return rounded(scores.orderBy(F.desc("score")).limit(25))


@query("px", sql=f", {_MOSAIC}, {_SEEN}, e AS (SELECT max(2 * y) AS my, max(2 * x) AS mx FROM seen), o AS MATERIALIZED (SELECT y, x, (y // 2) AS y0, (x // 2) AS x0, (y % 2) / 2.0 AS fy, (x % 2) / 2.0 AS fx FROM (SELECT m.y - 10 AS y, m.x - 6 AS x FROM mosaic m, e WHERE m.y - 10 BETWEEN 0 AND my AND m.x - 6 BETWEEN 0 AND mx)), n AS MATERIALIZED (SELECT o.y, o.x, sum(s.v * (CASE WHEN s.y = y0 THEN 1 - fy ELSE fy END) * (CASE WHEN s.x = x0 THEN 1 - fx ELSE fx END)) AS v FROM (SELECT o.*, y0 + p AS sy, x0 + q AS sx FROM o, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS c(p, q)) o JOIN seen s ON s.y = sy AND s.x = sx GROUP BY 1, 2), r AS MATERIALIZED (SELECT m.y, m.x, round(n.v, 6) AS object, round(m.v, 6) AS truth, round(n.v - m.v, 6) + 0.0 AS d FROM n JOIN mosaic m ON m.y = n.y + 10 AND m.x = n.x + 6) SELECT * FROM r")
def ground_truth_difference(spark, d):
    """What was seen, resampled to the mosaic's pixels, moved to where it fits, and the difference there; the shift is searched for."""
    truth = _mosaic(spark, d)
    rows, cols = truth.agg(F.max("y") + 1, F.max("x") + 1).first()
    return rounded(compare.aligned_difference(_seen(spark, d), truth, (rows, cols), (2.0, 2.0), (1.0, 1.0), 12))


def _dft_sql(source: str) -> str:
    """SQL tables r1, f: the orthonormal DFT of 8 x 8 images (pos_id, y, x, v), zero frequency in the middle."""
    turn = lambda c, b: f"-2 * {math.pi!r} / 8 * (({c} * (({b} + 4) % 8)) % 8)"
    return f"""t AS (SELECT k AS b FROM range(8) AS r(k)), r1 AS MATERIALIZED (SELECT pos_id, y, b AS kx, sum(v * cos({turn('x', 'b')})) / sqrt(8) AS re, sum(v * sin({turn('x', 'b')})) / sqrt(8) AS im FROM {source}, t GROUP BY 1, 2, 3),
  f AS MATERIALIZED (SELECT pos_id, b AS y, kx AS x, sum(re * cos({turn('y', 'b')}) - im * sin({turn('y', 'b')})) / sqrt(8) AS re, sum(re * sin({turn('y', 'b')}) + im * cos({turn('y', 'b')})) / sqrt(8) AS im FROM r1, t GROUP BY 1, 2, 3)"""


_HANN = "hw AS (SELECT pos_id, ky AS y, kx AS x, v * (0.5 - 0.5 * cos(2 * pi() * ky / 8)) * (0.5 - 0.5 * cos(2 * pi() * kx / 8)) AS v FROM px)"


@query("px", sql=f", {_HANN}, {_dft_sql('hw')}, pr AS (SELECT a.pos_id, a.y, a.x, a.re * b.re + a.im * b.im AS re, a.im * b.re - a.re * b.im AS im, (a.re * a.re + a.im * a.im) * (b.re * b.re + b.im * b.im) AS p FROM f a JOIN f b ON b.pos_id = a.pos_id + 1 AND b.y = a.y AND b.x = a.x) SELECT pos_id, y, x, round(CASE WHEN p > 1e-12 THEN re / sqrt(p) ELSE 1.0 END, 4) + 0.0 AS re, round(CASE WHEN p > 1e-12 THEN im / sqrt(p) ELSE 0.0 END, 4) + 0.0 AS im FROM pr")
def fourier_correlation(spark, d):
    """The normalised cross spectrum of each pattern and the next under a Hann window, pixel by pixel."""
    px = bridge.px(spark, d).select("pos_id", F.col("ky").alias("y"), F.col("kx").alias("x"), "v")
    held = fourier.packed(compare.windowed(px, (N, N)).select("pos_id", "y", "x", F.col("v").alias("re"), F.lit(0.0).alias("im")), "pos_id")
    spectra = fourier.unpacked(fourier.mapped(held, (N, N), _centred), "pos_id", N)
    after = spectra.withColumn("pos_id", F.col("pos_id") - 1)
    return rounded(compare.normalised_cross(spectra, after, ["pos_id"], 1e-12), 4)


def _centred(a: np.ndarray) -> np.ndarray:
    """The transform of images with their first pixel as origin, zero frequency in the middle."""
    return np.fft.fftshift(np.fft.fft2(a, norm="ortho"), axes=(-2, -1))


@query(sql="WITH v AS (SELECT l_returnflag AS flag, l_linestatus AS status, l_extendedprice AS v FROM lineitem), q AS (SELECT flag, status, unnest([0.001, 0.25, 0.5, 0.999]) AS share, unnest([quantile_cont(v, 0.001), quantile_cont(v, 0.25), quantile_cont(v, 0.5), quantile_cont(v, 0.999)]) AS v FROM v GROUP BY flag, status) SELECT flag, status, CAST(share AS DOUBLE) AS share, round(v, 6) AS v FROM q")
def exact_quantiles(spark, d):
    """Quantiles of prices by flag and status, by counting; three flags hold millions of rows each at scale."""
    v = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_extendedprice").alias("v"))
    return rounded(ranks.exact_quantiles(v, "v", [0.001, 0.25, 0.5, 0.999], ["flag", "status"], few=1000), 6, "v")


_COUNT = 32


def _order_sql() -> str:
    parts = []
    for k, iteration in enumerate((0, 1, 7)):
        keys = groups.round_keys("seed1/order", iteration)
        tables = groups.bijection_sql(_COUNT, keys).replace("walk", f"walk{k}").replace("image", f"image{k}")
        parts.append((iteration, tables, f"image{k}"))
    tables = ", ".join(p[1] for p in parts)
    found = " UNION ALL ".join(f"SELECT {i} AS iteration, i AS grp, x AS place FROM {name}" for i, _, name in parts)
    return f"WITH RECURSIVE scan AS (SELECT vec_id AS pos_id FROM embeddings), ids AS (SELECT k AS i FROM range({_COUNT}) AS t(k)), {tables}, o AS ({found}), g AS (SELECT pos_id % {_COUNT} AS grp, count(*) AS n FROM scan GROUP BY 1) SELECT iteration, grp, CAST(place AS BIGINT) AS place, n FROM o JOIN g USING (grp)"


@query(sql=_order_sql())
def group_order(spark, d):
    """The order of the positions' groups in three iterations, with their sizes: members stay."""
    g = bridge.scan(spark, d).groupBy(F.pmod("pos_id", F.lit(_COUNT)).alias("grp")).agg(F.count(F.lit(1)).alias("n"))
    manager, out = groups.Groups(_COUNT, "seed1"), None
    for iteration in (0, 1, 7):
        one = manager.order(g, iteration).select(F.lit(iteration).alias("iteration"), "grp", "place", "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("scan", sql=", c AS (SELECT pos_id // 25 AS centroid, avg(y) AS cy, avg(x) AS cx FROM scan GROUP BY 1), r AS (SELECT s.pos_id, centroid, (y - cy) * (y - cy) + (x - cx) * (x - cx) AS d2, row_number() OVER (PARTITION BY s.pos_id ORDER BY (y - cy) * (y - cy) + (x - cx) * (x - cx), centroid) AS rank FROM scan s, c) SELECT pos_id, centroid, round(d2, 6) AS d2, rank FROM r WHERE rank <= 3")
def nearest_centroid(spark, d):
    """The three nearest of the mean positions of every 25 positions: as many centroids as the scan is long."""
    s = bridge.scan(spark, d)
    c = s.groupBy(F.floor(F.col("pos_id") / 25).alias("centroid")).agg(F.avg("y").alias("cy"), F.avg("x").alias("cx"))
    return rounded(nearest.nearest(s, c, 3))
