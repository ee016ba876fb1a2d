"""Queries of operators through a Fourier transform."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import fourier, reduce, waves
from . import bridge
from .bridge import N, query, rounded


def _transform(source: str, name: str, inverse: bool = False) -> str:
    """SQL tables of the unitary transform of 8 x 8 images (pos_id, y, x, re, im): real space is centred, reciprocal space has its origin at the corner."""
    sign, at, out = ("", "{}", "((b + 4) % 8)") if inverse else ("-", "(({} + 4) % 8)", "b")
    turn = lambda c: f"{sign}2 * pi() / 8 * (({at.format(c)} * b) % 8)"
    line = lambda c, rest, of: f"sum(re * cos({turn(c)}) - im * sin({turn(c)})) / sqrt(8) AS re, sum(re * sin({turn(c)}) + im * cos({turn(c)})) / sqrt(8) AS im FROM {of}, range(8) AS r(b) GROUP BY {rest}"
    rows = f"{name}_x AS MATERIALIZED (SELECT pos_id, y, {out} AS x, {line('x', '1, 2, 3', source)})"
    return f"{rows}, {name} AS MATERIALIZED (SELECT pos_id, {out} AS y, x, {line('y', '1, 2, 3', name + '_x')})"


_F = ", " + _transform("cx", "f")
_K2 = "(power(CASE WHEN y < 4 THEN y ELSE y - 8 END, 2) + power(CASE WHEN x < 4 THEN x ELSE x - 8 END, 2)) / 16.0"  # of pixels 0.5 wide
_HANN = "(0.5 - 0.5 * cos(2 * pi() * (y + 1) / 9)) * (0.5 - 0.5 * cos(2 * pi() * (x + 1) / 9))"
_RING = f", h AS MATERIALIZED (SELECT pos_id, y, x, re * {_HANN} AS re, im * {_HANN} AS im FROM cx), " + _transform("h", "f") + """, t AS MATERIALIZED (SELECT CAST(floor(sqrt(power((CASE WHEN a.y < 4 THEN a.y ELSE a.y - 8 END) / 8.0, 2) + power((CASE WHEN a.x < 4 THEN a.x ELSE a.x - 8 END) / 8.0, 2)) / 0.1) AS BIGINT) AS r, a.re AS re1, a.im AS im1, b.re AS re2, b.im AS im2 FROM f a JOIN f b ON b.pos_id = a.pos_id + 1 AND b.y = a.y AND b.x = a.x)
  SELECT r, round(sqrt(power(sum(re1 * re2 + im1 * im2), 2) + power(sum(im1 * re2 - re1 * im2), 2)) / sqrt(sum(re1 * re1 + im1 * im1) * sum(re2 * re2 + im2 * im2)), 6) AS frc, round(sqrt(sum(re1 * re1 + im1 * im1) / sum(re2 * re2 + im2 * im2)), 6) AS ratio FROM t GROUP BY r"""
_CROSS = """, s AS (SELECT p.k - 4 AS dy, q.k - 4 AS dx FROM range(8) p(k), range(8) q(k) WHERE (p.k - 4) * (p.k - 4) + (q.k - 4) * (q.k - 4) <= 9), b AS MATERIALIZED (SELECT pos_id - 1 AS pos_id, (y + dy + 8) % 8 AS y, (x + dx + 8) % 8 AS x, re AS br, im AS bi, dy, dx FROM cx, s),
  c AS MATERIALIZED (SELECT pos_id, dy, dx, sum(re * br + im * bi) AS v FROM cx JOIN b USING (pos_id, y, x) GROUP BY 1, 2, 3) SELECT pos_id, arg_max(dy, v) AS dy, arg_max(dx, v) AS dx FROM c GROUP BY pos_id"""
_MID = ", c AS MATERIALIZED (SELECT pos_id, (y + 4) % 8 AS y, (x + 4) % 8 AS x, re, im FROM f), n AS MATERIALIZED (SELECT c.pos_id, coalesce(d.re - c.re, 0) AS yr, coalesce(d.im - c.im, 0) AS yi, coalesce(e.re - c.re, 0) AS xr, coalesce(e.im - c.im, 0) AS xi FROM c LEFT JOIN c d ON d.pos_id = c.pos_id AND d.y = c.y + 1 AND d.x = c.x LEFT JOIN c e ON e.pos_id = c.pos_id AND e.y = c.y AND e.x = c.x + 1)"


def _images(spark, d):
    return fourier.packed(bridge.cx(spark, d), "pos_id")


def _pairs(spark, d):
    i = _images(spark, d)
    return i.join(i.select((F.col("pos_id") - 1).alias("pos_id"), F.col("re").alias("re2"), F.col("im").alias("im2")), "pos_id")


def _filtered(spark, d, kernel):
    return rounded(fourier.unpacked(fourier.mapped(_images(spark, d), (N, N), kernel), "pos_id", N))


@query("cx", sql="SELECT pos_id, y, x, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM cx")
def low_pass_all(spark, d):
    """A low pass that lets everything through: the transform pair is the identity."""
    return _filtered(spark, d, fourier.low_pass((N, N), 1.0))


@query("cx", sql="SELECT a.pos_id, a.y, a.x, round(m.re, 6) + 0.0 AS re, round(m.im, 6) + 0.0 AS im FROM cx a JOIN (SELECT pos_id, avg(re) AS re, avg(im) AS im FROM cx GROUP BY pos_id) m ON a.pos_id = m.pos_id")
def object_low_pass(spark, d):
    """A low pass that lets only the mean through."""
    return _filtered(spark, d, fourier.low_pass((N, N), 0.05))


@query("cx", sql=_F + f", m AS (SELECT pos_id, y, x, re, im FROM f WHERE sqrt({_K2}) * 0.025 <= 0.02), " + _transform("m", "o", True) + " SELECT pos_id, y, x, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM o")
def limit_probe_support(spark, d):
    return _filtered(spark, d, fourier.probe_support((N, N), (0.5, 0.5), 0.025, 20.0))


@query("cx", sql=_F + f", m AS (SELECT pos_id, y, x, re * exp(-2 * pi() * pi() * 0.16 * {_K2}) AS re, im * exp(-2 * pi() * pi() * 0.16 * {_K2}) AS im FROM f), " + _transform("m", "o", True) + ", w AS MATERIALIZED (SELECT o.pos_id, o.y, o.x, 0.4 * cx.re + 0.6 * o.re AS re, 0.4 * cx.im + 0.6 * o.im AS im FROM o JOIN cx USING (pos_id, y, x)) SELECT pos_id, y, x, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM w")
def object_gaussian(spark, d):
    return _filtered(spark, d, fourier.gaussian((N, N), (0.5, 0.5), 0.4, 0.6))


@query("cx", sql=_F + " SELECT pos_id, round(sum(sqrt(re * re + im * im)), 6) AS cost FROM f GROUP BY pos_id")
def recip_l1_cost(spark, d):
    return rounded(fourier.measured(_images(spark, d), "pos_id", (N, N), fourier.recip_l1))


@query("cx", sql=_F + _MID + " SELECT pos_id, round(sum(yr * yr + yi * yi + xr * xr + xi * xi), 6) AS cost FROM n GROUP BY pos_id")
def probe_recip_tikhonov(spark, d):
    return rounded(fourier.measured(_images(spark, d), "pos_id", (N, N), fourier.recip_tikhonov))


@query("cx", sql=_F + _MID + " SELECT pos_id, round(sum(sqrt(yr * yr + yi * yi + xr * xr + xi * xi + 1e-8)), 6) AS cost FROM n GROUP BY pos_id")
def probe_recip_tv(spark, d):
    return rounded(fourier.measured(_images(spark, d), "pos_id", (N, N), fourier.recip_tv))


@query()
def probe_phase_tikhonov(spark, d):
    return rounded(fourier.measured(_images(spark, d), "pos_id", (N, N), fourier.recip_phase_tikhonov))


@query("cx", sql=_RING)
def fourier_ring_correlation(spark, d):
    return rounded(reduce.ring_correlation(fourier.ring_terms(_pairs(spark, d), "pos_id", (N, N), 0.1)))


@query("cx", sql=_CROSS)
def cross_correlate(spark, d):
    return fourier.shifts(_pairs(spark, d), "pos_id", (N, N), 3.0)


@query()
def compact_groups(spark, d):
    y, x = np.divmod(np.arange(64), 8)
    groups = fourier.compact_groups(np.column_stack([y, x]).astype(float), 16, waves.seeded("seed1"))
    return spark.createDataFrame([(g, int(i)) for g, members in enumerate(groups) for i in members], "group_id long, pos_id long")


@query()
def sparse_groups(spark, d):
    groups = fourier.sparse_groups(33, 8, waves.seeded("seed1"))
    return spark.createDataFrame([(g, int(i)) for g, members in enumerate(groups) for i in members], "group_id long, pos_id long")
