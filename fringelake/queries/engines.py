"""Queries over kernels and iterative engines; SQL cannot express most of these, so tests re-derive them in NumPy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import engines, grids, preprocess, waves
from ..plans import prepare
from . import analysis, bridge
from .bridge import N, SQL, query, rounded

LAM = 0.0250793


def _packed(spark, d):
    """(pos_id, re, im), packed as the table has them: nothing is exchanged."""
    real = lambda a: F.transform(a, lambda v: v.cast("double"))
    e, half = F.col("embedding"), N * N // 2
    return bridge.table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("pos_id"), F.transform(real(e), lambda v: 1 + v).alias("re"), real(F.concat(F.slice(e, half + 1, half), F.slice(e, 1, half))).alias("im"))


def _long(df):
    k = F.col("k")
    return df.select("pos_id", F.posexplode(F.arrays_zip("re", "im")).alias("k", "s")).select("pos_id", F.floor(k / N).alias("ky"), F.pmod(k, F.lit(N)).cast("long").alias("kx"), F.col("s.re").alias("re"), F.col("s.im").alias("im"))


@query("cx", sql=analysis._dft_sql(False))
def fft2_packed(spark, d):
    return rounded(_long(engines.transformed(_packed(spark, d), N, N)))


@query("cx", sql=analysis._dft_sql(True))
def ifft2_packed(spark, d):
    return rounded(_long(engines.transformed(_packed(spark, d), N, N, inverse=True)))


@query("px", sql=", o AS (SELECT k // 10 AS oy, k % 10 AS ox, 0.8 * (k // 10) AS u, 0.8 * (k % 10) AS w FROM range(100) AS t(k)), n AS (SELECT oy, ox, CAST(floor(u) AS BIGINT) + e AS ky, CAST(floor(w) AS BIGINT) + f AS kx, (CASE WHEN e = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END) * (CASE WHEN f = 1 THEN w - floor(w) ELSE 1 - (w - floor(w)) END) AS wt FROM o, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS q(e, f) WHERE u <= 7 AND w <= 7) SELECT pos_id, oy AS ky, ox AS kx, round(sum(wt * v), 5) AS v FROM n JOIN px USING (ky, kx) WHERE wt > 0 GROUP BY pos_id, oy, ox")
def resize_patterns(spark, d):
    """Patterns on 10 x 10 pixels of 0.8 old ones about the zero frequency; pixels beyond the detector are masked and left out."""
    e = bridge.table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("pos_id"), F.transform("embedding", lambda v: 100 * v.cast("double") * v.cast("double")).alias("e"))
    turned = lambda k: F.pmod(F.floor(k / N) + N // 2, F.lit(N)) * N + F.pmod(k + N // 2, F.lit(N))
    corner = e.select("pos_id", F.transform(F.sequence(F.lit(0), F.lit(N * N - 1)), lambda k: F.element_at("e", (turned(k) + 1).cast("int"))).alias("data"))
    out = prepare.resized(corner, (N, N), (10, 10), (0.8, 0.8)).select("pos_id", F.posexplode("data").alias("k", "v")).where("not isnan(v)")
    place = lambda c: F.pmod(c + 5, F.lit(10)).cast("long")
    return rounded(out.select("pos_id", place(F.floor(F.col("k") / 10)).alias("ky"), place(F.col("k")).alias("kx"), "v"), 5)


def true_state(modes: int = 1, slices: int = 1) -> engines.State:
    """A known phase object and focused probe, for simulated scans."""
    y, x = np.mgrid[:40, :40]
    phase = 0.4 * np.sin(y / 3) * np.cos(x / 4) + 0.2 * np.cos((y + x) / 2.5)
    probe = waves.focused_probe((16, 16), (0.4, 0.4), LAM, 18.0, 60.0) * 30
    probes = waves.hermite_modes(probe, modes, 0.8) if modes > 1 else probe[None]
    return engines.State(np.stack([np.exp(1j * phase / slices)] * slices), probes, (0.4, 0.4), LAM, [4.0] * slices)


def start_state(modes: int = 1, slices: int = 1) -> engines.State:
    s = true_state(modes, slices)
    s.obj = np.exp(1j * waves.seeded("start", 1).normal(0, 1e-3, s.obj.shape))
    return s


def scan_starts(spark):
    g = grids.index_grid(spark, 8, 8, "iy", "ix")
    return g.select((F.col("iy") * 8 + F.col("ix")).alias("pos_id"), (F.col("iy") * 3).alias("start_y"), (F.col("ix") * 3).alias("start_x"), F.lit(0.0).alias("sub_y"), F.lit(0.0).alias("sub_x"))


def _run(spark, solver, modes=1, slices=1, **kw):
    data = engines.simulate(scan_starts(spark), true_state(modes, slices))
    state = engines.reconstruct(data, start_state(modes, slices), engines.Engine(solver=solver, **kw))
    return spark.createDataFrame([(i + 1, float(e)) for i, e in enumerate(state.errors)], "iter long, error double")


@query()
def simulate_patterns(spark, d):
    return engines.simulate(scan_starts(spark), true_state())


@query()
def epie_run(spark, d):
    return _run(spark, "epie", iterations=3)


@query()
def lsqml_run(spark, d):
    return _run(spark, "lsqml", iterations=3)


@query()
def lsqml_multislice(spark, d):
    return _run(spark, "lsqml", modes=2, slices=2, iterations=2)


@query()
def gradient_run(spark, d):
    return _run(spark, "adam", iterations=3, rate=0.02, probe_rate=0.01)


@query()
def poisson_noise(spark, d):
    return preprocess.poisson_noise(bridge.px(spark, d).select("pos_id", "ky", "kx", "v"), 2.0, seed=11)


@query()
def focused_probe(spark, d):
    p = waves.focused_probe((N, N), (0.5, 0.5), LAM, 20.0, 100.0)
    return spark.createDataFrame([(y, x, float(p[y, x].real), float(p[y, x].imag)) for y in range(N) for x in range(N)], "y long, x long, re double, im double")


@query()
def hermite_modes(spark, d):
    m = waves.hermite_modes(waves.focused_probe((N, N), (0.5, 0.5), LAM, 20.0), 4)
    return spark.createDataFrame([(k, y, x, float(m[k, y, x].real), float(m[k, y, x].imag)) for k in range(len(m)) for y in range(N) for x in range(N)], "mode long, y long, x long, re double, im double")


@query()
def random_object(spark, d):
    o = waves.seeded("object", 0).normal(0.0, 1e-4, (N, N))
    return spark.createDataFrame([(y, x, float(np.cos(o[y, x])), float(np.sin(o[y, x]))) for y in range(N) for x in range(N)], "y long, x long, re double, im double")


@query("cx", sql="SELECT pos_id, round(sum(re * re + im * im), 5) AS energy FROM cx GROUP BY pos_id")
def parseval(spark, d):
    f = _long(engines.transformed(_packed(spark, d), N, N))
    return rounded(f.groupBy("pos_id").agg(F.sum(F.col("re") ** 2 + F.col("im") ** 2).alias("energy")), 5)


assert all(k in bridge.QUERIES for k in SQL)
