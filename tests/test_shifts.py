"""Shifts of images by blocks, against NumPy loops, pixel joins and the SQL; what goes through exchanges is counted."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from fringelake.operators import compare, shifts


def noise(spark, h, w, seed, y0=0, x0=0):
    """(y, x, v): noise that belongs to the place, and a little by the seed."""
    at = spark.range(h * w).select((F.floor(F.col("id") / w) + y0).alias("y"), (F.pmod("id", F.lit(w)) + x0).alias("x"))
    of = lambda *c: F.pmod(F.xxhash64("y", "x", *c), F.lit(1_000_003)) / 1e6
    return at.select("y", "x", (of() + 0.2 * of(F.lit(seed)) + 0.01 * F.col("y")).alias("v"))


@pytest.fixture
def large(spark):
    """Joins as of large tables, of which none is broadcast."""
    had = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", had)


def shuffled(spark) -> int:
    """Bytes written to exchanges so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def joined(img, truth, dys, dxs):
    """{(dy, dx): (n, score)} of lists of pixels, pair by pair."""
    there = {}
    for y, x, v in truth:
        there.setdefault((y, x), []).append(v)
    out = {}
    for dy in range(dys[0], dys[1] + 1):
        for dx in range(dxs[0], dxs[1] + 1):
            pairs = [(a, b) for y, x, a in img for b in there.get((y + dy, x + dx), [])]
            both = np.array([p for p in pairs if None not in p]).reshape(-1, 2)
            if pairs:
                d = both - both.mean(axis=0) if len(both) else both
                if np.ptp(both, axis=0).min(initial=0 if not len(both) else math.inf) == 0:
                    d = np.zeros_like(both)  # no rounding of a mean of equal values
                with np.errstate(invalid="ignore"):
                    score = None if not len(both) else (d[:, 0] @ d[:, 1]) / math.sqrt((d[:, 0] @ d[:, 0]) * (d[:, 1] @ d[:, 1])) if d.any(axis=0).all() or np.isnan(d).any() else math.nan
                out[dy, dx] = len(pairs), score
    return out


def same(got, want):
    assert set(got) == set(want)
    for k, (n, score) in want.items():
        assert got[k][0] == n, k
        assert (got[k][1] is None and score is None) or (got[k][1] is not None and score is not None and (got[k][1] == pytest.approx(score, abs=1e-9, nan_ok=True))), (k, got[k], score)


def test_scores_of_odd_pixels(spark):
    """Rows of one pixel, nulls, NaN that few shifts meet, equal values, places below zero and across blocks; shifts in parts."""
    r = np.random.default_rng(5)
    img = [(y, x, float(r.normal())) for y in range(250, 258) for x in range(-3, 4)] + [(250, 1, 2.0), (250, 1, 2.0), (251, 0, None), (252, 3, None), (252, 3, 0.5)]
    truth = [(y, x, float(r.normal())) for y in range(249, 259) for x in range(-4, 6)] + [(253, 1, 0.1), (253, 1, None), (249, -4, math.nan), (9000, 1, math.inf)]
    kind = "y long, x long, v double"
    for a, b in ((img, truth), ([(0, x, 0.1) for x in range(7)] + [(3, 0, 1.5)], [(0, x, 0.3) for x in range(9)] + [(3, 4, None)])):
        first, second = spark.createDataFrame([*a, (None, 1, 1.0)], kind), spark.createDataFrame([*b, (1, None, 1.0)], kind).repartition(3)
        for reach in (256, 2):
            with pytest.MonkeyPatch.context() as m:
                m.setattr(shifts, "REACH", reach)
                rows = compare.shift_scores(first, second, (-2, 2), (-1, 3), 0).collect()
            same({(x["dy"], x["dx"]): (x["n"], x["score"]) for x in rows}, joined(a, b, (-2, 2), (-1, 3)))
    assert any(x["score"] is not None and math.isnan(x["score"]) for x in rows) and compare.shift_scores(first, second, (-2, 2), (-1, 3), 7).count() < len(rows)
    assert compare.shift_scores(first.limit(0), second, (0, 1), (0, 1), 0).count() == compare.shift_scores(first, second.limit(0), (0, 1), (0, 1), 0).count() == 0


def test_transforms_are_as_exact_as_sums():
    """Blocks with transforms and without: noise on a large offset, a ramp, one huge value, few pixels that meet, equal values."""
    r = np.random.default_rng(6)
    f = r.normal(size=(280, 280))
    y, x = (g.ravel() for g in np.mgrid[0:256, 0:90])
    full, few = np.ones((280, 280)), np.zeros((280, 280))
    few[:5, 3:60] = 1
    spike = f.copy()
    spike[4, 20] = 1e9
    for c, truth, own in ((full, f + 1e4, f[y + 9, x + 3] + 5), (full, f.cumsum(0), f.cumsum(0)[y + 5, x + 14]), (full, spike, f[y, x]), (few, f, f[y + 2, x]), (full, 0 * f + 0.1, f[y, x])):
        one = np.ones(len(y))
        a, field = shifts.Cells(y * 256 + x, one, one, own, 0 * one), shifts.Cells(np.arange(0), c.ravel(), c.ravel(), (c * truth).ravel(), np.zeros(c.size))
        got = []
        for many in (0, 1 << 60):
            with pytest.MonkeyPatch.context() as m:
                m.setattr(shifts, "MANY", many)
                got.append(shifts._moments(a, field, 280, 25, 25))
        with np.errstate(invalid="ignore", divide="ignore"):
            p, q = (g[6] / np.sqrt(g[4] * g[5]) for g in got)
        assert np.array_equal(got[0][0], got[1][0]) and np.array_equal(np.isnan(p), np.isnan(q))
        assert np.allclose(p, q, atol=1e-9, rtol=0, equal_nan=True)


def test_shifts_are_not_rows(spark, large):
    """A search of 625 shifts sends each pixel about once, over blocks, and finds the planted one."""
    seen, truth = noise(spark, 300, 120, 1, 0, 0), noise(spark, 330, 170, 2, -4, -9)
    began = shuffled(spark)
    best = compare.shift_scores(seen, truth, (-12, 12), (-12, 12), 18_000).orderBy(F.desc("score")).first()
    assert (best["dy"], best["dx"]) == (0, 0) and best["n"] == 300 * 120
    assert shuffled(spark) - began < 30 * (300 * 120 + 330 * 170)


def test_difference_of_a_large_image(spark, large):
    """The object is read on the truth's grid within its blocks: exchanges have neither the shifts nor the finer pixels."""
    truth = noise(spark, 300, 150, 3)
    seen = truth.where("y >= 10 and x >= 6 and pmod(y, 2) = 0 and pmod(x, 2) = 0 and x < 130").select(((F.col("y") - 10) / 2).cast("long").alias("y"), ((F.col("x") - 6) / 2).cast("long").alias("x"), "v")
    began = shuffled(spark)
    d = compare.aligned_difference(seen, truth, (300, 150), (2.0, 2.0), (1.0, 1.0), 12).collect()
    assert shuffled(spark) - began < 60 * 300 * 150
    a = np.zeros((300, 150))
    for r in truth.collect():
        a[r["y"], r["x"]] = r["v"]
    assert len(d) == 289 * 123
    for r in d:
        y, x = r["y"], r["x"]
        near = [a[p, q] for p in ({y, y + y % 2, y - y % 2}) for q in ({x, x + x % 2, x - x % 2}) if p % 2 == q % 2 == 0]
        assert r["object"] == pytest.approx(np.mean(near), abs=1e-12) and r["truth"] == a[y, x] and r["d"] == r["object"] - r["truth"]


@pytest.mark.parametrize("lost", ["pos >= 493", "pmod(pos * 7, 11) = 3"])
def test_difference_of_ragged_patterns(spark, tmp_path, lost):
    """A last row that is not full, and patterns that are missing: as many rows as the SQL has."""
    duckdb = pytest.importorskip("duckdb")
    spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").withColumn("pos", F.col("vec_id")).where(f"not ({lost})").drop("pos").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    for name in ("ground_truth_difference", "ground_truth_shift"):
        with duckdb.connect() as c:
            c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
            want = c.execute(driver.oracle_sql()[name]).fetchall()
        assert sorted(map(tuple, driver.queries()[name](spark, str(tmp_path)).collect())) == sorted(want)
