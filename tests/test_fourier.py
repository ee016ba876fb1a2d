"""Fourier operators and groupings."""

import numpy as np
from pyspark.sql import functions as F

from fringelake.operators import fourier, waves
from fringelake.queries import registry


def test_ring_and_shift(spark):
    r = np.random.default_rng(2)
    a = r.normal(size=(8, 8)) + 1j * r.normal(size=(8, 8))
    b = np.roll(a, (2, -1), axis=(0, 1))
    df = spark.createDataFrame([(0, *[x.ravel().tolist() for x in (b.real, b.imag, a.real, a.imag)])], "k long, re array<double>, im array<double>, re2 array<double>, im2 array<double>")
    s = fourier.shifts(df, "k", (8, 8), 3.0).first()
    assert (s["dy"], s["dx"]) == (2, -1)
    same = df.select("k", "re", "im", F.col("re").alias("re2"), F.col("im").alias("im2"))
    from fringelake.operators.reduce import ring_correlation

    assert all(abs(x["frc"] - 1) < 1e-9 and abs(x["ratio"] - 1) < 1e-9 for x in ring_correlation(fourier.ring_terms(same, "k", (8, 8), 0.1)).collect())


def test_support_keeps_a_probe():
    p = waves.focused_probe((16, 16), (0.4, 0.4), 0.025, 18.0, 60.0)
    assert np.allclose(fourier.probe_support((16, 16), (0.4, 0.4), 0.025, 18.0)(p[None])[0], p)
    assert np.allclose(fourier.gaussian((16, 16), (0.4, 0.4), 0.3, 0.0)(p[None])[0], p)


def test_group_sizes():
    y, x = np.divmod(np.arange(64), 8)
    for most in (16, 7, 64):
        groups = fourier.compact_groups(np.column_stack([y, x]).astype(float), most, waves.seeded("a"))
        sizes = [len(g) for g in groups]
        assert sorted(np.concatenate(groups).tolist()) == list(range(64)) and max(sizes) - min(sizes) <= 1 and max(sizes) <= most
    assert [len(g) for g in fourier.sparse_groups(33, 8, waves.seeded("seed1"))] == [7, 7, 7, 6, 6]


def test_every_name_is_registered_once():
    assert len(registry.queries()) >= 150 and set(registry.oracle_sql()) <= set(registry.queries())
