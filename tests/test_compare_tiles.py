"""Image comparison, tiled windows, spatial search, ranks and groups against NumPy loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringelake.operators import compare, groups, nearest, ranks, tiles


def image(spark, a):
    return spark.createDataFrame([(int(y), int(x), float(a[y, x])) for y, x in np.ndindex(*a.shape)], "y long, x long, v double")


def some_windows(r, n, nz, ny, nx):
    return [(k, r.randrange(-12, 40), r.randrange(-12, 60), [r.random() for _ in range(nz * ny * nx)]) for k in range(n)] + [(900, -500, 3, [1.0] * (nz * ny * nx)), (901, 3, 5000, [1.0] * (nz * ny * nx))]


@pytest.mark.parametrize("nz,size,wy,wx", [(1, 16, 7, 9), (3, 8, 5, 20), (2, 64, 6, 6)])
def test_windows_of_tiles(spark, monkeypatch, nz, size, wy, wx):
    """Gather in every mode, sums and sets, with windows across and beyond the edges, many on one tile, and tiles passed on early."""
    monkeypatch.setattr(tiles, "GROUP", 5)
    r = random.Random(size)
    ny, nx = 33, 50
    t = tiles.Tiling(ny, nx, nz, size)
    obj = np.random.default_rng(1).normal(size=(nz, ny, nx))
    px = spark.createDataFrame([(int(z), int(y), int(x), float(obj[z, y, x])) for z, y, x in np.ndindex(*obj.shape)] + [(0, -1, 3, 9.0), (0, 3, nx, 9.0)], "z long, y long, x long, v double")
    rows = some_windows(r, 60, nz, wy, wx)
    windows = spark.createDataFrame(rows, "pos_id long, start_y long, start_x long, data array<double>").repartition(3)
    packed = tiles.tiles_of(px, t)
    for mode, how in (("constant", {"constant_values": 7.0}), ("nearest", None), ("wrap", None), ("reflect", None)):
        got = {x["pos_id"]: np.array(x["data"]).reshape(nz, wy, wx) for x in tiles.gather(packed, windows.where("pos_id < 900"), wy, wx, t, mode, 7.0).collect()}
        pad = np.pad(obj, ((0, 0), (100, 100), (100, 100)), {"constant": "constant", "nearest": "edge", "wrap": "wrap", "reflect": "symmetric"}[mode], **(how or {}))
        assert len(got) == 60
        for k, y, x, _ in rows[:60]:
            assert np.array_equal(got[k], pad[:, 100 + y : 100 + y + wy, 100 + x : 100 + x + wx]), (mode, k)
    total, n, last = np.zeros((nz, ny, nx)), np.zeros((ny, nx), int), obj.copy()
    for _, y, x, data in rows:
        a = np.array(data).reshape(nz, wy, wx)
        for i in range(wy):
            for j in range(wx):
                if 0 <= y + i < ny and 0 <= x + j < nx:
                    total[:, y + i, x + j] += a[:, i, j]
                    n[y + i, x + j] += 1
                    last[:, y + i, x + j] = a[:, i, j]
    for held in (1 << 24, 1):
        monkeypatch.setattr(tiles, "HELD", held)
        sums = tiles.sum_px(tiles.scatter_add(windows, wy, wx, t), t).collect()
        assert {(x["z"], x["y"], x["x"]) for x in sums} == {(z, int(y), int(x)) for z in range(nz) for y, x in zip(*np.nonzero(n))}
        assert all(math.isclose(x["v"], total[x["z"], x["y"], x["x"]], abs_tol=1e-12) and x["n"] == n[x["y"], x["x"]] for x in sums)
        done = tiles.pixels_of(tiles.scatter_set(packed, windows, wy, wx, t), t).collect()
        assert len(done) == nz * ny * nx and all(x["v"] == last[x["z"], x["y"], x["x"]] for x in done)


def test_tiles_without_windows(spark):
    t = tiles.Tiling(5, 5, size=4)
    none = spark.createDataFrame([], "pos_id long, start_y long, start_x long, data array<double>")
    packed = tiles.tiles_of(image(spark, np.arange(25.0).reshape(5, 5)), t)
    assert tiles.gather(packed, none, 2, 2, t).count() == tiles.scatter_add(none, 2, 2, t).count() == 0
    assert [x["v"] for x in tiles.pixels_of(tiles.scatter_set(packed, none, 2, 2, t), t).orderBy("y", "x").collect()] == list(range(25))
    with pytest.raises(ValueError, match="mode"):
        tiles.gather(packed, none, 2, 2, t, "mirror")


def test_nearest_is_exact(spark):
    r = random.Random(3)
    points = [(k, r.uniform(0, 100), r.uniform(0, 100)) for k in range(200)] + [(500, 4000.0, -900.0), (501, float("nan"), 1.0), (502, None, 1.0), (503, 50.0, 50.0)]
    places = [(k, r.gauss(20, 3), r.gauss(70, 3)) for k in range(60)] + [(100 + k, r.uniform(0, 100), r.uniform(0, 100)) for k in range(40)]
    places += [(200 + k, 50.0, 50.0) for k in range(300)] + [(900, None, 3.0), (901, float("inf"), 3.0)]
    p, c = spark.createDataFrame(points, "pos_id long, y double, x double"), spark.createDataFrame(places, "centroid long, cy double, cx double")
    good = [x for x in places if x[0] < 900]
    for k in (1, 3, 7):
        got = {}
        for x in nearest.nearest(p, c, k).collect():
            got.setdefault(x["pos_id"], []).append((x["rank"], x["centroid"], x["d2"]))
        assert set(got) == {i for i, _, _ in points} - {501, 502}
        for i, y, x in points:
            if i in got:
                want = sorted((((y - cy) ** 2 + (x - cx) ** 2), j) for j, cy, cx in good)[:k]
                assert [(a, b) for a, b, _ in sorted(got[i])] == [(n + 1, j) for n, (_, j) in enumerate(want)]
    few = c.where("centroid < 2")
    assert nearest.nearest(p, few, 5).groupBy("pos_id").count().where("count = 2").count() == 202
    assert nearest.nearest(p, c.limit(0), 3).count() == 0 and nearest.nearest(p.limit(0), c, 3).count() == 0
    one = nearest.nearest(p.where("pos_id < 5"), c.where("centroid = 7"), 1)
    assert one.where("centroid = 7").count() == 5


def test_quantiles_are_exact(spark):
    r = np.random.default_rng(8)
    parts = {"a": r.normal(size=3000), "b": np.repeat([1.0, 2.0, 5.0], [2000, 1, 999]), "c": np.array([4.0]), "d": np.r_[r.normal(size=999) * 1e-300, 1e300], "e": np.zeros(700), "f": np.r_[-1e308, 1e308, r.random(900)]}
    rows = [(g, float(v)) for g, vs in parts.items() for v in vs] + [("a", None), ("a", float("nan")), ("z", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    shares = [0.0, 0.01, 0.5, 0.777, 1.0]
    for few, bins in ((20_000, 4096), (50, 16), (1, 2)):
        got = {(x["g"], x["share"]): x["v"] for x in ranks.exact_quantiles(df, "v", shares, ["g"], few, bins).collect()}
        assert len(got) == len(parts) * len(shares)
        for g, vs in parts.items():
            for s in shares:
                assert math.isclose(got[g, s], np.quantile(vs, s), rel_tol=1e-12, abs_tol=1e-15), (g, s, few)
    whole = {x["share"]: x["v"] for x in ranks.exact_quantiles(df, "v", [0.3], [], 100).collect()}
    assert math.isclose(whole[0.3], np.quantile(np.concatenate(list(parts.values())), 0.3), rel_tol=1e-12)
    assert ranks.exact_quantiles(df.limit(0), "v", [0.5], ["g"]).count() == 0


def test_similarity(spark):
    r = np.random.default_rng(2)
    a = r.random((12, 15))
    b = a + 0.1 * r.random((12, 15))
    pairs = image(spark, a).withColumnRenamed("v", "a").join(image(spark, b).withColumnRenamed("v", "b"), ["y", "x"]).withColumn("z", F.lit(0))

    def plain(weights, p, q, y, x):
        k = weights.shape[0] // 2
        u, v = p[y - k : y + k + 1, x - k : x + k + 1], q[y - k : y + k + 1, x - k : x + k + 1]
        mu, mv = (weights * u).sum(), (weights * v).sum()
        f = weights.size / (weights.size - 1)
        vu, vv, uv = (f * ((weights * m).sum() - c) for m, c in ((u * u, mu * mu), (v * v, mv * mv), (u * v, mu * mv)))
        c1, c2 = (0.01 * np.ptp(q)) ** 2, (0.03 * np.ptp(q)) ** 2
        return (2 * mu * mv + c1) * (2 * uv + c2) / ((mu * mu + mv * mv + c1) * (vu + vv + c2))

    taps = np.exp(-(np.arange(-3, 4) ** 2) / (2 * 1.5**2))
    gauss = np.outer(taps, taps) / taps.sum() ** 2
    for sigma, weights in ((None, np.full((7, 7), 1 / 49)), (1.5, gauss)):
        got = {(x["y"], x["x"]): x["ssim"] for x in compare.ssim_map(pairs, ["z"], 3, sigma).collect()}
        assert set(got) == {(y, x) for y in range(3, 9) for x in range(3, 12)}
        assert all(abs(v - plain(weights, a, b, y, x)) < 1e-9 for (y, x), v in got.items())
    same = pairs.withColumn("b", F.col("a"))
    assert abs(compare.ssim(same, [], 2).first()["ssim"] - 1) < 1e-12
    far = pairs.withColumn("a", F.col("a") + 1e6).withColumn("b", F.col("b") + 1e6)
    assert 0.9 < compare.ssim(far, ["z"], 3).first()["ssim"] <= 1.0


def test_planted_shift_is_found(spark):
    r = np.random.default_rng(4)
    truth = np.cumsum(np.cumsum(r.normal(size=(64, 72)), axis=0), axis=1)
    seen = truth[9:49, 14:60] * 3 + 5  # another scale and offset
    for levels, most in ((0, 16), (3, 20)):
        assert compare.best_shift(image(spark, seen), image(spark, truth), most, levels) == (9, 14)
    d = compare.aligned_difference(image(spark, truth[6:46:2, 8:60:2]), image(spark, truth), (64, 72), (2.0, 2.0), (1.0, 1.0), 12, 1)
    exact = d.where("pmod(y, 2) = 0 and pmod(x, 2) = 0")
    assert exact.count() == 20 * 26 and exact.agg(F.max(F.abs("d"))).first()[0] < 1e-9
    scores = compare.shift_scores(image(spark, seen), image(spark, truth), (8, 10), (13, 15), 100)
    fine = compare.subpixel(scores, (9, 14)).first()
    assert abs(fine["dy"] - 9) < 0.5 and abs(fine["dx"] - 14) < 0.5
    with pytest.raises(ValueError, match="truth"):
        compare.best_shift(image(spark, truth), image(spark, truth[:4, :4]), 3)


def test_bijection_and_groups(spark):
    for n in (1, 2, 3, 7, 32, 100, 1000):
        keys = groups.round_keys("s", n)
        got = [x[0] for x in spark.range(n).select(groups.bijection(F.col("id"), n, keys)).collect()]
        assert sorted(got) == list(range(n)) and (n < 30 or got != sorted(got))
    ranked = spark.range(103).select(F.col("id").alias("pos_id"), F.col("id").alias("rank"))
    g = groups.Groups(10, "a", regroup=(4,))
    members = {k: {x["pos_id"]: x["grp"] for x in g.members(ranked, 103, k).collect()} for k in (0, 1, 3, 4, 9)}
    assert members[0] == members[1] == members[3] != members[4] == members[9]
    sizes = [list(members[0].values()).count(k) for k in range(10)]
    assert sum(sizes) == 103 and max(sizes) - min(sizes) <= 1
    order = lambda m, k: [x["place"] for x in m.order(spark.range(10).withColumnRenamed("id", "grp"), k).orderBy("grp").collect()]
    assert order(g, 0) != order(g, 1) and sorted(order(g, 1)) == list(range(10)) and order(g, 1) == order(g, 1)
    assert order(groups.Groups(10, "a", shuffle=False), 5) == list(range(10))
