"""Queries over grids, scans, cut-outs and preprocessing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cutouts, grids, preprocess, reduce, tiles
from . import bridge
from .bridge import N, query, rounded, table

S = grids.Sampling(8, 8, 0.25, 0.25)


@query(sql="SELECT iy * 20 + ix AS pos_id, iy, ix, round((v * cos(radians(30)) - u * sin(radians(30))) * 0.6, 6) + 0.0 AS y, round((v * sin(radians(30)) + u * cos(radians(30))) * 0.5, 6) + 0.0 AS x FROM (SELECT k // 20 AS iy, k % 20 AS ix, k // 20 - 12.5 AS v, k % 20 - 10.0 AS u FROM range(500) AS t(k))")
def raster_scan(spark, d):
    return rounded(grids.raster_scan(spark, 25, 20, (0.6, 0.5), 30.0))


@query(sql="SELECT iy * 20 + ix AS pos_id, iy, ix, round(v * 1.1 + u * 0.2, 6) + 0.0 AS y, round(v * 0.1 + u * 0.9, 6) + 0.0 AS x FROM (SELECT k // 20 AS iy, k % 20 AS ix, k // 20 - 12.5 AS v, k % 20 - 10.0 AS u FROM range(500) AS t(k))")
def raster_affine(spark, d):
    return rounded(grids.raster_scan(spark, 25, 20, (1.0, 1.0), affine=((1.1, 0.1), (0.2, 0.9))))


@query(sql="SELECT k // 8 AS y, k % 8 AS x, (0.25 - 2.0) / 2 + (k // 8) * 0.25 AS yy, (0.25 - 2.0) / 2 + (k % 8) * 0.25 AS xx FROM range(64) AS t(k)")
def real_grid(spark, d):
    return grids.real_grid(spark, S)


@query("grid", sql="SELECT ky, kx, fy, fx FROM grid")
def recip_grid(spark, d):
    return grids.recip_grid(spark, S)


@query(sql="SELECT k // 8 AS ky, k % 8 AS kx, (k // 8 - 4) / 2.0 AS fy, (k % 8 - 4) / 2.0 AS fx FROM range(64) AS t(k)")
def recip_grid_centered(spark, d):
    return grids.recip_grid(spark, S, centered=True)


@query("scan", sql="SELECT CAST(ceil((max(y) - min(y) + 4) / 0.5) AS BIGINT) + 1 AS ny, CAST(ceil((max(x) - min(x) + 4) / 0.4) AS BIGINT) + 1 AS nx, round(min(y) - 2, 6) AS corner_y, round(min(x) - 2, 6) AS corner_x FROM scan")
def object_grid(spark, d):
    return rounded(grids.object_grid_from_scan(bridge.scan(spark, d), (0.5, 0.4), 2.0))


@query("scan", sql="""SELECT CAST(20 + ceil(greatest(0.0, 0.0 - (min(y) - 1)) / 0.5) + ceil(greatest(0.0, max(y) + 1 - 9.5) / 0.5) AS BIGINT) AS ny,
  round(0.0 - ceil(greatest(0.0, 0.0 - (min(y) - 1)) / 0.5) * 0.5, 6) + 0.0 AS corner_y,
  CAST(20 + ceil(greatest(0.0, 0.0 - (min(x) - 1)) / 0.5) + ceil(greatest(0.0, max(x) + 1 - 9.5) / 0.5) AS BIGINT) AS nx,
  round(0.0 - ceil(greatest(0.0, 0.0 - (min(x) - 1)) / 0.5) * 0.5, 6) + 0.0 AS corner_x FROM scan""")
def expand_grid(spark, d):
    g = spark.range(1).select(F.lit(20).alias("ny"), F.lit(20).alias("nx"), F.lit(0.0).alias("corner_y"), F.lit(0.0).alias("corner_x"))
    return rounded(grids.expand_to_scan(g, bridge.scan(spark, d), (0.5, 0.5), 1.0))


@query(sql="SELECT k // 6 AS y, k % 6 AS x, round(-3.0 + (k // 6) * 0.5, 6) + 0.0 AS yy, round(-2.0 + (k % 6) * 0.4, 6) + 0.0 AS xx FROM range(30) AS t(k)")
def object_grid_points(spark, d):
    return rounded(grids.index_grid(spark, 5, 6).select("y", "x", (-3.0 + F.col("y") * 0.5).alias("yy"), (-2.0 + F.col("x") * 0.4).alias("xx")))


@query(sql="SELECT i - 1 AS z, t[i] AS thickness, CAST(coalesce(list_sum(t[1:i - 1]), 0) AS DOUBLE) AS depth FROM (SELECT [4.0, 2.5, 3.0, 1.5] AS t), range(1, 5) AS r(i)")
def slices_z(spark, d):
    return grids.slices(spark, [4.0, 2.5, 3.0, 1.5])


@query(sql="SELECT k AS z, 20.0 / 8 AS thickness, k * 2.5 AS depth FROM range(8) AS t(k)")
def slices_total(spark, d):
    return grids.slices(spark, [20.0 / 8] * 8)


@query(sql="SELECT 2.0 AS extent_y, 2.0 AS extent_x, -0.875 AS corner_y, -0.875 AS corner_x, 2.0 AS k_max_y, 2.0 AS k_max_x, round(4.0 / 3, 9) AS bwlim")
def sampling_derived(spark, d):
    (ey, ex), (cy, cx), (ky, kx) = S.extent, S.corner, S.k_max
    return spark.range(1).select(*[F.lit(v).alias(n) for n, v in (("extent_y", ey), ("extent_x", ex), ("corner_y", cy), ("corner_x", cx), ("k_max_y", ky), ("k_max_x", kx))], F.round(F.lit(S.bwlim), 9).alias("bwlim"))


@query("scan", sql="SELECT ny, nx, round(cy, 6) AS min_y, round(cx, 6) AS min_x, round(cy + (ny - 1) * 0.5, 6) AS max_y, round(cx + (nx - 1) * 0.4, 6) AS max_x FROM (SELECT CAST(ceil((max(y) - min(y) + 4) / 0.5) AS BIGINT) + 1 AS ny, CAST(ceil((max(x) - min(x) + 4) / 0.4) AS BIGINT) + 1 AS nx, min(y) - 2 AS cy, min(x) - 2 AS cx FROM scan)")
def object_grid_derived(spark, d):
    g = grids.object_grid_from_scan(bridge.scan(spark, d), (0.5, 0.4), 2.0)
    return rounded(g.select("ny", "nx", F.col("corner_y").alias("min_y"), F.col("corner_x").alias("min_x"), (F.col("corner_y") + (F.col("ny") - 1) * 0.5).alias("max_y"), (F.col("corner_x") + (F.col("nx") - 1) * 0.4).alias("max_x")))


@query("px", sql="SELECT (iy - 2) * 8 + ix - 5 AS pos_id, iy - 2 AS iy, ix - 5 AS ix, ky, kx, round(v, 6) AS v FROM px WHERE iy >= 2 AND iy < 22 AND ix >= 5 AND ix < 13")
def crop_scan(spark, d):
    return rounded(preprocess.crop_scan(bridge.px(spark, d).drop("a"), slice(2, -3), slice(5, 13), 25, 20))


@query("px", sql="SELECT pos_id, ky, kx, round(v * 0.37, 6) AS v FROM px")
def scale_patterns(spark, d):
    return rounded(preprocess.scale_patterns(bridge.px(spark, d), 0.37).select("pos_id", "ky", "kx", "v"))


@query("px", sql="SELECT pos_id, ky, kx, round(greatest(a, 0.0), 6) + 0.0 AS v FROM px")
def clip_counts(spark, d):
    return rounded(preprocess.clip_counts(bridge.px(spark, d).withColumn("v", F.col("a"))).select("pos_id", "ky", "kx", "v"))


@query("px", sql="SELECT pos_id, ky % 2 AS part_y, kx % 2 AS part_x, ky // 2 AS y, kx // 2 AS x, round(v, 6) AS v FROM px WHERE ky < 6 AND kx < 6")
def subimage_split(spark, d):
    px = bridge.px(spark, d).select("pos_id", F.col("ky").alias("y"), F.col("kx").alias("x"), "v").where("y < 7 and x < 7")
    even = px.where("y < 6 and x < 6")
    return rounded(even.select("pos_id", F.pmod("y", F.lit(2)).alias("part_y"), F.pmod("x", F.lit(2)).alias("part_x"), F.floor(F.col("y") / 2).alias("y"), F.floor(F.col("x") / 2).alias("x"), "v"))


@query("grid", sql="SELECT ky, kx, CASE WHEN sqrt(fy * fy + fx * fx) <= 1.2 THEN 1.0 ELSE 0.0 END AS m FROM grid")
def aperture_mask(spark, d):
    return bridge.recip(spark).select("ky", "kx", (F.sqrt(F.col("fy") ** 2 + F.col("fx") ** 2) <= 1.2).cast("double").alias("m"))


@query("img", sql="SELECT z, y, x, round(v, 6) AS v FROM img WHERE y >= 2 AND y < 6 AND x >= 1 AND x < 7")
def roi_crop(spark, d):
    y0, y1, x0, x1 = grids.region_crop((-1.0, -1.0), (0.3, 0.3), (8, 8), (-0.5, -0.8), (0.6, 0.99))
    return rounded(bridge.img(spark, d).where((F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1)))


@query("scan", sql="SELECT round(min(y), 6) AS min_y, round(min(x), 6) AS min_x, round(max(y), 6) AS max_y, round(max(x), 6) AS max_x FROM scan")
def scan_bbox(spark, d):
    return rounded(grids.scan_bbox(bridge.scan(spark, d)))


@query("scan", sql="SELECT count(*) AS outside FROM scan WHERE y - 1 < 0 OR y + 1 > 9.5 OR x - 1 < 0 OR x + 1 > 9.5")
def check_scan(spark, d):
    return grids.outside(bridge.scan(spark, d), (0.0, 0.0), (0.5, 0.5), (20, 20), 1.0).agg(F.count(F.lit(1)).alias("outside"))


@query("scan", "starts", sql="SELECT pos_id, start_y, start_x FROM starts")
def cutout_index(spark, d):
    return bridge.starts(spark, d)


@query("scan", sql="SELECT pos_id, round(((y + 5.0) / 0.5 - 3.5 - round_even((y + 5.0) / 0.5 - 3.5, 0)) * 0.5, 6) + 0.0 AS sub_y, round(((x + 5.0) / 0.5 - 3.5 - round_even((x + 5.0) / 0.5 - 3.5, 0)) * 0.5, 6) + 0.0 AS sub_x FROM scan")
def subpixel_shift(spark, d):
    return rounded(grids.cutout_index(bridge.scan(spark, d), (-5.0, -5.0), (0.5, 0.5), (N, N)).select("pos_id", "sub_y", "sub_x"))


@query("px", "scan", sql="SELECT pos_id, round(y, 6) AS y, round(x, 6) AS x FROM scan WHERE pos_id IN (SELECT pos_id FROM px GROUP BY pos_id HAVING avg(CASE WHEN a < 0 THEN 1 ELSE 0 END) <= 0.5)")
def drop_sparse_positions(spark, d):
    good = preprocess.drop_sparse(bridge.px(spark, d), "a < 0", 0.5)
    return rounded(bridge.scan(spark, d).join(good, "pos_id", "left_semi").select("pos_id", "y", "x"))


@query("px", "scan", sql=", l AS (SELECT pos_id, ky, kx, CASE WHEN a >= 0 THEN ln(a) ELSE CAST('nan' AS DOUBLE) END AS v FROM px WHERE a <> 0), s AS (SELECT pos_id, avg(CASE WHEN isnan(v) THEN 1 ELSE 0 END) AS share FROM l GROUP BY pos_id) SELECT pos_id, CAST(count(*) AS BIGINT) AS pixels, CAST(sum(CASE WHEN isnan(v) THEN 1 ELSE 0 END) AS BIGINT) AS absent, round(sum(CASE WHEN isnan(v) THEN 0 ELSE v END), 6) AS total FROM l WHERE pos_id IN (SELECT pos_id FROM s WHERE share <= 0.5) AND pos_id IN (SELECT pos_id FROM scan) GROUP BY pos_id")
def drop_nan_patterns(spark, d):
    """Logarithms of the entries, NaN where one is negative: positions with over half their pixels NaN go from patterns and scan."""
    px = bridge.px(spark, d).where("a <> 0").withColumn("v", F.when(F.col("a") >= 0, F.ln("a")).otherwise(float("nan")))
    good = preprocess.drop_sparse(px, "isnan(v)", 0.5)
    scan = bridge.scan(spark, d).join(good, "pos_id", "left_semi")
    kept = px.join(good, "pos_id", "left_semi").join(scan.select("pos_id"), "pos_id", "left_semi")
    nan = F.isnan("v")
    return rounded(kept.groupBy("pos_id").agg(F.count(F.lit(1)).alias("pixels"), F.count_if(nan).alias("absent"), F.sum(F.when(nan, 0.0).otherwise(F.col("v"))).alias("total")))


_OBJ = "obj AS (SELECT k // 80 AS y, k % 80 AS x, CAST((k // 80) * 2 + (k % 80) AS DOUBLE) AS v FROM range(6400) AS t(k)), w AS (SELECT k // 8 AS wy, k % 8 AS wx FROM range(64) AS t(k)), wp AS (SELECT pos_id, wy, wx, start_y + wy AS y, start_x + wx AS x FROM starts, w)"


def _obj(spark):
    return grids.index_grid(spark, 80, 80).withColumn("v", (F.col("y") * 2 + F.col("x")).cast("double"))


_TILES = tiles.Tiling(80, 80, size=32)


def _packed(spark, d):
    """(pos_id, start_y, start_x, data): each pattern as a window, packed as the table has it."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("pos_id"), F.transform("embedding", lambda a: 100 * a.cast("double") * a.cast("double")).alias("data"))
    return e.join(bridge.starts(spark, d), "pos_id").select("pos_id", F.col("start_y").cast("long").alias("start_y"), F.col("start_x").cast("long").alias("start_x"), "data")


def _starts(spark, d):
    return bridge.starts(spark, d).select("pos_id", F.col("start_y").cast("long").alias("start_y"), F.col("start_x").cast("long").alias("start_x"))


@query("starts", sql=", " + _OBJ + " SELECT wp.pos_id, wy, wx, coalesce(v, 1.0) AS v FROM wp LEFT JOIN obj ON wp.y = obj.y AND wp.x = obj.x")
def cutout_gather(spark, d):
    got = tiles.gather(tiles.tiles_of(_obj(spark), _TILES), _starts(spark, d), N, N, _TILES)
    return tiles.window_px(got, N, N).drop("wz")


_SLICES = ", big AS (SELECT z, a.k * 8 + y AS y, b.k * 8 + x AS x, re * (1 + a.k) + b.k AS v FROM stack, range(5) AS a(k), range(5) AS b(k)), w AS (SELECT k // 8 AS wy, k % 8 AS wx FROM range(64) AS t(k)), wq AS (SELECT pos_id, wy, wx, ((start_y - 20 + wy) % 80 + 80) % 80 AS y, ((start_x - 20 + wx) % 80 + 80) % 80 AS x FROM starts, w), wp AS (SELECT pos_id, wy, wx, CASE WHEN y < 40 THEN y ELSE 79 - y END AS y, CASE WHEN x < 40 THEN x ELSE 79 - x END AS x FROM wq)"


@query("stack", "starts", sql=_SLICES + " SELECT wp.pos_id, z AS wz, wy, wx, round(v, 6) AS v FROM wp JOIN big ON big.y = wp.y AND big.x = wp.x WHERE z < 3")
def cutout_slices(spark, d):
    """Windows of three slices of the label means, five by five of them, reflected at the edges."""
    s = bridge.stack(spark, d).where("z < 3")
    k = lambda n: F.explode(F.sequence(F.lit(0), F.lit(4))).alias(n)
    big = s.select("z", "y", "x", "re", k("a")).select("z", "y", "x", "re", "a", k("b"))
    big = big.select("z", (F.col("a") * N + F.col("y")).alias("y"), (F.col("b") * N + F.col("x")).alias("x"), (F.col("re") * (1 + F.col("a")) + F.col("b")).alias("v"))
    t = tiles.Tiling(40, 40, 3, 16)
    at = _starts(spark, d).select("pos_id", (F.col("start_y") - 20).alias("start_y"), (F.col("start_x") - 20).alias("start_x"))
    return rounded(tiles.window_px(tiles.gather(tiles.tiles_of(big, t), at, N, N, t, "reflect"), N, N))


@query("px", "starts", sql=", " + _OBJ + " SELECT wp.y, wp.x, round(sum(px.v), 6) AS v, count(*) AS n FROM wp JOIN px ON wp.pos_id = px.pos_id AND wy = ky AND wx = kx GROUP BY wp.y, wp.x")
def cutout_scatter_add(spark, d):
    w = _packed(spark, d)
    ny, nx = w.agg(F.max("start_y") + N, F.max("start_x") + N).first()  # the object is as large as the scan
    t = tiles.Tiling(ny, nx, size=32)
    return rounded(tiles.sum_px(tiles.scatter_add(w, N, N, t), t)).select("y", "x", "v", "n")


@query("px", "starts", sql=", " + _OBJ + ", l AS (SELECT wp.y, wp.x, arg_max(px.v, wp.pos_id) AS u FROM wp JOIN px ON wp.pos_id = px.pos_id AND wy = ky AND wx = kx GROUP BY wp.y, wp.x) SELECT obj.y, obj.x, round(coalesce(u, v), 6) AS v FROM obj LEFT JOIN l ON obj.y = l.y AND obj.x = l.x")
def cutout_scatter_set(spark, d):
    got = tiles.scatter_set(tiles.tiles_of(_obj(spark), _TILES), _packed(spark, d), N, N, _TILES)
    return rounded(tiles.pixels_of(got, _TILES).select("y", "x", "v"))


@query("mask", "starts", sql=" SELECT start_y + ky AS y, start_x + kx AS x, sum(m) AS v FROM starts, mask GROUP BY 1, 2")
def illumination_map(spark, d):
    return cutouts.illumination(bridge.starts(spark, d), bridge.mask(spark).select(F.col("ky").alias("wy"), F.col("kx").alias("wx"), F.col("m").alias("v")))


@query("cx", "starts", sql=", p AS (SELECT y AS wy, x AS wx, avg(re * re + im * im) AS v FROM cx GROUP BY 1, 2) SELECT start_y + wy AS y, start_x + wx AS x, round(sum(v), 6) AS v FROM starts, p GROUP BY 1, 2")
def probe_overlap(spark, d):
    p = bridge.cx(spark, d).groupBy(F.col("y").alias("wy"), F.col("x").alias("wx")).agg(F.avg(F.col("re") ** 2 + F.col("im") ** 2).alias("v"))
    return rounded(cutouts.illumination(bridge.starts(spark, d), p))


@query(sql="SELECT k // 16 AS ky, k % 16 AS kx, CASE WHEN k // 16 BETWEEN 2 AND 13 AND k % 16 BETWEEN 2 AND 13 THEN 1.0 ELSE 0.0 END AS m FROM range(256) AS t(k)")
def border_mask(spark, d):
    g = grids.index_grid(spark, 16, 16, "ky", "kx")
    return g.select("ky", "kx", (F.col("ky").between(2, 13) & F.col("kx").between(2, 13)).cast("double").alias("m"))


@query("px", sql="SELECT pos_id, (ky + 4) % 8 AS ky, (kx + 4) % 8 AS kx, round(v / 375.0, 9) AS v FROM px")
def adu_scale(spark, d):
    return rounded(preprocess.shift_index(bridge.px(spark, d).select("pos_id", "ky", "kx", (F.col("v") / 375.0).alias("v")), {"ky": 8, "kx": 8}, inverse=True), 9)


@query("scan", sql="SELECT pos_id, 1.5 AS ty, -0.5 AS tx FROM scan")
def global_tilt(spark, d):
    return bridge.scan(spark, d).select("pos_id", F.lit(1.5).alias("ty"), F.lit(-0.5).alias("tx"))


@query("px", sql="SELECT pos_id, ky, kx, round(CAST(CAST(v AS FLOAT) AS DOUBLE), 5) AS v FROM px")
def cast_dtype(spark, d):
    return rounded(bridge.px(spark, d).select("pos_id", "ky", "kx", F.col("v").cast("float").cast("double").alias("v")), 5)


@query("px", "scan", sql="SELECT (SELECT count(DISTINCT pos_id) FROM px) AS positions, (SELECT count(*) FROM scan) AS expected, (SELECT count(DISTINCT pos_id) FROM px) = (SELECT count(*) FROM scan) AS agrees")
def position_count_check(spark, d):
    return preprocess.count_check(bridge.px(spark, d), bridge.scan(spark, d))


@query("scan", sql="SELECT count(*) AS bad FROM scan WHERE isnan(y) OR isnan(x) OR isinf(y) OR isinf(x)")
def finite_check(spark, d):
    return preprocess.not_finite(bridge.scan(spark, d), "y", "x").agg(F.count(F.lit(1)).alias("bad"))


@query("pairs", sql="SELECT pos_id, ky, kx, abs(measured - model) <= 1e-8 + 0.05 * abs(model) AS close FROM pairs")
def isclose_check(spark, d):
    return bridge.pairs(spark, d).select("pos_id", "ky", "kx", preprocess.isclose("measured", "model", 0.05).alias("close"))


@query("px", sql="SELECT ky, kx, round(v, 6) AS v, pos_id FROM px WHERE ky = 3")
def axis_split(spark, d):
    return rounded(bridge.px(spark, d).where("ky = 3").select("ky", "kx", "v", "pos_id"))


@query("img", sql="SELECT z, y, x, round(CASE WHEN y = 3 THEN greatest(v, 1.0) ELSE v END, 6) AS v FROM img")
def indexed_update(spark, d):
    img = bridge.img(spark, d)
    change = img.where("y = 3").select("z", "y", "x", F.lit(1.0).alias("u"))
    return rounded(preprocess.indexed_update(img, change, ["z", "y", "x"], "max"))


@query("img", sql="SELECT z, y, x, round(CASE WHEN x = 2 THEN v - 0.25 ELSE v END, 6) AS v FROM img")
def indexed_subtract(spark, d):
    img = bridge.img(spark, d)
    return rounded(preprocess.indexed_update(img, img.where("x = 2").select("z", "y", "x", F.lit(0.25).alias("u")), ["z", "y", "x"], "subtract"))


@query("px", sql="SELECT pos_id, (ky + 4) % 8 AS ky, (kx + 4) % 8 AS kx, round(v, 6) AS v FROM px")
def fftshift(spark, d):
    return rounded(preprocess.shift_index(bridge.px(spark, d).select("pos_id", "ky", "kx", "v"), {"ky": 8, "kx": 8}))


@query("px", "scan", sql="SELECT px.pos_id, ky, kx, round(v, 6) AS v, round(y, 6) AS y, round(x, 6) AS x, 0.5 AS ty FROM px JOIN scan ON px.pos_id = scan.pos_id")
def aligned_join(spark, d):
    scan = bridge.scan(spark, d).select("pos_id", "y", "x")
    return rounded(bridge.px(spark, d).select("pos_id", "ky", "kx", "v").join(scan, "pos_id").withColumn("ty", F.lit(0.5)))
