"""Nearest points by a grid of cells, exactly, without all pairs.

A point meets the points of the 3 x 3 cells around its own. Every one within a cell's
width is among them, so it is done once its k nearest are no farther than that;
what is not done meets cells twice as wide. A grid's first width puts a few
points in a cell.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.lineage import materialised


def cell_width(centroids: DataFrame, per_cell: float = 2.0) -> float:
    """A width with `per_cell` points in a cell on average over their bounding box."""
    n, y0, y1, x0, x1 = centroids.agg(F.count(F.lit(1)), F.min("cy"), F.max("cy"), F.min("cx"), F.max("cx")).first()
    if not n:
        return 1.0
    area, longer = (y1 - y0) * (x1 - x0), max(y1 - y0, x1 - x0)
    return math.sqrt(area * per_cell / n) if area > 0 else max(longer * per_cell / n, 1e-9 * max(1.0, abs(y0), abs(x0)))


def nearest(points: DataFrame, centroids: DataFrame, k: int, width: float | None = None) -> DataFrame:
    """(pos_id, centroid, d2, rank): the k nearest of `centroids` (centroid, cy, cx) to each of `points` (pos_id, y, x).

    Ties go to the smaller centroid. Points with a null or non-finite coordinate have no row, and such centroids are no one's;
    with fewer than k centroids each point has them all.
    """
    finite = lambda c: F.col(c).isNotNull() & (F.abs(c) < float("inf"))
    points = points.select("pos_id", F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x")).where(finite("y") & finite("x"))
    centroids = centroids.select("centroid", F.col("cy").cast("double").alias("cy"), F.col("cx").cast("double").alias("cx")).where(finite("cy") & finite("cx"))
    # of many at one place only the first k can be among the nearest
    place = Window.partitionBy("cy", "cx").orderBy("centroid")
    centroids = materialised(centroids.withColumn("r", F.row_number().over(place)).where(F.col("r") <= k).drop("r"))
    n = centroids.count()
    if not n:
        return points.select("pos_id", F.lit(None).cast("long").alias("centroid"), F.lit(0.0).alias("d2"), F.lit(1).cast("long").alias("rank")).limit(0)
    ends = centroids.agg(F.min("cy").alias("y0"), F.max("cy").alias("y1"), F.min("cx").alias("x0"), F.max("cx").alias("x1"))
    own = points.agg(F.min("y"), F.max("y"), F.min("x"), F.max("x")).first()
    box = ends.first()
    if own[0] is None:
        return points.select("pos_id", F.lit(None).cast("long").alias("centroid"), F.lit(0.0).alias("d2"), F.lit(1).cast("long").alias("rank"))
    extent = max(max(own[1], box[1]) - min(own[0], box[0]), max(own[3], box[3]) - min(own[2], box[2]))
    size, wanted, found, left = width or cell_width(centroids), min(k, n), None, points
    beside = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])).alias("s")
    while True:
        cell = lambda c, s=size: F.floor(F.col(c) / s).cast("long")
        grid = centroids.withColumn("gy", cell("cy")).withColumn("gx", cell("cx"))
        around = left.select("pos_id", "y", "x", beside).select("pos_id", "y", "x", (cell("y") + F.col("s.a")).alias("gy"), (cell("x") + F.col("s.b")).alias("gx"))
        met = around.join(grid, ["gy", "gx"]).withColumn("d2", (F.col("y") - F.col("cy")) ** 2 + (F.col("x") - F.col("cx")) ** 2)
        order = Window.partitionBy("pos_id").orderBy("d2", "centroid")
        ranked = met.select("pos_id", "centroid", "d2", F.row_number().over(order).cast("long").alias("rank")).where(F.col("rank") <= wanted)
        ranked = materialised(ranked)
        last = size > extent  # the 3 x 3 cells have everything
        near = ranked.where((F.col("rank") == wanted) & (F.lit(last) | (F.col("d2") <= size * size * (1 - 1e-12)))).select("pos_id")
        done = ranked.join(near, "pos_id", "left_semi")
        found = done if found is None else found.unionByName(done)
        if last:
            return found
        left = materialised(left.join(near, "pos_id", "left_anti"))
        if left.isEmpty():
            return found
        size *= 2
