"""Windows of an object: gather, overlap-add and set, as equi-joins on pixels.

Each window is exploded into its pixels, whose indices join or aggregate; sums
are partial on the map side, so a pixel under many windows is no hot group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .grids import index_grid


def window_pixels(starts: DataFrame, ny: int, nx: int) -> DataFrame:
    """(pos_id, wy, wx, y, x) of every window; the offsets are a table of ny * nx rows."""
    offsets = F.broadcast(index_grid(starts.sparkSession, ny, nx, "wy", "wx"))
    return starts.crossJoin(offsets).select("pos_id", "wy", "wx", (F.col("start_y") + F.col("wy")).alias("y"), (F.col("start_x") + F.col("wx")).alias("x"))


def gather(obj: DataFrame, starts: DataFrame, ny: int, nx: int, value: str = "v", vacuum: float = 1.0) -> DataFrame:
    """(pos_id, wy, wx, v): the object under each window; `vacuum` outside it."""
    px = window_pixels(starts, ny, nx)
    return px.join(obj.select("y", "x", value), ["y", "x"], "left").select("pos_id", "wy", "wx", F.coalesce(F.col(value), F.lit(vacuum)).alias("v"))


def scatter_add(windows: DataFrame, starts: DataFrame, ny: int, nx: int) -> DataFrame:
    """(y, x, v, n): sum and number of window values at each pixel."""
    px = window_pixels(starts, ny, nx).join(windows, ["pos_id", "wy", "wx"])
    return px.groupBy("y", "x").agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("n"))


def scatter_set(obj: DataFrame, windows: DataFrame, starts: DataFrame, ny: int, nx: int) -> DataFrame:
    """(y, x, v): the object with windows set in order of pos_id; the last one stays."""
    px = window_pixels(starts, ny, nx).join(windows, ["pos_id", "wy", "wx"])
    last = px.groupBy("y", "x").agg(F.max_by("v", "pos_id").alias("set_v"))
    return obj.join(last, ["y", "x"], "left").select("y", "x", F.coalesce("set_v", "v").alias("v"))


def illumination(starts: DataFrame, intensity: DataFrame) -> DataFrame:
    """(y, x, v): overlap-add of one broadcast window intensity (wy, wx, v)."""
    return starts.crossJoin(F.broadcast(intensity)).groupBy((F.col("start_y") + F.col("wy")).alias("y"), (F.col("start_x") + F.col("wx")).alias("x")).agg(F.sum("v").alias("v"))
