"""The bridge from the plain tables to a 4-D dataset, in Spark and in SQL.

Each row of `embeddings` is a diffraction pattern of 8 x 8 pixels on a raster
20 positions wide; its entries also serve as a complex object and as images.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

N = 8
WIDTH = 20

#: Named common table expressions that a query's SQL may begin with.
CTE = {
    "px": "px AS (SELECT vec_id AS pos_id, vec_id // 20 AS iy, vec_id % 20 AS ix, k // 8 AS ky, k % 8 AS kx, CAST(embedding[k + 1] AS DOUBLE) AS a, 100 * CAST(embedding[k + 1] AS DOUBLE) * CAST(embedding[k + 1] AS DOUBLE) AS v FROM embeddings, range(64) AS t(k))",
    "cx": "cx AS (SELECT vec_id AS pos_id, k // 8 AS y, k % 8 AS x, 1 + CAST(embedding[k + 1] AS DOUBLE) AS re, CAST(embedding[(k + 32) % 64 + 1] AS DOUBLE) AS im FROM embeddings, range(64) AS t(k))",
    "stack": "stack AS (SELECT CAST(label AS BIGINT) AS z, y, x, round(avg(re), 9) AS re, round(avg(im), 9) AS im FROM cx JOIN embeddings ON cx.pos_id = vec_id GROUP BY 1, 2, 3)",
    "mask": "mask AS (SELECT k // 8 AS ky, k % 8 AS kx, CASE WHEN (k // 8 - 3.5) * (k // 8 - 3.5) + (k % 8 - 3.5) * (k % 8 - 3.5) <= 9 THEN 1.0 ELSE 0.0 END AS m FROM range(64) AS t(k))",
    "scan": "scan AS (SELECT vec_id AS pos_id, vec_id // 20 AS iy, vec_id % 20 AS ix, 0.6 * (vec_id // 20) + CAST(embedding[1] AS DOUBLE) AS y, 0.6 * (vec_id % 20) + CAST(embedding[2] AS DOUBLE) AS x FROM embeddings)",
    "starts": "starts AS (SELECT pos_id, CAST(round_even((y + 5.0) / 0.5 - 3.5, 0) AS BIGINT) AS start_y, CAST(round_even((x + 5.0) / 0.5 - 3.5, 0) AS BIGINT) AS start_x FROM scan)",
    "pairs": "pairs AS MATERIALIZED (SELECT p.pos_id, p.ky, p.kx, p.v AS measured, q.v AS model, m.m FROM px p JOIN px q ON q.pos_id = p.pos_id + 1 AND q.ky = p.ky AND q.kx = p.kx JOIN mask m ON m.ky = p.ky AND m.kx = p.kx)",
    "grid": "grid AS (SELECT k // 8 AS ky, k % 8 AS kx, (CASE WHEN k // 8 < 4 THEN k // 8 ELSE k // 8 - 8 END) / (8 * 0.25) AS fy, (CASE WHEN k % 8 < 4 THEN k % 8 ELSE k % 8 - 8 END) / (8 * 0.25) AS fx FROM range(64) AS t(k))",
    "img": "img AS (SELECT z, y, x, re AS v FROM stack)",
    "jobs": "jobs AS (SELECT user_id % 50 AS job_id, event_id, ts, event_type AS status, value, user_id FROM events)",
}
NEEDS = {"stack": ["cx"], "starts": ["scan"], "pairs": ["px", "mask"], "img": ["cx", "stack"]}


def query(*ctes: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            names: list[str] = []
            for c in ctes:
                names += [x for x in [*NEEDS.get(c, []), c] if x not in names]
            SQL[f.__name__] = ("WITH " + ", ".join(CTE[c] for c in names) + " " if names else "") + sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("pos_id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("e"), F.posexplode("embedding").alias("k", "a"))


def _yx(y: str, x: str):
    return F.floor(F.col("k") / N).cast("long").alias(y), F.pmod("k", F.lit(N)).cast("long").alias(x)


def px(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("a").cast("double")
    return _pixels(spark, d).select("pos_id", F.floor(F.col("pos_id") / WIDTH).alias("iy"), F.pmod("pos_id", F.lit(WIDTH)).alias("ix"), *_yx("ky", "kx"), a.alias("a"), (100 * a * a).alias("v"))


def cx(spark: SparkSession, d: str) -> DataFrame:
    im = F.element_at("e", (F.pmod(F.col("k") + 32, F.lit(64)) + 1).cast("int")).cast("double")
    return _pixels(spark, d).select("pos_id", "label", *_yx("y", "x"), (1 + F.col("a").cast("double")).alias("re"), im.alias("im"))


def stack(spark: SparkSession, d: str) -> DataFrame:
    """(z, y, x, re, im): the mean of all patterns of each label as a slice."""
    mean = lambda c: F.round(F.avg(c), 9).alias(c)
    return cx(spark, d).groupBy(F.col("label").alias("z"), "y", "x").agg(mean("re"), mean("im"))


def img(spark: SparkSession, d: str) -> DataFrame:
    return stack(spark, d).select("z", "y", "x", F.col("re").alias("v"))


def mask(spark: SparkSession) -> DataFrame:
    from ..operators.grids import index_grid

    inside = (F.col("ky") - 3.5) ** 2 + (F.col("kx") - 3.5) ** 2 <= 9
    return index_grid(spark, N, N, "ky", "kx").select("ky", "kx", inside.cast("double").alias("m"))


def scan(spark: SparkSession, d: str) -> DataFrame:
    iy, ix = F.floor(F.col("vec_id") / WIDTH), F.pmod("vec_id", F.lit(WIDTH))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("pos_id"), iy.alias("iy"), ix.alias("ix"), (0.6 * iy + F.col("embedding")[0].cast("double")).alias("y"), (0.6 * ix + F.col("embedding")[1].cast("double")).alias("x"))


def starts(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.grids import cutout_index

    return cutout_index(scan(spark, d), (-5.0, -5.0), (0.5, 0.5), (N, N)).select("pos_id", "start_y", "start_x")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each pattern (measured) beside the next position's (model)."""
    p = px(spark, d).select("pos_id", "ky", "kx", F.col("v").alias("measured"))
    q = px(spark, d).select((F.col("pos_id") - 1).alias("pos_id"), "ky", "kx", F.col("v").alias("model"))
    return p.join(q, ["pos_id", "ky", "kx"]).join(F.broadcast(mask(spark)), ["ky", "kx"])


def recip(spark: SparkSession) -> DataFrame:
    from ..operators.grids import Sampling, recip_grid

    return recip_grid(spark, Sampling(N, N, 0.25, 0.25))


def rounded(df: DataFrame, digits: int = 6, *cols: str) -> DataFrame:
    """Doubles rounded for comparison; minus zero becomes zero."""
    names = cols or [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in names})
