"""Exact quantiles of large groups: histograms zoom in on the ranks that are asked for.

A rank's bin is found by counting; the values of that bin are counted again in
finer bins until few are left, which are sorted, or all are equal. A count is a partial
aggregate, so a group in one task has bins, never rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.lineage import materialised

#: Bins of a range, and values that are sorted in one group at most.
BINS, FEW = 4096, 20_000


def exact_quantiles(df: DataFrame, value: str, shares: list[float], by: list[str], few: int = FEW, bins: int = BINS) -> DataFrame:
    """(by, share, v): quantiles with linear interpolation between ranks; null and NaN values are left out.

    Values outside the doubles' finite range are counted as the ends of it.
    """
    data = df.select(*by, F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    top = 1.7976931348623157e308
    data = data.withColumn("v", F.least(F.greatest("v", F.lit(-top)), F.lit(top)))
    ends = data.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    asked = F.explode(F.array(*[F.lit(s) for s in shares])).alias("share")
    place = F.col("share") * (F.col("n") - 1)
    low = F.floor(place).cast("long")
    need = ends.select(*by, "n", "lo", "hi", asked).select(*by, "share", "lo", "hi", "n", F.explode(F.array_distinct(F.array(low, F.least(low + 1, F.col("n") - 1)))).alias("rank"))
    need = materialised(need.withColumn("below", F.lit(0).cast("long")))  # a row a group, share and neighbour
    found = None
    while True:
        done = need.where("lo = hi").select(*by, "share", "rank", F.col("lo").alias("v"))
        found = done if found is None else found.unionByName(done)
        small = need.where(F.col("lo") < F.col("hi")).where(F.col("n") <= few)
        rest = need.where(F.col("lo") < F.col("hi")).where(F.col("n") > few)
        open_ = F.col("lo") < F.col("hi")
        some, many = need.agg(F.max(open_ & (F.col("n") <= few)), F.max(open_ & (F.col("n") > few))).first()
        if some:
            ranges = small.select(*by, "lo", "hi", "below").distinct()
            inside = _within(data, ranges, by)
            order = Window.partitionBy(*by, "lo", "hi").orderBy("v")  # few values
            ranked = inside.withColumn("at", F.row_number().over(order) - 1 + F.col("below"))
            met = small.select(*by, "share", "rank", "lo", "hi").join(ranked.select(*by, "lo", "hi", F.col("at").alias("rank"), "v"), [*by, "lo", "hi", "rank"])
            found = found.unionByName(met.select(*by, "share", "rank", "v"))
        if not many:
            break
        ranges = rest.select(*by, "lo", "hi", "below").distinct()
        # halves, so that a range of all doubles has a width
        at = F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * bins), F.lit(bins - 1))
        counted = _within(data, ranges, by).groupBy(*by, "lo", "hi", "below", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        run = Window.partitionBy(*by, "lo", "hi").orderBy("bin")  # bins, not values
        counted = counted.withColumn("before", F.col("below") + F.sum("n").over(run.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
        next_ = rest.select(*by, "share", "rank", "lo", "hi").join(counted.drop("below"), [*by, "lo", "hi"]).where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n")))
        need = materialised(next_.select(*by, "share", F.col("low").alias("lo"), F.col("high").alias("hi"), "n", "rank", F.col("before").alias("below")))
    ends = ends.select(*by, "n", asked)
    ranks = found.groupBy(*by, "share").agg(F.min(F.struct("rank", "v")).alias("a"), F.max(F.struct("rank", "v")).alias("b"))
    part = F.col("share") * (F.col("n") - 1) - F.col("a.rank")
    out = (ranks.join(ends, [*by, "share"]) if by else ranks.join(ends, "share")).select(*by, "share", (F.col("a.v") + part * (F.col("b.v") - F.col("a.v"))).alias("v"))
    return out


def _within(data: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    """The values of each range of their group; ranges of a group are a few."""
    inside = (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))
    if not by:
        return data.crossJoin(F.broadcast(ranges)).where(inside)
    return data.join(ranges, by).where(inside)
