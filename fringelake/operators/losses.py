"""Noise models, regularisation costs, constraints and optimiser steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def amplitude_terms(offset: float, eps: float) -> Column:
    """Squared amplitude residual of (model, measured) under a mask."""
    return F.col("m") * (F.sqrt(F.greatest("measured", F.lit(0.0)) + offset) - F.sqrt(F.col("model") + offset) - eps) ** 2


def amplitude_loss(pairs: DataFrame, variance: float = 0.0, offset: float = 0.0, eps: float = 1e-3) -> DataFrame:
    return pairs.agg((F.sum(amplitude_terms(offset, eps)) * (2 / (1 + variance))).alias("loss"))


def poisson_loss(pairs: DataFrame, eps: float = 1e-3) -> DataFrame:
    measured = F.greatest("measured", F.lit(0.0))
    return pairs.agg(F.sum(F.col("m") * (F.col("model") + measured * (F.ln(measured + eps) - F.ln(F.col("model") + eps) - 1))).alias("loss"))


def wave_factor(offset: float, eps: float) -> Column:
    """What multiplies the wave in the update of the amplitude model."""
    return (F.sqrt(F.greatest("measured", F.lit(0.0)) + offset) / (F.sqrt(F.col("model") + offset) + eps) - 1) * F.col("m")


def detector_error(pairs: DataFrame) -> DataFrame:
    """Mean over positions of the root of the squared intensity error."""
    each = pairs.groupBy("pos_id").agg(F.sqrt(F.sum((F.col("model") - F.col("measured")) ** 2)).alias("e"))
    return each.agg(F.avg("e").alias("error"))


def rescale_factor(pairs: DataFrame) -> DataFrame:
    each = pairs.groupBy("pos_id").agg(F.try_divide(F.sum(F.col("measured") * F.col("m")), F.sum(F.col("model") * F.col("m"))).alias("f"))
    return each.agg(F.avg("f").alias("factor"))


def clamp_amplitude(re: Column, im: Column, top: float) -> tuple[Column, Column]:
    a = F.sqrt(re * re + im * im)
    f = F.coalesce(F.try_divide(F.least(a, F.lit(top)), a), F.lit(1.0))
    return re * f, im * f


def sgd_step(p: Column, grad: Column, velocity: Column, rate: float, momentum: float, nesterov: bool = False) -> tuple[Column, Column]:
    """(parameter, velocity) after one step."""
    v = momentum * velocity + grad
    return p - rate * (momentum * v + grad if nesterov else v), v


def adam_step(p: Column, grad: Column, m: Column, v: Column, t: int, rate: float, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8) -> tuple[Column, Column, Column]:
    m = b1 * m + (1 - b1) * grad
    v = b2 * v + (1 - b2) * grad * grad
    return p - rate * (m / (1 - b1**t)) / (F.sqrt(v / (1 - b2**t)) + eps), m, v


def polyak_step(p: Column, grad: Column, loss: Column, grad2: Column, least: float, rate: float, most: float) -> Column:
    return p - F.least(F.lit(most), rate * F.try_divide(loss - least, grad2)) * grad


def steepest_position(gy: Column, gx: Column, step: float, most: float) -> tuple[Column, Column]:
    """Update along the gradient, its length capped."""
    length = step * F.sqrt(gy * gy + gx * gx)
    f = step * F.coalesce(F.least(F.lit(1.0), F.try_divide(F.lit(most), length)), F.lit(1.0))
    return gy * f, gx * f


def momentum_position(gy: Column, gx: Column, py: Column, px: Column, step: float, momentum: float, most: float) -> tuple[Column, Column]:
    uy, ux = momentum * py + step * gy, momentum * px + step * gx
    f = F.coalesce(F.least(F.lit(1.0), F.try_divide(F.lit(most), F.sqrt(uy * uy + ux * ux))), F.lit(1.0))
    return uy * f, ux * f


def mean_subtract(updates: DataFrame) -> DataFrame:
    """Update vectors without their mean, which is one broadcast row."""
    m = updates.agg(F.avg("uy").alias("my"), F.avg("ux").alias("mx"))
    return updates.crossJoin(F.broadcast(m)).select("pos_id", (F.col("uy") - F.col("my")).alias("uy"), (F.col("ux") - F.col("mx")).alias("ux"))
