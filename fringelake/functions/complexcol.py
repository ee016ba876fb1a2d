"""Complex numbers as (re, im) pairs of columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

Pair = tuple[Column, Column]


def c_mul(a: Pair, b: Pair) -> Pair:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def c_abs2(a: Pair) -> Column:
    return a[0] * a[0] + a[1] * a[1]


def c_abs(a: Pair) -> Column:
    return F.sqrt(c_abs2(a))


def c_arg(a: Pair) -> Column:
    return F.atan2(a[1], a[0])


def c_exp_i(phase: Column) -> Pair:
    return F.cos(phase), F.sin(phase)
