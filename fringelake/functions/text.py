"""String helpers: names, versions, durations, base64."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def parse_set(s: Column) -> Column:
    """A comma-separated list as distinct trimmed names."""
    return F.array_distinct(F.transform(F.split(s, ","), lambda x: F.trim(x)))


def filename_dims(name: Column) -> list[Column]:
    pattern = r"x(\d+)_y(\d+)"
    return [F.regexp_extract(name, pattern, 1).try_cast("long").alias("nx"), F.regexp_extract(name, pattern, 2).try_cast("long").alias("ny")]


def version(v: Column) -> Column:
    return F.transform(F.split(v, "\\."), lambda x: x.cast("int"))


def version_between(v: Column, low: str, high: str) -> Column:
    return (version(v) >= version(F.lit(low))) & (version(v) <= version(F.lit(high)))


def hhmmss(seconds: Column) -> Column:
    minutes = F.floor(seconds / 60)
    return F.format_string("%02d:%02d:%06.3f", F.floor(seconds / 3600), F.pmod(minutes, F.lit(60)), seconds - 60 * minutes)


def base64_url(s: Column) -> Column:
    return F.translate(F.base64(s.cast("binary")), "+/", "-_")


def from_base64_url(s: Column) -> Column:
    return F.unbase64(F.translate(s, "-_", "+/")).cast("string")


def output_name(kind: str, iteration: Column, ext: str) -> Column:
    return F.concat(F.lit(f"{kind}_iter"), F.lpad(iteration.cast("string"), F.greatest(F.lit(4), F.length(iteration.cast("string"))), F.lit("0")), F.lit(f".{ext}"))
