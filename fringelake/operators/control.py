"""Flags, schedules, groups, and folds over job and log events."""

from __future__ import annotations

import ast
import math

from pyspark.sql import Column, DataFrame, Window, functions as F


def flag(i: Column, after: int = 0, every: int = 1, before: int | None = None) -> Column:
    on = (i > after) & ((i - after) % every == 0)
    return on if before is None else on & (i < before)


def any_true(spec: bool | dict, niter: int) -> bool:
    """Could the flag be true in an engine of niter iterations?"""
    if isinstance(spec, bool):
        return spec
    after, every, before = spec.get("after", 0), spec.get("every", 1), spec.get("before")
    return after + every <= min(niter, before - 1 if before is not None else niter)


def piecewise(iterations: DataFrame, steps: DataFrame) -> DataFrame:
    """(i, value) of the greatest start at or before i; a schedule has few steps."""
    return iterations.join(F.broadcast(steps), F.col("start") <= F.col("i")).groupBy("i").agg(F.max_by("value", "start").alias("value"))


_CALLS = {"exp", "log", "sqrt", "abs", "sin", "cos", "tan", "pow", "floor", "ceil", "least", "greatest"}
_NODES = (ast.Expression, ast.BinOp, ast.UnaryOp, ast.Call, ast.Name, ast.Load, ast.Constant, ast.Add, ast.Sub, ast.Mult, ast.Div, ast.Pow, ast.Mod, ast.USub, ast.UAdd)


def expression(iterations: DataFrame, text: str, niter: int) -> DataFrame:
    """(i, value) of an arithmetic expression of i and niter. Only numbers, these names and plain functions are let in; nothing is evaluated in Python."""
    for node in ast.walk(ast.parse(text, mode="eval")):
        if not isinstance(node, _NODES):
            raise ValueError(f"not allowed in a schedule: {type(node).__name__}")
        if isinstance(node, ast.Constant) and not isinstance(node.value, (int, float)):
            raise ValueError("only numbers are allowed in a schedule")
        if isinstance(node, ast.Call) and not (isinstance(node.func, ast.Name) and node.func.id in _CALLS and not node.keywords):
            raise ValueError("unknown function in a schedule")
        if isinstance(node, ast.Name) and node.id not in _CALLS | {"i", "niter"}:
            raise ValueError(f"unknown name in a schedule: {node.id}")
    return iterations.withColumn("niter", F.lit(float(niter))).select("i", F.expr(text.replace("**", "^") if "**" not in text else _powers(text)).cast("double").alias("value"))


def _powers(text: str) -> str:
    """`a ** b` as pow(a, b)."""

    class Rewrite(ast.NodeTransformer):
        def visit_BinOp(self, node: ast.BinOp) -> ast.AST:
            self.generic_visit(node)
            return ast.Call(ast.Name("pow", ast.Load()), [node.left, node.right], []) if isinstance(node.op, ast.Pow) else node

    return ast.unparse(Rewrite().visit(ast.parse(text, mode="eval")))


def even_groups(positions: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """(pos_id, grp from 1): groups whose sizes differ by one at most, larger ones first.

    Positions are put in order (of a seeded hash, if there is a seed) by a range
    exchange; ranks come from the partitions' sizes, so no task sees all rows.
    """
    key = F.xxhash64("pos_id", F.lit(seed)) if seed is not None else F.col("pos_id")
    ordered = positions.select("pos_id", key.alias("key")).repartitionByRange("key", "pos_id").withColumn("part", F.spark_partition_id())
    ordered = ordered.persist()
    sizes = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    total = sizes.agg(F.sum("size").alias("total"))
    before = sizes.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # one row a partition
    rank = F.row_number().over(Window.partitionBy("part").orderBy("key", "pos_id")) - 1
    ranked = ordered.withColumn("rank", rank).join(F.broadcast(before), "part").crossJoin(F.broadcast(total)).withColumn("i", F.col("rank") + F.col("before"))
    size, extra = F.floor(F.col("total") / n), F.pmod(F.col("total"), F.lit(n))
    large = extra * (size + 1)
    grp = F.when(F.col("i") < large, F.floor(F.col("i") / (size + 1))).otherwise(extra + F.floor(F.try_divide(F.col("i") - large, size)))
    return ranked.select("pos_id", (grp + 1).cast("long").alias("grp"))


def group_sizes(groups: DataFrame) -> DataFrame:
    return groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))


def fraction_mask(groups: DataFrame, n: int, fraction: float) -> DataFrame:
    """(group_id, used): every so many-th group, at least one."""
    every = n // max(1, math.ceil(n * fraction))
    return groups.select("group_id", (F.col("group_id") % every == 0).alias("used"))


def duplicates(table: DataFrame, key: str, of: str) -> DataFrame:
    return table.groupBy(key).agg(F.countDistinct(of).alias("n")).where("n > 1")


def last_status(events: DataFrame, key: str) -> DataFrame:
    """The newest status of each key, as a fold that combines on the map side."""
    newest = F.max_by(F.struct("status", "event_id"), F.struct("ts", "event_id")).alias("m")
    return events.groupBy(key).agg(newest).select(key, "m.status", "m.event_id")


def numbered(events: DataFrame, key: str) -> DataFrame:
    return events.withColumn("i", (F.row_number().over(Window.partitionBy(key).orderBy("ts", "event_id")) - 1).cast("long"))


def page(log: DataFrame, before: int, limit: int = 100) -> DataFrame:
    first = max(0, before - min(limit, 100))
    return log.where((F.col("i") >= first) & (F.col("i") < before))


def throttled(events: DataFrame, key: str, seconds: float) -> DataFrame:
    """Updates more than so many seconds after the one before."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = events.withColumn("gap", at - F.lag(at).over(w))
    return gap.where(F.col("gap").isNull() | (F.col("gap") > seconds * 1e6)).drop("gap")


def extract_vars(state: DataFrame, paths: dict[str, str], key: list[str]) -> DataFrame:
    return state.select(*key, *[F.col(path).alias(name) for name, path in paths.items()])
