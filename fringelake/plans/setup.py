"""From a plan and measured patterns to positions, probe and object, and through the engines.

What a plan gives comes first, then an earlier state, then what the data say; a
part that none of them gives is an error. The hooks that may change patterns
(`post_load`) or patterns and positions (`post_init`) run in the plan's order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import engines, grids, optics, preprocess, waves
from ..sources import frames, metadata, tilts
from .output import OutputRun, formatted
from .plan import Plan, PlanError
from .prepare import padded
from .registry import Registry

RAW = Registry("raw_data")
TILTS = Registry("tilt")
SCANS = Registry("scan")
PROBES = Registry("probe")
OBJECTS = Registry("object")
#: Fixed value: file_type of simulated data's metadata.
SIMULATED = "pyMultislicer_metadata"


@dataclass(frozen=True)
class Experiment:
    """px: (pos_id, iy, ix, ky, kx, v), corner origin; its scan shape; pattern shape, steps in Å and wavelength; what the
    source says about the scan (step in Å, affine correction) and the probe, if it does; width of the detector's
    edge, in pixels, that is masked."""

    px: DataFrame
    scan_shape: tuple[int, int]
    shape: tuple[int, int]
    step: tuple[float, float]
    lam: float
    scan_step: tuple[float, float] | None = None
    conv_angle: float | None = None
    defocus: float = 0.0
    scan_affine: tuple[tuple[float, float], tuple[float, float]] | None = None
    edge: int = 0


@dataclass(frozen=True)
class Detector:
    """A file or folder of frames, or the metadata (.json) that names one. What is given here comes before the metadata."""

    path: str
    kv: float | None = None
    diff_step: float | None = None
    adu: float | None = None
    edge: int = 2


@dataclass(frozen=True)
class GlobalTilt:
    tilt: tuple[float, float]


@dataclass(frozen=True)
class CustomTilt:
    path: str


@RAW.add("detector", Detector)
def _detector(spark: SparkSession, props: Detector) -> Experiment:
    """Frames of a detector with everything that its metadata say: beam, sampling, scan and probe.

    Measured frames (not simulated ones) are divided by the counts of an electron (`adu`), if these are known.
    """
    path, kv, diff_step, adu = props.path, props.kv, props.diff_step, props.adu
    meta, shape = None, None
    if path.lower().endswith(".json"):
        found = metadata.read_metadata(spark, path).take(2)
        if len(found) != 1:
            raise PlanError(f"raw_data: {path} holds {len(found) and 'several' or 'no'} records of metadata")
        meta = found[0]
        if not meta["raw_filename"]:
            raise PlanError(f"raw_data: {path} names no raw file")
        if meta["scan_shape"] is None or len(meta["scan_shape"]) != 2:
            raise PlanError(f"raw_data: {path} gives no scan_shape of two numbers")
        path = meta["folder"] + meta["raw_filename"]
        kv = kv if kv is not None else meta["voltage"] and meta["voltage"] / 1e3
        diff_step = diff_step if diff_step is not None else meta["diff_step"]
        shape = (meta["scan_shape"][1], meta["scan_shape"][0])  # metadata have x before y
        measured = meta["file_type"] != SIMULATED
        adu = (adu if adu is not None else meta["adu"]) if measured else None
    if absent := [n for n, v in (("kv", kv), ("diff_step", diff_step)) if not v]:
        raise PlanError("\n".join(f"raw_data: {n} is neither given nor in the metadata" for n in absent))
    read = frames.read_frames(spark, path, shape)
    shape = shape or frames.shape_from_name(path)
    if shape is None:
        size = read.agg(F.max("iy"), F.max("ix")).first()
        shape = (size[0] + 1, size[1] + 1) if size[0] is not None else (0, 0)
    v, k = F.col("v").cast("double"), F.col("k")
    px = read.select("pos_id", "iy", "ix", F.posexplode("data").alias("k", "v")).select(
        "pos_id", "iy", "ix", F.floor(k / frames.COLUMNS).alias("ky"), F.pmod(k, F.lit(frames.COLUMNS)).cast("long").alias("kx"), (v / adu if adu else v).alias("v")
    )
    px = preprocess.shift_index(px, {"ky": frames.ROWS, "kx": frames.COLUMNS}, inverse=True)
    lam = optics.wavelength(kv * 1e3)
    extent = lam / (diff_step * 1e-3)
    x = Experiment(px, shape, (frames.ROWS, frames.COLUMNS), (extent / frames.ROWS, extent / frames.COLUMNS), lam, edge=props.edge)
    if meta is None:
        return x
    step = meta["scan_step"] and tuple(s * 1e10 for s in reversed(meta["scan_step"]))
    affine = meta["scan_correction"] and tuple(tuple(reversed(row)) for row in reversed(meta["scan_correction"]))
    return replace(x, scan_step=step, conv_angle=meta["conv_angle"], defocus=(meta["defocus"] or 0.0) * 1e10, scan_affine=affine)


@TILTS.add("global", GlobalTilt)
def _global_tilt(x: Experiment, props: GlobalTilt) -> DataFrame:
    ty, tx = map(float, props.tilt)
    return x.px.sparkSession.range(x.scan_shape[0] * x.scan_shape[1]).select(F.col("id").alias("pos_id"), F.lit(ty).alias("ty"), F.lit(tx).alias("tx"))


@TILTS.add("custom", CustomTilt)
def _custom_tilt(x: Experiment, props: CustomTilt) -> DataFrame:
    return tilts.read_tilts(x.px.sparkSession, props.path, x.scan_shape)


@dataclass(frozen=True)
class Raster:
    step: tuple[float, float] | None = None
    rotation: float = 0.0
    affine: tuple[tuple[float, float], tuple[float, float]] | None = None


@dataclass(frozen=True)
class Focused:
    conv_angle: float | None = None
    defocus: float | None = None
    modes: int = 1
    base_power: float = 0.7


@dataclass(frozen=True)
class Random:
    sigma: float = 1e-6


@SCANS.add("raster", Raster)
def _raster(x: Experiment, props: Raster) -> DataFrame:
    step = props.step or x.scan_step
    if step is None:
        raise PlanError("scan raster: no step in plan or data")
    return grids.raster_scan(x.px.sparkSession, *x.scan_shape, tuple(step), props.rotation, props.affine or x.scan_affine)


@PROBES.add("focused", Focused)
def _focused(x: Experiment, props: Focused) -> np.ndarray:
    angle = props.conv_angle if props.conv_angle is not None else x.conv_angle
    if angle is None:
        raise PlanError("probe focused: no conv_angle in plan or data")
    probe = waves.focused_probe(x.shape, x.step, x.lam, angle, x.defocus if props.defocus is None else props.defocus)
    return waves.hermite_modes(probe, props.modes, props.base_power) if props.modes > 1 else probe[None]


@OBJECTS.add("random", Random)
def _random(shape: tuple[int, int, int], seed: object, props: Random) -> np.ndarray:
    return np.exp(1j * waves.seeded(seed, "object").normal(0.0, props.sigma, shape))


def packed(px: DataFrame) -> DataFrame:
    """(pos_id, data): a pattern's pixels in order."""
    pixels = F.sort_array(F.collect_list(F.struct("ky", "kx", "v")))  # as many as a pattern has
    return px.groupBy("pos_id").agg(F.transform(pixels, lambda s: s["v"].cast("double")).alias("data"))


def _within_edge(x: Experiment) -> Column:
    inside = F.lit(True)
    for axis, n in zip(("ky", "kx"), x.shape):
        inside &= F.pmod(F.col(axis) + n // 2, F.lit(n)).between(x.edge, n - 1 - x.edge)
    return inside


def initialise(plan: Plan, x: Experiment, before: engines.State | None = None) -> tuple[DataFrame, engines.State]:
    """(patterns at their windows, state) as the engines take them."""
    px = x.px.withColumn("v", F.col("v").cast("float" if plan.dtype == "float32" else "double"))
    shape = x.scan_shape
    for hook in plan.post_load:
        px = hook(px, shape)
        size = px.agg(F.max("iy"), F.max("ix")).first()
        if size[0] is None:
            raise PlanError(f"{hook.name} leaves no pattern")
        shape = (size[0] + 1, size[1] + 1)
    x = replace(x, px=px, scan_shape=shape)
    scan = SCANS.parse(plan.scan or "raster")(x).select("pos_id", "y", "x")
    counts = preprocess.count_check(px, scan).first()
    if not counts["agrees"]:
        raise PlanError(f"{counts['positions']} patterns at {counts['expected']} positions")
    tilt = TILTS.parse(plan.tilt)(x) if plan.tilt else None
    mask = grids.index_grid(px.sparkSession, *x.shape, "ky", "kx").select("ky", "kx", _within_edge(x).cast("double").alias("m"))
    for hook in plan.post_init:
        px, scan, mask = hook(px, scan, mask, x.shape)
    if x.edge or plan.post_init:  # engines take NaN as masked; so is what comes in part from masked pixels
        whole = F.col("m") > 1 - 1e-6
        px = px.join(F.broadcast(mask), ["ky", "kx"]).withColumn("v", F.when(whole, F.col("v")).otherwise(float("nan"))).drop("m")
    probe = PROBES.parse(plan.probe or "focused")(x) if plan.probe or before is None else before.probe
    if probe.shape[-2:] != tuple(x.shape):
        raise PlanError(f"the earlier probe has {probe.shape[-2:]} pixels, the patterns {x.shape}")
    pad = tuple(n * s / 2 + 2 * s for n, s in zip(x.shape, x.step))
    g = grids.object_grid_from_scan(scan, x.step, max(pad)).first()
    size, corner = (g["ny"], g["nx"]), (g["corner_y"], g["corner_x"])
    slices = list(plan.slices) or [0.0]
    if plan.object or before is None:
        obj = OBJECTS.parse(plan.object or "random")((len(slices), *size), plan.seed)
    else:
        obj = before.obj
        if not np.allclose(before.step, x.step):
            raise PlanError(f"the earlier object has pixels of {before.step} Å, the patterns {x.step}")
        if before.corner is not None:  # it grows by whole pixels where the scan goes beyond it
            low = tuple(max(0, int(np.ceil((b - c) / s - 1e-6))) for b, c, s in zip(before.corner, corner, x.step))
            start = tuple(b - n * s for b, n, s in zip(before.corner, low, x.step))
            high = tuple(max(0, int(np.ceil((c - b) / s - 1e-6)) + n - m - k) for b, c, s, n, m, k in zip(start, corner, x.step, size, obj.shape[1:], low))
            obj, corner = padded(obj, low, high), start
        elif obj.shape[1:] != size:
            raise PlanError(f"the earlier object has {obj.shape[1:]} pixels and no corner, the scan needs {size}")
    starts = grids.cutout_index(scan, corner, x.step, x.shape)
    patterns = packed(px).join(starts, "pos_id").select("pos_id", "start_y", "start_x", "sub_y", "sub_x", "data")
    if tilt is not None:
        absent = F.raise_error(F.concat(F.lit("no tilt of position "), F.col("pos_id"))).cast("double")
        patterns = patterns.join(tilt, "pos_id", "left").withColumns({c: F.coalesce(c, absent) for c in ("ty", "tx")})
    state = engines.State(obj, probe, x.step, x.lam, slices, corner=corner)
    intensity = patterns.select(F.aggregate("data", F.lit(0.0), lambda a, v: a + F.nanvl(v, F.lit(0.0))).alias("i")).agg(F.avg("i")).first()[0]
    state.probe = state.probe * np.sqrt(max(intensity, 0.0) / max(float((np.abs(state.probe) ** 2).sum()), 1e-300))
    return patterns, state


def load(spark: SparkSession, plan: Plan) -> Experiment:
    """What the plan's raw data say."""
    if not plan.raw_data:
        raise PlanError("plan: no raw_data")
    return RAW.parse(plan.raw_data)(spark)


def run(plan: Plan, x: Experiment | None = None, before: engines.State | None = None, observer: Callable[[int, float], None] | None = None, spark: SparkSession | None = None) -> engines.State:
    """The whole plan: patterns and state are made ready, then its engines follow one another, and what it saves is written.

    Without `x` the plan's raw data are read, and `spark` is needed."""
    if x is None:
        if spark is None:
            raise PlanError("a session is needed to read the plan's raw data")
        x = load(spark, plan)
    if plan.save is None:
        return _run(plan, x, before, lambda i, e, s: observer(i, e) if observer else None)
    total = 0

    def watch(i: int, error: float, state: engines.State) -> None:
        nonlocal total
        total += 1
        if plan.save.every and total % plan.save.every == 0:
            out.state(formatted("state_name", plan.save.state_name, iter=total), state, total)
        if observer:
            observer(i, error)

    with OutputRun(x.px.sparkSession, formatted("out_dir", plan.save.out_dir, name=plan.name)) as out:
        done = _run(plan, x, before, watch)
        if not (plan.save.every and total and total % plan.save.every == 0):
            out.state(formatted("state_name", plan.save.state_name, iter=total), done, total)
    return done


def _run(plan: Plan, x: Experiment, before: engines.State | None, watch: Callable[[int, float, engines.State], None]) -> engines.State:
    from .plan import execute

    patterns, state = initialise(plan, x, before)
    patterns = patterns.persist()
    try:
        return execute(plan, patterns, state, watch=watch)
    finally:
        patterns.unpersist()
