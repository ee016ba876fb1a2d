"""Patterns and state made ready for an engine of another shape, with other modes or other slices.

Object and probe are arrays of a bounded size (`engines.LARGEST_STATE`); patterns are resampled batch by batch where they
lie, and positions by arithmetic on their own row, so nothing is exchanged but one row of extreme positions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators import engines, images, waves
from .registry import PlanError

METHODS = ("pad_crop", "resample")


@dataclass(frozen=True)
class Preparation:
    """sim_shape: pixels of probe and patterns, if not as they are; pad_crop keeps the window's extent (and the patterns'
    sampling), resample keeps the probe's pixel size (and the patterns' extent). obj_pad_px: pixels that the object goes on
    beyond the outermost windows. probe_modes, slices: as they are, if None."""

    sim_shape: tuple[int, int] | None = None
    resize_method: str = "pad_crop"
    obj_pad_px: float | None = None
    probe_modes: int | None = None
    base_mode_power: float = 0.7
    slices: tuple[float, ...] | None = None

    def checked(self) -> Preparation:
        if self.resize_method not in METHODS:
            raise PlanError(f"resize_method {self.resize_method}: known are {', '.join(METHODS)}")
        if self.sim_shape is not None and (len(self.sim_shape) != 2 or min(self.sim_shape) < 1):
            raise PlanError(f"sim_shape {self.sim_shape}: two numbers of pixels are needed")
        if self.probe_modes is not None and self.probe_modes < 1:
            raise PlanError(f"probe_modes {self.probe_modes}: at least one is needed")
        return self


def linear(n: int, m: int, ratio: float, offset: float) -> np.ndarray:
    """(m, n) weights: output o reads input at ratio * o + offset, linear between pixels, nothing outside."""
    at = ratio * np.arange(m) + offset
    return np.maximum(0.0, 1 - np.abs(at[:, None] - np.arange(n)))


def resized(patterns: DataFrame, old: tuple[int, int], new: tuple[int, int], ratio: tuple[float, float]) -> DataFrame:
    """`patterns` with its packed `data` (zero frequency first) at another shape.

    Output pixels are `ratio` input pixels apart; the zero frequency stays in place. What lies outside the detector, in part
    or wholly, or comes from a masked (NaN) pixel, is NaN.
    """
    y, x = (linear(n, m, r, n // 2 - r * (m // 2)) for n, m, r in zip(old, new, ratio))
    outside = (y.sum(axis=1) < 1 - 1e-9)[:, None] | (x.sum(axis=1) < 1 - 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index("data")
            a = np.fft.fftshift(batch.column(k).flatten().to_numpy(zero_copy_only=False).reshape(-1, *old), axes=(1, 2))
            lost = np.isnan(a)
            out = y @ np.where(lost, 0.0, a) @ x.T
            out[(y @ lost @ x.T > 1e-9) | outside] = np.nan
            rows = pa.array(list(np.fft.ifftshift(out, axes=(1, 2)).reshape(len(a), -1)), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([rows if i == k else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return patterns.mapInArrow(run, patterns.schema)


def replaced(patterns: DataFrame, before: tuple, after: tuple) -> DataFrame:
    """Windows of another shape or step about the same places; `before` and `after` are (shape, step), and `after` ends with
    the pixels that the object's corner has moved by."""
    (n0, d0), (n1, d1, moved) = before, after
    out = {}
    for k, a in enumerate("yx"):
        at = (F.col(f"start_{a}") + (n0[k] - 1) / 2) * d0[k] + F.col(f"sub_{a}")  # in Å from the object's corner
        u = at / d1[k] + moved[k] - (n1[k] - 1) / 2
        out |= {f"start_{a}": F.rint(u).cast("long"), f"sub_{a}": (u - F.rint(u)) * d1[k]}
    return patterns.withColumns(out)


def padded(obj: np.ndarray, low: tuple[int, int], high: tuple[int, int]) -> np.ndarray:
    """The object with vacuum around it."""
    return np.pad(obj, ((0, 0), (low[0], high[0]), (low[1], high[1])), constant_values=1.0)


def resliced(obj: np.ndarray, old: list[float], new: list[float]) -> np.ndarray:
    """The object at other thicknesses, its projected potential conserved."""
    log = np.log(np.maximum(np.abs(obj), 1e-300)) + 1j * np.angle(obj)
    out = np.zeros((max(1, len(new)), *obj.shape[1:]), complex)
    for to, source, weight in images.reslicing(old, new):
        out[to] += weight * log[source]
    return np.exp(out)


def prepare(patterns: DataFrame, state: engines.State, p: Preparation) -> tuple[DataFrame, engines.State]:
    """Patterns and state as the engine wants them; the state given stays as it is where nothing changes."""
    p.checked()
    if p == Preparation(resize_method=p.resize_method, base_mode_power=p.base_mode_power):
        return patterns, state
    s = replace(state)
    old, step = s.probe.shape[-2:], tuple(s.step)
    new = tuple(map(int, p.sim_shape or old))
    if new != old:
        keep = p.resize_method == "pad_crop"
        s.step = tuple(d * n / m for d, n, m in zip(step, old, new)) if keep else step
        ratio = (1.0, 1.0) if keep else tuple(n / m for n, m in zip(old, new))
        patterns = resized(patterns, old, new, ratio)
        ways = [linear(n, m, b / a, ((n - 1) - b / a * (m - 1)) / 2) for n, m, a, b in zip(old, new, step, s.step)]
        s.probe = ways[0] @ s.probe @ ways[1].T
    if s.step != step:  # the object's pixels are the probe's
        sizes = [math.ceil((n - 1) * a / b - 1e-9) + 1 for n, a, b in zip(s.obj.shape[1:], step, s.step)]
        ways = [linear(n, m, b / a, 0.0) for n, m, a, b in zip(s.obj.shape[1:], sizes, step, s.step)]
        s.obj = 1 + ways[0] @ (s.obj - 1) @ ways[1].T
    low, high = (0, 0), (0, 0)
    if p.obj_pad_px is not None or new != old:
        middle = [(F.col(f"start_{a}") + (n - 1) / 2) * d + F.col(f"sub_{a}") for a, n, d in zip("yx", old, step)]
        ends = patterns.agg(*[f(c / d) for c, d in zip(middle, s.step) for f in (F.min, F.max)]).first()
        if ends[0] is None:
            raise PlanError("no patterns")
        reach = [n / 2 + (p.obj_pad_px or 0.0) for n in new]
        low = tuple(max(0, math.ceil(reach[k] - ends[2 * k] - 1e-9)) for k in (0, 1))
        high = tuple(max(0, math.ceil(ends[2 * k + 1] + reach[k] - (s.obj.shape[1 + k] - 1) - 1e-9)) for k in (0, 1))
        s.obj = padded(s.obj, low, high)
        patterns = replaced(patterns, (old, step), (new, s.step, low))
        if s.corner is not None:
            s.corner = tuple(c - n * d for c, n, d in zip(s.corner, low, s.step))
    if s.obj.nbytes + s.probe.nbytes > engines.LARGEST_STATE:
        raise PlanError("object and probe would be larger than a step may carry")
    if p.probe_modes is not None and p.probe_modes != len(s.probe):
        s.probe = s.probe[: p.probe_modes] if p.probe_modes < len(s.probe) else waves.hermite_modes(s.probe.sum(axis=0), p.probe_modes, p.base_mode_power)
    if p.slices is not None and (len(p.slices) != len(s.thickness) or not np.allclose(p.slices, s.thickness)):
        if len(p.slices) > 1 or len(s.obj) > 1:
            s.obj = resliced(s.obj, list(s.thickness) or [0.0], list(p.slices))
        s.thickness = list(p.slices) or [0.0]
    return patterns, s
