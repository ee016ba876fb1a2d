"""Iterative phase retrieval: ePIE, LSQML and gradient engines over pattern tables.

Patterns stay in a table, one cached frame a group; object and probe are small
arrays of a known size that travel with each step. A step over one group runs as
NumPy kernels on whole Arrow batches of positions and gives one row of partial
sums a partition; these are added in a few tasks first, so the driver gets a few
times the bytes of object and probe, whatever the scan. Groups follow one
another, as the algorithms ask; positions within a group are done in parallel.

LSQML weights each position's update by the step length that is best for it (the
least squares of the wave update along it) and by its illumination. Positions
can be refined after each iteration, by the same least squares along the
probe's derivatives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import penalties
from .waves import backward, fft2, forward, frequencies, ifft2, propagator

#: Largest object plus probe, in bytes, that is sent with a step.
LARGEST_STATE = 256 << 20
#: What a noise model adds to intensities under the root.
OFFSETS = {"amplitude": 0.0, "anscombe": 0.375, "poisson": 0.0}


@dataclass
class State:
    """obj (z, Ny, Nx), probe (modes, ny, nx), steps in Å and one error for each iteration; corner: where the object's first pixel lies, if known."""

    obj: np.ndarray
    probe: np.ndarray
    step: tuple[float, float]
    lam: float
    thickness: list[float] = field(default_factory=list)
    errors: list[float] = field(default_factory=list)
    corner: tuple[float, float] | None = None

    def props(self) -> list[np.ndarray]:
        return [propagator(self.probe.shape[-2:], self.step, self.lam, dz) for dz in self.thickness[: len(self.obj) - 1]]


@dataclass(frozen=True)
class Engine:
    """solver: epie, lsqml, sgd, adam or polyak. noise: amplitude, anscombe or poisson; the first two compare roots with
    `offset` under them (if None, that of OFFSETS), with a Gaussian variance beside that of the counts. presolve: the
    probe is first brought to the measured intensity.
    gamma, illum_reg: damping of step lengths and of little lit pixels. costs: (name, weight) of
    regularisers, for the gradient solvers. constraints: (name, arguments, "group" or "iter").
    momentum, nesterov: of sgd and adam. Positions: none, steepest or momentum, moved by
    position_rate of their step, at most max_move Å."""

    solver: str = "epie"
    iterations: int = 5
    groups: int = 4
    rate: float = 0.5
    probe_rate: float = 0.5
    gamma: float = 1e-4
    illum_reg: float = 1e-2
    offset: float | None = None
    eps: float = 1e-3
    noise: str = "anscombe"
    update_probe: bool = True
    max_amplitude: float | None = None
    costs: tuple[tuple[str, float], ...] = ()
    constraints: tuple[tuple[str, tuple[tuple[str, float], ...], str], ...] = ()
    momentum: float = 0.0
    nesterov: bool = False
    positions: str = "none"
    position_rate: float = 0.5
    position_memory: float = 0.9
    max_move: float = 1.0
    variance: float = 0.0
    presolve: bool = False

    def __post_init__(self) -> None:
        if self.noise not in OFFSETS:
            raise ValueError(f"unknown noise model {self.noise}; known are {', '.join(OFFSETS)}")
        if self.offset is None:
            object.__setattr__(self, "offset", OFFSETS[self.noise])


POSITION = "pos_id long, start_y long, start_x long, sub_y double, sub_x double"


def _numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]


def _patterns(batch: pa.RecordBatch, shape: tuple[int, int]) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("data")).flatten().to_numpy(zero_copy_only=False).reshape(-1, *shape)


def _pieces(batches: Iterator[pa.RecordBatch], state: State) -> Iterator[pa.RecordBatch]:
    """Batches of so many positions that their waves take about 64 MB."""
    each = 16 * (state.probe.size * (len(state.obj) + 2) + len(state.obj) * state.probe[0].size)
    n = max(1, (64 << 20) // each)
    for batch in batches:
        for k in range(0, batch.num_rows, n):
            yield batch.slice(k, n)


class Views:
    """Object windows and shifted probes of a batch of positions."""

    def __init__(self, batch: pa.RecordBatch, state: State):
        self.state = state
        y, x, sub_y, sub_x = _numbers(batch, "start_y", "start_x", "sub_y", "sub_x")
        ny, nx = state.probe.shape[-2:]
        if len(y) and (y.min() < 0 or x.min() < 0 or y.max() + ny > state.obj.shape[1] or x.max() + nx > state.obj.shape[2]):
            raise ValueError("a position's window is off the object; grow the object to the scan first")
        self.rows, self.cols = y[:, None] + np.arange(ny), x[:, None] + np.arange(nx)
        self.obj = np.moveaxis(state.obj[:, self.rows[:, :, None], self.cols[:, None, :]], 1, 0)
        ky, kx = frequencies((ny, nx), state.step)
        self.filter = np.exp(-2j * np.pi * (sub_y[:, None, None] * ky + sub_x[:, None, None] * kx))[:, None]
        self.tilt = None
        if "ty" in batch.schema.names:
            ty, tx = (np.tan(t * 1e-3)[:, None, None] for t in _numbers(batch, "ty", "tx"))
            self.tilt = (ky * ty + kx * tx)[:, None]
        self.probe = self.shift(np.broadcast_to(state.probe, (len(y), *state.probe.shape)), self.filter) if np.any(sub_y) or np.any(sub_x) else np.broadcast_to(state.probe, (len(y), *state.probe.shape))

    def props(self, base: list[np.ndarray]) -> list[np.ndarray]:
        """Propagators of each position: those of no tilt, times the ramp of its own (`ty`, `tx` in mrad, where the table has them)."""
        if self.tilt is None:
            return base
        return [p * np.exp(2j * np.pi * dz * self.tilt) for p, dz in zip(base, self.state.thickness)]

    @staticmethod
    def shift(a: np.ndarray, by: np.ndarray) -> np.ndarray:
        return ifft2(fft2(a) * by)

    def add(self, out: np.ndarray, views: np.ndarray) -> None:
        """Overlap-add of (position, ny, nx) views."""
        np.add.at(out, (self.rows[:, :, None], self.cols[:, None, :]), views)


def simulate(positions: DataFrame, state: State) -> DataFrame:
    """(pos_id, start_y, start_x, sub_y, sub_x, ty and tx if given, data): intensities of the model at each position."""
    props = state.props()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, state):
            v = Views(batch, state)
            model = (np.abs(forward(v.obj, v.probe, v.props(props))[1]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(model.reshape(batch.num_rows, -1)), pa.list_(pa.float64()))], [*batch.schema.names, "data"])

    tilts = [c for c in ("ty", "tx") if c in positions.columns]
    kept = positions.select("pos_id", "start_y", "start_x", "sub_y", "sub_x", *[F.col(c).cast("double") for c in tilts])
    return kept.mapInArrow(run, POSITION + "".join(f", {c} double" for c in tilts) + ", data array<double>")


def fit(model: np.ndarray, measured: np.ndarray, e: Engine) -> tuple[np.ndarray, np.ndarray]:
    """(loss of each position, d loss / d intensity); a pixel measured as NaN is masked and adds nothing."""
    seen = ~np.isnan(measured)
    measured = np.where(seen, np.maximum(measured, 0), model)
    if e.noise == "poisson":
        loss = model + measured * (np.log(measured + e.eps) - np.log(model + e.eps) - 1)
        return (loss * seen).sum(axis=(-2, -1)), (1 - measured / (model + e.eps)) * seen
    root = np.sqrt(model + e.offset)
    diff = (root - np.sqrt(measured + e.offset)) / (1 + e.variance)
    return (diff**2).sum(axis=(-2, -1)) * (1 + e.variance), diff / np.maximum(root, 1e-30)


def wave_update(far: np.ndarray, model: np.ndarray, measured: np.ndarray, e: Engine) -> np.ndarray:
    """What brings the far field to the measured intensity."""
    if e.noise == "poisson":
        return -far * fit(model, measured, e)[1][:, None]
    change = np.sqrt(np.maximum(measured, 0) + e.offset) / (np.sqrt(model + e.offset) + e.eps) - 1
    return far * np.nan_to_num(change)[:, None]  # masked pixels stay as they are


def loss_and_gradient(obj: np.ndarray, probe: np.ndarray, props: list[np.ndarray], measured: np.ndarray, e: Engine) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Loss of each position, its gradients (d/d conj), and the squared intensity error; leading axes are positions."""
    waves, far = forward(obj, probe, props)
    model = (np.abs(far) ** 2).sum(axis=-3)
    loss, slope = fit(model, measured, e)
    d_obj, d_probe = backward(far * slope[..., None, :, :], obj, waves, props)
    return loss, d_obj, d_probe, np.nansum((model - measured) ** 2, axis=(-2, -1))


def _length(wave: np.ndarray, along: np.ndarray, damping: float) -> np.ndarray:
    """For each position, the multiple of `along` nearest to `wave`."""
    axes = tuple(range(1, wave.ndim))
    return (wave * along.conj()).real.sum(axis=axes) / ((np.abs(along) ** 2).sum(axis=axes) + damping)


def lsqml_sums(v: Views, props: list[np.ndarray], measured: np.ndarray, e: Engine, d_obj: np.ndarray, w_obj: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Adds each position's best step, weighted by its illumination; (probe steps, squared errors, wave update at the first slice)."""
    waves, far = forward(v.obj, v.probe, props)
    model = (np.abs(far) ** 2).sum(axis=1)
    chi = ifft2(wave_update(far, model, measured, e))
    for z in range(len(props), -1, -1):
        psi, o = waves[z], v.obj[:, z, None]
        lit = (np.abs(psi) ** 2).sum(axis=1)
        step = (chi * psi.conj()).sum(axis=1)
        v.add(d_obj[z], _length(chi, step[:, None] * psi, e.gamma)[:, None, None] * step * lit)
        v.add(w_obj[z], lit)
        if z:
            chi = ifft2(fft2(chi * o.conj()) * props[z - 1].conj())
    step = chi * v.obj[:, 0, None].conj()
    length = _length(chi, step * v.obj[:, 0, None], e.gamma)[:, None, None, None]
    through = np.abs(np.prod(v.obj, axis=1))[:, None] ** 2
    return v.shift(length * step * through, v.filter.conj()).sum(axis=0), np.nansum((model - measured) ** 2, axis=(-2, -1)), chi


def _partial(state: State, e: Engine) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    props = state.props()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = state.probe.shape[-2:]
        d_obj, d_probe = np.zeros_like(state.obj), np.zeros_like(state.probe)
        w_obj, w_probe = np.zeros(state.obj.shape), np.zeros(shape)
        loss, error, n = 0.0, 0.0, 0
        for batch in _pieces(batches, state):
            v, measured = Views(batch, state), _patterns(batch, shape)
            if e.solver == "lsqml":
                steps, sq, _ = lsqml_sums(v, v.props(props), measured, e, d_obj, w_obj)
                d_probe += steps
            else:
                ls, go, gp, sq = loss_and_gradient(v.obj, v.probe, v.props(props), measured, e)
                for z in range(len(state.obj)):
                    v.add(d_obj[z], go[:, z])
                    v.add(w_obj[z], (np.abs(v.probe) ** 2).sum(axis=1))
                d_probe += v.shift(gp, v.filter.conj()).sum(axis=0)
                loss += float(ls.sum())
            w_probe += (np.abs(np.prod(v.obj, axis=1)) ** 2).sum(axis=0)
            error, n = error + float(np.sqrt(sq).sum()), n + batch.num_rows
        raw = [pa.array([x.tobytes()], pa.binary()) for x in (d_obj, d_probe, w_obj, w_probe)]
        yield pa.RecordBatch.from_arrays([*raw, pa.array([loss]), pa.array([error]), pa.array([n], pa.int64())], ["d_obj", "d_probe", "w_obj", "w_probe", "loss", "error", "n"])

    return run


_SUMS = "d_obj binary, d_probe binary, w_obj binary, w_probe binary, loss double, error double, n long"
#: Rows of partial sums that reach the driver.
LAST = 8


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row with the sums of all rows."""
    total: list | None = None
    for batch in batches:
        for r in batch.to_pylist():
            got = [np.frombuffer(r["d_obj"], complex), np.frombuffer(r["d_probe"], complex), np.frombuffer(r["w_obj"]), np.frombuffer(r["w_probe"]), r["loss"], r["error"], r["n"]]
            total = got if total is None else [a + b for a, b in zip(total, got)]
    if total:
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in total[:4]] + [pa.array([x]) for x in total[4:]], ["d_obj", "d_probe", "w_obj", "w_probe", "loss", "error", "n"])


def step_sums(group: DataFrame, state: State, e: Engine) -> dict[str, np.ndarray | float]:
    """Sums over one group of positions."""
    if state.obj.nbytes + state.probe.nbytes > LARGEST_STATE:
        raise ValueError("object and probe are larger than a step may carry; cut the object into tiles")
    rows = group.mapInArrow(_partial(state, e), _SUMS).repartition(LAST).mapInArrow(_added, _SUMS).collect()
    total: dict[str, np.ndarray | float] = {}
    for r in rows:
        got = {"d_obj": np.frombuffer(r["d_obj"], complex).reshape(state.obj.shape), "d_probe": np.frombuffer(r["d_probe"], complex).reshape(state.probe.shape), "w_obj": np.frombuffer(r["w_obj"]).reshape(state.obj.shape), "w_probe": np.frombuffer(r["w_probe"]).reshape(state.probe.shape[1:]), "loss": r["loss"], "error": r["error"], "n": r["n"]}
        total = {k: total[k] + v for k, v in got.items()} if total else got
    return total


def apply_step(state: State, s: dict[str, np.ndarray | float], e: Engine, moments: dict[str, list[np.ndarray]], t: int) -> None:
    """Update object and probe in place by the solver's rule."""
    if not s or not s["n"]:
        return
    if e.solver == "epie":
        state.obj = state.obj - e.rate * s["d_obj"] / max(s["w_obj"].max(), 1e-30)
        d_probe = e.probe_rate * s["d_probe"] / max(s["w_probe"].max(), 1e-30)
    elif e.solver == "lsqml":
        lit = lambda w: w + e.illum_reg * np.maximum(w.max(axis=(-2, -1), keepdims=True), 1e-30)
        state.obj = state.obj + e.rate * s["d_obj"] / lit(s["w_obj"])
        d_probe = -e.probe_rate * s["d_probe"] / lit(s["w_probe"])
    elif e.solver in ("sgd", "adam", "polyak"):
        costs = [s["loss"] / s["n"]]
        g_obj, g_probe = s["d_obj"] / s["n"], s["d_probe"] / s["n"]
        for name, weight in e.costs:
            if name in penalties.OBJECT_COSTS:
                cost, g = penalties.OBJECT_COSTS[name](state.obj)
                g_obj = g_obj + weight * g
            else:
                cost, g = penalties.PROBE_COSTS[name](state.probe)
                g_probe = g_probe + weight * g
            costs.append(weight * cost)
        out = []
        for name, g, rate in (("obj", g_obj, e.rate), ("probe", g_probe, e.probe_rate)):
            if e.solver == "polyak":  # the step that would bring the cost to zero, at most `rate`
                out.append(min(rate, sum(costs) / max(float((np.abs(g) ** 2).sum()) * 2, 1e-30)) * g)
            elif e.solver == "sgd":
                m = moments.setdefault(name, [np.zeros_like(g)])
                m[0] = e.momentum * m[0] + g
                out.append(rate * (g + e.momentum * m[0] if e.nesterov else m[0]))
            else:
                m, v = moments.setdefault(name, [np.zeros_like(g), np.zeros(g.shape)])
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * np.abs(g) ** 2
                moments[name] = [m, v]
                ahead = 0.9 * m / (1 - 0.9 ** (t + 1)) + 0.1 * g / (1 - 0.9**t) if e.nesterov else m / (1 - 0.9**t)
                out.append(rate * ahead / (np.sqrt(v / (1 - 0.999**t)) + 1e-8))
        state.obj, d_probe = state.obj - out[0], out[1]
    else:
        raise ValueError(f"unknown solver {e.solver}")
    if e.update_probe:
        state.probe = state.probe - d_probe
    if e.max_amplitude:
        penalties.clamp_amplitude(state, e.max_amplitude)
    constrain(state, e, "group")


def constrain(state: State, e: Engine, when: str) -> None:
    for name, arguments, at in e.constraints:
        if at == when:
            penalties.CONSTRAINTS[name](state, **dict(arguments))


def position_steps(patterns: DataFrame, state: State, e: Engine) -> DataFrame:
    """(pos_id, step_y, step_x) in Å: least squares of the wave update along the probe's derivatives."""
    props = state.props()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = state.probe.shape[-2:]
        k = frequencies(shape, state.step)
        for batch in _pieces(batches, state):
            v = Views(batch, state)
            chi = lsqml_sums(v, v.props(props), _patterns(batch, shape), e, np.zeros_like(state.obj), np.zeros(state.obj.shape))[2]
            steps = [_length(chi, v.shift(v.probe, -2j * np.pi * f) * v.obj[:, 0, None], e.gamma) for f in k]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("pos_id")), *map(pa.array, steps)], ["pos_id", "step_y", "step_x"])

    return patterns.mapInArrow(run, "pos_id long, step_y double, step_x double")


def moved(patterns: DataFrame, state: State, e: Engine) -> DataFrame:
    """`patterns` at refined positions: steps have no common part, and no position moves by more than max_move."""
    steps = position_steps(patterns, state, e)
    if "was_y" not in patterns.columns:
        patterns = patterns.withColumns({"was_y": F.lit(0.0), "was_x": F.lit(0.0)})
    both = patterns.join(steps, "pos_id")
    memory = e.position_memory if e.positions == "momentum" else 0.0
    both = both.withColumns({f"was_{a}": memory * F.col(f"was_{a}") + e.position_rate * F.col(f"step_{a}") for a in "yx"}).drop("step_y", "step_x")
    size = F.sqrt(F.col("was_y") ** 2 + F.col("was_x") ** 2)
    both = both.withColumns({f"was_{a}": F.col(f"was_{a}") * F.least(F.lit(1.0), F.try_divide(F.lit(e.max_move), size)) for a in "yx"}).fillna(0.0, ["was_y", "was_x"])
    mean = both.agg(F.avg("was_y").alias("mean_y"), F.avg("was_x").alias("mean_x"))
    both = both.crossJoin(F.broadcast(mean))  # one row
    for axis, (a, d, n) in enumerate(zip("yx", state.step, state.probe.shape[-2:])):
        at = F.col(f"start_{a}") + (F.col(f"sub_{a}") + F.col(f"was_{a}") - F.col(f"mean_{a}")) / d
        start = F.least(F.greatest(F.round(at), F.lit(0)), F.lit(state.obj.shape[1 + axis] - n)).cast("long")
        both = both.withColumn("at", at).withColumn(f"start_{a}", start).withColumn(f"sub_{a}", (F.col("at") - F.col(f"start_{a}")) * d).drop("at")
    return both.drop("mean_y", "mean_x")


def reconstruct(patterns: DataFrame, state: State, e: Engine, observer: Callable[[int, float], None] | None = None) -> State:
    """Runs the engine; `patterns` has (pos_id, start_y, start_x, sub_y, sub_x, data), and tilts (ty, tx) if positions have their own."""
    known = {*penalties.OBJECT_COSTS, *penalties.PROBE_COSTS}
    if bad := [n for n, _ in e.costs if n not in known] + [n for n, _, _ in e.constraints if n not in penalties.CONSTRAINTS]:
        raise ValueError(f"unknown costs or constraints {bad}")
    split = lambda p: [p.where(F.pmod(F.xxhash64("pos_id"), F.lit(e.groups)) == g).persist() for g in range(e.groups)]
    if e.presolve:
        state = presolved(patterns, state, e)
    frames = split(patterns)  # each group is read once and kept by itself
    moments: dict[str, list[np.ndarray]] = {}
    t = 0
    for i in range(e.iterations):
        error, n = 0.0, 0
        for frame in frames:
            t += 1
            s = step_sums(frame, state, e)
            apply_step(state, s, e, moments, t)
            if s:
                error, n = error + s["error"], n + s["n"]
        constrain(state, e, "iter")
        state.errors.append(error / max(1, n))
        if e.positions != "none" and i + 1 < e.iterations:
            whole = frames[0]
            for frame in frames[1:]:
                whole = whole.unionByName(frame)
            later = split(moved(whole, state, e))
            for frame in later:
                frame.count()
            for frame in frames:
                frame.unpersist()
            frames = later
        if observer:
            observer(i + 1, state.errors[-1])
    for frame in frames:
        frame.unpersist()
    return state


def rescaled(patterns: DataFrame, state: State, e: Engine) -> float:
    """Mean over positions of measured over modelled intensity, before an engine starts.

    A pixel measured as NaN is left out of both; positions that the model leaves dark have no say. Each position's sums
    are made where its pattern is: no exchange but that of the mean's partial sums.
    """
    props = state.props()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = state.probe.shape[-2:]
        for batch in _pieces(batches, state):
            v, measured = Views(batch, state), _patterns(batch, shape)
            model = (np.abs(forward(v.obj, v.probe, v.props(props))[1]) ** 2).sum(axis=1)
            sums = [np.where(np.isnan(measured), 0, x).sum(axis=(1, 2)) for x in (measured, model)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in sums], ["e", "m"])

    return patterns.mapInArrow(run, "e double, m double").agg(F.avg(F.try_divide("e", "m")).alias("f")).first()["f"]


def presolved(patterns: DataFrame, state: State, e: Engine) -> State:
    """The state with its probe brought to the measured intensity; a factor that is no positive number is an error."""
    factor = rescaled(patterns, state, e)
    if factor is None or not np.isfinite(factor) or factor <= 0:
        raise ValueError(f"measured over modelled intensity is {factor}: patterns or probe are empty")
    state.probe = state.probe * np.sqrt(factor)
    return state


def transformed(patterns: DataFrame, ny: int, nx: int, inverse: bool = False) -> DataFrame:
    """(pos_id, re, im) of the 2-D transform of packed (pos_id, re, im) arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, ny, nx)
            out = (ifft2 if inverse else fft2)(get("re") + 1j * get("im")).reshape(-1, ny * nx)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(out.real), pa.list_(pa.float64())), pa.array(list(out.imag), pa.list_(pa.float64()))], ["pos_id", "re", "im"])

    return patterns.select("pos_id", "re", "im").mapInArrow(run, "pos_id long, re array<double>, im array<double>")
