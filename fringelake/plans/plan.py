"""Reconstruction plans: parsing and running."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, functions as F

from ..operators import align, engines, preprocess
from .output import Save, formatted
from .prepare import Preparation, prepare
from .registry import PlanError, Registry, record

POST_LOAD = Registry("post_load")
POST_INIT = Registry("post_init")
ENGINES = Registry("engine")
NOISE = Registry("noise_model")


@dataclass(frozen=True)
class Crop:
    y: tuple[int | None, int | None] = (None, None)
    x: tuple[int | None, int | None] = (None, None)


@dataclass(frozen=True)
class Scale:
    scale: float


@dataclass(frozen=True)
class Poisson:
    scale: float = 1.0
    gaussian: float = 1e-3
    seed: int = 0


@dataclass(frozen=True)
class DropNans:
    threshold: float = 0.9


@dataclass(frozen=True)
class Align:
    pass


@dataclass(frozen=True)
class Amplitude:
    gaussian_variance: float = 0.1
    eps: float = 1e-3
    offset: float = engines.OFFSETS["amplitude"]


@dataclass(frozen=True)
class Anscombe:
    gaussian_variance: float = 0.1
    eps: float = 1e-3
    offset: float = engines.OFFSETS["anscombe"]


@dataclass(frozen=True)
class Counts:
    eps: float = 1e-3


@NOISE.add("amplitude", Amplitude)
def _amplitude(e: engines.Engine, props: Amplitude) -> engines.Engine:
    return replace(e, noise="amplitude", offset=props.offset, eps=props.eps, variance=props.gaussian_variance)


@NOISE.add("anscombe", Anscombe)
def _anscombe(e: engines.Engine, props: Anscombe) -> engines.Engine:
    return replace(e, noise="anscombe", offset=props.offset, eps=props.eps, variance=props.gaussian_variance)


@NOISE.add("poisson", Counts)
def _counts(e: engines.Engine, props: Counts) -> engines.Engine:
    return replace(e, noise="poisson", offset=engines.OFFSETS["poisson"], eps=props.eps)


@POST_LOAD.add("crop_data", Crop)
def _crop(px: DataFrame, shape: tuple[int, int], props: Crop) -> DataFrame:
    return preprocess.crop_scan(px, slice(*props.y), slice(*props.x), *shape)


@POST_LOAD.add("scale", Scale)
def _scale(px: DataFrame, shape: tuple[int, int], props: Scale) -> DataFrame:
    return preprocess.scale_patterns(px, props.scale)


@POST_LOAD.add("poisson", Poisson)
def _poisson(px: DataFrame, shape: tuple[int, int], props: Poisson) -> DataFrame:
    return preprocess.poisson_noise(px, props.scale, props.seed, props.gaussian)


@POST_INIT.add("drop_nans", DropNans)
def _drop(px: DataFrame, scan: DataFrame, mask: DataFrame, shape: tuple[int, int], props: DropNans) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Positions with more than the threshold of their pixels NaN go, from patterns and scan."""
    good = preprocess.drop_sparse(px, "isnan(v)", props.threshold)
    return px.join(good, "pos_id", "left_semi"), scan.join(good, "pos_id", "left_semi"), mask


@POST_INIT.add("diffraction_align", Align)
def _align(px: DataFrame, scan: DataFrame, mask: DataFrame, shape: tuple[int, int], props: Align) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mean pattern's centre comes to the middle; patterns and mask are shifted alike."""
    by = align.centre(px, mask, shape, corner=True).first()  # one row
    if by["dy"] is None:
        raise PlanError("diffraction_align: the mean pattern is empty")
    return align.shifted(px, (by["dy"], by["dx"]), shape, ["pos_id", "iy", "ix"], corner=True), scan, align.shifted(mask, (by["dy"], by["dx"]), shape, [], corner=True, value="m")


Named = list[dict[str, Any]]


def _constraints(group: Named, every: Named) -> tuple:
    """Constraints of each group, and of each iteration, as an engine takes them."""
    plain = lambda c: tuple(sorted((k, float(v)) for k, v in c.items() if k != "type"))
    return tuple((c["type"], plain(c), when) for when, some in (("group", group), ("iter", every)) for c in some)


def _preparation(props: Any) -> Preparation | None:
    """What the engine asks for; an engine from elsewhere asks for nothing."""
    if not isinstance(props, (Conventional, Gradient)):
        return None
    sequence = lambda v: None if v is None else tuple(v)
    return Preparation(sequence(props.sim_shape), props.resize_method, props.obj_pad_px, props.probe_modes, props.base_mode_power, sequence(props.slices))


@dataclass(frozen=True)
class Conventional:
    niter: int
    grouping: int = 4
    solver: str = "lsqml"
    beta_object: float = 0.5
    beta_probe: float = 0.5
    gamma: float = 1e-4
    illum_reg: float = 1e-2
    noise_model: Any = "amplitude"
    update_probe: bool = True
    presolve: bool = True
    position_solver: str = "none"
    position_rate: float = 0.5
    max_move: float = 1.0
    group_constraints: Named = field(default_factory=list)
    iter_constraints: Named = field(default_factory=list)
    sim_shape: Any = None
    resize_method: str = "pad_crop"
    obj_pad_px: float | None = None
    probe_modes: int | None = None
    base_mode_power: float = 0.7
    slices: Any = None


@dataclass(frozen=True)
class Gradient:
    niter: int
    grouping: int = 4
    solver: str = "adam"
    learning_rate: float = 0.02
    probe_rate: float = 0.01
    momentum: float = 0.0
    nesterov: bool = False
    noise_model: Any = "amplitude"
    update_probe: bool = True
    presolve: bool = True
    regularizers: Named = field(default_factory=list)
    group_constraints: Named = field(default_factory=list)
    iter_constraints: Named = field(default_factory=list)
    sim_shape: Any = None
    resize_method: str = "pad_crop"
    obj_pad_px: float | None = None
    probe_modes: int | None = None
    base_mode_power: float = 0.7
    slices: Any = None


@ENGINES.add("conventional", Conventional)
def _conventional(patterns: DataFrame, state: engines.State, props: Conventional, observer: Callable[[int, float], None] | None = None) -> engines.State:
    e = engines.Engine(
        props.solver, props.niter, props.grouping, props.beta_object, props.beta_probe, props.gamma, props.illum_reg, presolve=props.presolve, update_probe=props.update_probe,
        constraints=_constraints(props.group_constraints, props.iter_constraints), positions=props.position_solver, position_rate=props.position_rate, max_move=props.max_move,
    )
    return engines.reconstruct(patterns, state, NOISE.parse(props.noise_model)(e), observer)


@ENGINES.add("gradient", Gradient)
def _gradient(patterns: DataFrame, state: engines.State, props: Gradient, observer: Callable[[int, float], None] | None = None) -> engines.State:
    e = engines.Engine(
        props.solver, props.niter, props.grouping, props.learning_rate, props.probe_rate, presolve=props.presolve, update_probe=props.update_probe, momentum=props.momentum, nesterov=props.nesterov,
        costs=tuple((c["type"], float(c["cost"])) for c in props.regularizers), constraints=_constraints(props.group_constraints, props.iter_constraints),
    )
    return engines.reconstruct(patterns, state, NOISE.parse(props.noise_model)(e), observer)


@dataclass(frozen=True)
class Plan:
    name: str
    engines: list[Any]
    post_load: list[Any] = field(default_factory=list)
    post_init: list[Any] = field(default_factory=list)
    seed: Any = None
    dtype: str = "float32"
    scan: Any = None
    probe: Any = None
    object: Any = None
    slices: tuple[float, ...] = ()
    raw_data: Any = None
    tilt: Any = None
    save: Any = None

    @staticmethod
    def from_data(data: dict[str, Any], allow_import: bool = False) -> Plan:
        """A validated plan; every problem found is in the one error."""
        p, problems = record(Plan, data, "plan"), []
        out: dict[str, list[Any]] = {"post_load": [], "post_init": [], "engines": []}
        for part, registry in (("post_load", POST_LOAD), ("post_init", POST_INIT), ("engines", ENGINES)):
            for spec in getattr(p, part):
                try:
                    hook = registry.parse(spec, allow_import)
                    if noise := getattr(hook.props, "noise_model", None):
                        NOISE.parse(noise, allow_import)
                    if wanted := _preparation(hook.props):
                        wanted.checked()
                    out[part].append(hook)
                except PlanError as e:
                    problems.append(str(e))
        if p.dtype not in ("float32", "float64"):
            problems.append(f"plan: unknown dtype {p.dtype}")
        save = p.save
        if save is not None:
            try:
                save = record(Save, {"out_dir": save} if isinstance(save, str) else save, "save")
                formatted("out_dir", save.out_dir, name=p.name)
                formatted("state_name", save.state_name, iter=0)
            except PlanError as e:
                problems.append(str(e))
        if problems:
            raise PlanError("\n".join(problems))
        return Plan(p.name, out["engines"], out["post_load"], out["post_init"], p.seed, p.dtype, p.scan, p.probe, p.object, tuple(p.slices), p.raw_data, p.tilt, save)

    @staticmethod
    def from_json(text: str) -> Plan:
        return Plan.from_data(json.loads(text))

    @staticmethod
    def from_yaml_all(text: str) -> list[Plan]:
        """Plans of a file of several documents."""
        import yaml

        return [Plan.from_data(d) for d in yaml.safe_load_all(text)]


def execute(plan: Plan, patterns: DataFrame, state: engines.State, observer: Callable[[int, float], None] | None = None, watch: Callable[[int, float, engines.State], None] | None = None) -> engines.State:
    """The plan's engines one after the other on packed patterns, each prepared for; `watch` sees the state at work as well."""
    if patterns.agg(F.count(F.lit(1))).first()[0] == 0:
        raise PlanError("no patterns")
    for engine in plan.engines:
        if wanted := _preparation(engine.props):
            patterns, state = prepare(patterns, state, wanted)

        def see(i: int, error: float, state: engines.State = state) -> None:
            if watch:
                watch(i, error, state)
            if observer:
                observer(i, error)

        state = engine(patterns, state, observer=see)
    return state
