"""Named hooks with typed properties, and plans made of them.

A hook is `name` or {"type": name, ...properties}; unknown names and unknown
properties are errors, collected for the whole plan. A hook given by import
path runs code named in the plan, so it is refused unless the caller allows it.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Mapping
from dataclasses import MISSING, dataclass, field, fields, is_dataclass
from typing import Any


class PlanError(ValueError):
    """All problems of a plan, one a line."""


@dataclass
class Hook:
    name: str
    call: Callable[..., Any]
    props: Any

    def __call__(self, *args: Any, **kw: Any) -> Any:
        return self.call(*args, props=self.props, **kw)


@dataclass
class Registry:
    kind: str
    known: dict[str, tuple[Callable[..., Any], type]] = field(default_factory=dict)

    def add(self, name: str, props: type) -> Callable[[Callable[..., Any]], Callable[..., Any]]:
        def keep(f: Callable[..., Any]) -> Callable[..., Any]:
            self.known[name] = (f, props)
            return f

        return keep

    def parse(self, spec: str | Mapping[str, Any], allow_import: bool = False) -> Hook:
        spec = {"type": spec} if isinstance(spec, str) else dict(spec)
        name = spec.pop("type", None)
        if not isinstance(name, str):
            raise PlanError(f"{self.kind}: a hook needs a type")
        if name in self.known:
            call, props = self.known[name]
            return Hook(name, call, record(props, spec, f"{self.kind} {name}"))
        if ":" in name:
            if not allow_import:
                raise PlanError(f"{self.kind}: {name} names code to import; the caller has not allowed that")
            module, attribute = name.split(":", 1)
            return Hook(name, getattr(importlib.import_module(module), attribute), spec)
        raise PlanError(f"{self.kind}: unknown hook {name}; known are {', '.join(sorted(self.known))}")


def record(kind: type, values: Mapping[str, Any], where: str) -> Any:
    """An instance of a dataclass from a mapping; unknown and missing keys are errors."""
    assert is_dataclass(kind)
    names = {f.name: f for f in fields(kind)}
    problems = [f"{where}: unknown property {k}" for k in values if k not in names]
    problems += [f"{where}: {n} is missing" for n, f in names.items() if n not in values and f.default is MISSING and f.default_factory is MISSING]
    if problems:
        raise PlanError("\n".join(problems))
    return kind(**values)


def merged(left: Mapping[str, Any], right: Mapping[str, Any]) -> dict[str, Any]:
    """Settings with those of `right` over them; hooks of another type replace, records merge."""
    out = dict(left)
    for k, v in right.items():
        old = out.get(k)
        same = isinstance(old, Mapping) and isinstance(v, Mapping) and old.get("type", v.get("type")) == v.get("type", old.get("type"))
        out[k] = merged(old, v) if same else v
    return out
