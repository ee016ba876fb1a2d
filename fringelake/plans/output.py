"""The folder that a run writes to: artefacts one by one, each whole or not there, and a marker last.

An artefact is written to a staging folder, renamed into place, and then gets its row in
the manifest. `finished` is written after all of them, so a folder without it is of
a run that failed or still goes on; its artefacts named by the manifest can be read all the same.
All of it goes through Spark's file systems. (Where a store has no rename of folders, a
reader that goes by the manifest still sees whole artefacts only.)
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from types import TracebackType
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..operators.engines import State
from ..sources.state import read_state, write_state
from .registry import PlanError

MARKER, MANIFEST, STAGING = "finished", "manifest", "_staging"
ROW = "name string, kind string, iteration long, bytes long, written double"


@dataclass(frozen=True)
class Save:
    """out_dir: format of the folder's path, with {name}; state_name: of a state's, with {iter}. A state is written
    after each `every` iterations (0: none) and at the end."""

    out_dir: str
    every: int = 0
    state_name: str = "state_iter{iter:05d}"


def formatted(kind: str, text: str, **names: Any) -> str:
    """`text` with its {fields} filled in; an unknown one is an error of the plan."""
    try:
        out = text.format(**names)
    except (KeyError, IndexError) as e:
        raise PlanError(f"{kind}: {text!r} has the unknown field {e}; known are {', '.join(sorted(names))}") from None
    except (ValueError, AttributeError, TypeError) as e:
        raise PlanError(f"{kind}: {text!r} is no format: {e}") from None
    if not out.strip("/ "):
        raise PlanError(f"{kind}: {text!r} names nothing")
    return out


class OutputRun:
    """`with OutputRun(spark, folder) as out: out.write(...)`; the marker is written if nothing was raised.

    A folder that holds the marker is another run's and refused; one without is taken
    on: artefacts of the same name are replaced.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.path = lambda *parts: spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))
        self.files = self.path().getFileSystem(spark._jsc.hadoopConfiguration())
        self.staging = f"{STAGING}-{uuid.uuid4().hex}"

    def __enter__(self) -> OutputRun:
        if self.files.exists(self.path(MARKER)):
            raise FileExistsError(f"{self.folder} holds a finished run")
        self.files.mkdirs(self.path(self.staging))
        return self

    def __exit__(self, kind: type[BaseException] | None, error: BaseException | None, trace: TracebackType | None) -> None:
        self.files.delete(self.path(self.staging), True)
        if kind is None:
            self._put(MARKER, b"")

    def _put(self, name: str, content: bytes) -> None:
        out = self.files.create(self.path(name), True)
        try:
            out.write(bytearray(content))
        finally:
            out.close()

    def write(self, name: str, kind: str, writer: Callable[[str], None], iteration: int | None = None) -> str:
        """`writer` fills the folder that it is given; then that becomes the artefact `name`."""
        if "/" in name or name in (MARKER, MANIFEST) or name.startswith(("_", ".")):
            raise PlanError(f"an artefact cannot be called {name!r}")
        writer(f"{self.folder}/{self.staging}/{name}")
        row, target = f"{MANIFEST}/{name}.json", self.path(name)
        self.files.delete(self.path(row), False)  # not named while it is replaced
        self.files.delete(target, True)
        if not self.files.rename(self.path(self.staging, name), target):
            raise OSError(f"{self.folder}/{name} could not be put in place")
        size = self.files.getContentSummary(target).getLength()
        self._put(row, json.dumps({"name": name, "kind": kind, "iteration": iteration, "bytes": size, "written": time.time()}).encode())
        return f"{self.folder}/{name}"

    def table(self, name: str, df: DataFrame, iteration: int | None = None) -> str:
        return self.write(name, "table", lambda to: df.write.parquet(to), iteration)

    def state(self, name: str, state: State, iteration: int | None = None) -> str:
        tables = state_tables(self.spark, state)
        return self.write(name, "state", lambda to: write_state(self.spark, to, tables, state.lam), iteration)


def finished(spark: SparkSession, folder: str) -> bool:
    out = OutputRun(spark, folder)
    return bool(out.files.exists(out.path(MARKER)))


def artefacts(spark: SparkSession, folder: str) -> DataFrame:
    """(name, kind, iteration, bytes, written) of what the folder holds whole; none where there is none."""
    out = OutputRun(spark, folder)
    if not out.files.exists(out.path(MANIFEST)):
        return spark.createDataFrame([], ROW)
    return spark.read.schema(ROW).json(f"{out.folder}/{MANIFEST}")


def state_tables(spark: SparkSession, state: State) -> dict[str, DataFrame]:
    """Object, probe and errors as tables; both arrays are of the size that a step may carry."""

    def long(a: np.ndarray, first: str) -> DataFrame:
        z, y, x = (i.ravel() for i in np.indices(a.shape))
        return spark.createDataFrame(pd.DataFrame({first: z, "y": y, "x": x, "re": a.real.ravel(), "im": a.imag.ravel()}))

    errors = [(k + 1, float(e)) for k, e in enumerate(state.errors)]
    return {"object": long(state.obj, "z"), "probe": long(state.probe, "mode"), "progress": spark.createDataFrame(errors, "iter long, error double")}


def load_state(spark: SparkSession, folder: str, step: tuple[float, float], thickness: list[float] | None = None) -> State:
    """What `OutputRun.state` wrote, for an engine to go on from."""
    tables, lam = read_state(spark, folder)
    if lam is None:
        raise ValueError(f"{folder} gives no wavelength")

    def array(name: str, first: str) -> np.ndarray:
        p = tables[name].toPandas()
        out = np.zeros(tuple(int(p[c].max()) + 1 for c in (first, "y", "x")), complex)
        out[p[first], p["y"], p["x"]] = p["re"] + 1j * p["im"]
        return out

    errors = [r["error"] for r in tables["progress"].orderBy("iter").collect()]  # one row an iteration
    obj = array("object", "z")
    return State(obj, array("probe", "mode"), step, lam, thickness or [0.0] * len(obj), errors)
