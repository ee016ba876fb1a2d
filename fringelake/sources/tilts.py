"""Tilts of each position from array files (.npy) of shape (ny, nx, 2) or (ny * nx, 2), entries (ty, tx) in mrad.

The header is read by the driver and held against the scan's shape; the numbers are
read in byte ranges by the tasks, in either memory order, so no file is read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from . import files

SCHEMA = "pos_id long, ty double, tx double"
#: Positions of a task.
PER_TASK = 1 << 18


@dataclass
class Positions(InputPartition):
    first: int
    n: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.ny, self.nx = options["path"], int(options["ny"]), int(options["nx"])
        disk, path = files.located(self.path)
        size = files.size(disk, path)
        with disk.open_input_file(path) as f:
            try:
                version = np.lib.format.read_magic(f)
                header = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
                self.shape, self.columns_first, self.kind = header(f)
            except ValueError as e:
                raise ValueError(f"{self.path} is no array file: {e}") from None
            self.start = f.tell()
        if self.kind.kind not in "fiu":
            raise ValueError(f"{self.path}: tilts are real numbers, not {self.kind}")
        if self.shape not in ((self.ny, self.nx, 2), (self.ny * self.nx, 2)):
            raise ValueError(f"{self.path}: an array of shape {self.shape} does not fit a scan of {self.ny} x {self.nx}")
        if size != self.start + self.ny * self.nx * 2 * self.kind.itemsize:
            raise ValueError(f"{self.path}: {size} bytes do not hold what the header says")

    def partitions(self) -> list[Positions]:
        n = self.ny * self.nx
        return [Positions(k, min(PER_TASK, n - k)) for k in range(0, n, PER_TASK)] or [Positions(0, 0)]

    def read(self, partition: Positions) -> Iterator[pa.RecordBatch]:
        if not partition.n:
            return
        disk, path = files.located(self.path)
        width, at = self.kind.itemsize, np.arange(partition.first, partition.first + partition.n)
        with disk.open_input_file(path) as f:
            if self.columns_first:
                ty, tx = (np.frombuffer(f.read_at(partition.n * width, self.start + (c * self.ny * self.nx + partition.first) * width), self.kind) for c in range(2))
                pos = at if len(self.shape) == 2 else at % self.ny * self.nx + at // self.ny
            else:
                ty, tx = np.frombuffer(f.read_at(partition.n * 2 * width, self.start + partition.first * 2 * width), self.kind).reshape(-1, 2).T
                pos = at
        yield pa.RecordBatch.from_arrays([pa.array(pos), *[pa.array(np.ascontiguousarray(t, np.float64)) for t in (ty, tx)]], ["pos_id", "ty", "tx"])


class TiltSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tilt_array"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def read_tilts(spark: SparkSession, path: str, shape: tuple[int, int]) -> DataFrame:
    """(pos_id, ty, tx), one row a position; an array that does not fit the scan is an error, NaNs are kept."""
    spark.dataSource.register(TiltSource)
    return spark.read.format("tilt_array").option("path", path).option("ny", shape[0]).option("nx", shape[1]).load()
