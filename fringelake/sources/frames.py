"""Raw detector frames: 128 x 128 float32 pixels with two dead rows, as a batch data source and sink.

A scan is one file, or a folder of files in order that a manifest names. Frames are
read in byte ranges as Arrow batches, so a file of any size is never read whole. The
writer puts the dead rows back: each task writes its own files into a staging folder;
the commit checks that the frames follow one another without a gap, moves the files
into place and writes the manifest last. What the manifest does not name is not read,
so neither a failed job nor a task that ran twice leaves a frame behind. The files put
one after the other are the single file of the detector.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from . import files

#: Stored rows, used rows, columns of a frame.
STORED, ROWS, COLUMNS = 130, 128, 128
PIXELS = ROWS * COLUMNS
FRAME = STORED * COLUMNS * 4
SCHEMA = "pos_id long, iy long, ix long, data array<float>"
MANIFEST = "frames.json"
#: Frames of an Arrow batch, about 4 MB.
BATCH = 64


def shape_from_name(path: str) -> tuple[int, int] | None:
    """(ny, nx) from a name with x<nx>_y<ny>."""
    m = re.search(r"x(\d+)_y(\d+)", path.rstrip("/").rsplit("/", 1)[-1])
    return (int(m[2]), int(m[1])) if m else None


@dataclass
class Frames(InputPartition):
    """`n` frames of a file from its frame `at` on; the first one is position `first`."""

    file: str
    at: int
    n: int
    first: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.per_task = int(options.get("framespertask", 256))
        disk, path = files.located(self.path)
        shape = (int(options["ny"]), int(options["nx"])) if "ny" in options else None
        if files.kind(disk, path) == fs.FileType.Directory:
            if files.kind(disk, f"{path}/{MANIFEST}") != fs.FileType.File:
                raise ValueError(f"{self.path} has no {MANIFEST}: it was not written to its end")
            with disk.open_input_stream(f"{path}/{MANIFEST}") as f:
                manifest = json.loads(f.read())
            names = [f"{path}/{p['file']}" for p in manifest["parts"]]
            shape = shape or (tuple(manifest["shape"]) if manifest["shape"] else None)
        else:
            names = [path]
        self.parts, self.n = [], 0
        for name in names:
            size = files.size(disk, name)
            if size % FRAME:
                raise ValueError(f"{name}: {size} bytes are no whole number of frames")
            self.parts.append((name, self.n, size // FRAME))
            self.n += size // FRAME
        shape = shape or shape_from_name(path)
        if shape is None:
            raise ValueError("the scan's shape is neither given nor in the file's name")
        if shape[0] * shape[1] != self.n:
            raise ValueError(f"{self.path} has {self.n} frames; the scan has {shape[0]} x {shape[1]}")
        self.nx = shape[1]

    def partitions(self) -> list[Frames]:
        cut = [Frames(name, at, min(self.per_task, n - at), first + at) for name, first, n in self.parts for at in range(0, n, self.per_task)]
        return cut or [Frames("", 0, 0, 0)]

    def read(self, partition: Frames) -> Iterator[pa.RecordBatch]:
        if not partition.n:
            return
        disk = files.located(self.path)[0]
        with disk.open_input_file(partition.file) as f:
            for at in range(partition.at, partition.at + partition.n, BATCH):
                n = min(BATCH, partition.at + partition.n - at)
                raw = f.read_at(n * FRAME, at * FRAME)
                pixels = np.frombuffer(raw, "<f4").reshape(n, STORED, COLUMNS)[:, :ROWS][:, ::-1].reshape(-1)
                pos = partition.first + at - partition.at + np.arange(n)
                data = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * PIXELS), pa.array(pixels, pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array(pos), pa.array(pos // self.nx), pa.array(pos % self.nx), data], ["pos_id", "iy", "ix", "data"])


@dataclass
class Written(WriterCommitMessage):
    """A staged file: its first position and how many frames it holds."""

    file: str
    first: int
    n: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.shape = [int(options["ny"]), int(options["nx"])] if "ny" in options else None
        self.staging = f"_staging-{uuid.uuid4().hex}"
        disk, path = files.located(self.path)
        found = files.kind(disk, path)
        if found == fs.FileType.File or (found == fs.FileType.Directory and not overwrite):
            raise ValueError(f"{self.path} is there already")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written | None:
        """One file of this task's rows; they come in order of pos_id."""
        disk, path = files.located(self.path)
        out, name, first, n = None, f"{uuid.uuid4().hex}.raw", 0, 0
        try:
            for batch in iterator:
                pos = batch.column(batch.schema.get_field_index("pos_id"))
                data = batch.column(batch.schema.get_field_index("data"))
                if pos.null_count or data.null_count or np.any(data.value_lengths().to_numpy(zero_copy_only=False) != PIXELS):
                    raise ValueError(f"a frame has an id and {ROWS} x {COLUMNS} pixels")
                if not batch.num_rows:
                    continue
                ids = pos.to_numpy(zero_copy_only=False)
                first = int(ids[0]) if out is None else first
                if not np.array_equal(ids, first + n + np.arange(len(ids))):
                    raise ValueError(f"positions do not follow one another after {first + n - 1}")
                if out is None:
                    disk.create_dir(f"{path}/{self.staging}", recursive=True)
                    out = disk.open_output_stream(f"{path}/{self.staging}/{name}")
                frame = np.zeros((len(ids), STORED, COLUMNS), "<f4")
                frame[:, :ROWS] = data.flatten().to_numpy(zero_copy_only=False).reshape(-1, ROWS, COLUMNS)[:, ::-1]
                out.write(frame.tobytes())
                n += len(ids)
        finally:
            if out is not None:
                out.close()
        return Written(name, first, n)

    def commit(self, messages: list[Written | None]) -> None:
        disk, path = files.located(self.path)
        parts = sorted((m for m in messages if m is not None and m.n), key=lambda m: m.first)
        at = 0
        for m in parts:
            if m.first != at:
                raise ValueError(f"positions {at} to {m.first - 1} are missing" if m.first > at else f"position {m.first} is there twice")
            at += m.n
        if self.shape and self.shape[0] * self.shape[1] != at:
            raise ValueError(f"{at} frames; the scan has {self.shape[0]} x {self.shape[1]}")
        disk.create_dir(path, recursive=True)
        version = self.staging.removeprefix("_staging-")[:8]
        named = []
        for k, m in enumerate(parts):
            file = f"part-{k:05d}-{version}.raw"
            disk.move(f"{path}/{self.staging}/{m.file}", f"{path}/{file}")
            named.append({"file": file, "first": m.first, "frames": m.n})
        with disk.open_output_stream(f"{path}/{self.staging}.json") as f:
            f.write(json.dumps({"shape": self.shape, "parts": named}).encode())
        disk.move(f"{path}/{self.staging}.json", f"{path}/{MANIFEST}")  # from here on readers see the new frames
        keep = {MANIFEST, *[p["file"] for p in named]}
        for info in disk.get_file_info(fs.FileSelector(path)):  # an earlier version's files, and what tasks that ran twice left
            if info.base_name == self.staging:
                disk.delete_dir(info.path)
            elif info.type == fs.FileType.File and info.base_name not in keep and re.match(r"part-\d{5,}-[0-9a-f]{8}\.raw\Z", info.base_name):
                disk.delete_file(info.path)

    def abort(self, messages: list[Written | None]) -> None:
        disk, path = files.located(self.path)
        if files.kind(disk, f"{path}/{self.staging}") == fs.FileType.Directory:
            disk.delete_dir(f"{path}/{self.staging}")
        if files.kind(disk, path) == fs.FileType.Directory and not disk.get_file_info(fs.FileSelector(path)):
            disk.delete_dir(path)


class FrameSource(DataSource):
    """spark.read or df.write .format("detector_frames").option("path", ...): a path that every executor can open."""

    @classmethod
    def name(cls) -> str:
        return "detector_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return _Reader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer({k.lower(): v for k, v in self.options.items()}, overwrite)


def read_frames(spark: SparkSession, path: str, shape: tuple[int, int] | None = None) -> DataFrame:
    """(pos_id, iy, ix, data) of a file, or of a folder that `write_frames` wrote."""
    spark.dataSource.register(FrameSource)
    reader = spark.read.format("detector_frames").option("path", path)
    if shape:
        reader = reader.option("ny", shape[0]).option("nx", shape[1])
    return reader.load()


def write_frames(patterns: DataFrame, path: str, shape: tuple[int, int] | None = None, overwrite: bool = False) -> None:
    """A folder of frames in order of pos_id, which runs from 0 without a gap.

    `shape` is the scan's; if it is not given here, a reader takes it from the folder's name.
    No frames at all are a scan of none. A null or wrong-sized pattern, an id that is missing
    or there twice, or a folder that is there already is an error, and nothing is written.
    """
    patterns.sparkSession.dataSource.register(FrameSource)
    rows = patterns.select(F.col("pos_id").cast("long"), F.col("data").cast("array<float>")).repartitionByRange("pos_id").sortWithinPartitions("pos_id")
    writer = rows.write.format("detector_frames").mode("overwrite" if overwrite else "append").option("path", path)
    if shape:
        writer = writer.option("ny", shape[0]).option("nx", shape[1])
    writer.save()


def border_masked(patterns: DataFrame, width: int = 2) -> DataFrame:
    """Long pixels (pos_id, ky, kx, v, m) with the mask of `width` pixels at the edge."""
    k = F.col("k")
    px = patterns.select("pos_id", F.posexplode("data").alias("k", "v")).select("pos_id", F.floor(k / COLUMNS).alias("ky"), F.pmod(k, F.lit(COLUMNS)).cast("long").alias("kx"), F.col("v").cast("double").alias("v"))
    inside = F.col("ky").between(width, ROWS - 1 - width) & F.col("kx").between(width, COLUMNS - 1 - width)
    return px.withColumn("m", inside.cast("double"))
