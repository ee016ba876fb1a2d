"""Vectors as blocks of whole numbers, exact at any magnitude.

A vector table becomes one row a block of at most `BLOCK` vectors, made from
the Arrow batches of the scan, so that nothing is shuffled. A block holds ids,
labels and a matrix of whole numbers; numbers beyond 32 bits are Python
integers, so that sums and squared distances are exact in every case.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame, functions as F

from .session import checkpointed
from .textkit import column

#: Vectors of a block at most.
BLOCK = 8192
#: Numbers up to this are kept as 32-bit integers.
SMALL = 1 << 30


@dataclass
class Block:
    """ids and labels with their null marks, and a row of whole numbers a vector."""

    ids: np.ndarray
    no_id: np.ndarray
    labels: np.ndarray
    no_label: np.ndarray
    x: np.ndarray


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * value) of finite doubles, `scale` a power of two: int32, or Python integers where one is larger."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * float(scale))
    if not scaled.size or np.abs(scaled).max() <= SMALL:
        return scaled.astype(np.int32)
    flat = [int(s) if abs(s) < 2.0**1000 else int(v) * scale for s, v in zip(scaled.ravel().tolist(), values.ravel().tolist())]
    out = np.empty(len(flat), object)
    out[:] = flat
    return out.reshape(values.shape)


def greatest(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def arithmetic(dims: int, *arrays: np.ndarray) -> type:
    """A type in which squared distances over `dims` numbers of these arrays are exact."""
    most = dims * (2 * max(map(greatest, arrays))) ** 2
    return np.int32 if most < 1 << 31 else np.int64 if most < 1 << 63 else object


def long(value: int) -> int | None:
    """`value`, or null where a long can't hold it."""
    return int(value) if -(1 << 63) <= value < 1 << 63 else None


def usable(embedding: Column, dims: int) -> Column:
    """True of arrays of `dims` components, none null, NaN or infinite; else false or null."""
    inf = F.lit(float("inf"))
    # array_contains is null where it finds nothing among nulls; NaN counts as the largest number
    return (F.size(embedding) == dims) & ~F.array_contains(embedding, inf) & (F.array_max(embedding) < inf) & (F.array_min(embedding) > -inf)


def cleaned(vectors: DataFrame, dims: int) -> DataFrame:
    """(vec_id, label, embedding) of the usable vectors."""
    label = F.col("label").cast("long") if "label" in vectors.columns else F.lit(None).cast("long")
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col("embedding").cast("array<double>").alias("embedding")).where(usable(F.col("embedding"), dims))


def usual_size(vectors: DataFrame, multiple: int) -> int:
    """The number of components that most vectors have, among multiples of `multiple`; of equally frequent ones the larger."""
    size = F.size(F.col("embedding"))
    found = vectors.where((size > 0) & (size % multiple == 0)).groupBy(size.alias("n")).agg(F.count(F.lit(1)).alias("times"))
    first = found.orderBy(F.desc("times"), F.desc("n")).first()
    return first["n"] if first else multiple


def _numbers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    null = np.asarray(col.is_null().to_numpy(zero_copy_only=False), bool)
    return col.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), null


def _pack(batches: Iterator[pa.RecordBatch], dims: int, scale: int) -> Iterator[pa.RecordBatch]:
    for whole_batch in batches:
        for at in range(0, whole_batch.num_rows, BLOCK):
            batch = whole_batch.slice(at, BLOCK)
            values = column(batch, "embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, dims)
            body = pickle.dumps(Block(*_numbers(column(batch, "vec_id")), *_numbers(column(batch, "label")), whole(values, scale)), 5)
            yield pa.RecordBatch.from_arrays([pa.array([body], pa.binary())], ["body"])


def blocks(clean: DataFrame, dims: int, scale: int) -> DataFrame:
    """(body) rows of the cleaned vectors in the shared checkpoint folder; partitions as the scan has them."""
    return checkpointed(clean.mapInArrow(lambda it: _pack(it, dims, scale), "body binary"))


def loaded(packed: DataFrame) -> RDD:
    """An RDD of `Block`."""
    return packed.rdd.map(lambda row: pickle.loads(row[0]))


def nullable(numbers: np.ndarray, null: np.ndarray) -> pa.Array:
    return pa.array(numbers, pa.int64(), mask=null)
