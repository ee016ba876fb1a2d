"""Operators through a Fourier transform of packed images, as NumPy kernels in Arrow batches.

An image is one row (key, re, im) with arrays in row-major order; every
operator here is a map over rows, so images of any number are done in parallel.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .waves import fft2, frequencies, ifft2

Kernel = Callable[[np.ndarray], np.ndarray]


def packed(px: DataFrame, key: str) -> DataFrame:
    """(key, re, im) arrays from long pixels (key, y, x, re, im); an image's pixels are bounded."""
    ordered = lambda n: F.transform(F.sort_array(F.collect_list(F.struct("y", "x", n))), lambda s: s[n]).alias(n)
    return px.groupBy(key).agg(ordered("re"), ordered("im"))


def unpacked(images: DataFrame, key: str, nx: int) -> DataFrame:
    k = F.col("k")
    return images.select(key, F.posexplode(F.arrays_zip("re", "im")).alias("k", "s")).select(key, F.floor(k / nx).alias("y"), F.pmod(k, F.lit(nx)).cast("long").alias("x"), F.col("s.re").alias("re"), F.col("s.im").alias("im"))


def _arrays(batch: pa.RecordBatch, shape: tuple[int, int], re: str = "re", im: str = "im") -> np.ndarray:
    get = lambda c: np.array(batch.column(batch.schema.get_field_index(c)).to_pylist(), float).reshape(-1, *shape)
    return get(re) + 1j * get(im)


def mapped(images: DataFrame, shape: tuple[int, int], kernel: Kernel) -> DataFrame:
    """Each image through `kernel` (n, ny, nx) -> (n, ny, nx)."""
    schema = images.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = kernel(_arrays(batch, shape)).reshape(batch.num_rows, -1)
            new = {"re": pa.array(list(out.real), pa.list_(pa.float64())), "im": pa.array(list(out.imag), pa.list_(pa.float64()))}
            yield pa.RecordBatch.from_arrays([new.get(n, c) for n, c in zip(batch.schema.names, batch.columns)], batch.schema.names)

    return images.mapInArrow(run, schema)


def measured(images: DataFrame, key: str, shape: tuple[int, int], kernel: Callable[[np.ndarray], np.ndarray], key_type: str = "long") -> DataFrame:
    """(key, cost) of each image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(key)), pa.array(np.asarray(kernel(_arrays(batch, shape)), float))], [key, "cost"])

    return images.mapInArrow(run, f"{key} {key_type}, cost double")


def probe_support(shape: tuple[int, int], step: tuple[float, float], lam: float, mrad: float) -> Kernel:
    """Keeps the reciprocal pixels within an aperture."""
    ky, kx = frequencies(shape, step)
    mask = np.sqrt(ky**2 + kx**2) * lam <= mrad * 1e-3
    return lambda a: ifft2(fft2(a) * mask)


def low_pass(shape: tuple[int, int], top: float) -> Kernel:
    """Keeps frequencies up to `top` (1/px)."""
    ky, kx = frequencies(shape, (1.0, 1.0))
    mask = ky**2 + kx**2 <= top**2
    return lambda a: ifft2(fft2(a) * mask)


def gaussian(shape: tuple[int, int], step: tuple[float, float], sigma: float, weight: float) -> Kernel:
    ky, kx = frequencies(shape, step)
    blur = np.exp(-2 * math.pi**2 * sigma**2 * (ky**2 + kx**2))
    return lambda a: (1 - weight) * a + weight * ifft2(fft2(a) * blur)


def recip_l1(a: np.ndarray) -> np.ndarray:
    return np.abs(fft2(a)).sum(axis=(-2, -1))


def _centred(a: np.ndarray) -> np.ndarray:
    return np.fft.fftshift(fft2(a), axes=(-2, -1))


def recip_tikhonov(a: np.ndarray) -> np.ndarray:
    f = _centred(a)
    return sum((np.abs(np.diff(f, axis=k)) ** 2).sum(axis=(-2, -1)) for k in (-2, -1))


def recip_tv(a: np.ndarray, eps: float = 1e-8) -> np.ndarray:
    f = _centred(a)
    gy = np.diff(f, axis=-2, append=f[..., -1:, :])
    gx = np.diff(f, axis=-1, append=f[..., :, -1:])
    return np.sqrt(np.abs(gy) ** 2 + np.abs(gx) ** 2 + eps).sum(axis=(-2, -1))


def recip_phase_tikhonov(a: np.ndarray) -> np.ndarray:
    f = fft2(a)
    unit = f / np.maximum(np.abs(f), 1e-12)
    return sum((np.angle(unit[..., 1:, :] * unit[..., :-1, :].conj() if k == 0 else unit[..., 1:] * unit[..., :-1].conj()) ** 2).sum(axis=(-2, -1)) for k in (0, 1))


def ring_terms(pairs: DataFrame, key: str, shape: tuple[int, int], step: float, key_type: str = "long") -> DataFrame:
    """(r, re1, im1, re2, im2) reciprocal pixels of image pairs (re, im, re2, im2) under a Hann window."""
    ky, kx = frequencies(shape, (1.0, 1.0))
    r = np.floor(np.hypot(ky, kx) / step).astype(np.int64).ravel()
    hann = np.outer(np.hanning(shape[0] + 2)[1:-1], np.hanning(shape[1] + 2)[1:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, g = fft2(_arrays(batch, shape) * hann), fft2(_arrays(batch, shape, "re2", "im2") * hann)
            n = batch.num_rows
            keys = np.repeat(batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False), len(r))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.tile(r, n)), *(pa.array(x.ravel()) for x in (f.real, f.imag, g.real, g.imag))], [key, "r", "re1", "im1", "re2", "im2"])

    return pairs.mapInArrow(run, f"{key} {key_type}, r long, re1 double, im1 double, re2 double, im2 double")


def shifts(pairs: DataFrame, key: str, shape: tuple[int, int], most: float, key_type: str = "long") -> DataFrame:
    """(key, dy, dx): the shift of largest cross-correlation, at most `most` pixels long."""
    y, x = np.mgrid[: shape[0], : shape[1]]
    dy, dx = y - shape[0] // 2, x - shape[1] // 2
    allowed = np.hypot(dy, dx) <= most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = np.fft.fftshift(np.fft.ifft2(np.fft.fft2(_arrays(batch, shape)) * np.fft.fft2(_arrays(batch, shape, "re2", "im2")).conj()), axes=(-2, -1)).real
            at = np.where(allowed, c, -np.inf).reshape(batch.num_rows, -1).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(key)), pa.array(dy.ravel()[at]), pa.array(dx.ravel()[at])], [key, "dy", "dx"])

    return pairs.mapInArrow(run, f"{key} {key_type}, dy long, dx long")


def compact_groups(positions: np.ndarray, most: int, rng: np.random.Generator, rounds: int = 20) -> list[np.ndarray]:
    """Indices of compact groups whose sizes differ by one at most: seeded centroids, then the nearest group with room.

    A scan's positions are a bounded driver-side array, as group membership is.
    """
    n = len(positions)
    k = -(-n // most)
    center = positions[[rng.integers(n)]]
    while len(center) < k:
        d = ((positions[:, None] - center) ** 2).sum(axis=-1).min(axis=1)
        center = np.vstack([center, positions[rng.choice(n, p=d / d.sum() if d.sum() else None)]])
    for _ in range(rounds):
        near = ((positions[:, None] - center) ** 2).sum(axis=-1).argmin(axis=1)
        center = np.stack([positions[near == j].mean(axis=0) if (near == j).any() else center[j] for j in range(k)])
    distance = ((positions[:, None] - center) ** 2).sum(axis=-1)
    room = np.full(k, n // k)
    spare = n % k
    groups: list[list[int]] = [[] for _ in range(k)]
    for i in np.argsort(distance.min(axis=1), kind="stable").tolist():
        for j in np.argsort(distance[i], kind="stable").tolist():
            if len(groups[j]) < room[j] or (spare and len(groups[j]) == n // k):
                spare -= len(groups[j]) == n // k
                groups[j].append(i)
                break
    return [np.array(sorted(g)) for g in groups]


def sparse_groups(n: int, most: int, rng: np.random.Generator) -> list[np.ndarray]:
    """A seeded permutation cut into groups whose sizes differ by one at most, larger ones first."""
    return np.array_split(rng.permutation(n), -(-n // most))
