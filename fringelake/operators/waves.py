"""NumPy wave kernels, used inside Arrow batches only."""

from __future__ import annotations

import hashlib
import json
import math

import numpy as np


def fft2(a: np.ndarray) -> np.ndarray:
    """Centred real space to corner-origin reciprocal space, unitary."""
    return np.fft.fft2(np.fft.ifftshift(a, axes=(-2, -1)), norm="ortho")


def ifft2(a: np.ndarray) -> np.ndarray:
    return np.fft.fftshift(np.fft.ifft2(a, norm="ortho"), axes=(-2, -1))


def frequencies(shape: tuple[int, int], step: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    return np.meshgrid(np.fft.fftfreq(shape[0], step[0]), np.fft.fftfreq(shape[1], step[1]), indexing="ij")


def focused_probe(shape: tuple[int, int], step: tuple[float, float], lam: float, mrad: float, defocus: float = 0.0) -> np.ndarray:
    ky, kx = frequencies(shape, step)
    t2 = (ky**2 + kx**2) * lam**2
    p = np.exp(-1j * math.pi * defocus / lam * t2) * (np.sqrt(t2) <= mrad * 1e-3)
    return ifft2(p / np.sqrt((np.abs(p) ** 2).sum()))


def propagator(shape: tuple[int, int], step: tuple[float, float], lam: float, dz: float, tilt: tuple[float, float] = (0.0, 0.0)) -> np.ndarray:
    ky, kx = frequencies(shape, step)
    k2 = ky**2 + kx**2
    bw = 2 / 3 * min(0.5 / step[0], 0.5 / step[1])
    ramp = kx * math.tan(tilt[1] * 1e-3) + ky * math.tan(tilt[0] * 1e-3)
    return np.exp(-1j * math.pi * dz * (lam * k2 - 2 * ramp)) * (k2 <= bw**2)


def shifted(probe: np.ndarray, step: tuple[float, float], shift: tuple[float, float]) -> np.ndarray:
    if shift == (0.0, 0.0):
        return probe
    ky, kx = frequencies(probe.shape[-2:], step)
    return ifft2(fft2(probe) * np.exp(-2j * math.pi * (shift[0] * ky + shift[1] * kx)))


def hermite_modes(base: np.ndarray, n: int, base_power: float = 0.7, rel_powers: tuple[float, ...] = (1.0,)) -> np.ndarray:
    """n orthogonal modes y^a x^b base by Gram-Schmidt about the centroid.

    The first has base_power of the base's intensity, the others split the rest
    by rel_powers, whose last goes on for those after it.
    """
    ny, nx = base.shape
    w = np.abs(base) ** 2
    y, x = np.mgrid[:ny, :nx].astype(float)
    y, x = y - (y * w).sum() / w.sum(), x - (x * w).sum() / w.sum()
    scale = math.sqrt(((y**2 + x**2) * w).sum() / w.sum()) or 1.0
    modes: list[np.ndarray] = []
    order = 0
    while len(modes) < n:
        for b in range(order + 1):
            m = (y / scale) ** (order - b) * (x / scale) ** b * base
            for prev in modes:
                m = m - prev * (prev.conj() * m).sum()
            norm = np.sqrt((np.abs(m) ** 2).sum())
            if len(modes) < n and norm > 1e-12:
                modes.append(m / norm)
        order += 1
        if order > ny + nx:
            break
    total = w.sum()
    rel = [*rel_powers[: len(modes) - 1], *[rel_powers[-1]] * (len(modes) - 1 - len(rel_powers))]
    powers = [base_power, *[(1 - base_power) * r / sum(rel) for r in rel]] if len(modes) > 1 else [1.0]
    return np.stack([m * math.sqrt(total * p) for m, p in zip(modes, powers)])


def seeded(seed: object, *entropy: object) -> np.random.Generator:
    digest = hashlib.sha256((json.dumps(seed) + json.dumps(list(entropy))).encode()).digest()
    return np.random.Generator(np.random.PCG64(np.random.SeedSequence(int.from_bytes(digest, "little"))))


def forward(obj: np.ndarray, probe: np.ndarray, props: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """(wave entering each slice, far field) of `obj` (..., z, ny, nx) and `probe` (..., modes, ny, nx)."""
    waves, psi = [], probe
    for z in range(obj.shape[-3]):
        waves.append(psi)
        psi = psi * obj[..., z, None, :, :]
        if z < len(props):
            psi = ifft2(fft2(psi) * props[z])
    return waves, fft2(psi)


def backward(far_grad: np.ndarray, obj: np.ndarray, waves: list[np.ndarray], props: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Adjoint of `forward`: (gradient on each slice, gradient on the probe)."""
    g = ifft2(far_grad)
    out = np.zeros(obj.shape, complex)
    for z in range(obj.shape[-3] - 1, -1, -1):
        if z < len(props):
            g = ifft2(fft2(g) * props[z].conj())
        out[..., z, :, :] = (g * waves[z].conj()).sum(axis=-3)
        g = g * obj[..., z, None, :, :].conj()
    return out, g
