"""Constraints on object and probe, and regularisers with their gradients, as small NumPy helpers of the engines.

Object and probe have a bounded size and travel with a step (see `engines`); the
same costs over tables are in `losses` and `reduce`. Gradients are with respect
to the conjugate, like those of the engines.
"""

from __future__ import annotations

import math

import numpy as np

from .waves import fft2, frequencies, ifft2

EPS = 1e-8


def _d(a: np.ndarray, axis: int) -> np.ndarray:
    """Forward difference; zero at the end."""
    return np.diff(a, axis=axis, append=np.take(a, [-1], axis=axis))


def _adjoint(g: np.ndarray, axis: int) -> np.ndarray:
    g = np.swapaxes(g, axis, -1)
    out = np.zeros_like(g)
    out[..., :-1] -= g[..., :-1]
    out[..., 1:] += g[..., :-1]
    return np.swapaxes(out, axis, -1)


def l1(o: np.ndarray) -> tuple[float, np.ndarray]:
    size = np.sqrt(np.abs(o - 1) ** 2 + EPS)
    return float(size.sum()), (o - 1) / (2 * size)


def l2(o: np.ndarray) -> tuple[float, np.ndarray]:
    return float((np.abs(o - 1) ** 2).sum()), o - 1


def recip_l1(o: np.ndarray) -> tuple[float, np.ndarray]:
    f = np.fft.fft2(o.prod(axis=0), norm="ortho")
    size = np.sqrt(np.abs(f) ** 2 + EPS)
    g = np.fft.ifft2(f / (2 * size), norm="ortho")
    rest = np.stack([np.delete(o, z, axis=0).prod(axis=0) for z in range(len(o))])
    return float(size.sum()), g * rest.conj()


def _tikhonov(o: np.ndarray, axes: tuple[int, ...]) -> tuple[float, np.ndarray]:
    ds = [(_d(o, a), a) for a in axes]
    return float(sum((np.abs(d) ** 2).sum() for d, _ in ds)), sum(_adjoint(d, a) for d, a in ds)


def _variation(o: np.ndarray, axes: tuple[int, ...]) -> tuple[float, np.ndarray]:
    ds = [(_d(o, a), a) for a in axes]
    size = np.sqrt(sum(np.abs(d) ** 2 for d, _ in ds) + EPS)
    return float(size.sum()), sum(_adjoint(d / (2 * size), a) for d, a in ds)


def tikhonov(o: np.ndarray) -> tuple[float, np.ndarray]:
    return _tikhonov(o, (-2, -1))


def tv(o: np.ndarray) -> tuple[float, np.ndarray]:
    return _variation(o, (-2, -1))


def layers_tikhonov(o: np.ndarray) -> tuple[float, np.ndarray]:
    return _tikhonov(o, (0,)) if len(o) > 1 else (0.0, np.zeros_like(o))


def layers_tv(o: np.ndarray) -> tuple[float, np.ndarray]:
    return _variation(o, (0,)) if len(o) > 1 else (0.0, np.zeros_like(o))


def probe_recip_tikhonov(p: np.ndarray) -> tuple[float, np.ndarray]:
    cost, g = tikhonov(np.fft.fftshift(fft2(p), axes=(-2, -1)))
    return cost, ifft2(np.fft.ifftshift(g, axes=(-2, -1)))


def probe_recip_tv(p: np.ndarray) -> tuple[float, np.ndarray]:
    cost, g = tv(np.fft.fftshift(fft2(p), axes=(-2, -1)))
    return cost, ifft2(np.fft.ifftshift(g, axes=(-2, -1)))


OBJECT_COSTS = {f.__name__: f for f in (l1, l2, recip_l1, tikhonov, tv, layers_tikhonov, layers_tv)}
PROBE_COSTS = {f.__name__: f for f in (probe_recip_tikhonov, probe_recip_tv)}


def clamp_amplitude(state, amplitude: float = 1.1) -> None:
    state.obj = state.obj * np.minimum(1.0, amplitude / np.maximum(np.abs(state.obj), 1e-30))


def limit_probe_support(state, max_angle: float) -> None:
    """Probe within max_angle mrad."""
    ky, kx = frequencies(state.probe.shape[-2:], state.step)
    state.probe = ifft2(fft2(state.probe) * (np.hypot(ky, kx) <= max_angle * 1e-3 / state.lam))


def remove_phase_ramp(state) -> None:
    """The best plane through each slice's phase goes."""
    y, x = (a.ravel() for a in np.mgrid[: state.obj.shape[1], : state.obj.shape[2]].astype(float))
    a = np.stack([np.ones_like(y), y, x], axis=1)
    for z, o in enumerate(state.obj):
        plane = a @ np.linalg.lstsq(a, np.angle(o).ravel(), rcond=None)[0]
        state.obj[z] = o * np.exp(-1j * plane.reshape(o.shape))


def _low_pass(o: np.ndarray, response: np.ndarray) -> np.ndarray:
    return np.fft.ifft2(np.fft.fft2(o) * response)


def object_low_pass(state, max_frequency: float = 0.4) -> None:
    """Frequencies up to so many per pixel stay."""
    ky, kx = frequencies(state.obj.shape[-2:], (1.0, 1.0))
    state.obj = _low_pass(state.obj, np.hypot(ky, kx) <= max_frequency)


def object_gaussian(state, sigma: float, weight: float = 1.0) -> None:
    """Blend with the object blurred by sigma Å."""
    ky, kx = frequencies(state.obj.shape[-2:], state.step)
    state.obj = (1 - weight) * state.obj + weight * _low_pass(state.obj, np.exp(-2 * math.pi**2 * sigma**2 * (ky**2 + kx**2)))


def layers(state, sigma: float, weight: float = 0.9) -> None:
    """Blend with slices blurred along z by sigma Å, the outer ones going on."""
    n = len(state.obj)
    if n < 2:
        return
    s = sigma / max(1e-30, sum(state.thickness[:n]) / n)
    radius = math.ceil(2 * s)
    taps = np.exp(-0.5 * (np.arange(-radius, radius + 1) / max(s, 1e-30)) ** 2)
    at = np.clip(np.arange(n)[:, None] + np.arange(-radius, radius + 1), 0, n - 1)
    state.obj = (1 - weight) * state.obj + weight * np.einsum("k,zkyx->zyx", taps / taps.sum(), state.obj[at])


CONSTRAINTS = {f.__name__: f for f in (clamp_amplitude, limit_probe_support, remove_phase_ramp, object_low_pass, object_gaussian, layers)}
