"""Wave optics: electrons, probes, propagators, small transforms, sampling metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.complexcol import Pair, c_exp_i, c_mul

#: Electron rest energy (eV), rest mass (kg), speed of light (m/s), Planck constant times c (eV Å), charge (C).
REST_EV, MASS, LIGHT, HC, CHARGE = 510999.06, 9.1093897e-31, 299792458.0, 12398.4244, 1.60217733e-19


def electron_columns(energy: Column) -> dict[str, Column]:
    """Relativistic properties of an electron of kinetic energy (eV); wavelength in Å, momentum in eV/c."""
    total = energy + REST_EV
    momentum = F.sqrt(energy * (energy + 2 * REST_EV))
    gamma = total / REST_EV
    beta = momentum / total
    wavelength = F.try_divide(F.lit(HC), momentum)
    return {
        "total": total, "gamma": gamma, "mass": gamma * MASS, "momentum": momentum, "beta": beta, "velocity": beta * LIGHT, "wavelength": wavelength,
        "sigma": F.try_divide(2 * math.pi * total, wavelength * energy * (total + REST_EV)),
    }


def wavelength(energy: float) -> float:
    return HC / math.sqrt(energy * (energy + 2 * REST_EV))


def aperture(grid: DataFrame, lam: float, radius_mrad: float, defocus: float = 0.0) -> DataFrame:
    """(ky, kx, re, im): a focused probe in reciprocal space, of unit intensity over the grid."""
    theta2 = (F.col("fy") ** 2 + F.col("fx") ** 2) * lam * lam
    inside = (F.sqrt(theta2) <= radius_mrad * 1e-3).cast("double")
    phase = -2 * math.pi * (defocus / (2 * lam)) * theta2
    re, im = c_exp_i(phase)
    probe = grid.select("ky", "kx", (re * inside).alias("re"), (im * inside).alias("im"))
    total = probe.agg(F.sqrt(F.sum(F.col("re") ** 2 + F.col("im") ** 2)).alias("norm"))
    return probe.crossJoin(F.broadcast(total)).select("ky", "kx", F.try_divide(F.col("re"), F.col("norm")).alias("re"), F.try_divide(F.col("im"), F.col("norm")).alias("im"))


def shift_filter(grid: DataFrame, shifts: DataFrame) -> DataFrame:
    """(pos_id, ky, kx, re, im): exp(-2 pi i (y ky + x kx)) for each shift; the grid is broadcast."""
    re, im = c_exp_i(-2 * math.pi * (F.col("y") * F.col("fy") + F.col("x") * F.col("fx")))
    return shifts.crossJoin(F.broadcast(grid)).select("pos_id", "ky", "kx", re.alias("re"), im.alias("im"))


def fresnel_pair(lam: float, dz: Column | float, tilt_y: Column | float = 0.0, tilt_x: Column | float = 0.0) -> Pair:
    """exp(-i pi dz (lam k^2 - 2 (kx tan tx + ky tan ty))), tilts in mrad."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    k2 = F.col("fy") ** 2 + F.col("fx") ** 2
    ramp = F.col("fx") * F.tan(lit(tilt_x) * 1e-3) + F.col("fy") * F.tan(lit(tilt_y) * 1e-3)
    return c_exp_i(-math.pi * lit(dz) * (lam * k2 - 2 * ramp))


def fresnel(grid: DataFrame, lam: float, dz: float, tilt: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    re, im = fresnel_pair(lam, dz, tilt[0], tilt[1])
    return grid.select("ky", "kx", re.alias("re"), im.alias("im"))


def tilt_propagators(base: DataFrame, grid: DataFrame, tilts: DataFrame, dz: float) -> DataFrame:
    """The base propagator times each position's tilt ramp."""
    p = base.join(grid, ["ky", "kx"])
    phase = 2 * math.pi * dz * (F.col("fx") * F.tan(F.col("tx") * 1e-3) + F.col("fy") * F.tan(F.col("ty") * 1e-3))
    re, im = c_mul((F.col("re"), F.col("im")), c_exp_i(phase))
    return tilts.crossJoin(F.broadcast(p)).select("pos_id", "ky", "kx", re.alias("re"), im.alias("im"))


def dft2(px: DataFrame, twiddles: DataFrame, n: int, inverse: bool = False) -> DataFrame:
    """Unitary 2-D transform of small (pos_id, y, x, re, im) images by a broadcast table of n^2 index pairs.

    Forward: centred to corner; inverse: corner to centred. Separable: rows, then columns.
    """
    sign = 1.0 if inverse else -1.0

    def one(df: DataFrame, axis: str, out: str, keep: list[str]) -> DataFrame:
        a = F.pmod(F.col(axis) + (0 if inverse else (n + 1) // 2), F.lit(n))
        b = F.col("b")
        angle = sign * 2 * math.pi / n * F.pmod(a * b, F.lit(n))
        re, im = c_mul((F.col("re"), F.col("im")), c_exp_i(angle))
        place = F.pmod(b + (n // 2 if inverse else 0), F.lit(n)).cast("long")
        return df.crossJoin(F.broadcast(twiddles)).groupBy(*keep, place.alias(out)).agg((F.sum(re) / math.sqrt(n)).alias("re"), (F.sum(im) / math.sqrt(n)).alias("im"))

    first = one(px, "x", "kx", ["pos_id", "y"])
    return one(first, "y", "ky", ["pos_id", "kx"]).select("pos_id", "ky", "kx", "re", "im")


def hermite_order(i: Column) -> Column:
    """Anti-diagonal of the i-th mode."""
    return F.ceil((F.sqrt(8.0 * i + 9) - 3) / 2).cast("long")


def sampling_metrics(lam: Column, conv_mrad: Column, defocus: Column, step: Column, diff_step_mrad: Column) -> dict[str, Column]:
    """Metrics of a scan set-up: geometric probe radius, fundamental and probe sampling, linear and areal oversampling, Ronchigram magnification, and the parameters."""
    radius = F.abs(defocus) * F.tan(conv_mrad * 1e-3)
    window = lam / (diff_step_mrad * 1e-3)
    return {
        "probe_radius": radius, "fov": window, "linear_overlap": 1 - F.try_divide(step, 2 * radius), "areal_oversamp": F.try_divide(math.pi * radius * radius, step * step),
        "fund_samp": F.try_divide(window, step), "probe_samp": F.try_divide(window, 2 * radius), "linear_oversamp": F.try_divide(2 * radius, step), "ronchi_mag": F.try_divide(conv_mrad, diff_step_mrad * radius), "k_max": F.try_divide(conv_mrad * 1e-3, lam),
        "wavelength": lam, "conv_angle": conv_mrad, "defocus": defocus, "scan_step": step, "diff_step": diff_step_mrad,
    }


# Two Gaussian classes (failure, success) over log10 of Ronchigram magnification and areal oversampling.
CLASS_MEANS = ((0.49027803, 1.82918678), (0.80980859, 2.00158048))
CLASS_ROTATIONS = (((-0.2316652028331075, 0.972795576571098), (0.972795576571098, 0.2316652028331075)), ((-0.26985970170864165, 0.9628996528162853), (0.9628996528162853, 0.26985970170864165)))
CLASS_VARIANCES = ((0.56440416, 0.07769331), (0.4110058, 0.06621369))


def success_probability(ronchi_mag: Column, areal_oversamp: Column) -> Column:
    """P(success) by quadratic discriminants with even priors."""
    u, w = F.log10(ronchi_mag), F.log10(areal_oversamp)
    scores = []
    for mean, axes, variances in zip(CLASS_MEANS, CLASS_ROTATIONS, CLASS_VARIANCES):
        along = [((u - mean[0]) * axes[0][k] + (w - mean[1]) * axes[1][k]) for k in (0, 1)]
        scores.append(-0.5 * sum(a * a / v + math.log(v) for a, v in zip(along, variances)))
    return 1 / (1 + F.exp(scores[0] - scores[1]))

