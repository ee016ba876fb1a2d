"""Kernels, engines and operators against NumPy and known values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringelake.operators import control, cutouts, engines, grids, images, optics, penalties, preprocess, reduce, waves
from fringelake.queries.engines import scan_starts, start_state, true_state


def test_transform_pairs():
    r = np.random.default_rng(1)
    for shape in ((5, 5), (8, 6)):
        a = r.normal(size=shape) + 1j * r.normal(size=shape)
        assert np.allclose(waves.ifft2(waves.fft2(a)), a)
        assert np.isclose((np.abs(waves.fft2(a)) ** 2).sum(), (np.abs(a) ** 2).sum())
    delta = np.zeros((5, 5))
    delta[2, 2] = 1
    assert np.allclose(waves.fft2(delta), 1 / 5)


def test_focus_there_and_back():
    lam, shape, step = 0.0251, (64, 64), (0.3, 0.3)
    focused = waves.focused_probe(shape, step, lam, 10.0)
    under = waves.focused_probe(shape, step, lam, 10.0, -200.0)
    moved = waves.ifft2(waves.fft2(under) * waves.propagator(shape, step, lam, 200.0))
    assert np.allclose(moved, focused, atol=1e-9)
    back = waves.propagator(shape, step, lam, 50.0) * waves.propagator(shape, step, lam, -50.0)
    assert np.allclose(back, waves.propagator(shape, step, lam, 0.0))


def test_modes_are_orthogonal():
    m = waves.hermite_modes(waves.focused_probe((24, 24), (0.4, 0.4), 0.025, 15.0, 80.0), 5)
    gram = np.einsum("iyx,jyx->ij", m.conj(), m)
    assert np.allclose(gram - np.diag(np.diag(gram)), 0, atol=1e-10)
    assert np.allclose(np.diag(gram).real, [0.7, *[0.3 / 4] * 4])  # the others split the rest


@pytest.mark.parametrize("slices", [1, 2])
def test_gradient_matches_finite_differences(slices):
    r = np.random.default_rng(3)
    s = true_state(2, slices)
    obj = s.obj[:, :16, :16] * np.exp(1j * r.normal(0, 0.1, (slices, 16, 16)))
    props, e = s.props(), engines.Engine()
    measured = r.uniform(0, 20, (16, 16))
    loss, d_obj, d_probe, _ = engines.loss_and_gradient(obj, s.probe, props, measured, e)
    for z, y, x in ((0, 5, 6), (slices - 1, 8, 8)):
        for step in (1e-6, 1e-6j):
            moved = obj.copy()
            moved[z, y, x] += step
            slope = (engines.loss_and_gradient(moved, s.probe, props, measured, e)[0] - loss) / 1e-6
            want = 2 * (d_obj[z, y, x].real if step.imag == 0 else d_obj[z, y, x].imag) if isinstance(step, complex) else 2 * d_obj[z, y, x].real
            assert math.isclose(slope, want, rel_tol=1e-3, abs_tol=1e-4)
    moved = s.probe.copy()
    moved[1, 7, 9] += 1e-6
    slope = (engines.loss_and_gradient(obj, moved, props, measured, e)[0] - loss) / 1e-6
    assert math.isclose(slope, 2 * d_probe[1, 7, 9].real, rel_tol=1e-3, abs_tol=1e-4)


@pytest.mark.parametrize("solver,rates", [("epie", {}), ("lsqml", {}), ("polyak", {"rate": 0.1, "probe_rate": 0.0}), ("adam", {"rate": 0.02, "probe_rate": 0.01, "nesterov": True, "noise": "poisson", "costs": (("tv", 1e-4), ("layers_tv", 1.0), ("probe_recip_tikhonov", 1e-6)), "constraints": (("clamp_amplitude", (("amplitude", 1.05),), "group"), ("remove_phase_ramp", (), "iter"))}), ("sgd", {"rate": 0.02, "probe_rate": 0.0, "momentum": 0.3, "nesterov": True}), ("adam", {"rate": 0.02, "probe_rate": 0.01}), ("sgd", {"rate": 0.02, "probe_rate": 0.0})])
def test_engines_reduce_the_error(spark, solver, rates):
    data = engines.simulate(scan_starts(spark), true_state())
    seen = []
    s = engines.reconstruct(data, start_state(), engines.Engine(solver=solver, iterations=3, groups=2, **rates), lambda i, e: seen.append((i, e)))
    assert s.errors[-1] < s.errors[0] and [e for _, e in seen] == s.errors
    assert math.isclose(engines.rescaled(data, true_state(), engines.Engine()), 1.0, rel_tol=1e-9)


def test_lsqml_step_by_hand(spark):
    """One group, one iteration, two slices, against a loop over positions."""
    truth, state = true_state(1, 2), start_state(1, 2)
    data = engines.simulate(scan_starts(spark), truth)
    e = engines.Engine(solver="lsqml", iterations=1, groups=1, rate=0.7, probe_rate=0.4)
    obj, probe, prop = state.obj.copy(), state.probe[0].copy(), state.props()[0]
    num, lit, dp, wp = np.zeros_like(obj), np.zeros(obj.shape), np.zeros_like(probe), np.zeros(probe.shape)
    best = lambda wave, along: (wave * along.conj()).real.sum() / ((abs(along) ** 2).sum() + e.gamma)
    for r in data.collect():
        at = np.s_[r["start_y"] : r["start_y"] + 16, r["start_x"] : r["start_x"] + 16]
        o1, o2 = obj[0][at], obj[1][at]
        second = waves.ifft2(waves.fft2(probe * o1) * prop)
        far = waves.fft2(second * o2)
        want = np.array(r["data"]).reshape(16, 16)
        chi = waves.ifft2(far * (np.sqrt(want + e.offset) / (np.sqrt(abs(far) ** 2 + e.offset) + e.eps) - 1))
        for z, psi, o in ((1, second, o2), (0, probe, o1)):
            step = chi * psi.conj()
            num[z][at] += best(chi, step * psi) * step * abs(psi) ** 2
            lit[z][at] += abs(psi) ** 2
            if z:
                chi = waves.ifft2(waves.fft2(chi * o.conj()) * prop.conj())
        step = chi * o1.conj()
        dp += best(chi, step * o1) * step * abs(o1 * o2) ** 2
        wp += abs(o1 * o2) ** 2
    got = engines.reconstruct(data, state, e)
    want = obj + 0.7 * num / (lit + e.illum_reg * lit.max(axis=(1, 2), keepdims=True))
    assert np.allclose(got.obj, want) and np.allclose(got.probe[0], probe + 0.4 * dp / (wp + e.illum_reg * wp.max()))


def test_penalty_gradients():
    rng = np.random.default_rng(6)
    o, d = (rng.normal(size=(3, 5, 6)) + 1j * rng.normal(size=(3, 5, 6)) for _ in range(2))
    for name, cost in {**penalties.OBJECT_COSTS, **penalties.PROBE_COSTS}.items():
        h = 1e-6
        slope = (cost(o + h * d)[0] - cost(o - h * d)[0]) / (2 * h)
        assert math.isclose(slope, 2 * (cost(o)[1].conj() * d).real.sum(), rel_tol=1e-4), name
    assert penalties.layers_tv(o[:1])[0] == 0.0


def test_constraints():
    rng = np.random.default_rng(7)
    y, x = np.mgrid[:12, :10]
    s = engines.State(np.stack([1.4 * np.exp(1j * (0.1 * y - 0.05 * x))] * 3), rng.normal(size=(1, 8, 8)) + 0j, (0.4, 0.4), 0.025, [2.0] * 3)
    penalties.clamp_amplitude(s, 1.1)
    assert np.allclose(abs(s.obj), 1.1)
    penalties.remove_phase_ramp(s)
    assert np.allclose(np.angle(s.obj), 0)
    for name, arguments in (("object_low_pass", {"max_frequency": 0.2}), ("object_gaussian", {"sigma": 1.0}), ("layers", {"sigma": 2.0})):
        penalties.CONSTRAINTS[name](s, **arguments)
        assert np.allclose(s.obj, 1.1), name  # a flat object stays
    penalties.limit_probe_support(s, 10.0)
    once = s.probe.copy()
    penalties.limit_probe_support(s, 10.0)
    assert np.allclose(once, s.probe)


def test_positions_move_towards_the_truth(spark):
    truth = true_state()
    at = scan_starts(spark).withColumn("sub_y", F.lit(0.05) * (F.col("pos_id") % 3 - 1)).withColumn("sub_x", F.lit(0.04) * (F.col("pos_id") % 2))
    data = engines.simulate(at, truth).withColumn("sub_y", F.lit(0.0)).withColumn("sub_x", F.lit(0.0)).select(*at.columns, "data")
    e = engines.Engine(positions="steepest", position_rate=1.0)
    steps = engines.position_steps(data, truth, e).select("pos_id", "step_y", "step_x", (F.col("pos_id") % 3 - 1).alias("ty"), (F.col("pos_id") % 2).alias("tx"))
    got = steps.agg(F.corr("step_y", "ty"), F.corr("step_x", "tx")).first()
    assert got[0] > 0.5 and got[1] > 0.5, got  # a shift shows in the intensity by the object's structure only
    # steps lose their common part and are held to max_move; windows stay on the object
    moved = engines.moved(data, truth, engines.Engine(positions="momentum", position_rate=1e6, max_move=0.9)).collect()
    assert len(moved) == 64 and all(math.hypot(r["was_y"], r["was_x"]) <= 0.9 + 1e-9 and 0 <= r["start_y"] <= 24 and 0 <= r["start_x"] <= 24 for r in moved)
    s = engines.reconstruct(data, true_state(), engines.Engine(solver="lsqml", iterations=3, groups=2, positions="momentum", position_rate=200.0, max_move=0.05, update_probe=False, rate=0.0))
    assert s.errors[2] < s.errors[0]


def test_windows_off_the_object_are_refused(spark):
    with pytest.raises(Exception, match="off the object"):
        engines.simulate(scan_starts(spark).withColumn("start_y", F.lit(30).cast("long")), true_state()).count()


def test_modes_share_the_power():
    m = waves.hermite_modes(waves.focused_probe((16, 16), (0.4, 0.4), 0.025, 18.0), 4, 0.7, (2.0, 1.0))
    power = (abs(m) ** 2).sum(axis=(1, 2))
    assert np.allclose(power / power.sum(), [0.7, 0.15, 0.075, 0.075])


def test_electron(spark):
    c = optics.electron_columns(F.lit(200e3))
    got = spark.range(1).select(*[v.alias(k) for k, v in c.items()]).first()
    want = {"total": 710999.06, "momentum": 494367.9034888, "wavelength": 0.02507934741, "gamma": 1.391390152459, "beta": 0.69531442627, "velocity": 208450020.93, "sigma": 7.2883988338e-4}
    for k, v in want.items():
        assert math.isclose(got[k], v, rel_tol=1e-6), k
    zero = spark.range(1).select(optics.electron_columns(F.lit(0.0))["wavelength"].alias("w")).first()
    assert zero["w"] is None


def test_grid_from_scan_with_nan(spark):
    scan = spark.createDataFrame([(-4.8, -1.0), (float("nan"), 3.0), (4.2, 10.0), (0.0, 2.0)], "y double, x double")
    g = grids.object_grid_from_scan(scan, (0.5, 0.5), 2.0).first()
    assert (g["ny"], g["nx"], g["corner_y"], g["corner_x"]) == (27, 31, -6.8, -3.0)


def test_windows(spark):
    obj = grids.index_grid(spark, 20, 20).withColumn("v", (F.col("y") * 2 + F.col("x")).cast("double"))
    starts = spark.createDataFrame([(0, 1, 2), (1, 10, 10), (2, 17, -2)], "pos_id long, start_y long, start_x long")
    got = {(r["pos_id"], r["wy"], r["wx"]): r["v"] for r in cutouts.gather(obj, starts, 4, 4).collect()}
    assert len(got) == 48 and got[0, 3, 1] == 2 * 4 + 3 and got[2, 3, 0] == 1.0 and got[2, 0, 2] == 34.0
    windows = spark.createDataFrame([(p, y, x, float(p + 1)) for p in range(3) for y in range(4) for x in range(4)], "pos_id long, wy long, wx long, v double")
    near = spark.createDataFrame([(0, 0, 0), (1, 2, 2), (2, 0, 0)], "pos_id long, start_y long, start_x long")
    total = cutouts.scatter_add(windows, near, 4, 4)
    assert total.agg(F.sum("v")).first()[0] == 16 * (1 + 2 + 3)
    last = {(r["y"], r["x"]): r["v"] for r in cutouts.scatter_set(obj, windows, near, 4, 4).collect()}
    assert last[3, 3] == 3.0 and last[5, 5] == 2.0 and last[9, 9] == 27.0


def test_ramp_and_unwrap(spark):
    y, x = np.mgrid[:6, :7]
    plane = 0.3 * y - 0.7 * x + 2
    frame = lambda v: spark.createDataFrame([(0, int(a), int(b), float(v[a, b])) for a in range(6) for b in range(7)], "z long, y long, x long, v double")
    assert all(abs(r["v"]) < 1e-9 for r in reduce.remove_ramp(frame(plane), "z").collect())
    phase = 1.7 * y + 2.1 * x
    wrapped = np.angle(np.exp(1j * phase))
    got = np.zeros((6, 7))
    for r in reduce.unwrap(reduce.unwrap(frame(wrapped), "x", "z", "y"), "y", "z", "x").collect():
        got[r["y"], r["x"]] = r["v"]
    assert np.allclose(got, np.unwrap(np.unwrap(wrapped, axis=1), axis=0))


def test_identity_resample(spark):
    img = grids.index_grid(spark, 5, 5).withColumn("v", (F.col("y") * 10 + F.col("x")).cast("double"))
    same = images.resample(img, (5, 5), ((1.0, 0.0), (0.0, 1.0)), (0.0, 0.0))
    assert {(r["y"], r["x"], r["v"]) for r in same.collect()} == {(r["y"], r["x"], r["v"]) for r in img.collect()}


def test_noise_does_not_depend_on_partitions(spark):
    px = spark.range(50).select(F.col("id").alias("pos_id"), F.lit(1).cast("long").alias("ky"), F.lit(2).cast("long").alias("kx"), (F.col("id") * 1.0).alias("v"))
    a = sorted(tuple(r) for r in preprocess.poisson_noise(px.repartition(5), 3.0, 7).collect())
    assert a == sorted(tuple(r) for r in preprocess.poisson_noise(px.coalesce(1), 3.0, 7).collect())


def test_updates_and_groups(spark):
    base = spark.createDataFrame([(0, 2.0), (1, 3.0), (2, 4.0)], "k long, v double")
    change = spark.createDataFrame([(1, 2.0)], "k long, u double")
    want = {"set": 2, "add": 5, "subtract": 1, "multiply": 6, "divide": 1.5, "power": 9, "min": 2, "max": 3}
    for op, v in want.items():
        got = {r["k"]: r["v"] for r in preprocess.indexed_update(base, change, ["k"], op).collect()}
        assert got == {0: 2.0, 1: float(v), 2: 4.0}
    sizes = sorted(r["n"] for r in control.group_sizes(control.even_groups(spark.range(33).withColumnRenamed("id", "pos_id"), 5, 3)).collect())
    assert sizes == [6, 6, 7, 7, 7]


@pytest.mark.parametrize("bad", ["__import__('os')", "i.real", "open(i)", "'a'", "[i]", "x + 1", "exp(i, a=1)"])
def test_schedules_let_nothing_else_in(spark, bad):
    with pytest.raises((ValueError, SyntaxError)):
        control.expression(spark.range(3).withColumnRenamed("id", "i"), bad, 3)


def test_schedule_powers(spark):
    got = [r["value"] for r in control.expression(spark.range(4).withColumnRenamed("id", "i"), "2 ** i + niter", 4).orderBy("i").collect()]
    assert got == [5.0, 6.0, 8.0, 12.0]
