"""Alignment of patterns, noise models told apart, the probe's first scale, exported images."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_kernels import scan_starts, start_state, true_state

from fringelake.operators import align, engines, export, reduce
from fringelake.plans import prepare, setup
from fringelake.plans.plan import Plan, PlanError, execute

PX = "pos_id long, iy long, ix long, ky long, kx long, v double"


def moved(image, dy, dx):
    """Bilinear reading at a place plus the shift, zero outside; a plain loop."""
    out = np.zeros(image.shape)
    for (y, x), _ in np.ndenumerate(image):
        for (b, a), v in np.ndenumerate(image):
            w = max(0.0, 1 - abs(y + dy - b)) * max(0.0, 1 - abs(x + dx - a))
            out[y, x] += w * v if w else 0.0
    return out


@pytest.mark.parametrize("shape", [(6, 7), (8, 5)])
def test_patterns_come_to_the_middle(spark, shape):
    rng = np.random.default_rng(sum(shape))
    images = rng.random((3, *shape)) + np.array([[[0.0]], [[2.0]], [[5.0]]]) * (np.arange(shape[1]) > 3)
    images[1, 2, 3] = np.nan
    m = (rng.random(shape) > 0.2).astype(float)
    mean = np.nansum(images * m, axis=0)
    k = [np.arange(n) - n // 2 for n in shape]
    want = (k[0][:, None] * mean).sum() / mean.sum(), (k[1] * mean).sum() / mean.sum()
    rows = [(p, 0, p, (y - shape[0] // 2) % shape[0], (x - shape[1] // 2) % shape[1], float(v)) for (p, y, x), v in np.ndenumerate(images)]
    mask = [((y - shape[0] // 2) % shape[0], (x - shape[1] // 2) % shape[1], float(v)) for (y, x), v in np.ndenumerate(m)]
    px, mask = spark.createDataFrame(rows, PX), spark.createDataFrame(mask, "ky long, kx long, m double")
    by = align.centre(px, mask, shape, corner=True).first()
    assert np.allclose([by["dy"], by["dx"]], want)
    got = np.full((3, *shape), -1.0)
    for r in align.shifted(px, want, shape, ["pos_id"], corner=True).collect():
        got[r["pos_id"], (r["ky"] + shape[0] // 2) % shape[0], (r["kx"] + shape[1] // 2) % shape[1]] = r["v"]
    for a, b in zip(got, images):
        assert np.allclose(a, moved(b, *want), equal_nan=True)
    later = np.full(shape, -1.0)
    for r in align.shifted(mask, want, shape, [], corner=True, value="m").collect():
        later[(r["ky"] + shape[0] // 2) % shape[0], (r["kx"] + shape[1] // 2) % shape[1]] = r["m"]
    assert np.allclose(later, moved(m, *want))


def test_nothing_measured_has_no_middle(spark):
    px = spark.createDataFrame([(0, 0, 0, 0, 0, float("nan"))], PX)
    mask = spark.createDataFrame([(0, 0, 1.0)], "ky long, kx long, m double")
    assert tuple(align.centre(px, mask, (1, 1)).first()) == (None, None)
    assert align.shifted(px.where("false"), (0.2, 0.1), (1, 1), ["pos_id"]).count() == 0


def test_a_plan_aligns_patterns_and_mask(spark):
    """Patterns off the middle by whole pixels: the hook brings them back, and what came in from outside is masked."""
    truth = true_state()
    far = np.zeros((16, 16))
    far[:] = np.hypot(*np.meshgrid(np.arange(16) - 8, np.arange(16) - 8, indexing="ij")) < 4
    rows = [(p, p // 2, p % 2, (y + 2 - 8) % 16, (x - 1 - 8) % 16, float(v)) for p in range(4) for (y, x), v in np.ndenumerate(far)]
    x = setup.Experiment(spark.createDataFrame(rows, PX), (2, 2), (16, 16), (0.4, 0.4), truth.lam, (1.2, 1.2), 18.0, 60.0)
    plan = Plan.from_data({"name": "a", "engines": [], "post_init": ["diffraction_align"]})
    patterns, _ = setup.initialise(plan, x)
    for r in patterns.collect():
        got = np.fft.fftshift(np.array(r["data"]).reshape(16, 16))
        outside = np.isnan(got)
        assert np.nansum(got) == far.sum() and np.allclose(np.nan_to_num(got), np.where(outside, 0, far))
        assert outside.sum() == 2 * 16 + 14  # two rows and a column came in
    with pytest.raises(PlanError, match="empty"):
        setup.initialise(plan, setup.Experiment(x.px.withColumn("v", F.lit(0.0)), (2, 2), (16, 16), (0.4, 0.4), truth.lam, (1.2, 1.2), 18.0, 60.0))


def test_noise_models_differ():
    rng = np.random.default_rng(3)
    model, measured = rng.random((2, 4, 4)) + 0.1, rng.random((2, 4, 4)) + 0.1
    for noise, offset in (("amplitude", 0.0), ("anscombe", 0.375)):
        e = engines.Engine(noise=noise, variance=0.1)
        assert e.offset == offset and engines.Engine(noise=noise, offset=0.2).offset == 0.2
        loss, slope = engines.fit(model, measured, e)
        assert np.allclose(loss, ((np.sqrt(model + offset) - np.sqrt(measured + offset)) ** 2).sum(axis=(1, 2)) / 1.1)
        h = 1e-6
        for at in ((0, 1, 2), (1, 3, 0)):
            step = np.zeros(model.shape)
            step[at] = h
            rise = (engines.fit(model + step, measured, e)[0] - engines.fit(model - step, measured, e)[0]).sum() / (2 * h)
            assert np.isclose(slope[at], rise, rtol=1e-5)
    with pytest.raises(ValueError, match="unknown noise model"):
        engines.Engine(noise="rice")


def test_noise_models_of_plans(spark):
    data = engines.simulate(scan_starts(spark), true_state())
    errors = {}
    for noise in ("amplitude", "anscombe", {"type": "amplitude", "offset": 0.375}):
        plan = Plan.from_data({"name": "n", "engines": [{"type": "gradient", "niter": 2, "grouping": 1, "noise_model": noise}]})
        errors[str(noise)] = plan.engines[0](data, start_state()).errors
    plain, root, same = errors.values()
    assert plain != root and np.allclose(root, same)
    with pytest.raises(PlanError) as e:
        Plan.from_data({"name": "n", "engines": [{"type": "gradient", "niter": 1, "noise_model": "rice"}, {"type": "conventional", "niter": 1, "noise_model": {"type": "poisson", "offset": 1.0}}]})
    assert "rice" in str(e.value) and "offset" in str(e.value)


def test_presolve_brings_the_probe_to_the_intensity(spark):
    truth = true_state()
    data = engines.simulate(scan_starts(spark), truth)
    data = data.withColumn("data", F.transform("data", lambda v, k: F.when(k % 5 == 0, float("nan")).otherwise(v)))
    s = true_state()
    s.probe = s.probe * 3
    done = engines.reconstruct(data, s, engines.Engine(solver="lsqml", iterations=0, presolve=True))
    assert np.allclose(done.probe, truth.probe)
    with pytest.raises(ValueError, match="empty"):
        engines.presolved(data, engines.State(truth.obj, truth.probe * 0, truth.step, truth.lam, truth.thickness), engines.Engine())


def test_unwrapped_phases_lose_their_plane(spark):
    """A steep ramp over two slices wraps; unwrapped, it is a plane, which goes."""
    y, x = np.mgrid[:9, :11]
    bump = np.exp(-((y - 4) ** 2 + (x - 5) ** 2) / 4)
    angle = np.stack([0.9 * x - 0.7 * y + bump, 1.1 * x + 0.8 * y])
    rows = [(*map(int, at), float(np.cos(v)), float(np.sin(v))) for at, v in np.ndenumerate(angle)]
    obj = spark.createDataFrame(rows, "z long, y long, x long, re double, im double")
    whole = {(r["y"], r["x"]): r["v"] for r in export.phase_image(obj).collect()}
    a = np.stack([np.ones(99), y.ravel(), x.ravel()], axis=1)
    want = bump - (a @ np.linalg.lstsq(a, bump.ravel(), rcond=None)[0]).reshape(9, 11)
    assert all(np.isclose(whole[at], v, atol=1e-9) for at, v in np.ndenumerate(want))
    roi = F.expr("y < 3")
    held = {(r["y"], r["x"]): r["v"] for r in export.phase_image(obj, roi, crop=False).collect()}
    b = a[: 3 * 11]
    want = bump - (a @ np.linalg.lstsq(b, bump[:3].ravel(), rcond=None)[0]).reshape(9, 11)
    assert len(held) == 99 and all(np.isclose(held[at], v, atol=1e-9) for at, v in np.ndenumerate(want))
    assert export.phase_image(obj, roi, stack=True).count() == 2 * 33


@pytest.mark.parametrize("bits, least", [(8, 0.0), (8, 5.0), (16, 0.2), (64, 0.0)])
def test_levels(spark, bits, least):
    v = np.random.default_rng(bits).normal(size=400)
    img = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "x long, v double")
    lo, hi = np.quantile(v, [0.001, 0.999])
    wider = max(0.0, least - (hi - lo)) / 2
    lo, hi = lo - wider, hi + wider
    got = {r["x"]: int(r["v"]) for r in reduce.robust_scale(img, bits, min_range=least).collect()}
    for i, x in enumerate(v):
        level = 2.0**bits / (hi - lo) * (x - lo)
        want = 2**bits - 1 if level >= 2**bits - 1 else int(max(level, 0))
        assert abs(got[i] - want) <= max(0, 2 ** (bits - 50))


def test_patterns_at_another_shape(spark):
    """Padding and cropping about the zero frequency; other sampling against a plain loop; masked and outer pixels are NaN."""
    rng = np.random.default_rng(8)
    for old, new, ratio in (((6, 7), (8, 9), (1.0, 1.0)), ((8, 8), (6, 4), (1.0, 1.0)), ((8, 6), (10, 9), (0.8, 6 / 9))):
        a = rng.random((3, *old))
        a[1, 4, 2] = np.nan
        rows = [(p, [float(v) for v in np.fft.ifftshift(x).ravel()]) for p, x in enumerate(a)]
        got = {r["pos_id"]: np.fft.fftshift(np.array(r["data"]).reshape(new)) for r in prepare.resized(spark.createDataFrame(rows, "pos_id long, data array<double>"), old, new, ratio).collect()}
        for p in range(3):
            for y, x in np.ndindex(*new):
                v, w = (r * (k - m // 2) + n // 2 for k, m, n, r in zip((y, x), new, old, ratio))
                near = [(b, c, (1 - abs(v - b)) * (1 - abs(w - c))) for b in range(old[0]) for c in range(old[1]) if abs(v - b) < 1 - 1e-12 and abs(w - c) < 1 - 1e-12]
                want = sum(k * a[p, b, c] for b, c, k in near) if np.isclose(sum(k for *_, k in near), 1) else np.nan
                assert np.isclose(got[p][y, x], want, equal_nan=True)


@pytest.mark.parametrize("method", ["pad_crop", "resample"])
def test_windows_stay_where_they_are(spark, method):
    """Another shape moves no position: windows' middles, in Å from where the object began, are as before, and fit the object."""
    s, data = true_state(), engines.simulate(scan_starts(spark), true_state())
    s.corner = (-3.0, 2.0)
    middle = lambda rows, s: {r["pos_id"]: [c + (r[f"start_{a}"] + (n - 1) / 2) * d + r[f"sub_{a}"] for a, n, d, c in zip("yx", s.probe.shape[-2:], s.step, s.corner)] for r in rows}
    was = middle(data.collect(), s)
    p, t = prepare.prepare(data, s, prepare.Preparation((20, 24), method, 3.0, 2, 0.7, (2.0, 3.0)))
    rows = p.collect()
    now = middle(rows, t)
    assert all(np.allclose(was[k], now[k]) for k in was) and len(now) == len(was)
    assert t.probe.shape == (2, 20, 24) and t.thickness == [2.0, 3.0] and len(t.obj) == 2 and len(rows[0]["data"]) == 480
    assert np.allclose(t.step, (0.4 * 16 / 20, 0.4 * 16 / 24) if method == "pad_crop" else (0.4, 0.4))
    for r in rows:
        for k, (a, n) in enumerate(zip("yx", (20, 24))):
            assert r[f"start_{a}"] >= 2 and r[f"start_{a}"] + n <= t.obj.shape[1 + k] - 2 and abs(r[f"sub_{a}"]) <= t.step[k] / 2 + 1e-9
    whole = np.prod(t.obj, axis=0)  # two slices are the one they come from
    assert np.isclose(abs(whole).max(), abs(s.obj[0]).max(), atol=0.05) and s.probe.shape[-2:] == (16, 16) and s.step == (0.4, 0.4)
    assert prepare.prepare(data, s, prepare.Preparation())[1] is s


def test_engines_of_different_shapes_follow_one_another(spark):
    truth = true_state()
    data = engines.simulate(scan_starts(spark), truth)
    seen = []
    first = {"type": "conventional", "niter": 2, "grouping": 2}
    plan = Plan.from_data({"name": "s", "engines": [{**first, "sim_shape": [12, 12]}, {**first, "sim_shape": [16, 16], "probe_modes": 2, "obj_pad_px": 2}]})
    done = execute(plan, data, start_state(), watch=lambda i, e, s: seen.append((i, s.probe.shape)))
    assert seen == [(1, (1, 12, 12)), (2, (1, 12, 12)), (1, (2, 16, 16)), (2, (2, 16, 16))] and len(done.errors) == 4 and np.isfinite(done.errors).all()
    with pytest.raises(PlanError) as e:
        Plan.from_data({"name": "s", "engines": [{**first, "resize_method": "stretch"}, {**first, "sim_shape": [0, 3]}, {**first, "probe_modes": 0}]})
    assert len(str(e.value).splitlines()) == 3


def test_an_earlier_object_grows_to_the_scan(spark):
    truth = true_state()
    rows = [(p, p // 2, p % 2, y, x, 1.0) for p in range(4) for y in range(16) for x in range(16)]
    x = setup.Experiment(spark.createDataFrame(rows, PX), (2, 2), (16, 16), (0.4, 0.4), truth.lam, (1.2, 1.2), 18.0, 60.0)
    plan = Plan.from_data({"name": "g", "engines": []})
    small = setup.initialise(plan, x)[1]
    marked = engines.State(small.obj * 0 + 2, small.probe, small.step, small.lam, small.thickness, corner=small.corner)
    wide = {"name": "g", "engines": [], "scan": {"type": "raster", "step": (6.0, 1.2)}}
    patterns, grown = setup.initialise(Plan.from_data(wide), x, marked)
    fresh = setup.initialise(Plan.from_data(wide), x)[1]
    assert (grown.obj == 2).sum() == marked.obj.size and set(np.unique(grown.obj)) == {1, 2} and grown.obj.shape[1] >= fresh.obj.shape[1]
    at = [int(round((b - c) / 0.4)) for b, c in zip(marked.corner, grown.corner)]
    assert (grown.obj[0, at[0] : at[0] + marked.obj.shape[1], at[1] : at[1] + marked.obj.shape[2]] == 2).all()
    ends = patterns.agg(F.min("start_y"), F.max("start_y") + 16).first()
    assert ends[0] >= 0 and ends[1] <= grown.obj.shape[1]
    with pytest.raises(PlanError, match="pixels of"):
        setup.initialise(plan, x, engines.State(marked.obj, marked.probe, (0.3, 0.3), marked.lam, marked.thickness))
