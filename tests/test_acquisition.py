"""Detector files, tilts, metadata as a plan's source, the folder of a run, and logs put in order by streaming state."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringelake.operators import control, engines, waves
from fringelake.plans import output, setup
from fringelake.plans.plan import Plan
from fringelake.plans.registry import PlanError
from fringelake.queries.engines import scan_starts, start_state, true_state
from fringelake.sources import frames, tilts
from fringelake.streaming import jobs, ordered

EVENTS = "/root/testdata/sf0.001/events.parquet"


def patterns(spark, n, seed=1):
    r = np.random.default_rng(seed).random((n, 128 * 128)).astype("f4")
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(r)], "pos_id long, data array<float>").repartition(4), r


def names(folder):
    return sorted(f for f in os.listdir(folder) if not f.startswith("."))


def test_frames_are_committed_in_parts(spark, tmp_path):
    df, r = patterns(spark, 150)
    path = str(tmp_path / "scan")
    frames.write_frames(df, path, (10, 15))
    parts = [f for f in names(path) if f.endswith(".raw")]
    assert len(parts) > 1 and names(path) == sorted([frames.MANIFEST, *parts])
    back = frames.read_frames(spark, path).orderBy("pos_id").collect()
    assert [(b["pos_id"], b["iy"], b["ix"]) for b in back] == [(k, k // 15, k % 15) for k in range(150)]
    assert np.array_equal(np.array([b["data"] for b in back], "f4"), r)
    # in order, the parts are the detector's single file
    single = tmp_path / "single_x15_y10.raw"
    single.write_bytes(b"".join((tmp_path / "scan" / p).read_bytes() for p in parts))
    same = frames.read_frames(spark, f"file://{single}").orderBy("pos_id").collect()
    assert same == back
    with pytest.raises(Exception, match="there already"):
        frames.write_frames(df, path)
    fewer, few = patterns(spark, 6, 2)
    frames.write_frames(fewer, path, (2, 3), overwrite=True)
    again = frames.read_frames(spark, path).orderBy("pos_id").collect()
    assert np.array_equal(np.array([b["data"] for b in again], "f4"), few) and not set(parts) & set(names(path))


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    df, _ = patterns(spark, 20)
    cases = {
        "missing": df.where("pos_id <> 7"), "twice": df.unionByName(df.where("pos_id = 3")), "pixels": df.withColumn("data", F.when(F.col("pos_id") == 19, F.array(F.lit(1.0))).otherwise(F.col("data"))),
        "id": df.withColumn("pos_id", F.when(F.col("pos_id") != 5, F.col("pos_id"))),
    }
    for name, bad in cases.items():
        path = tmp_path / name
        with pytest.raises(Exception):
            frames.write_frames(bad, str(path), (4, 5))
        assert not path.exists(), name
    good = tmp_path / "good"
    frames.write_frames(df, str(good), (4, 5))
    before = names(good)
    with pytest.raises(Exception):
        frames.write_frames(cases["missing"], str(good), (4, 5), overwrite=True)
    assert names(good) == before and frames.read_frames(spark, str(good)).count() == 20
    os.remove(good / frames.MANIFEST)
    with pytest.raises(Exception, match="not written to its end"):
        frames.read_frames(spark, str(good)).count()
    frames.write_frames(df.where("false"), str(tmp_path / "none"), (0, 0))
    assert frames.read_frames(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("flat", [False, True])
@pytest.mark.parametrize("order", ["C", "F"])
@pytest.mark.parametrize("kind", ["<f4", ">f8", "<i2"])
def test_tilt_files(spark, tmp_path, flat, order, kind, monkeypatch):
    monkeypatch.setattr(tilts, "PER_TASK", 5)
    t = (np.random.default_rng(3).normal(size=(3, 4, 2)) * 10).astype(kind)
    np.save(tmp_path / "t.npy", np.array(t.reshape(12, 2) if flat else t, order=order))
    got = tilts.read_tilts(spark, str(tmp_path / "t.npy"), (3, 4)).orderBy("pos_id").collect()
    assert [r["pos_id"] for r in got] == list(range(12))
    assert np.array_equal([(r["ty"], r["tx"]) for r in got], t.reshape(12, 2).astype(float))


def test_tilt_files_that_do_not_fit(spark, tmp_path):
    for a, match in ((np.zeros((4, 3, 2)), "does not fit"), (np.zeros((11, 2)), "does not fit"), (np.zeros(24), "does not fit"), (np.zeros((12, 2), complex), "real numbers")):
        np.save(tmp_path / "t.npy", a)
        with pytest.raises(Exception, match=match):
            tilts.read_tilts(spark, str(tmp_path / "t.npy"), (3, 4)).collect()
    (tmp_path / "t.npy").write_bytes(b"not an array")
    with pytest.raises(Exception, match="no array file"):
        tilts.read_tilts(spark, str(tmp_path / "t.npy"), (3, 4)).collect()
    np.save(tmp_path / "t.npy", np.zeros((12, 2)))
    (tmp_path / "t.npy").write_bytes((tmp_path / "t.npy").read_bytes()[:-8])
    with pytest.raises(Exception, match="do not hold"):
        tilts.read_tilts(spark, str(tmp_path / "t.npy"), (3, 4)).collect()


def test_each_position_has_its_tilt(spark):
    """Model and engines against propagators that are made for each position's tilt alone."""
    s = true_state()
    s.obj = np.exp(0.2j * np.random.default_rng(4).normal(size=(2, *s.obj.shape[1:])))
    s.thickness = [30.0, 30.0]
    starts = scan_starts(spark).where("pos_id < 6").withColumns({"ty": F.col("pos_id") * 2.0 - 3, "tx": 5.0 - F.col("pos_id")})
    made = engines.simulate(starts, s).collect()
    for r in made:
        one = engines.State(s.obj, s.probe, s.step, s.lam, s.thickness)
        prop = [waves.propagator(s.probe.shape[-2:], s.step, s.lam, 30.0, (r["ty"], r["tx"]))]
        one.props = lambda prop=prop: prop
        plain = engines.simulate(scan_starts(spark).where(F.col("pos_id") == r["pos_id"]), one).first()
        assert np.allclose(r["data"], plain["data"], rtol=1e-9, atol=1e-12)
    table = engines.simulate(starts, s)
    fit = engines.step_sums(table, s, engines.Engine("lsqml"))
    assert fit["error"] / fit["n"] < 1e-9
    assert engines.step_sums(table.drop("ty", "tx"), s, engines.Engine("lsqml"))["error"] > 1e-4


@pytest.mark.parametrize("solver, noise", [("lsqml", "amplitude"), ("adam", "amplitude"), ("adam", "poisson")])
def test_masked_pixels_add_nothing(spark, solver, noise):
    truth = true_state()
    made = engines.simulate(scan_starts(spark).where("pos_id < 4"), truth)
    e = engines.Engine(solver, noise=noise)
    wrong = made.withColumn("data", F.transform("data", lambda v, k: F.when(k % 7 == 0, float("nan")).otherwise(v)))
    true = engines.step_sums(made, truth, e)
    masked = engines.step_sums(wrong, truth, e)
    assert np.isfinite(masked["d_obj"]).all() and np.isfinite(masked["error"])
    if noise == "amplitude" and solver == "adam":
        assert abs(masked["d_obj"]).max() < 1e-9
    assert masked["error"] <= true["error"] + 1e-9


def acquired(spark, folder, **more):
    df, r = patterns(spark, 6)
    frames.write_frames(df, str(folder / "raw"), (2, 3))
    meta = {"version": "2.0", "raw_filename": "raw", "voltage": 300e3, "diff_step": 0.8, "conv_angle": 20.0, "defocus": 2e-8, "scan_shape": [3, 2], "scan_step": [2e-10, 1e-10], "adu": 2.0, "scan_correction": [[1.0, 0.1], [0.2, 0.9]], **more}
    (folder / "meta.json").write_text(json.dumps(meta))
    return r


def test_metadata_alone_start_a_plan(spark, tmp_path):
    r = acquired(spark, tmp_path)
    plan = Plan.from_data({"name": "m", "engines": [], "raw_data": {"type": "detector", "path": str(tmp_path / "meta.json")}})
    x = setup.load(spark, plan)
    assert x.scan_shape == (2, 3) and np.allclose(x.scan_step, (1.0, 2.0)) and x.conv_angle == 20.0 and np.isclose(x.defocus, 200.0)
    assert np.isclose(x.lam, 0.0196875, rtol=1e-4) and np.allclose(x.step, x.lam / 0.8e-3 / 128)
    assert x.scan_affine == ((0.9, 0.2), (0.1, 1.0))
    one = {(p["ky"], p["kx"]): p["v"] for p in x.px.where("pos_id = 4").collect()}
    centred = np.fft.ifftshift(r[4].reshape(128, 128)) / 2
    assert all(one[y, c] == centred[y, c] for y in range(0, 128, 9) for c in range(0, 128, 7))
    made, state = setup.initialise(plan, x)
    assert made.count() == 6 and state.probe.shape == (1, 128, 128)
    edge = np.isnan(np.fft.fftshift(np.array(made.where("pos_id = 4").first()["data"]).reshape(128, 128)))
    assert edge.sum() == 128 * 128 - 124 * 124 and not edge[2:-2, 2:-2].any()
    # what the plan gives comes first, and simulated frames are not scaled
    acquired_again = tmp_path / "sim"
    acquired_again.mkdir()
    acquired(spark, acquired_again, file_type=setup.SIMULATED)
    y = setup.RAW.parse({"type": "detector", "path": str(acquired_again / "meta.json"), "kv": 80.0, "diff_step": 1.0})(spark)
    assert np.isclose(y.lam, 0.04176, rtol=1e-3) and y.px.agg(F.max("v")).first()[0] > 0.9
    with pytest.raises(PlanError, match="kv is neither(.|\n)*diff_step is neither"):
        setup.RAW.parse({"type": "detector", "path": str(tmp_path / "raw")})(spark)
    with pytest.raises(PlanError, match="no raw_data"):
        setup.load(spark, Plan.from_data({"name": "m", "engines": []}))
    bare = setup.RAW.parse({"type": "detector", "path": str(tmp_path / "raw"), "kv": 300.0, "diff_step": 0.8})(spark)
    assert bare.scan_shape == (2, 3) and bare.scan_step is None


def test_tilts_reach_the_patterns(spark, tmp_path):
    acquired(spark, tmp_path)
    t = np.arange(12.0).reshape(2, 3, 2)
    np.save(tmp_path / "t.npy", t)
    raw = {"type": "detector", "path": str(tmp_path / "meta.json")}
    plan = Plan.from_data({"name": "m", "engines": [], "raw_data": raw, "tilt": {"type": "custom", "path": str(tmp_path / "t.npy")}})
    x = setup.load(spark, plan)
    got = setup.initialise(plan, x)[0].select("pos_id", "ty", "tx").orderBy("pos_id").collect()
    assert [(r["ty"], r["tx"]) for r in got] == [tuple(v) for v in t.reshape(6, 2)]
    plan = Plan.from_data({"name": "m", "engines": [], "tilt": {"type": "global", "tilt": [1.0, -2.0]}})
    assert {(r["ty"], r["tx"]) for r in setup.initialise(plan, x)[0].collect()} == {(1.0, -2.0)}


def small(spark, **more):
    data = engines.simulate(scan_starts(spark), true_state())
    return data, Plan.from_data({"name": "run 1", "engines": [{"type": "conventional", "niter": 3, "grouping": 2}], **more})


def saved(spark, monkeypatch, plan, data):
    """Runs the plan from patterns that are ready."""
    monkeypatch.setattr(setup, "initialise", lambda *_: (data, start_state()))
    return setup.run(plan, setup.Experiment(data, (1, 1), (8, 8), (1.0, 1.0), 0.02))


def test_a_run_has_a_folder(spark, tmp_path, monkeypatch):
    data, plan = small(spark, save={"out_dir": str(tmp_path) + "/{name}", "every": 2})
    done = saved(spark, monkeypatch, plan, data)
    folder = str(tmp_path / "run 1")
    assert output.finished(spark, folder) and not [f for f in os.listdir(folder) if f.startswith("_")]
    rows = output.artefacts(spark, folder).orderBy("iteration").collect()
    assert [(r["name"], r["kind"], r["iteration"]) for r in rows] == [("state_iter00002", "state", 2), ("state_iter00003", "state", 3)] and all(r["bytes"] > 0 for r in rows)
    back = output.load_state(spark, f"{folder}/state_iter00003", done.step, done.thickness)
    assert np.allclose(back.obj, done.obj) and np.allclose(back.probe, done.probe) and back.errors == done.errors and back.lam == done.lam
    with pytest.raises(FileExistsError):
        saved(spark, monkeypatch, plan, data)


def test_a_failed_run_leaves_no_marker(spark, tmp_path):
    folder = str(tmp_path / "r")
    with pytest.raises(RuntimeError):
        with output.OutputRun(spark, folder) as out:
            out.table("first", spark.range(3))
            raise RuntimeError("stopped")
    assert not output.finished(spark, folder) and [r["name"] for r in output.artefacts(spark, folder).collect()] == ["first"] and names(folder) == ["first", "manifest"]
    with pytest.raises(Exception, match="broken"):
        with output.OutputRun(spark, folder) as out:
            out.table("second", spark.range(3).selectExpr("CAST(raise_error('broken') AS INT) AS a"))
    assert names(folder) == ["first", "manifest"]
    with output.OutputRun(spark, folder) as out:
        out.table("first", spark.range(5))
    assert output.finished(spark, folder) and spark.read.parquet(f"{folder}/first").count() == 5
    assert output.artefacts(spark, str(tmp_path / "nothing")).count() == 0


def test_output_names():
    with pytest.raises(PlanError, match="unknown hook(.|\n)*unknown field"):
        Plan.from_data({"name": "a", "engines": ["none"], "save": "x/{nam}"})
    for bad in ("x/{nam}", "{", "{name.a}", "{0}", "/"):
        with pytest.raises(PlanError, match="out_dir"):
            Plan.from_data({"name": "a", "engines": [], "save": bad})
    with pytest.raises(PlanError, match="state_name"):
        Plan.from_data({"name": "a", "engines": [], "save": {"out_dir": "x", "state_name": "{iteration}"}})
    with pytest.raises(PlanError, match="unknown property"):
        Plan.from_data({"name": "a", "engines": [], "save": {"out_dir": "x", "often": 2}})


def test_streams_put_a_log_in_order(spark, tmp_path):
    """All events, out of order in many files, give the rows of the batch operators."""
    batch = spark.read.parquet(EVENTS).select((F.col("user_id") % 50).alias("job_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("status"))
    ends = batch.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    span = (ends["b"] - ends["a"]).total_seconds()
    late = span / 8  # an event comes up to so much later than its time
    came = (F.unix_micros("ts") / 1e6 - ends["a"].timestamp()) + late * F.pmod(F.xxhash64("event_id"), F.lit(1000)) / 1000
    files = batch.withColumn("file", F.floor(came / (span / 3)))
    folder = str(tmp_path / "in")
    schema = batch.schema
    for k in sorted(r["file"] for r in files.select("file").distinct().collect()):
        files.where(F.col("file") == k).drop("file").orderBy(F.xxhash64("event_id")).coalesce(1).write.mode("append").parquet(folder)
    awkward = spark.sql("SELECT CAST(NULL AS BIGINT) AS job_id, 9L AS event_id, CAST(NULL AS TIMESTAMP) AS ts, 'x' AS status UNION ALL SELECT -1L, 10L, timestamp'2100-01-01', NULL UNION ALL SELECT -1L, 11L, timestamp'2200-01-01', NULL UNION ALL SELECT 1L, 12L, timestamp'9000-01-01', 'x'")
    for k in (9, 12, 10, 11):  # the far ones close all buckets before them
        awkward.where(F.col("event_id") == k).coalesce(1).write.mode("append").parquet(folder)
    ordered.use_state_store(spark)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    gap = span / 400
    out = ordered.ordered_log(stream, "job_id", f"{int(late) + 3600} seconds", max(1, int(span / 50)), gap)
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    got = spark.read.parquet(str(tmp_path / "out")).where("job_id >= 0")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(got.select("job_id", "event_id", "i")) == rows(control.numbered(batch, "job_id").select("job_id", "event_id", "i"))
    wide = rows(control.throttled(batch, "job_id", gap).select("job_id", "event_id"))
    assert rows(got.where("published").select("job_id", "event_id")) == wide and 0 < len(wide) < batch.count()
    last = got.groupBy("job_id").agg(F.max_by(F.struct("status", "event_id"), "i").alias("m")).select("job_id", "m.status", "m.event_id")
    assert rows(last) == rows(control.last_status(batch, "job_id"))


def test_streams_merge(spark, tmp_path):
    for k in range(2):
        spark.range(5 * k, 5 * k + 5).coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
    read = [spark.readStream.schema("id long").parquet(str(tmp_path / f"in{k}")) for k in range(2)]
    q = jobs.progress_sink(jobs.merged(*read), str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(10))
