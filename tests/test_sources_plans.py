"""Sources, state, plans and streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringelake.plans import setup
from fringelake.plans.plan import POST_LOAD, Plan, execute
from fringelake.plans.registry import PlanError, merged
from fringelake.queries.engines import scan_starts, start_state, true_state
from fringelake.operators import engines, grids
from fringelake.sources import frames, metadata, state
from fringelake.streaming import jobs


def test_frames_round_trip(spark, tmp_path):
    r = np.random.default_rng(1).normal(size=(6, 128 * 128)).astype("f4")
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(r)], "pos_id long, data array<float>")
    path = str(tmp_path / "scan_x3_y2.raw")
    frames.write_frames(df, path)
    back = frames.read_frames(spark, path).orderBy("pos_id").collect()
    assert [(b["iy"], b["ix"]) for b in back] == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2)]
    assert np.array_equal(np.array([b["data"] for b in back], "f4"), r)
    with pytest.raises(Exception, match="scan has"):
        frames.read_frames(spark, path, (5, 5)).collect()
    assert frames.border_masked(frames.read_frames(spark, path)).where("pos_id = 0").agg(F.sum("m")).first()[0] == 124 * 124


def test_metadata_version(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"version": "2.0", "voltage": 200e3, "scan_shape": [4, 5], "extra": {"a": 1}}))
    got = metadata.read_metadata(spark, str(tmp_path / "a.json")).first()
    assert got["voltage"] == 200e3 and list(got["scan_shape"]) == [4, 5] and got["defocus"] is None
    (tmp_path / "b.json").write_text(json.dumps({"version": "1.0"}))
    with pytest.raises(Exception, match="version"):
        metadata.read_metadata(spark, str(tmp_path / "b.json")).collect()


def test_state_round_trip(spark, tmp_path):
    scan = spark.createDataFrame([(0, 1.0, 2.0)], "pos_id long, y double, x double")
    state.write_state(spark, str(tmp_path / "s"), {"scan": scan}, 0.025)
    tables, lam = state.read_state(spark, str(tmp_path / "s"))
    assert lam == 0.025 and tables["scan"].collect() == scan.collect()
    with pytest.raises(ValueError, match="incomplete"):
        state.complete(tables)
    with pytest.raises(ValueError, match="lacks"):
        state.checked("tilt", scan)


def test_plans(spark):
    plan = Plan.from_yaml_all("name: a\nengines:\n- {type: conventional, niter: 2, grouping: 2}\n- {type: gradient, niter: 1}\npost_load: [{type: scale, scale: 2.0}]\n")[0]
    with pytest.raises(PlanError) as e:
        Plan.from_data({"name": "b", "engines": [{"type": "conventional"}, "none"], "post_load": [{"type": "scale", "size": 1}]})
    assert len(str(e.value).splitlines()) == 4
    with pytest.raises(PlanError, match="not allowed"):
        POST_LOAD.parse("os:system")
    s = execute(plan, engines.simulate(scan_starts(spark), true_state()), start_state())
    assert len(s.errors) == 3 and s.errors[-1] < s.errors[0]
    assert merged({"a": {"type": "x", "p": 1, "q": 2}, "b": 1}, {"a": {"p": 3}, "c": 2}) == {"a": {"type": "x", "p": 3, "q": 2}, "b": 1, "c": 2}
    assert merged({"a": {"type": "x", "p": 1}}, {"a": {"type": "y"}}) == {"a": {"type": "y"}}


def test_a_whole_plan(spark):
    """Patterns of a known object; the plan crops, drops, makes probe, scan and object ready and runs two engines."""
    truth = true_state()
    scan = grids.raster_scan(spark, 8, 8, (1.2, 1.2))
    g = grids.object_grid_from_scan(scan, (0.4, 0.4), 4.0).first()
    rng = np.random.default_rng(2)
    truth.obj = np.exp(0.3j * rng.normal(size=(1, g["ny"], g["nx"])))
    data = engines.simulate(grids.cutout_index(scan, (g["corner_y"], g["corner_x"]), (0.4, 0.4), (16, 16)), truth).join(scan.select("pos_id", "iy", "ix"), "pos_id")
    px = data.select("pos_id", "iy", "ix", F.posexplode("data").alias("k", "v")).select("pos_id", "iy", "ix", F.floor(F.col("k") / 16).alias("ky"), (F.col("k") % 16).alias("kx"), "v")
    x = setup.Experiment(px, (8, 8), (16, 16), (0.4, 0.4), truth.lam, (1.2, 1.2), 18.0, 60.0)
    engine = {"type": "conventional", "niter": 3, "grouping": 2, "group_constraints": [{"type": "clamp_amplitude", "amplitude": 1.2}]}
    plan = Plan.from_data({"name": "w", "seed": 5, "engines": [engine, {"type": "gradient", "niter": 1, "grouping": 2, "regularizers": [{"type": "tv", "cost": 1e-4}]}], "post_load": [{"type": "crop_data", "y": [0, 7], "x": [None, None]}], "post_init": ["drop_nans"], "object": {"type": "random", "sigma": 1e-3}})
    patterns, state = setup.initialise(plan, x)
    assert patterns.count() == 56 and state.probe.shape == (1, 16, 16) and np.isclose((abs(state.probe) ** 2).sum(), (abs(truth.probe) ** 2).sum(), rtol=1e-3)
    done = setup.run(plan, x)
    assert len(done.errors) == 4 and done.errors[2] < done.errors[0] and abs(done.obj).max() <= 1.25
    again = setup.run(Plan.from_data({"name": "w", "engines": [engine], "post_load": [{"type": "crop_data", "y": [0, 7], "x": [None, None]}]}), x, done)
    assert again.errors[0] < done.errors[0]  # from the earlier state on
    with pytest.raises(PlanError, match="no step"):
        setup.initialise(plan, setup.Experiment(px, (8, 8), (16, 16), (0.4, 0.4), truth.lam))
    with pytest.raises(PlanError, match="patterns at"):
        setup.initialise(Plan.from_data({"name": "w", "engines": []}), setup.Experiment(px.where("pos_id > 3"), (8, 8), (16, 16), (0.4, 0.4), truth.lam, (1.2, 1.2), 18.0))


def test_crop_hook_uses_slices(spark):
    px = spark.createDataFrame([(y * 4 + x, y, x, 0, 0, 1.0) for y in range(3) for x in range(4)], "pos_id long, iy long, ix long, ky long, kx long, v double")
    got = POST_LOAD.parse({"type": "crop_data", "y": (1, None), "x": (None, -1)})(px, (3, 4)).orderBy("pos_id").collect()
    assert [(r["pos_id"], r["iy"], r["ix"]) for r in got] == [(0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 1, 0), (4, 1, 1), (5, 1, 2)]


def test_job_stream(spark, tmp_path):
    rows = spark.sql("SELECT id % 3 AS job_id, concat('s', id) AS status, id AS event_id, timestamp_seconds(id) AS ts FROM range(10)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = jobs.last_status(stream, "job_id").writeStream.outputMode("complete").format("memory").queryName("statuses").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["job_id"], r["status"]) for r in spark.sql("SELECT * FROM statuses").collect()} == {(0, "s9"), (1, "s7"), (2, "s8")}
