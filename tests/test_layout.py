"""Work that must not grow beside the input: packed rows dealt by recording are not shuffled again."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom import fixtures as X
from trackloom.functions import geometry as G
from trackloom.jobs import queries


def exchanged(df) -> list[str]:
    """What the plan's exchanges deal by, but for broadcasts."""
    return re.findall(r"\bExchange (\w+\([^\n]*?), (?:ENSURE|REPARTITION)", df._jdf.queryExecution().executedPlan().toString())


def test_the_common_clock_shuffles_events_only(spark, small):
    for rows in (queries.clean_landmarks(spark, small), queries.reconstruct(spark, small)):
        assert exchanged(rows) and all(re.match(r"hashpartitioning\(recording#\w+, \d+\)?$", e) for e in exchanged(rows))


def test_the_common_clock_of_undealt_rows_with_clocks_by_recording(spark, small):
    """The same rows, from tables in any order, with offsets for each recording, and NULL arrays where a camera has nothing."""
    kp = X.keypoints(spark, small)
    times = queries.times_of(kp)
    want = queries.timeseries.on_common_clock(kp, spark.sql(X.offsets_sql()), times, 3).orderBy("recording", "tau").collect()
    loose = kp.repartition(5, "t")
    clocks = kp.select("recording").distinct().crossJoin(spark.sql(X.offsets_sql()).where("cam > 0"))
    got = queries.timeseries.on_common_clock(loose, clocks, times.union(times), 3).orderBy("recording", "tau").collect()
    assert got == want and len(got) == times.count()
    blind = queries.timeseries.on_common_clock(loose.where("cam < 2"), clocks, times, 3)
    assert blind.where("u is null and v is null and conf is null").count() == len(want)


@pytest.mark.parametrize("noise", [0.0, 3.0, 200.0])
def test_linear_triangulation_is_the_least_singular_vector(noise):
    cameras = queries._TRUE_RIG
    rng = np.random.default_rng(1)
    points = rng.uniform([-1, -1, 0], [1, 1, 2], (5000, 3))
    xy = np.stack([c.undistort(c.project(points) + rng.normal(0, noise, (5000, 2))) for c in cameras])
    weight = np.where(np.isfinite(xy).all(axis=2), rng.uniform(0.3, 1, (3, 5000)) * (rng.random((3, 5000)) > 0.2), 0)
    got = G.dlt(cameras, xy, weight)
    for k in np.flatnonzero((weight > 0).sum(axis=0) >= 2)[:500]:
        rows = [w * (v * c.matrix[2] - c.matrix[i]) for c, p, w in zip(cameras, xy[:, k], weight[:, k]) if w > 0 for i, v in enumerate(p)]
        x = np.linalg.svd(np.array(rows))[2][-1]
        assert np.allclose(got[k], x[:3] / x[3], rtol=1e-7, atol=1e-9)
    assert np.isnan(got[(weight > 0).sum(axis=0) < 2]).all()


def test_blocks_of_pairs_are_dealt_without_a_shuffle_and_lose_none(spark, small, monkeypatch):
    from trackloom.operators import selfcalib

    rays = queries.studio_rays(spark, small)
    monkeypatch.setattr(selfcalib, "kept", lambda df: df)
    blocks = selfcalib.pair_blocks(rays, 23, 0.6, block=500)
    assert not exchanged(blocks)
    sure = lambda k: F.get("conf", F.lit(k) * 23 + F.col("j")) >= 0.6
    want = {k: rays.select("*", F.explode(F.sequence(F.lit(0), F.lit(22))).alias("j")).where(sure(0) & sure(k)).select(F.xxhash64("recording", "tau", "j").alias("h")) for k in (1, 2)}
    for k, rows in want.items():
        got = blocks.where(F.col("b") == k).select(F.explode("h").alias("h"))
        assert got.exceptAll(rows).count() == rows.exceptAll(got).count() == 0 and rows.count() > 5000
    assert blocks.where(F.size("h") > 500).count() == 0


def test_votes_for_many_matrices_are_those_of_each():
    from trackloom.operators import selfcalib

    rng = np.random.default_rng(2)
    es, x = rng.normal(0, 1, (30, 3, 3)), rng.normal(0, 1, (3000, 4))
    assert selfcalib._votes(es, x, 0.05).tolist() == [(selfcalib._distance(e, x) < 0.05).sum() for e in es]


def test_the_report_triangulates_once(spark, small):
    plan = queries.recording_report(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"MapInArrow work\(recording#\w+, tau#\w+, u#", plan)) == 2  # the damage and the triangulation


@pytest.mark.parametrize("n", [0, 1, 2, 7])
def test_quantiles_are_those_of_percentile(spark, n):
    from trackloom.operators import report

    values = np.random.default_rng(n).normal(size=n)
    rows = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    for share in (0.1, 0.5):
        assert report._quantile(np.append(values, np.nan), share) == rows.agg(F.percentile("v", F.lit(share))).head()[0]


def test_clock_refinement_shuffles_sketches_only(spark, small):
    """What is exchanged besides events and offsets is rows of counts, which have no keypoints; the medians are those of all errors to 0.14 %."""
    from trackloom.operators import rig, sync

    kp = queries.slice_.numbered_cameras(X.studio_keypoints(spark, small), X.STUDIO_CAMERAS)
    times = queries.times_of(kp)
    start = queries.slice_.numbered_cameras(X.from_events(spark, small, X.studio_offsets_sql("spark")), X.STUDIO_CAMERAS)
    found = sync.epipolar_medians(kp, X.camera_rows(), times, start.withColumn("ds", F.array("offset_s", F.col("offset_s") + 0.02)))
    plan = found._jdf.queryExecution().executedPlan().toString()
    union = next(i for i, line in enumerate(plan.splitlines()) if line.strip(" :+-*()0123456789").startswith("Union"))
    assert sum(" Exchange " in line for line in plan.splitlines()[:union]) == 1  # the sketches
    got = {(r.cam, r.k): (r.px, r.n) for r in found.collect()}
    for k, late in ((0, 0.0), (1, 0.02)):
        clocks = start.withColumn("offset_s", F.col("offset_s") + late)
        rays = rig.undistorted(queries.timeseries.on_common_clock(kp, clocks, times, 3), X.camera_rows())
        for cam in (1, 2):
            one, two = queries._TRUE_RIG[0], queries._TRUE_RIG[cam]
            px = rig.sampson_px(rig.pair_points(rays, 0, cam, 23, 0.6), *rig.relative_pose(one, two), (one.k[0, 0] + two.k[0, 0]) / 2)
            want = px.agg(F.percentile("px", F.lit(0.5)).alias("m"), F.count("*").alias("n")).head()
            assert got[cam, k][1] == want.n and abs(got[cam, k][0] / want.m - 1) < 0.003


def test_the_filter_in_blocks_is_the_recursion():
    b, a = G.butterworth(4, 0.5)
    x = np.random.default_rng(3).normal(0, 1, (333, 3))
    state = np.zeros((4, 3))
    assert np.allclose(G._filter(b, a, x, state, 32), G._filter(b, a, x, state, 1000), rtol=0, atol=1e-12)


def test_smoothing_reads_its_rows_once(spark):
    from trackloom.operators import cleaning

    df = spark.range(40).selectExpr("1L as recording", "id / 15D as t", "0 as joint", "if(id % 7 = 0, null, id * 1D) as x", "1D as y", "2D as z", "3 as views")
    out = cleaning.clean_and_smooth(df, 0.01)
    assert "Union" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 40 and out.where("x is null").count() == 6


def test_bundle_adjustment_leaves_no_points_of_its_rounds(spark, small, monkeypatch, tmp_path):
    from trackloom.operators import bundle

    monkeypatch.setattr(bundle, "shared_folder", lambda spark: str(tmp_path / "rounds"))
    found = bundle.refine_rig(queries.clean_synced(spark, small).limit(50), X.camera_rows(), rounds=3)
    kept = [d for d in (tmp_path / "rounds").iterdir() if "x_new" in spark.read.parquet(str(d)).columns]
    assert len(found) == 3 and not kept


def test_agreement_of_models_shuffles_sketches_only_and_counts_repeated_moments(spark, small):
    plan = exchanged(queries.backend_agreement(spark, small))
    assert sum("joint" in e for e in plan) == 1 and all("joint" in e or re.match(r"hashpartitioning\(recording#\w+, \d+\)?$", e) for e in plan)
    a = spark.createDataFrame([("r", 0, 1.0, [0.0], [0.0]), ("r", 0, 1.00001, [9.0], [0.0]), ("r", 0, 2.0, [0.0], [0.0]), (None, 0, 1.0, [0.0], [0.0])], "recording string, cam int, t double, u array<double>, v array<double>")
    b = a.where("t < 2").selectExpr("recording", "cam", "t", "transform(u, x -> x + 3) as u", "transform(v, x -> x + 4) as v")
    assert [tuple(r) for r in queries.pose.backend_agreement(a, b).collect()] == [(0, 0, 5.0)]  # of 5, 5, 12.6 and 7.2
