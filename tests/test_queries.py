"""A sample of the queries against their SQL in DuckDB at the smallest size."""

import duckdb
import pytest

from pyspark.sql import functions as F

import __spark_entry__ as entry

NAMES = ["frame_timing", "asof_interpolate", "asof_nearest", "track_summary", "actor_boxes", "series_windows", "triangulate", "bone_outliers", "fill_gaps", "board_view_funnel", "bad_views", "fingerprints", "frame_at", "thin_by_time", "common_clock"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, small, name):
    got = entry.queries()[name](spark, small).toPandas()
    db = duckdb.connect()
    for table in ("events", "lineitem"):
        db.sql(f"create view {table} as select * from '{small}/{table}.parquet'")
    want = db.sql(entry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want)
    got, want = (d[columns].sort_values(columns).reset_index(drop=True) for d in (got, want))
    for c in columns:
        assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and rows[0].valid > 0.95 and rows[0].arm_swaps > 100


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_queries_take_all_times_and_rows_and_see_a_do_nothing_stand_in(spark, small, monkeypatch):
    """Stand-ins that return their input note what they are given, and fail against the SQL."""
    import duckdb

    from trackloom import fixtures as X
    from trackloom.jobs import queries

    seen = {}

    def refine_offsets(kp, cameras, times, start):
        seen["times"] = times.count()
        return start

    def refine_rigs(synced, cameras):
        seen["rows"] = synced.count()
        return cameras

    monkeypatch.setattr(queries.sync, "refine_offsets", refine_offsets)
    monkeypatch.setattr(queries.bundle, "refine_rigs", refine_rigs)
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{small}/events.parquet'")
    for name in ("refine_offsets", "refine_rig"):
        cur = con.execute(queries.SQL[name])
        names = [d[0] for d in cur.description]
        assert sorted(map(tuple, queries.QUERIES[name](spark, small).select(*names).collect())) != sorted(cur.fetchall())
    assert seen == {"times": queries.times_of(X.studio_keypoints(spark, small).where("cam = 'cam1'").withColumn("cam", F.lit(0))).count(), "rows": queries.clean_synced(spark, small).count()}


def test_the_whole_way_on_names(spark, small):
    from trackloom import fixtures as X

    got = {row.recording: row for row in entry.queries()["scene_from_keypoints"](spark, small).collect()}
    assert set(got) == {f"r{row.recording}" for row in X.frames(spark, small).select("recording").distinct().collect()}
    assert all(row.points > 10_000 and 0.7 < row.z < 1.3 and row.last_s > row.first_s for row in got.values())


def test_a_rig_is_calibrated_from_points(spark, small):
    import numpy as np

    from trackloom import fixtures as X
    from trackloom.jobs import queries
    from trackloom.operators import reconstruction, rig, selfcalib

    rays = queries.studio_rays(spark, small)
    blocks = selfcalib.pair_blocks(rays, 23, 0.6, block=500)
    assert blocks.groupBy("rig", "b", "part").count().where("count > 1").count() == 0
    poses = selfcalib.relative_poses(blocks, X.FOCAL, hypotheses=50)
    true = reconstruction.camera_list(X.camera_rows())
    base = np.linalg.norm(rig.relative_pose(true[0], true[1])[1])
    found = {r.b: r for r in selfcalib.chained(rays, poses, 23).collect()}
    assert set(found) == {1, 2} and all(r.rig == "one" for r in found.values())
    for b, row in found.items():
        want_r, want_t = rig.relative_pose(true[0], true[b])
        assert np.abs(np.array(row.r).reshape(3, 3) - want_r).max() < 0.001 and np.abs(np.array(row.t) - want_t / base).max() < 0.003
    assert selfcalib.relative_poses(blocks.limit(0), X.FOCAL).count() == 0


def test_marks_that_one_camera_sees_give_no_point_and_no_scale(spark, small):
    from trackloom import fixtures as X
    from trackloom.jobs import queries
    from trackloom.operators import reconstruction, selfcalib

    rows, cameras = queries.rig_landmarks(spark, small)
    camera = reconstruction.camera_list(X.camera_rows())[0]
    u, v = (float(x) for x in camera.project(camera.center[None] * 0.0)[0])
    marks = spark.createDataFrame([("one", "a", 0, u, v), ("one", "a", 1, None, None), ("one", "b", 0, u, v)], "rig string, mark string, cam int, u double, v double")
    assert selfcalib.marked_points(marks, cameras).count() == 0
    known = spark.createDataFrame([("one", 0, "a", 1.0, 1.0, 0.0, [0.0, 0.0, 1.0])], "rig string, recording long, mark string, time_s double, length_m double, hand_offset_m double, up array<double>")
    assert selfcalib.handle_scales(marks, rows, cameras, known).count() == 0
    assert selfcalib.fit_floors(rows.limit(0), cameras).count() == 0
