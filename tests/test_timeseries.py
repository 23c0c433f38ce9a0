import pytest
from pyspark.sql import functions as F

from trackloom.operators import calibration, cleaning, timeseries, tracks
from trackloom.streaming.ingest import add_batch, ingest_pose_chunks, ingested

KP = "recording long, cam int, t double, u array<double>, v array<double>, conf array<double>"


def at(spark, times, obs, gap=0.15):
    kp = spark.createDataFrame([(1, 0, t, [x], [x], [c]) for t, x, c in obs], KP)
    asked = spark.createDataFrame([(1, 0, float(t)) for t in times], "recording long, cam int, t double")
    rows = {r.t: r for r in timeseries.asof_interpolate(kp, asked, gap).collect()}
    return [(rows[float(t)].u[0] if rows[float(t)].u else None, rows[float(t)].conf[0]) for t in times]


def test_interpolation_rules(spark):
    obs = [(0.0, 0.0, 0.9), (0.1, 10.0, 0.8), (0.5, 50.0, 0.7), (0.6, None, 0.6), (0.7, 70.0, 0.5)]
    got = at(spark, [0.0, 0.05, 0.1, 0.3, 0.5, 0.55, 0.65, 0.8, -0.1], obs)
    assert got[0] == (0.0, 0.9)  # the first row stands alone
    assert abs(got[1][0] - 5) < 1e-9 and got[1][1] == 0.8
    assert abs(got[2][0] - 10) < 1e-9 and got[2][1] == 0.8  # an exact hit takes the lesser confidence
    assert got[3] == (None, 0.0)  # never across a gap
    assert got[4] == (None, 0.0)  # an exact hit after a gap
    assert got[5][0] is None and got[6][0] is None  # a missing neighbour
    assert got[7] == (None, 0.0) and got[8] == (None, 0.0)


def test_nearest_prefers_the_later_of_two(spark):
    left = spark.createDataFrame([(1, 0.5)], "recording long, t double")
    right = spark.createDataFrame([(1, 0.4375, 1), (1, 0.5625, 2), (2, 0.5, 3)], "recording long, t double, x int")
    assert [r.x for r in timeseries.asof_nearest(left, right, ["recording"], ["x"]).collect()] == [2]
    assert timeseries.asof_nearest(left, right, ["recording"], ["x"], 0.01).count() == 0


def test_thinning_counts_from_the_last_kept_frame(spark):
    f = spark.createDataFrame([(1, 0, t) for t in (0.0, 0.09, 0.1, 0.19, 0.25, 0.3)], "recording long, cam int, t double")
    assert sorted(r.t for r in timeseries.thin_by_time(f, 0.1).collect()) == [0.0, 0.1, 0.25]


def test_median_of_five_repeats_the_ends(spark):
    s = spark.createDataFrame([(1, float(i), float(x)) for i, x in enumerate([9, 1, 2, 3, 4, 50])], "k int, t double, x double")
    assert [r.x for r in timeseries.rolling_median(s, ["x"], ["k"]).orderBy("t").collect()] == [9.0, 3.0, 3.0, 3.0, 4.0, 50.0]
    short = s.where("t < 5")
    assert [r.x for r in timeseries.rolling_median(short, ["x"], ["k"]).orderBy("t").collect()] == [9.0, 1.0, 2.0, 3.0, 4.0]


def test_gaps_and_segments(spark):
    rows = [(1, i / 10, 0, None if i in (3, 12, 13, 14, 15, 16, 17) or i == 0 else float(i)) for i in range(25)]
    d = spark.createDataFrame(rows, "recording long, t double, joint int, x double").withColumn("y", F.col("x")).withColumn("z", F.col("x"))
    got = {round(r.t * 10): r for r in cleaning.segments(cleaning.fill_gaps(d)).collect()}
    assert got[3].filled and abs(got[3].x - 3) < 1e-9 and not got[14].filled and got[14].x is None and got[0].x is None
    assert [got[i].segment for i in (1, 11, 14, 18)] == [1, 1, None, 2]
    few = d.where("t < 0.9")
    assert cleaning.fill_gaps(few).where("filled").count() == 0


def test_smoothing_keeps_constants_and_short_segments(spark):
    rows = [(1, i / 15, j, 2.0 if j == 0 else float(i % 2)) for j, n in ((0, 40), (1, 15)) for i in range(n)]
    d = spark.createDataFrame(rows, "recording long, t double, joint int, x double").withColumn("y", F.col("x")).withColumn("z", F.col("x"))
    got = cleaning.clean_and_smooth(d).collect()
    assert len(got) == 55 and all(abs(r.x - 2) < 1e-9 for r in got if r.joint == 0)
    assert {r.x for r in got if r.joint == 1} == {0.0, 1.0}


def test_bone_outlier_hides_the_next_limb(spark, small):
    from trackloom import fixtures as X

    rows = [(1, float(i), *[[b[k] + (0.5 if j == 7 and i == 3 and k == 0 else 0) for j, b in enumerate(X.BODY)] for k in range(3)]) for i in range(9)]
    d = spark.createDataFrame(rows, "recording long, tau double, x array<double>, y array<double>, z array<double>")
    got = {r.tau: r for r in cleaning.reject_bone_outliers(d).collect()}
    assert got[3.0].x[7] is None and got[3.0].x[9] is not None and got[3.0].dropped == 1 and got[4.0].dropped == 0


def test_chains_follow_the_cheapest(spark):
    s = spark.createDataFrame(
        [(1, 0, 2, 0.0, 5.0, 10, 400.0, 0.0, 0.0, 400.0, 0.0), (1, 0, 7, 6.0, 9.0, 10, 300.0, 410.0, 0.0, 700.0, 0.0), (1, 0, 9, 6.5, 9.0, 10, 100.0, 420.0, 0.0, 500.0, 0.0), (1, 0, 1, 0.0, 9.0, 10, 1.0, 0.0, 0.0, 1.0, 0.0)],
        "recording long, cam int, track_id int, t0 double, t1 double, n long, path_px double, start_x double, start_y double, end_x double, end_y double",
    )
    assert [r.track_id for r in tracks.stitch_tracks(s).orderBy("position").collect()] == [2, 7]


def test_view_choice_spreads(spark):
    rows = [(0, v, v * 1.0, p, (v % 4) * 300 + p * 10.0, 100.0, 50.0) for v in range(8) for p in range(6)]
    d = spark.createDataFrame(rows, "cam int, view long, t double, point_id int, u double, v double, sharpness double")
    chosen = [r.view for r in calibration.select_views(d, (1280, 1024), 4).collect()]
    assert len(chosen) == 4 and {v % 4 for v in chosen} == {0, 1, 2, 3}


def test_ingest_takes_each_frame_once(spark, tmp_path):
    schema = "recording string, cam string, backend string, t double, u array<double>, v array<double>, conf array<double>"
    frame = lambda t: ("r", "c", "logit", t, [float(i) for i in range(23)], [0.0] * 23, [1.0] * 23)
    src, out, check = (str(tmp_path / n) for n in ("src", "out", "check"))
    spark.createDataFrame([frame(0.0), frame(0.1)], schema).write.parquet(src)
    ingest_pose_chunks(spark, src, out, check, spark.read.parquet(src).schema)
    spark.createDataFrame([frame(0.1), frame(0.2)], schema).write.mode("append").parquet(src)
    ingest_pose_chunks(spark, src, out, check, spark.read.parquet(src).schema)
    got = ingested(spark, out).orderBy("t").collect()
    assert [r.t for r in got] == [0.0, 0.1, 0.2] and got[0].u[0] == 22.0 and got[0].conf[0] == 0.5


def test_a_batch_that_is_run_again_overwrites_itself(spark, tmp_path):
    schema = "recording string, cam string, backend string, config string, t double, u array<double>, v array<double>, conf array<double>"
    frame = lambda r, t, u=0.0: (r, "c", "logit", None, t, [u] * 23, [0.0] * 23, [1.0] * 23)
    out = str(tmp_path / "out")
    add_batch(spark, spark.createDataFrame([frame("a", 0.0), frame("b", 0.0)], schema), 0, out)
    add_batch(spark, spark.createDataFrame([frame("a", 0.0, 9.0), frame("a", 1.0)], schema), 1, out)
    again = spark.createDataFrame([frame("a", 1.0, 5.0), frame("a", 0.0, 9.0), frame("b", 2.0)], schema)
    for _ in range(2):  # the first try was lost after it had written
        add_batch(spark, again, 1, out)
    got = sorted((r.recording, r.t, r.u[0]) for r in ingested(spark, out).collect())
    assert got == [("a", 0.0, 0.0), ("a", 1.0, 5.0), ("b", 0.0, 0.0), ("b", 2.0, 0.0)]
    add_batch(spark, again.limit(0), 2, out)
    assert ingested(spark, out).count() == 4


def test_select_views_needs_no_task_for_a_camera(spark, monkeypatch):
    from pyspark.sql.group import GroupedData

    monkeypatch.setattr(GroupedData, "applyInPandas", None)
    rows = [(c, v, 10.0 * v, p, 80.0 + 160.0 * ((v + p) % 8), 64.0 + 128.0 * (v // 8 % 8), 100.0 + v) for c in (0, 1) for v in range(20 if c else 3) for p in range(4)]
    d = spark.createDataFrame(rows, "cam int, view int, t double, point_id int, u double, v double, sharpness double")
    got = calibration.select_views(d, (1280, 1024), 5).collect()
    used, chosen = [0] * 64, []
    cells = {v: sorted({(v // 8 % 8) * 8 + (v + p) % 8 for p in range(4)}) for v in range(20)}
    for _ in range(5):
        gain = {v: sum(1 / (1 + used[c]) for c in cells[v]) + 0.25 + 0.25 * (100 + v) / 119 for v in range(20) if v not in chosen}
        chosen.append(max(gain, key=lambda v: (gain[v], -v)))
        for c in cells[chosen[-1]]:
            used[c] += 1
    assert {(r.cam, r.view) for r in got} == {(0, v) for v in range(3)} | {(1, v) for v in chosen}


def test_the_nearest_frame(spark):
    frames = spark.createDataFrame([("r", 0, t, i) for i, t in enumerate((1.0, 1.03, 1.06, 1.5))], "recording string, cam int, t double, frame_index long")
    asked = spark.createDataFrame([("r", 0, t) for t in (1.02, 1.001, 1.045, 1.2, 1.9, 0.98, 0.9)], "recording string, cam int, t double")
    got = {row.t: row.t_frame for row in timeseries.frame_at(frames, asked).collect()}
    assert got == {1.02: 1.03, 1.001: 1.0, 1.045: 1.03, 1.9: 1.5, 0.98: 1.0}


def test_offsets_of_each_recording(spark):
    rows = [(rec, cam, i / 10, [i / 10 + cam], [0.0], [1.0]) for rec in ("a", "b") for cam in (0, 1) for i in range(30)]
    tracks = spark.createDataFrame(rows, "recording string, cam int, t double, u array<double>, v array<double>, conf array<double>")
    offsets = spark.createDataFrame([("a", 1, 0.1), ("b", 1, 0.3)], "recording string, cam int, offset_s double")
    times = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "recording string, tau double")
    got = {row.recording: row.u for row in timeseries.on_common_clock(tracks, offsets, times, 2).collect()}
    assert {k: [round(x, 6) for x in v] for k, v in got.items()} == {"a": [1.0, 2.1], "b": [1.0, 2.3]}


def test_unknown_backends_are_rejected(spark):
    from trackloom.streaming import ingest

    for backend in ("nobody", None):
        rows = spark.createDataFrame([("r", 0, backend, 1.0, [1.0], [1.0], [1.0])], "recording string, cam int, backend string, t double, u array<double>, v array<double>, conf array<double>")
        with pytest.raises(Exception, match="unknown backend"):
            ingest.to_canonical(rows).collect()
