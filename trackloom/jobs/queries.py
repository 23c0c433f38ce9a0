"""Queries over the derived scene, each with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import columns as C
from ..operators import bundle, calibration, cleaning, pose, reconstruction, report, rig, selfcalib, sync, timeseries, tracks, views
from ..skeleton import EDGE_INDEX, INDEX, JOINTS
from ..sources import files
from . import slice as slice_
from . import studio

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r(column, digits: int = 4):
    """Rounded, without a negative zero."""
    return F.round(column, digits) + F.lit(0.0)


def q(expr: str, digits: int = 4) -> str:
    return f"round({expr}, {digits}) + 0.0"


KP, CLEAN, TRUTH, TRACKS = X.keypoints_sql("duckdb"), X.keypoints_sql("duckdb", False, False), X.truth_sql("duckdb"), X.tracks_sql("duckdb")
FRAMES = f"select recording, cam, i, t from ({KP}) k where joint = 0"
TIMES = "select recording, t as tau from (select *, min(t) over (partition by recording) as lo, max(t) over (partition by recording) as hi from fr where cam = 0) x where t >= lo + 0.5::double and t <= hi - 0.5::double"
ASOF = f"""
with kp as materialized ({KP}), fr as (select recording, cam, t from kp where joint = 0), times as ({TIMES}),
q as (select recording, cam, tau, tau + offset_s as t from times cross join ({X.offsets_sql()}) o),
b as (select q.*, x.t as t0 from q asof left join fr x on q.recording = x.recording and q.cam = x.cam and q.t > x.t),
e as (select b.*, x.t as t1 from b asof left join fr x on b.recording = x.recording and b.cam = x.cam and b.t <= x.t),
lim as (select recording, cam, min(t) as lo, max(t) as hi from fr group by 1, 2),
ok as (select e.*, coalesce(t >= lo and t <= hi and (t0 is null or t1 - t0 <= 0.15::double), false) as good, case when t0 is null then 1.0::double else (t - t0) / (t1 - t0) end as w from e join lim using (recording, cam)),
obs as (select ok.recording, ok.cam, ok.tau, j.joint, case when good then (1 - w) * coalesce(k0.u, 0) + w * k1.u end as u, case when good then (1 - w) * coalesce(k0.v, 0) + w * k1.v end as v, case when good then least(coalesce(k0.conf, 9), k1.conf) else 0 end as conf
  from ok cross join (select cast(range as int) as joint from range(23)) j left join kp k0 on k0.recording = ok.recording and k0.cam = ok.cam and k0.t = ok.t0 and k0.joint = j.joint left join kp k1 on k1.recording = ok.recording and k1.cam = ok.cam and k1.t = ok.t1 and k1.joint = j.joint)"""


def keypoints(spark, sf_dir):
    return X.keypoints(spark, sf_dir)


def times_of(kp):
    return timeseries.reference_times(kp, 0)


def zero_offsets(spark):
    return spark.createDataFrame([], "cam int, offset_s double")


def clean_synced(spark, sf_dir):
    kp = X.keypoints(spark, sf_dir, False, False)
    return timeseries.on_common_clock(kp, zero_offsets(spark), times_of(kp), X.CAMERAS)


def clean_landmarks(spark, sf_dir):
    return reconstruction.triangulated(clean_synced(spark, sf_dir), X.camera_rows(), fix_swaps=False)


IN_TIME = "tau >= (select min(tau) + 0.5::double from tr y where y.recording = x.recording) and tau <= (select max(tau) - 0.5::double from tr y where y.recording = x.recording)"
TRUTH_IN = f"with tr as materialized ({TRUTH}), lim as (select recording, min(tau) + 0.5::double as lo, max(tau) - 0.5::double as hi from tr group by 1), inn as (select tr.* from tr join lim using (recording) where tau >= lo and tau <= hi)"
RAYS = f"select recording, cam, tau, i, joint, a, b from (select *, {X._camera('0', 'x', 'y', 'z')} / {X._camera('2', 'x', 'y', 'z')} as a, {X._camera('1', 'x', 'y', 'z')} / {X._camera('2', 'x', 'y', 'z')} as b from inn cross join (select cast(range as int) as cam from range({X.CAMERAS})) c) w"


@query(f"""with f as ({FRAMES}), d as (select *, t - lag(t) over (partition by recording, cam order by t) as dt from f),
s as (select recording, cam, quantile_cont(dt, 0.5) as m, min(dt) as lo, max(dt) as hi, quantile_cont(dt, 0.95) - quantile_cont(dt, 0.05) as spread from d where dt > 0 group by 1, 2)
select d.recording, d.cam, count(*) as n, {q("max(t) - min(t)")} as duration, {q("(count(*) - 1) / (max(t) - min(t))")} as fps, {q("any_value(m)")} as median_dt, {q("any_value(lo)")} as min_dt, {q("any_value(hi)")} as max_dt,
 count(*) filter (where dt > 1.5::double * m) as gaps, any_value(spread > 0.1::double * m) as variable from d join s using (recording, cam) group by 1, 2""")
def frame_timing(spark, sf_dir):
    out = report.frame_timing(keypoints(spark, sf_dir))
    return out.select("recording", "cam", "n", *[r(c).alias(c) for c in ("duration", "fps", "median_dt", "min_dt", "max_dt")], "gaps", "variable")


@query(f"with f as ({FRAMES}) select recording, cam, {q('t')} as t from (select *, row_number() over (partition by recording, cam order by t) - 1 as nr from f where t >= 5 and t <= 50) x where nr % 7 = 0")
def select_frames(spark, sf_dir):
    return timeseries.select_frames(keypoints(spark, sf_dir), 5.0, 50.0, 7).select("recording", "cam", r("t").alias("t"))


@query(f"with fr as ({FRAMES}) select recording, {q('tau')} as tau from ({TIMES}) x")
def reference_times(spark, sf_dir):
    return times_of(keypoints(spark, sf_dir)).select("recording", r("tau").alias("tau"))


@query(f"{ASOF} select recording, cam, {q('tau')} as tau, count(u) as n, {q('avg(u)')} as u, {q('avg(v)')} as v, {q('min(conf)')} as conf from obs group by recording, cam, tau")
def asof_interpolate(spark, sf_dir):
    kp = keypoints(spark, sf_dir)
    asked = times_of(kp).crossJoin(F.broadcast(spark.sql(X.offsets_sql()))).select("recording", "cam", (F.col("tau") + F.col("offset_s")).alias("t"), "tau")
    rows = timeseries.asof_interpolate(kp, asked)
    mean = lambda c: F.expr(f"aggregate(filter({c}, x -> x is not null), 0D, (s, x) -> s + x) / nullif(size(filter({c}, x -> x is not null)), 0)")
    return rows.select("recording", "cam", r("tau").alias("tau"), F.size(F.filter("u", lambda x: x.isNotNull())).cast("long").alias("n"), r(mean("u")).alias("u"), r(mean("v")).alias("v"), r(F.array_min("conf")).alias("conf"))


@query(f"{ASOF} select recording, {q('tau')} as tau, count(u) as n, {q('sum(conf)')} as conf from obs group by recording, tau")
def common_clock(spark, sf_dir):
    kp = keypoints(spark, sf_dir)
    rows = timeseries.on_common_clock(kp, spark.sql(X.offsets_sql()), times_of(kp), X.CAMERAS)
    return rows.select("recording", r("tau").alias("tau"), F.size(F.filter("u", lambda x: x.isNotNull())).cast("long").alias("n"), r(F.aggregate("conf", F.lit(0.0), lambda a, x: a + x)).alias("conf"))


@query(f"""with f as ({FRAMES}), a as (select recording, t from f where cam = 0), c as (select recording, t as x from f where cam = 1),
b as (select a.*, x as x0 from a asof left join c on a.recording = c.recording and a.t > c.x), e as (select b.*, c.x as x1 from b asof left join c on b.recording = c.recording and b.t <= c.x),
p as (select recording, t, case when x1 is null or abs(x0 - t) < abs(x1 - t) then x0 else x1 end as near from e) select recording, {q('t')} as t, {q('near')} as t_near from p where abs(near - t) < 0.1::double""")
def asof_nearest(spark, sf_dir):
    kp = keypoints(spark, sf_dir).select("recording", "cam", "t", "i")
    out = timeseries.asof_nearest(kp.where("cam = 0").select("recording", "t"), kp.where("cam = 1").select("recording", "t", "i"), ["recording"], ["i"], 0.1)
    return out.select("recording", r("t").alias("t"), r("t_near").alias("t_near"))


@query(f"""with f as ({FRAMES}), a as (select recording, cam, t + (i % 7) * 0.01::double as t from f where i % 3 = 0), last as (select recording, cam, max(t) as hi from f group by 1, 2),
b as (select a.*, f.t as x0 from a asof left join f on a.recording = f.recording and a.cam = f.cam and a.t > f.t), e as (select b.*, f.t as x1 from b asof left join f on b.recording = f.recording and b.cam = f.cam and b.t <= f.t),
p as (select e.*, hi, case when x0 is null then x1 when x1 is null then x0 when x1 - t < t - x0 then x1 else x0 end as near from e join last using (recording, cam))
select recording, cam, {q('t')} as t, {q('near')} as t_frame from p where t > hi or abs(near - t) <= 0.05::double""")
def frame_at(spark, sf_dir):
    f = keypoints(spark, sf_dir).select("recording", "cam", "t", F.col("i").cast("long").alias("frame_index"))
    asked = f.where("frame_index % 3 = 0").select("recording", "cam", (F.col("t") + F.col("frame_index") % 7 * 0.01).alias("t"))
    return timeseries.frame_at(f, asked, 0.05).select("recording", "cam", r("t").alias("t"), r("t_frame").alias("t_frame"))


@query(f"""with recursive f as ({FRAMES}), k as (select recording, cam, min(t) as t from f where t >= 0 group by 1, 2
union all select k.recording, k.cam, min(f.t) from k join f on k.recording = f.recording and k.cam = f.cam and f.t + 0.000001::double >= k.t + 0.25::double group by 1, 2) select recording, cam, {q('t')} as t from k""")
def thin_by_time(spark, sf_dir):
    return timeseries.thin_by_time(keypoints(spark, sf_dir).select("recording", "cam", "t"), 0.25).select("recording", "cam", r("t").alias("t"))


@query(f"with kp as ({KP}) select recording, cam, joint, count(*) as n, {q('avg(conf)')} as weight from kp where conf >= 0.7::double group by 1, 2, 3")
def valid_observations(spark, sf_dir):
    return pose.valid_obs(keypoints(spark, sf_dir), 0.7).groupBy("recording", "cam", "joint").agg(F.count("*").alias("n"), r(F.avg("weight")).alias("weight"))


@query(f"with kp as ({KP}) select recording, cam, 22 - joint as joint, {q('avg(u)')} as u, {q('avg((conf * 3) / (1 + conf * 3))')} as conf from kp group by 1, 2, 3")
def canonical_joints(spark, sf_dir):
    raw = keypoints(spark, sf_dir).withColumn("conf", F.transform("conf", lambda x: x * 3))
    rule = pose.BACKENDS["logit"]
    rows = pose.normalize_conf(pose.map_joints(raw, rule["names"]), rule["rule"]).select("recording", "cam", F.posexplode(F.arrays_zip("u", "conf")).alias("joint", "o"))
    return rows.groupBy("recording", "cam", "joint").agg(r(F.avg("o.u")).alias("u"), r(F.avg("o.conf")).alias("conf"))


@query(f"""with kp as ({KP}), d as (select *, sqrt(pow(lead(u) over w - 2 * u + lag(u) over w, 2) + pow(lead(v) over w - 2 * v + lag(v) over w, 2)) as jump from kp window w as (partition by recording, cam, joint order by t))
select recording, cam, {q('avg(conf)')} as mean_conf, {q('quantile_cont(jump, 0.5)')} as jitter from d group by 1, 2""")
def pose_quality(spark, sf_dir):
    return pose.pose_quality(keypoints(spark, sf_dir)).select("recording", "cam", r("mean_conf").alias("mean_conf"), r("jitter").alias("jitter"))


@query(f"with kp as ({KP}) select cam, joint, {q('quantile_cont(sqrt(pow(1 + joint / 10.0::double, 2) + 0.25::double), 0.5)')} as median_px from kp group by 1, 2")
def backend_agreement(spark, sf_dir):
    a = keypoints(spark, sf_dir)
    b = a.withColumn("u", F.transform("u", lambda x, j: x + 1 + j / F.lit(10.0))).withColumn("v", F.transform("v", lambda x: x - 0.5))
    return pose.backend_agreement(a, b).select("cam", "joint", r("median_px").alias("median_px"))


FOOT5 = """foot as (select recording, cam, track_id, t, (x1 + x2) / 2 as x, y2 as y, count(*) over k as n, first_value((x1 + x2) / 2) over o as fx, first_value(y2) over o as fy, last_value((x1 + x2) / 2) over o as lx, last_value(y2) over o as ly,
 lag((x1 + x2) / 2, 1) over w as xa, lag((x1 + x2) / 2, 2) over w as xb, lead((x1 + x2) / 2, 1) over w as xc, lead((x1 + x2) / 2, 2) over w as xd, lag(y2, 1) over w as ya, lag(y2, 2) over w as yb, lead(y2, 1) over w as yc, lead(y2, 2) over w as yd
 from tk where track_id >= 0 window k as (partition by recording, cam, track_id), w as (partition by recording, cam, track_id order by t), o as (partition by recording, cam, track_id order by t rows between unbounded preceding and unbounded following)),
med as (select recording, cam, track_id, t, case when n > 5 then list_sort([coalesce(xb, fx), coalesce(xa, fx), x, coalesce(xc, lx), coalesce(xd, lx)])[3] else x end as x, case when n > 5 then list_sort([coalesce(yb, fy), coalesce(ya, fy), y, coalesce(yc, ly), coalesce(yd, ly)])[3] else y end as y from foot),
stp as (select *, coalesce(sqrt(pow(x - lag(x) over w, 2) + pow(y - lag(y) over w, 2)), 0) as step from med window w as (partition by recording, cam, track_id order by t)),
summ as (select recording, cam, track_id, min(t) as t0, max(t) as t1, count(*) as n, sum(step) as path_px, arg_min(x, t) as start_x, arg_min(y, t) as start_y, arg_max(x, t) as end_x, arg_max(y, t) as end_y from stp group by 1, 2, 3)"""
ONE = f"with tk as materialized (select * exclude (nr) from (select *, row_number() over (partition by recording, cam, track_id, t order by score desc) as nr from ({TRACKS}) x) y where nr = 1), {FOOT5}"


def one_box(spark, sf_dir):
    """Tracks without doubled boxes of one id, so that times are unique within a track."""
    from pyspark.sql import Window as W

    rows = X.tracks(spark, sf_dir)
    return rows.withColumn("__nr", F.row_number().over(W.partitionBy("recording", "cam", "track_id", "t").orderBy(F.desc("score")))).where("__nr = 1").drop("__nr")


SUMMARY = ["t0", "t1", "path_px", "start_x", "start_y", "end_x", "end_y"]


@query(f"{ONE} select recording, cam, track_id, n, {', '.join(q(c, 3) + ' as ' + c for c in SUMMARY)} from summ")
def track_summary(spark, sf_dir):
    return tracks.track_summary(one_box(spark, sf_dir)).select("recording", "cam", "track_id", "n", *[r(c, 3).alias(c) for c in SUMMARY])


@query(f"{ONE} select recording, cam, track_id, cast(rank as int) as rank from (select *, row_number() over (partition by recording, cam order by path_px * (t1 - t0) desc, track_id) as rank from summ) x where rank <= 2")
def top_candidates(spark, sf_dir):
    return tracks.top_candidates(tracks.track_summary(one_box(spark, sf_dir)), 2).select("recording", "cam", "track_id", "rank")


@query(f"""{ONE}, top as (select * from (select *, row_number() over (partition by recording, cam order by path_px * (t1 - t0) desc, track_id) as rank from summ) x where rank <= 4)
select a.recording, a.track_id as track_0, b.track_id as track_1, c.track_id as track_2 from top a join top b on a.recording = b.recording and a.cam = 0 and b.cam = 1 join top c on a.recording = c.recording and c.cam = 2""")
def candidate_combos(spark, sf_dir):
    return tracks.candidate_combos(tracks.top_candidates(tracks.track_summary(one_box(spark, sf_dir))), X.CAMERAS)


@query(f"""{ONE} select a.recording, a.cam, a.track_id, b.track_id as next_id, {q('b.t0 - a.t1 + sqrt(pow(b.start_x - a.end_x, 2) + pow(b.start_y - a.end_y, 2)) / 200')} as cost from summ a join summ b on a.recording = b.recording and a.cam = b.cam and a.track_id <> b.track_id
where b.t0 - a.t1 >= 0 and b.t0 - a.t1 <= 3 and sqrt(pow(b.start_x - a.end_x, 2) + pow(b.start_y - a.end_y, 2)) <= 200""")
def stitch_candidates(spark, sf_dir):
    return tracks.stitch_candidates(tracks.track_summary(one_box(spark, sf_dir))).withColumn("cost", r("cost"))


CHAIN = "select recording, cam, position, (case cam when 0 then 5 when 1 then 3 else 9 end) + 100 * position as track_id from (select distinct event_id // 1000 as recording from events) x cross join (select cast(range as int) as cam from range(3)) c cross join (select cast(range as int) as position from range(2)) p"


@query(f"{CHAIN}")
def stitch_tracks(spark, sf_dir):
    seeds = chain_rows(spark, sf_dir).where("position = 0").select("recording", "cam", F.col("track_id").cast("long").alias("seed"))
    return tracks.stitch_tracks(tracks.track_summary(one_box(spark, sf_dir)), seeds)


def chain_rows(spark, sf_dir):
    return X.from_events(spark, sf_dir, CHAIN.replace("//", "div").replace("select cast(range as int) as cam from range(3)", "select explode(sequence(0, 2)) as cam").replace("select cast(range as int) as position from range(2)", "select explode(sequence(0, 1)) as position"))


@query(f"with tk as ({TRACKS}) select recording, cam, {q('t')} as t, track_id, {q('score')} as score from (select *, row_number() over (partition by recording, cam, t order by score desc, track_id) as nr from tk) x where nr = 1")
def best_per_frame(spark, sf_dir):
    return tracks.best_per_frame(X.tracks(spark, sf_dir)).select("recording", "cam", r("t").alias("t"), "track_id", r("score").alias("score"))


@query(f"""with tk as ({TRACKS}), ch as ({CHAIN}), b as (select * from (select tk.*, row_number() over (partition by recording, cam, t order by score desc, track_id) as nr from tk semi join ch using (recording, cam, track_id)) x where nr = 1),
s as (select *, (x1 + x2) / 2 as m, first_value(x1) over o as fx, last_value(x1) over o as lx, first_value(y2) over o as fy, last_value(y2) over o as ly from b window o as (partition by recording, cam order by t rows between unbounded preceding and unbounded following))
select recording, cam, {q('t')} as t, {q('list_sort([coalesce(lag(x1, 2) over w, fx), coalesce(lag(x1, 1) over w, fx), x1, coalesce(lead(x1, 1) over w, lx), coalesce(lead(x1, 2) over w, lx)])[3]', 3)} as x1, {q('list_sort([coalesce(lag(y2, 2) over w, fy), coalesce(lag(y2, 1) over w, fy), y2, coalesce(lead(y2, 1) over w, ly), coalesce(lead(y2, 2) over w, ly)])[3]', 3)} as y2 from s window w as (partition by recording, cam order by t)""")
def actor_boxes(spark, sf_dir):
    return tracks.actor_boxes(X.tracks(spark, sf_dir), chain_rows(spark, sf_dir)).select("recording", "cam", r("t").alias("t"), r("x1", 3).alias("x1"), r("y2", 3).alias("y2"))


@query(f"with tk as ({TRACKS}), ch as ({CHAIN}) select recording, cam, count(ch.track_id) as boxes, count(distinct t) as frames, {q('count(ch.track_id) / count(distinct t)')} as covered from tk left join ch using (recording, cam, track_id) group by 1, 2")
def actor_coverage(spark, sf_dir):
    rows = X.tracks(spark, sf_dir)
    return tracks.actor_coverage(rows, rows, chain_rows(spark, sf_dir)).withColumn("covered", r("covered"))


@query("select distinct recording, cam, 'multiview' as method, track_id as walker from (" + CHAIN + ") c where position = 0")
def select_actor(spark, sf_dir):
    """Whom all cameras see: the track's number, of its two parts the first one's."""
    out = tracks.select_actor(one_box(spark, sf_dir), X.camera_rows())
    return out.select("recording", "cam", "method", (F.col("seed") % 100).alias("walker"))


@query(f"with f as ({FRAMES}), x as (select *, row_number() over (partition by recording, cam order by t) - 1 as k, count(*) over (partition by recording, cam) as n from f) select recording, cam, {q('t')} as t from x where exists (select 1 from range(25) s where floor(s.range * (n - 1) / 24) = k)")
def evenly_spaced(spark, sf_dir):
    return tracks.evenly_spaced(keypoints(spark, sf_dir).select("recording", "cam", "t"), 25, ["recording", "cam"]).select("recording", "cam", r("t").alias("t"))


@query(f"with f as ({FRAMES}), x as (select *, row_number() over (partition by recording, cam order by t) - 1 as k, count(*) over (partition by recording, cam) as n from f) select recording, cam, {q('t')} as t from x where k % greatest(1, n // 400) = 0")
def stride_sample(spark, sf_dir):
    return tracks.stride_sample(keypoints(spark, sf_dir).select("recording", "cam", "t"), ["recording", "cam"]).select("recording", "cam", r("t").alias("t"))


@query(f"""with s as (select recording, cam, t, u as x from ({KP}) k where joint = 9), e as (select *, lag(x) over w as a, lead(x) over w as b, sum(x) over (partition by recording, cam order by t rows between 15 preceding and 15 following) / 31 as m, avg(x) over (partition by recording, cam) as mean, stddev_pop(x) over (partition by recording, cam) as sd from s window w as (partition by recording, cam order by t))
select recording, cam, {q('t')} as t, {q('coalesce((b - a) / 2, b - x, x - a)')} as slope, {q('x - m')} as flat, {q('(x - mean) / (sd + 1e-12::double)')} as z, {q('b - 2 * x + a')} as d2 from e""")
def series_windows(spark, sf_dir):
    keys = ["recording", "cam"]
    s = keypoints(spark, sf_dir).select(*keys, "t", F.get("u", F.lit(9)).alias("x"))
    s = timeseries.second_difference(timeseries.zscore(timeseries.detrend(timeseries.gradient(s, "x", keys, "slope"), "x", keys, "flat"), "x", keys, "z"), ["x"], keys)
    return s.select(*keys, r("t").alias("t"), r("slope").alias("slope"), r("flat").alias("flat"), r("z").alias("z"), r("d2_x").alias("d2"))


@query(f"select recording, cam, joint, {q('avg(u)')} as u, {q('avg(v)')} as v, {q('max(u)')} as u_max from ({CLEAN}) k group by 1, 2, 3")
def project_landmarks(spark, sf_dir):
    truth = X.truth(spark, sf_dir)
    rows = None
    for c in X.camera_rows():
        u, v = C.fisheye_uv(*C.affine(F.col("x"), F.col("y"), F.col("z"), c["r"], c["t"]), c["k"], c["d"])
        part = truth.select("recording", F.lit(c["cam"]).alias("cam"), "joint", u.alias("u"), v.alias("v"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("recording", "cam", "joint").agg(r(F.avg("u")).alias("u"), r(F.avg("v")).alias("v"), r(F.max("u")).alias("u_max"))


@query(f"{TRUTH_IN}, ry as ({RAYS}) select p.recording, p.joint, count(*) as n, {q('avg(p.a)')} as ax, {q('avg(p.b)')} as ay, {q('avg(s.a)')} as bx, {q('avg(s.b)')} as by_ from ry p join ry s on p.recording = s.recording and p.tau = s.tau and p.joint = s.joint and p.cam = 0 and s.cam = 1 group by 1, 2")
def pair_points(spark, sf_dir):
    rays = rig.undistorted(clean_synced(spark, sf_dir), X.camera_rows())
    return rig.pair_points(rays, 0, 1, len(JOINTS), 0.5).groupBy("recording", "joint").agg(F.count("*").alias("n"), *[r(F.avg(c)).alias(n) for c, n in (("ax", "ax"), ("ay", "ay"), ("bx", "bx"), ("by", "by_"))])


@query(f"{TRUTH_IN} select recording, {q('tau')} as tau, joint, {q('x', 3)} as x, {q('y', 3)} as y, {q('z', 3)} as z, 3 as views from inn")
def triangulate(spark, sf_dir):
    return cleaning.landmarks_long(clean_landmarks(spark, sf_dir)).select("recording", r("t").alias("tau"), "joint", *[r(c, 3).alias(c) for c in "xyz"], "views")


@query()
def reconstruct(spark, sf_dir):
    kp = keypoints(spark, sf_dir)
    return reconstruction.reconstruct(kp, X.camera_rows(), spark.sql(X.offsets_sql()), times_of(kp))


@query()
def repair_counts(spark, sf_dir):
    return report.repair_counts(reconstruct(spark, sf_dir), X.CAMERAS)


_HEELS = {INDEX["left_heel"]: [INDEX["left_ankle"], INDEX["left_knee"]], INDEX["right_heel"]: [INDEX["right_ankle"], INDEX["right_knee"]]}
#: Damage of the clean pixels, by arithmetic that both engines repeat: joint j of camera c in frame i. Noise by recording, views far off, unsure and unseen views, and heels
#: taken for ankles or knees in two recordings of three.
_OFF_U = "(cast((i * 7 + j * 3 + c * 11) % 50 as double) - 24.5) / 10 * (recording % 4 * 2 + 0.5) + (case when c = 2 and i % 50 = 7 then 80.0 else 0.0 end)"
_OFF_V = "(cast((i * 3 + j * 11 + c * 7) % 40 as double) - 19.5) / 10 * (recording % 4 * 2 + 0.5)"
_SURE = "(case when (i * 5 + j) % 11 = 0 and c > 0 then 0.0 when (i + 23 * c + j) % 5 = 0 then 0.25 else {conf} end)"
_PLACE = "(case when i % 20 = 0 or recording % 3 = 0 then j " + " ".join(f"when j = {j} and recording % 3 = {k + 1} then {p}" for j, ps in _HEELS.items() for k, p in enumerate(ps)) + " else j end)"


def doubles(expr: str, engine: str) -> str:
    """Plain decimals as doubles."""
    return re.sub(r"(?<![\w.])\d+\.\d+(?![\w.])", lambda m: m[0] + ("D" if engine == "spark" else "::double"), expr)


def damaged_landmarks(spark, sf_dir):
    """Keypoints of all recordings on the common clock, damaged (by the arithmetic above, over arrays), and triangulated."""
    synced = clean_synced(spark, sf_dir)
    names, c, j = synced.columns, np.repeat(np.arange(X.CAMERAS), 23), np.tile(np.arange(23), X.CAMERAS)

    def work(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            number = np.asarray(batch.column("recording"))[:, None]
            i = np.floor(np.asarray(batch.column("tau")) * 15 + 0.01).astype(int)[:, None]
            u, v, conf = (reconstruction._numbers(batch.column(x), n) for x in ("u", "v", "conf"))
            at, sure = np.tile(j, (n, 1)), np.where((i + 23 * c + j) % 5 == 0, 0.25, conf)
            for heel, taken in _HEELS.items():
                for k, place in enumerate(taken):
                    at = np.where((i % 20 != 0) & (number % 3 == k + 1) & (j == heel), place, at)
            sure = np.where(((i * 5 + j) % 11 == 0) & (c > 0), 0.0, sure)
            size = number % 4 * 2 + 0.5
            off_u = ((i * 7 + j * 3 + c * 11) % 50 - 24.5) / 10 * size + np.where((c == 2) & (i % 50 == 7), 80.0, 0.0)
            off_v = ((i * 3 + j * 11 + c * 7) % 40 - 19.5) / 10 * size
            moved = [np.take_along_axis(x, c * 23 + at, axis=1) + off for x, off in ((u, off_u), (v, off_v))]
            yield pa.RecordBatch.from_arrays([batch.column("recording"), batch.column("tau"), *map(reconstruction._lists, (*moved, sure))], names=names)

    return reconstruction.triangulated(synced.mapInArrow(work, synced.schema), X.camera_rows(), fix_swaps=False)


def _robust_sql(limit: float = 15.0, least: float = 0.5) -> str:
    """CTEs of the damaged views and their robust triangulation: ``inn`` (frames), ``px`` (errors of used views), ``marks`` (joints: views, z).

    Undistortion by Newton steps; the linear solution of a set of views is the p that minimises |A (p, 1)|^2 / |(p, 1)|^2, by Cramer's rule with the quotient put in again; a
    moment of three views whose worst error is above the limit leaves out the camera without which the worst error is least.
    """
    f = X.number(X.FOCAL)
    k1, k2, k3, k4 = map(X.number, X.DISTORTION)
    u0, v0 = X._fisheye("a", "b")
    x, y, z = X._world("place")
    newton = "select *, target as th from (select *, sqrt(pa * pa + pb * pb) as target from pa0) z"
    for _ in range(8):
        newton = f"select * exclude (th), th - (th * (1 + th * th * ({k1} + th * th * ({k2} + th * th * ({k3} + th * th * {k4})))) - target) / (1 + th * th * (3 * {k1} + th * th * (5 * {k2} + th * th * (7 * {k3} + th * th * 9 * {k4})))) as th from ({newton}) z"
    r = [[X._case("cam", [pose[0][i][k] for pose in X.POSES]) for k in range(3)] for i in range(3)]
    t = [X._case("cam", [pose[1][i] for pose in X.POSES]) for i in range(3)]
    row = [[f"w * ({c} * {r[2][k]} - {r[n][k]})" for k in range(3)] + [f"w * ({c} * {t[2]} - {t[n]})"] for n, c in enumerate(("ua", "ub"))]
    names = [[f"{'pq'[n]}{k}" for k in range(4)] for n in range(2)]
    sums = ", ".join(f"sum(p{m} * p{n} + q{m} * q{n}) as n{m}{n}" for m in range(4) for n in range(m, 4))
    det = lambda m: f"({m[0]} * ({m[4]} * {m[8]} - {m[5]} * {m[7]}) - {m[1]} * ({m[3]} * {m[8]} - {m[5]} * {m[6]}) + {m[2]} * ({m[3]} * {m[7]} - {m[4]} * {m[6]}))"
    whole = ["(n00 - lam)", "n01", "n02", "n01", "(n11 - lam)", "n12", "n02", "n12", "(n22 - lam)"]
    put = lambda k: det([f"(-n{i // 3}3)" if i % 3 == k else whole[i] for i in range(9)])
    solved = "select *, cast(0 as double) as lam from sums where views >= 2"
    for _ in range(4):
        solved = f"select * exclude (lam), (n00 * x * x + n11 * y * y + n22 * z * z + 2 * (n01 * x * y + n02 * x * z + n12 * y * z + n03 * x + n13 * y + n23 * z) + n33) / (x * x + y * y + z * z + 1) as lam, lam as used from (select * {{}}, {put(0)} / {det(whole)} as x, {put(1)} / {det(whole)} as y, {put(2)} / {det(whole)} as z from ({solved}) z) z"
    first, *rest = solved.split("{}")  # the innermost has no earlier point to replace
    solved = "exclude (x, y, z, used)".join([first, *rest[:-1]]) + rest[-1]
    return f"""fr as ({X.sql(X.FRAMES, "duckdb")}), ordered as (select *, lag(i) over (partition by recording order by tau) as i0, min(tau) over (partition by recording) as lo, max(tau) over (partition by recording) as hi from fr),
inn as materialized (select recording, i, i0, tau from ordered where tau >= lo + 0.5::double and tau <= hi - 0.5::double),
vw as (select *, c as cam, {doubles(_PLACE, "duckdb")} as place, {doubles(_SURE, "duckdb").format(conf="(0.5::double + cast(least((i * 7 + j * 3 + c) % 50, (i0 * 7 + j * 3 + c) % 50) as double) / 100)")} as conf from inn cross join (select cast(range as int) as c from range({X.CAMERAS})) c cross join (select cast(range as int) as j from range(23)) j),
seen as (select *, {X._camera("0", "x", "y", "z")} / {X._camera("2", "x", "y", "z")} as a, {X._camera("1", "x", "y", "z")} / {X._camera("2", "x", "y", "z")} as b from (select *, {x} as x, {y} as y, {z} as z from vw) z),
uv as (select recording, i, j, cam, conf, {u0} + {doubles(_OFF_U, "duckdb")} as u, {v0} + {doubles(_OFF_V, "duckdb")} as v from seen where conf >= {X.number(least)}), pa0 as (select *, (u - {X.number(X.CX)}) / {f} as pa, (v - {X.number(X.CY)}) / {f} as pb from uv),
flat as materialized (select recording, i, j, cam, conf, u, v, pa * tan(th) / target as ua, pb * tan(th) / target as ub from ({newton}) z),
rows_ as (select recording, i, j, leave, {', '.join(f'{row[n][k]} as {names[n][k]}' for n in range(2) for k in range(4))} from (select *, conf as w from flat cross join (select cast(range - 1 as int) as leave from range({X.CAMERAS + 1})) l where cam <> leave) z),
sums as (select recording, i, j, leave, count(*) as views, {sums} from rows_ group by 1, 2, 3, 4),
points as (select recording, i, j, leave, views, x, y, z from ({solved}) z),
again as (select recording, i, j, leave, views, cam, x, y, z, {X._camera("0", "x", "y", "z")} / {X._camera("2", "x", "y", "z")} as a, {X._camera("1", "x", "y", "z")} / {X._camera("2", "x", "y", "z")} as b, u, v from points join flat using (recording, i, j) where cam <> leave),
errors as materialized (select recording, i, j, leave, views, cam, z, sqrt(pow({u0} - u, 2) + pow({v0} - v, 2)) as px from again),
worst as (select recording, i, j, leave, views, any_value(z) as z, max(px) as most from errors group by 1, 2, 3, 4, 5),
chosen as (select recording, i, j, case when max(most) filter (where leave = -1) > {X.number(limit)} and max(views) = 3 then arg_min(leave, most) filter (where leave >= 0) else -1 end as leave from worst group by 1, 2, 3),
px as materialized (select e.recording, e.cam, e.px from errors e join chosen using (recording, i, j, leave)),
marks as (select m.recording, m.j, coalesce(p.views, 0) as views, case when most <= {X.number(limit)} then p.z end as z from (select recording, i, j from inn cross join (select cast(range as int) as j from range(23)) j) m left join (select w.* from worst w join chosen using (recording, i, j, leave)) p on m.recording = p.recording and m.i = p.i and m.j = p.j)"""


ROBUST = _robust_sql()


@query(f"with {ROBUST} select recording, cam, {q('quantile_cont(px, 0.5)', 3)} as median_px, {q('quantile_cont(px, 0.9)', 3)} as p90_px from px group by 1, 2")
def reprojection_stats(spark, sf_dir):
    """Medians and 90th percentiles of the errors of damaged keypoints, other ones in each recording and camera."""
    return report.reprojection_stats(damaged_landmarks(spark, sf_dir), X.CAMERAS).select("recording", "cam", r("median_px", 3).alias("median_px"), r("p90_px", 3).alias("p90_px"))


EDGES_SQL = "select * from (values " + ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(EDGE_INDEX)) + ") as e(edge, a, b)"


@query(f"""{TRUTH_IN}, bones as (select p.recording, e.edge, sqrt(pow(p.x - s.x, 2) + pow(p.y - s.y, 2) + pow(p.z - s.z, 2)) as len from ({EDGES_SQL}) e join inn p on p.joint = e.a join inn s on s.joint = e.b and s.recording = p.recording and s.i = p.i)
select recording, edge, {q('quantile_cont(len, 0.5)')} as median, {q('stddev_pop(len) / quantile_cont(len, 0.5)')} as cv from bones group by 1, 2""")
def bone_stats(spark, sf_dir):
    return cleaning.bone_stats(cleaning.bone_lengths(clean_landmarks(spark, sf_dir))).select("recording", "edge", r("median").alias("median"), r("cv").alias("cv"))


_DAMAGE = "case when joint = 7 and i % 37 = 0 then x + 0.5::double when joint = 10 and i % 41 = 0 then x + 0.4::double when joint = 16 and i % 29 = 0 then x + 0.3::double else x end"
_LIMB = lambda a, b: f"sqrt(pow(max(x) filter (where joint = {a}) - max(x) filter (where joint = {b}), 2) + pow(max(y) filter (where joint = {a}) - max(y) filter (where joint = {b}), 2) + pow(max(z) filter (where joint = {a}) - max(z) filter (where joint = {b}), 2))"
_UP = [(INDEX[f"{s}_{a}"], INDEX[f"{s}_{b}"]) for s in ("left", "right") for a, b in cleaning.LIMBS[0]]
_LOW = [(INDEX[f"{s}_{a}"], INDEX[f"{s}_{b}"]) for s in ("left", "right") for a, b in cleaning.LIMBS[1]]


@query(f"""with d as materialized (select recording, i, tau, joint, {_DAMAGE} as x, y, z from ({TRUTH}) t), l1 as (select recording, i, {', '.join(_LIMB(a, b) + f' as l{b}' for a, b in _UP)} from d group by 1, 2),
m1 as (select recording, {', '.join(f'quantile_cont(l{b}, 0.5) as m{b}' for _, b in _UP)} from l1 group by 1), b1 as ({' union all '.join(f'select recording, i, {b} as joint from l1 join m1 using (recording) where abs(l{b} - m{b}) > 0.25::double * m{b}' for _, b in _UP)}),
d2 as (select d.* from d anti join b1 using (recording, i, joint)), l2 as (select recording, i, {', '.join(_LIMB(a, b) + f' as l{b}' for a, b in _LOW)} from d2 group by 1, 2),
m2 as (select recording, {', '.join(f'quantile_cont(l{b}, 0.5) as m{b}' for _, b in _LOW)} from l2 group by 1), b2 as ({' union all '.join(f'select recording, i, {b} as joint from l2 join m2 using (recording) where abs(l{b} - m{b}) > 0.25::double * m{b}' for _, b in _LOW)})
select recording, {q('tau')} as tau, joint from (select * from b1 union all select * from b2) b join d using (recording, i, joint)""")
def bone_outliers(spark, sf_dir):
    rows = X.truth(spark, sf_dir).withColumn("x", F.expr(_DAMAGE.replace("::double", "D")))
    packed = rows.groupBy("recording", "tau").agg(F.array_sort(F.collect_list(F.struct("joint", "x", "y", "z"))).alias("p")).select("recording", "tau", *[F.expr(f"transform(p, o -> o.{c})").alias(c) for c in "xyz"])
    out = cleaning.reject_bone_outliers(packed).select("recording", "tau", F.posexplode("x").alias("joint", "x"))
    return out.where("x is null").select("recording", r("tau").alias("tau"), "joint")


_HOLES = "(i * 7 + joint * 3) % 60 < 3 or (joint = 4 and i between 100 and 130) or (joint = 8 and i % 200 <> 0)"
GAPS = f"""with d as (select recording, tau as t, joint, case when {_HOLES} then null else x end as x from ({TRUTH}) k),
e as (select *, count(x) over (partition by recording, joint) as n, last_value(case when x is not null then t end ignore nulls) over w as ta, last_value(x ignore nulls) over w as xa, first_value(case when x is not null then t end ignore nulls) over f as tb, first_value(x ignore nulls) over f as xb from d
 window w as (partition by recording, joint order by t rows between unbounded preceding and current row), f as (partition by recording, joint order by t rows between current row and unbounded following)),
g as (select recording, t, joint, x is null and n >= 10 and coalesce(tb - ta <= 0.5::double, false) as filled, case when x is not null then x when n >= 10 and tb - ta <= 0.5::double then xa + (t - ta) / (tb - ta) * (xb - xa) end as x from e)"""


def holed(spark, sf_dir):
    hole = F.expr(_HOLES)
    rows = X.truth(spark, sf_dir)
    return rows.select("recording", F.col("tau").alias("t"), "joint", *[F.when(~hole, F.col(c)).alias(c) for c in "xyz"])


@query(f"{GAPS} select recording, {q('t')} as t, joint, filled, {q('x')} as x from g")
def fill_gaps(spark, sf_dir):
    return cleaning.fill_gaps(holed(spark, sf_dir)).select("recording", r("t").alias("t"), "joint", "filled", r("x").alias("x"))


@query(f"""{GAPS}, s as (select *, case when x is not null and lag(x) over (partition by recording, joint order by t) is null then 1 else 0 end as new from g), n as (select *, sum(new) over (partition by recording, joint order by t) as segment from s)
select recording, joint, cast(segment as bigint) as segment, count(*) as n from n where x is not null group by 1, 2, 3""")
def segments(spark, sf_dir):
    return cleaning.segments(cleaning.fill_gaps(holed(spark, sf_dir))).where("segment is not null").groupBy("recording", "joint", "segment").agg(F.count("*").alias("n"))


@query()
def clean_and_smooth(spark, sf_dir):
    return cleaning.clean_and_smooth(holed(spark, sf_dir)).select("recording", r("t").alias("t"), "joint", "filled", *[r(c).alias(c) for c in "xyz"])


@query(f"{TRUTH_IN} select recording, {q('tau')} as t, {q('avg(x)')} as x, {q('avg(y)')} as y, {q('avg(z)')} as z, least(76, row_number() over (partition by recording order by tau)) as trail from inn where joint in (11, 12) group by recording, tau")
def pelvis_path(spark, sf_dir):
    return cleaning.pelvis_path(clean_landmarks(spark, sf_dir), 75).select("recording", r("t").alias("t"), *[r(c).alias(c) for c in "xyz"], "trail")


_POSE01 = rig.relative_pose(*(reconstruction.camera_list(X.camera_rows())[:2]))
_E01 = C.essential(list(_POSE01[0].ravel()), list(_POSE01[1]))
_FA = [f"({X.number(float(_E01[3 * i]))} * p.a + {X.number(float(_E01[3 * i + 1]))} * p.b + {X.number(float(_E01[3 * i + 2]))})" for i in range(3)]
_FB = [f"({X.number(float(_E01[i]))} * (s.a + 0.01::double * (s.i % 5)) + {X.number(float(_E01[3 + i]))} * s.b + {X.number(float(_E01[6 + i]))})" for i in range(2)]


@query(f"{TRUTH_IN}, ry as ({RAYS}) select p.recording, p.joint, {q(f'avg(420 * abs((s.a + 0.01::double * (s.i % 5)) * {_FA[0]} + s.b * {_FA[1]} + {_FA[2]}) / sqrt({_FA[0]} * {_FA[0]} + {_FA[1]} * {_FA[1]} + {_FB[0]} * {_FB[0]} + {_FB[1]} * {_FB[1]}))', 3)} as px from ry p join ry s on p.recording = s.recording and p.tau = s.tau and p.joint = s.joint and p.cam = 0 and s.cam = 1 group by 1, 2")
def epipolar_error(spark, sf_dir):
    pairs = rig.pair_points(rig.undistorted(clean_synced(spark, sf_dir), X.camera_rows()), 0, 1, len(JOINTS), 0.5)
    frames = X.frames(spark, sf_dir).select("recording", "tau", "i")
    pairs = pairs.join(frames, ["recording", "tau"]).withColumn("bx", F.col("bx") + 0.01 * (F.col("i") % 5))
    return rig.sampson_px(pairs, *_POSE01, X.FOCAL).groupBy("recording", "joint").agg(r(F.avg("px"), 3).alias("px"))


_A, _O = [0.0, 1.0, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0, 1.0], [0.5, -0.25, 0.1]


@query(f"select recording, joint, {q('avg(2 * (y + 0.25::double))')} as x, {q('avg(-2 * (x - 0.5::double))')} as y, {q('avg(2 * (z - 0.1::double))')} as z from ({TRUTH}) t group by 1, 2")
def to_world(spark, sf_dir):
    return rig.to_world(X.truth(spark, sf_dir), _A, _O, 2.0).groupBy("recording", "joint").agg(*[r(F.avg(c)).alias(c) for c in "xyz"])


@query(f"""select recording, joint, {q('avg(320 / tan(radians(25::double)) * y / (5 - x) + 320)', 3)} as sx, {q('avg(320 / tan(radians(25::double)) * (1 - z) / (5 - x) + 240)', 3)} as sy, bool_and(true) as in_front from ({TRUTH}) t group by 1, 2""")
def viewer(spark, sf_dir):
    out = rig.view_project(X.truth(spark, sf_dir), (0.0, 0.0, 1.0), 0.0, 0.0, 5.0, (640, 480))
    return out.groupBy("recording", "joint").agg(r(F.avg("sx"), 3).alias("sx"), r(F.avg("sy"), 3).alias("sy"), F.bool_and("in_front").alias("in_front"))


@query(f"""with {ROBUST}, st as (select recording, count(*) as frames, max(tau) - min(tau) as duration, quantile_cont(d, 0.5) as m from (select recording, tau, tau - lag(tau) over (partition by recording order by tau) as d from inn) x group by 1),
a as (select recording, avg(case when z is null then 0.0::double else 1.0::double end) as valid, avg(views) as views, quantile_cont(z, 0.1) filter (where j in ({INDEX["left_heel"]}, {INDEX["right_heel"]})) as heel from marks group by 1),
e as (select recording, quantile_cont(px, 0.5) as median from px group by 1)
select recording, frames, {q('duration')} as duration, {q('1 / m')} as fps, {q('valid')} as valid, {q('views')} as views, {q('heel', 3)} as heel_p10, {q('median', 3)} as median_px, concat_ws(',', case when median > 4 then 'reprojection' end, case when abs(heel) > 0.06::double then 'floor' end) as warnings
 from st join a using (recording) join e using (recording)""")
def recording_report(spark, sf_dir):
    """The report of landmarks of damaged keypoints, so that some recordings are warned of."""
    out = report.recording_report(damaged_landmarks(spark, sf_dir))
    return out.select("recording", "frames", r("duration").alias("duration"), r("fps").alias("fps"), r("valid").alias("valid"), r("views").alias("views"), r("heel_p10", 3).alias("heel_p10"), r("median_px", 3).alias("median_px"), "warnings")


@query(f"{TRUTH_IN} select recording, {q('tau')} as t, {', '.join(q(f'max({a}) filter (where joint = {i})', 3) + f' as {n}_{a}' for i, n in enumerate(JOINTS) for a in 'xyz')} from inn group by recording, tau")
def landmarks_wide(spark, sf_dir):
    out = report.landmarks_wide(clean_landmarks(spark, sf_dir), 6)
    return out.select("recording", r("t").alias("t"), *[r(c, 3).alias(c) for c in out.columns[2:]])


@query(f"with k as ({CLEAN}), lim as (select recording, min(t) + 0.5::double as lo, max(t) - 0.5::double as hi from k group by 1) select recording, cam, joint, count(*) as n, {q('avg(u)', 3)} as u, {q('avg(v)', 3)} as v, {q('avg(u)', 3)} as pu, {q('avg(v)', 3)} as pv from k join lim using (recording) where t >= lo and t <= hi group by 1, 2, 3")
def reprojection_table(spark, sf_dir):
    out = report.reprojection_table(clean_landmarks(spark, sf_dir), clean_synced(spark, sf_dir), X.camera_rows())
    return out.groupBy("recording", "cam", "joint").agg(F.count("*").alias("n"), *[r(F.avg(c), 3).alias(c) for c in ("u", "v", "pu", "pv")])


@query(f"with tk as ({TRACKS}) select recording, cam, {q('t')} as t, track_id, {q('(x1 + x2) / 2', 2)} as u, {q('(y1 + y2) / 2', 2)} as v from tk")
def virtual_view_round_trip(spark, sf_dir):
    boxes = X.tracks(spark, sf_dir).withColumn("u", (F.col("x1") + F.col("x2")) / 2).withColumn("v", (F.col("y1") + F.col("y2")) / 2)
    seen = views.raw_to_crop(views.virtual_views(boxes, X.camera_rows()).drop("score", "frame_index", "i"), X.camera_rows()).drop("u", "v")
    return views.crop_to_raw(seen, X.camera_rows()).select("recording", "cam", r("t").alias("t"), "track_id", r("u", 2).alias("u"), r("v", 2).alias("v"))


_STAGES = [("people", ["a"]), ("pose", ["b"]), ("export", ["a", "b"])]


@query("""with c as (select distinct event_id // 1000 as recording from events), s as (select recording, 'people' as stage, substr(sha1('|' || recording), 1, 12) as f1 from c)
select recording, stage, f1 as fingerprint from s union all select recording, 'pose', substr(sha1(f1 || '|x' || (recording % 3)), 1, 12) from s
union all select recording, 'export', substr(sha1(substr(sha1(f1 || '|x' || (recording % 3)), 1, 12) || '|' || recording || '|x' || (recording % 3)), 1, 12) from s""")
def fingerprints(spark, sf_dir):
    rows = X.frames(spark, sf_dir).select("recording").distinct().select("recording", F.col("recording").cast("string").alias("a"), F.concat(F.lit("x"), F.col("recording") % 3).alias("b"))
    return report.fingerprints(rows, _STAGES)


@query()
def chunk_names(spark, sf_dir):
    return report.chunk_names(keypoints(spark, sf_dir).select("recording", "cam", "t"))


@query(f"with f as ({FRAMES}), c as (select distinct recording, cam, (row_number() over (partition by recording, cam order by t) - 1) // 300 as chunk from f) select recording, cam, cast(chunk as bigint) as chunk from c where chunk % 2 = 1")
def pending_chunks(spark, sf_dir):
    todo = report.chunk_names(keypoints(spark, sf_dir).select("recording", "cam", "t")).select("recording", "cam", F.col("chunk").cast("long").alias("chunk"))
    return report.pending(todo, todo.where("chunk % 2 = 0"), ["recording", "cam", "chunk"])


@query(f"""with v as ({X.BOARD}), p as ({X.BOARD_POINTS.replace('D,', '::double,').replace('D)', '::double)')}), s as (select cam, view, max(sharpness) as sharpness, count(*) as n, var_pop(x) as a, var_pop(y) as b, covar_pop(x, y) as c from v left join p using (point_id) group by 1, 2),
e as (select *, (a + b) / 2 as m, sqrt(pow((a - b) / 2, 2) + pow(c, 2)) as d from s), w as (select *, coalesce(case when m + d = 0 then null else sqrt(greatest(m - d, 0) / (m + d)) end, 0) as ratio from e)
select cam, case when n < 4 then 'too_few' when sharpness < 100 then 'blurry' when n < 6 or ratio < 0.15::double then 'degenerate' else 'ok' end as reason, count(*) as views from w group by 1, 2""")
def board_view_funnel(spark, sf_dir):
    out = calibration.board_view_funnel(X.from_lineitem(spark, sf_dir, X.BOARD), spark.sql(X.BOARD_POINTS), 4, 100.0)
    return out.groupBy("cam", "reason").agg(F.count("*").alias("views"))


@query(f"""with v as ({X.BOARD}), c as (select cam, greatest(0, least(11, cast(floor(v / 1024 * 12) as int))) * 12 + greatest(0, least(11, cast(floor(u / 1280 * 12) as int))) as cell, count(*) as points from v group by 1, 2) select *, 144 - count(*) over (partition by cam) as empty from c""")
def coverage_map(spark, sf_dir):
    return calibration.coverage_map(X.from_lineitem(spark, sf_dir, X.BOARD), X.BOARD_SIZE)


@query(f"with m as ({X.MOTION}), g as (select * from m where x % 4 = 0 and y % 4 = 0) select cam, x, y, hits from (select *, max(hits) over (partition by cam) as top from g) z where hits > 0.02::double * top")
def work_area(spark, sf_dir):
    return calibration.work_area(X.from_lineitem(spark, sf_dir, X.MOTION))


def board_cameras():
    return [c | {"width": 1280, "height": 1024} for c in X.camera_rows()]


@query(f"with v as ({X.BOARD}) select cam, {q('quantile_cont(sqrt(pow(u - 640, 2) + pow(v - 480, 2)), 0.99)')} as covered_r, {q('sqrt(640 * 640 + 544 * 544)')} as corner_r, {q('quantile_cont(sqrt(pow(u - 640, 2) + pow(v - 480, 2)), 0.99) / sqrt(640 * 640 + 544 * 544)')} as covered_frac from v group by 1")
def calibration_reach(spark, sf_dir):
    out = calibration.calibration_validity(X.from_lineitem(spark, sf_dir, X.BOARD), board_cameras())
    return out.select("cam", r("covered_r").alias("covered_r"), r("corner_r").alias("corner_r"), r("covered_frac").alias("covered_frac"))


@query()
def calibration_validity(spark, sf_dir):
    work = calibration.work_area(X.from_lineitem(spark, sf_dir, X.MOTION)).select("cam", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "hits")
    return calibration.calibration_validity(X.from_lineitem(spark, sf_dir, X.BOARD), board_cameras(), work)


@query()
def select_views(spark, sf_dir):
    return calibration.select_views(X.from_lineitem(spark, sf_dir, X.BOARD), X.BOARD_SIZE, 40)


RESIDUALS = "select cast(l_orderkey % 3 as int) as cam, case when l_linenumber % 2 = 0 then 'pinhole' else 'fisheye' end as model, l_orderkey DIV 50 as view, cast(l_quantity as double) / 20 * (case when l_orderkey DIV 50 % 17 = 0 then 6 else 1 end) as du, cast(l_suppkey % 10 as double) / 5 as dv from lineitem"
RMS = f"with e as ({X.sql(RESIDUALS, 'duckdb')}), s as (select cam, model, view, count(*) as n, sqrt(avg(du * du + dv * dv)) as rms from e group by 1, 2, 3)"


def residuals(spark, sf_dir):
    return X.from_lineitem(spark, sf_dir, X.sql(RESIDUALS, "spark"))


@query(f"{RMS} select cam, model, view, n, {q('rms')} as rms from s")
def view_rms(spark, sf_dir):
    return calibration.view_rms(residuals(spark, sf_dir)).withColumn("rms", r("rms"))


@query(f"{RMS}, t as (select cam, model, sqrt(sum(n * rms * rms) / sum(n)) as rms from s group by 1, 2), w as (select cam, max(rms) filter (where model = 'pinhole') as p, max(rms) filter (where model = 'fisheye') as f from t group by 1) select cam, case when f is null or p < 0.9::double * f then 'pinhole' else 'fisheye' end as model from w")
def lens_model(spark, sf_dir):
    return calibration.choose_model(calibration.total_rms(calibration.view_rms(residuals(spark, sf_dir))))


@query(f"{RMS}, x as (select *, count(*) over k as c, quantile_cont(rms, 0.5) over k as m, row_number() over (partition by cam, model order by rms desc, view) as nr from s window k as (partition by cam, model)) select cam, model, view, n, {q('rms')} as rms from x where rms > greatest(2.0::double, 3 * m) and nr <= least(ceil(c * 0.1::double), greatest(0, c - 8))")
def bad_views(spark, sf_dir):
    return calibration.bad_views(calibration.view_rms(residuals(spark, sf_dir))).withColumn("rms", r("rms"))


@query()
def motion_signal(spark, sf_dir):
    kp = keypoints(spark, sf_dir)
    return sync.motion_signal(kp, kp.select("recording", "cam", "t")).withColumn("signal", r("signal"))


@query(f"select recording, cam, cast(round(offset_s * 30) as int) as thirtieths from ({X.studio_offsets_sql('duckdb')}) o")
def coarse_offsets(spark, sf_dir):
    """Clock offsets of the studio's recordings by motion alone, in thirtieths of a second: right to a sixtieth."""
    found = sync.coarse_offsets(X.studio_keypoints(spark, sf_dir), "cam1")
    return found.select("recording", "cam", F.round(F.col("offset_s") * 30).cast("int").alias("thirtieths"))


_REF = f"select recording, t, i from ({X.studio_frames_sql('duckdb')}) f where cam = 0 and not ({X.HOLE})"
_IN = f"select recording, t, i from (select *, min(t) over (partition by recording) as lo, max(t) over (partition by recording) as hi from ({_REF}) r) x where t >= lo + 0.5::double and t <= hi - 0.5::double"


@query(f"""with tau as materialized ({_IN}), d as (select *, t - lag(t) over (partition by recording order by t) as dt from tau),
o as (select recording, string_agg(cam || ' ' || cast(round(offset_s * 300) as int), ',' order by cam) as offsets from ({X.studio_offsets_sql('duckdb')}) x group by 1)
select recording, count(*) as frames, {q("max(t) - min(t)", 3)} as duration, {q("1 / quantile_cont(dt, 0.5)", 3)} as fps, any_value(offsets) as offsets, 'multiview' as method, true as walker, 6 as chained, 1.0::double as valid, 0.02::double as heel_p10, '' as warnings,
 '{" ".join(f"{round(z, 1) + 0.0}" for _, _, z in X.BODY)}' as heights from d join o using (recording) group by 1""")
def studio_report(spark, sf_dir):
    """From tracks and keypoints of named recordings to reports, in one job: who acts, the clocks (no offset is given), landmarks, rigs. Offsets in 1/300 s, so right to 1.7 ms; the joints' mean heights to 0.1 m."""
    out = files.shared_folder(spark)
    points, boxes = X.studio_keypoints(spark, sf_dir), X.studio_tracks(spark, sf_dir)
    todo = points.select("recording").distinct().withColumn("fingerprint", F.lit("first"))
    studio.run(boxes, points, todo, X.camera_rows(), X.STUDIO_CAMERAS, out)
    told = studio.reports(spark, out)
    offsets = F.array_join(F.transform(F.array_sort("offsets"), lambda o: F.concat_ws(" ", o.cam, F.round(o.ms * 0.3).cast("int"))), ",")
    walker = F.forall(F.arrays_zip(F.col("seeds").alias("s"), F.array(F.lit(5), F.lit(3), F.lit(9)).alias("w")), lambda p: p["s"] % 100 == p["w"])
    means = studio.landmarks(spark, out).groupBy("recording", "joint").agg(F.avg(F.col("z").cast("double")).alias("z")).groupBy("recording")
    heights = means.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("joint", F.round("z", 1).alias("z")))), lambda x: (x.z + 0.0).cast("string")), " ").alias("heights"))
    return told.join(heights, "recording").select("heights", "recording", "frames", r("duration", 3).alias("duration"), r("fps", 3).alias("fps"), offsets.alias("offsets"), "method", walker.alias("walker"), F.col("chained").cast("int").alias("chained"), r("valid", 2).alias("valid"), r("heel_p10", 2).alias("heel_p10"), F.array_join("warnings", ",").alias("warnings"))


_LATE = {"cam3": 0.11, "cam4": -0.13}


@query(f"select recording, cam, cast(round(offset_s * 300) as int) as three_hundredths from ({X.studio_offsets_sql('duckdb')}) o")
def refine_offsets(spark, sf_dir):
    """Clock offsets of the studio's recordings in 1/300 s, so right to 1.7 ms; they start wrong by 110 and 130 ms."""
    kp = slice_.numbered_cameras(X.studio_keypoints(spark, sf_dir), X.STUDIO_CAMERAS)
    start = X.from_events(spark, sf_dir, X.studio_offsets_sql("spark"))
    start = slice_.numbered_cameras(start.withColumn("offset_s", F.col("offset_s") + F.when(F.col("cam") == "cam3", _LATE["cam3"]).otherwise(_LATE["cam4"])), X.STUDIO_CAMERAS)
    found = sync.refine_offsets(kp, X.camera_rows(), times_of(kp), start)
    name = F.element_at(F.array(*map(F.lit, X.STUDIO_CAMERAS)), F.col("cam") + 1)
    return found.select("recording", name.alias("cam"), F.round(F.col("offset_s") * 300).cast("int").alias("three_hundredths"))


_TRUE_RIG = reconstruction.camera_list(X.camera_rows())


def _moved_rigs() -> list[dict]:
    """Two rigs of the scene's cameras: in the first the third camera stands 0.3 m off, in the second the second one is turned by 0.06 about the first one."""
    rigs, first = [], _TRUE_RIG[0]
    for name, cam, d in (("one", 2, [0.0, 0.0, 0.0, 0.2, -0.2, 0.1]), ("two", 1, [0.03, -0.04, 0.03, 0.0, 0.0, 0.0])):
        for c, row in zip(_TRUE_RIG, X.camera_rows(), strict=True):
            own_r, own_t = rig.relative_pose(first, c)
            moved = bundle.turned(replace(c, r=own_r, t=own_t), np.array(d)) if c.cam == cam else None
            moved = replace(c, r=moved.r @ first.r, t=moved.t + moved.r @ first.t) if moved else c
            rigs.append(row | {"rig": name, "r": [float(v) for v in moved.r.ravel()], "t": [float(v) for v in moved.t]})
    return rigs


@query("select rig, cam, x, y, z from (values " + ", ".join(f"({c.cam}, " + ", ".join(f"{round(float(v), 3) + 0.0}::double" for v in c.center) + ")" for c in _TRUE_RIG) + ") as c(cam, x, y, z) cross join (select distinct if(event_id // 1000 % 2 = 0, 'one', 'two') as rig from events) e")
def refine_rig(spark, sf_dir):
    """Two rigs at once, each with a camera that was moved, found again from the walkers that each has filmed: the cameras' places to 1 mm."""
    rows = clean_synced(spark, sf_dir).withColumn("rig", F.when(F.col("recording") % 2 == 0, "one").otherwise("two"))
    names = ["rig", "cam", "model", "width", "height", "k", "d", "r", "t"]
    rigs = spark.createDataFrame([tuple(c[n] for n in names) for c in _moved_rigs()], "rig string, cam int, model string, width int, height int, k array<double>, d array<double>, r array<double>, t array<double>")
    found = bundle.refine_rigs(rows, rigs.join(rows.select("rig").distinct(), "rig", "left_semi"))
    place = [-sum((F.get("r", F.lit(3 * i + k)) * F.get("t", F.lit(i)) for i in range(3)), F.lit(0.0)) for k in range(3)]
    return found.select("rig", "cam", *[r(p, 3).alias(c) for p, c in zip(place, "xyz", strict=True)])


_RIG_SQL = "if(recording % 2 = 0, 'one', 'two')"
#: The second rig lists the scene's cameras from another one on.
_ORDER = {"one": [0, 1, 2], "two": [1, 2, 0]}


def _unit_places() -> list[tuple]:
    """rig, cam, and where each camera is from the first one, in units of the first pair's distance."""
    out = []
    for name, order in _ORDER.items():
        first, base = _TRUE_RIG[order[0]], None
        for b, c in enumerate(order[1:], 1):
            r_, t = rig.relative_pose(first, _TRUE_RIG[c])
            base = base or float(np.linalg.norm(t))
            out.append((name, b, *[float(v) for v in -r_.T @ t / base]))
    return out


def studio_rays(spark, sf_dir):
    """Rays of two rigs on recordings of their own."""
    rays, n = rig.undistorted(clean_synced(spark, sf_dir), X.camera_rows()).withColumn("rig", F.expr(_RIG_SQL)), len(JOINTS)
    turned = lambda c: F.when(F.col("rig") == "one", F.col(c)).otherwise(F.concat(*[F.slice(c, n * k + 1, n) for k in _ORDER["two"]]))
    return files.kept(rays.select("rig", "recording", "tau", turned("a").alias("a"), turned("b").alias("b"), turned("conf").alias("conf")))


@query("select rig, b, x, y, z from (values " + ", ".join(f"('{n}', {b}, {', '.join(str(round(v * 26)) for v in p)})" for n, b, *p in _unit_places()) + f") as c(rig, b, x, y, z) semi join (select distinct {_RIG_SQL} as rig from (select event_id // 1000 as recording from events) e) e using (rig)")
def calibrate_rig(spark, sf_dir):
    """Two rigs from the motion alone: where each camera is from the first one, in 1/26 of the first pair's distance (no place is within 1/80 of a border)."""
    rays = studio_rays(spark, sf_dir)
    poses = selfcalib.chained(rays, selfcalib.relative_poses(selfcalib.pair_blocks(rays, len(JOINTS), 0.6), X.FOCAL), len(JOINTS))
    place = [-sum((F.get("r", F.lit(3 * i + k)) * F.get("t", F.lit(i)) for i in range(3)), F.lit(0.0)) for k in range(3)]
    return poses.select("rig", "b", *[F.round(p * 26).cast("int").alias(c) for p, c in zip(place, "xyz", strict=True)])


@query()
def scene_from_keypoints(spark, sf_dir):
    """The whole way on recordings and cameras known by name, each recording with its own clock offsets: repair, triangulation, bones, gaps, smoothing; a row for each recording."""
    kp = X.keypoints(spark, sf_dir).select(F.concat(F.lit("r"), "recording").alias("recording"), F.concat(F.lit("cam"), "cam").alias("cam"), "t", "u", "v", "conf")
    offsets = kp.select("recording").distinct().crossJoin(spark.sql(X.offsets_sql()))
    _, smooth = slice_.landmarks(slice_.numbered_cameras(kp, [f"cam{c}" for c in range(X.CAMERAS)]), X.camera_rows(), offsets)
    return smooth.groupBy("recording").agg(F.count("x").alias("points"), F.sum(F.col("filled").cast("int")).cast("long").alias("filled"), r(F.avg("z"), 1).alias("z"), F.min("t").alias("first_s"), F.max("t").alias("last_s"))


#: The second rig's frame is turned and shifted against the world.
_TURN = bundle.turned(_TRUE_RIG[0], np.array([0.4, -0.2, 0.9, 0, 0, 0])).r @ _TRUE_RIG[0].r.T
_SHIFT = np.array([0.5, -1.0, 3.0])


def rig_landmarks(spark, sf_dir):
    """(packed landmarks of two rigs in their own frames, their cameras)."""
    rows = clean_landmarks(spark, sf_dir).withColumn("rig", F.expr(_RIG_SQL))

    def axis(i: int):
        return F.transform(F.arrays_zip("x", "y", "z"), lambda p: sum((p[c] * float(_TURN[i, k]) for k, c in enumerate("xyz")), F.lit(float(_SHIFT[i]))))

    mixed = [F.when(F.col("rig") == "one", F.col(c)).otherwise(a).alias(c) for c, a in zip("xyz", map(axis, range(3)), strict=True)]
    cams = []
    for name in _ORDER:
        for row, c in zip(X.camera_rows(), _TRUE_RIG, strict=True):
            own_r = c.r if name == "one" else c.r @ _TURN.T
            own_t = c.t if name == "one" else c.t - own_r @ _SHIFT
            cams.append((name, c.cam, row["model"], row["width"], row["height"], row["k"], row["d"], [float(v) for v in own_r.ravel()], [float(v) for v in own_t]))
    cameras = spark.createDataFrame(cams, "rig string, cam int, model string, width int, height int, k array<double>, d array<double>, r array<double>, t array<double>")
    return files.kept(rows.select("rig", "recording", "tau", *mixed)), cameras


@query(f"{TRUTH_IN} select {_RIG_SQL} as rig, joint, count(*) as n, {q('avg(z) - 0.02::double', 3)} as z from inn group by 1, 2")
def fit_floor(spark, sf_dir):
    """The floors of two rigs, one of them in a turned frame: how high each joint is above it on average."""
    rows, cameras = rig_landmarks(spark, sf_dir)
    floors = selfcalib.fit_floors(rows, cameras).select("rig", *[F.get("a", F.lit(6 + k)).alias(f"up{k}") for k in range(3)], *[F.get("o", F.lit(k)).alias(f"o{k}") for k in range(3)])
    long = rows.select("rig", F.posexplode(F.arrays_zip("x", "y", "z")).alias("joint", "p")).where("p.x is not null").join(floors, "rig")
    height = sum(((F.col(f"p.{c}") - F.col(f"o{k}")) * F.col(f"up{k}") for k, c in enumerate("xyz")), F.lit(0.0))
    return long.groupBy("rig", "joint").agg(F.count("*").alias("n"), r(F.avg(height), 3).alias("z"))


_MARK, _LENGTH, _HAND, _WHEN = (0.5, 0.4, 0.1), 1.5, 0.07, 20.03


@query(f"""{TRUTH_IN}, f as (select recording, arg_min(tau, abs(tau - {_WHEN}::double)) as tau from inn where recording < 2 group by 1)
select {_RIG_SQL} as rig, {q('tau')} as tau, {q(f"({_LENGTH}::double - {_HAND}::double) / sqrt(pow(x - {_MARK[0]}::double, 2) + pow(y - {_MARK[1]}::double, 2) + pow(z - {_MARK[2]}::double, 2))")} as scale
 from inn join f using (recording, tau) where joint = {INDEX["left_wrist"]}""")
def handle_scale(spark, sf_dir):
    """Metres per unit of two rigs from a handle of known length: its end marked in the pictures, the other end in the upper hand at the frame nearest to the marks' time."""
    rows, cameras = rig_landmarks(spark, sf_dir)
    marks, known = [], []
    for k, name in enumerate(_ORDER):
        for c in _TRUE_RIG[k:]:  # the second rig's mark is seen by two cameras
            uv = c.project(np.array([_MARK]))[0]
            marks.append((name, "handle", c.cam, float(uv[0]), float(uv[1])))
        up = [0.0, 0.0, 1.0] if name == "one" else [float(v) for v in _TURN[:, 2]]
        known.append((name, k, "handle", _WHEN, _LENGTH, _HAND, up))
    marks, known = spark.createDataFrame(marks, "rig string, mark string, cam int, u double, v double"), spark.createDataFrame(known, "rig string, recording long, mark string, time_s double, length_m double, hand_offset_m double, up array<double>")
    # both wrists are equally high in the scene: the right one goes a little lower in the first rig, and is missing in the second
    right = F.lit(INDEX["right_wrist"])
    lower = F.transform("z", lambda z, j: F.when((j == right) & (F.col("rig") == "one"), z - 0.01).otherwise(z))
    hidden = F.transform("x", lambda x, j: F.when((j != right) | (F.col("rig") == "one"), x))
    return selfcalib.handle_scales(marks, rows.withColumns({"z": lower, "x": hidden}), cameras, known).select("rig", r("tau").alias("tau"), r("scale").alias("scale"))
