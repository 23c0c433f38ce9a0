"""A walking scene derived from ``events`` by arithmetic that Spark and DuckDB repeat alike.

1,000 consecutive events are one recording; an event is a frame. Three fisheye cameras look at one walker. The same
SQL text serves both engines, but for integer division.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.files import exists, shared_folder

# Fixed values of the scene: camera model and places, clock offsets, image size.
FOCAL, CX, CY, WIDTH, HEIGHT = 420.0, 640.0, 480.0, 1280, 960
DISTORTION = (0.05, -0.02, 0.008, -0.002)
PLACES = [(3.0, 0.0, 2.5), (-1.5, 2.6, 2.5), (-1.5, -2.6, 2.5)]
TARGET = (0.0, 0.0, 1.0)
OFFSETS = [0.0, 0.173, -0.211]
CAMERAS = len(PLACES)

#: Where each joint is relative to the walker (x ahead, y to the left, z up, metres), in the order of skeleton.JOINTS.
BODY = [
    (0.10, 0.00, 1.62), (0.08, 0.03, 1.66), (0.08, -0.03, 1.66), (0.01, 0.07, 1.64), (0.01, -0.07, 1.64),
    (0.00, 0.19, 1.40), (0.00, -0.19, 1.40), (0.03, 0.24, 1.12), (0.03, -0.24, 1.12), (0.12, 0.25, 0.90), (0.12, -0.25, 0.90),
    (0.00, 0.11, 0.94), (0.00, -0.11, 0.94), (0.03, 0.12, 0.51), (0.03, -0.12, 0.51), (0.00, 0.12, 0.09), (0.00, -0.12, 0.09),
    (0.17, 0.11, 0.02), (0.14, 0.17, 0.02), (-0.06, 0.12, 0.02), (0.17, -0.11, 0.02), (0.14, -0.17, 0.02), (-0.06, -0.12, 0.02),
]


def look_at(place, target=TARGET) -> tuple[list[list[float]], list[float]]:
    """(R, t) of a camera at ``place`` that looks at ``target``: z ahead, x to the right, y down."""
    z = [b - a for a, b in zip(place, target, strict=True)]
    norm = math.sqrt(sum(v * v for v in z))
    z = [v / norm for v in z]
    x = [z[1], -z[0], 0.0]
    norm = math.sqrt(sum(v * v for v in x))
    x = [v / norm for v in x]
    y = [z[1] * x[2] - z[2] * x[1], z[2] * x[0] - z[0] * x[2], z[0] * x[1] - z[1] * x[0]]
    rotation = [x, y, z]
    return rotation, [-sum(r * p for r, p in zip(row, place, strict=True)) for row in rotation]


POSES = [look_at(p) for p in PLACES]


def number(x: float) -> str:
    """A double literal for both engines."""
    return f"cast({x!r} as double)"


def _case(index: str, values) -> str:
    return "(case " + index + " " + " ".join(f"when {i} then {number(v)}" for i, v in enumerate(values)) + " end)"


def sql(text: str, engine: str) -> str:
    """``DIV`` is integer division."""
    return text.replace(" DIV ", " div " if engine == "spark" else " // ")


_FRAME = "cast(event_id % 1000 as int) as i, event_id, cast(event_id % 1000 as double) / 15 + cast(event_id % 7 as double) / 1000 as tau"
FRAMES = f"select event_id DIV 1000 as recording, {_FRAME} from events"


def tri(period: int) -> str:
    half = number(period / 2)
    return f"(abs(cast(i % {period} as double) - {half}) / {half} - {number(0.5)})"


def _world(joint: str) -> tuple[str, str, str]:
    return (
        f"({_case(joint, [b[0] for b in BODY])} + {tri(200)})",
        f"({_case(joint, [b[1] for b in BODY])} + {number(0.8)} * {tri(140)})",
        _case(joint, [b[2] for b in BODY]),
    )


def _fisheye(a: str, b: str) -> tuple[str, str]:
    """SQL for the pixel of a point with normalised coordinates a, b (columns)."""
    r = f"sqrt({a} * {a} + {b} * {b})"
    th = f"atan({r})"
    k1, k2, k3, k4 = map(number, DISTORTION)
    s2 = f"({th} * {th})"
    scale = f"(case when {r} = 0 then {number(1.0)} else {th} * (1 + {k1} * {s2} + {k2} * {s2} * {s2} + {k3} * {s2} * {s2} * {s2} + {k4} * {s2} * {s2} * {s2} * {s2}) / {r} end)"
    return f"({number(FOCAL)} * {a} * {scale} + {number(CX)})", f"({number(FOCAL)} * {b} * {scale} + {number(CY)})"


def _camera(k: str, x: str, y: str, z: str) -> str:
    """SQL for coordinate 0, 1 or 2 of a world point in camera ``cam``."""
    i = int(k)
    r = [_case("cam", [pose[0][i][j] for pose in POSES]) for j in range(3)]
    return f"({r[0]} * {x} + {r[1]} * {y} + {r[2]} * {z} + {_case('cam', [pose[1][i] for pose in POSES])})"


_SWAP = {5: 6, 6: 5, 7: 8, 8: 7, 9: 10, 10: 9}


def truth_sql(engine: str) -> str:
    """recording, i, tau, joint, x, y, z."""
    x, y, z = _world("joint")
    joints = "select explode(sequence(0, 22)) as joint" if engine == "spark" else "select cast(range as int) as joint from range(23)"
    return sql(f"select recording, i, tau, joint, {x} as x, {y} as y, {z} as z from ({FRAMES}) f cross join ({joints}) j", engine)


def keypoints_sql(engine: str, damage: bool = True, offsets: bool = True) -> str:
    """recording, cam, i, t, joint, u, v, conf in long form.

    With ``damage``: dropped frames, a gap in camera 1, outlier views in camera 2, swapped arms in camera 1. With ``offsets`` each
    camera has its clock and jitter.
    """
    x, y, z = _world("place")
    number_list = "select explode(sequence(0, {n})) as {c}" if engine == "spark" else "select cast(range as int) as {c} from range({m})"
    joints, cams = (number_list.format(n=n - 1, m=n, c=c) for n, c in ((23, "joint"), (CAMERAS, "cam")))
    swap = "case joint " + " ".join(f"when {a} then {b}" for a, b in _SWAP.items()) + " else joint end"
    place = f"(case when cam = 1 and i % 250 between 20 and 59 then {swap} else joint end)" if damage else "joint"
    drop = "where not ((i * 7 + cam * 13) % 97 < 2 or (cam = 1 and i between 300 and 320))" if damage else ""
    shift = f"(case when cam = 2 and i % 50 = 7 then {number(80.0)} else {number(0.0)} end)" if damage else number(0.0)
    t = f"cast(i as double) / 15 + cast((event_id + 3 * cam) % 7 as double) / 1000 + {_case('cam', OFFSETS)}" if offsets else "tau"
    u, v = _fisheye("a", "b")
    return sql(
        f"""
        select recording, cam, i, t, joint, {u} + {shift} as u, {v} + {shift} as v, cast(0.5 as double) + cast((i * 7 + joint * 3 + cam) % 50 as double) / 100 as conf
        from (select *, {_camera("0", "x", "y", "z")} / {_camera("2", "x", "y", "z")} as a, {_camera("1", "x", "y", "z")} / {_camera("2", "x", "y", "z")} as b
              from (select *, {x} as x, {y} as y, {z} as z
                    from (select recording, cam, i, {t} as t, joint, {place} as place from ({FRAMES}) f cross join ({cams}) c cross join ({joints}) j {drop}) p) w) n""",
        engine,
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")


def from_events(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run fixture SQL over the events of ``sf_dir``."""
    return spark.sql(text.replace("from events", "from {events}"), events=events(spark, sf_dir))


_WRITTEN: dict[tuple, tuple] = {}


def once(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A derived table, written in the shared folder by the first query of an application that asks for it, and read from there by the others."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    path, schema = _WRITTEN.get(key, (None, None))
    if path is None or not exists(spark, path):
        table = build()
        path, schema = shared_folder(spark), table.schema
        table.write.parquet(path)
        _WRITTEN[key] = path, schema
    return spark.read.schema(schema).parquet(path)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(spark, sf_dir, sql(FRAMES, "spark"))


def by_recording(spark: SparkSession, sf_dir: str, recording: str = "event_id DIV 1000") -> DataFrame:
    """recording, event_id: the events dealt by recording, some 25 recordings a task; what is derived from them row by row stays so dealt, and grouping it by recording shuffles nothing."""
    rows = events(spark, sf_dir).select(F.expr(sql(recording, "spark")).alias("recording"), "event_id")
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // 25_000 + 1), "recording")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(spark, sf_dir, truth_sql("spark"))


#: Numbers 0 ... 999, the frames of a recording.
NUMBERS = "select cast(id as int) as i from range(0, 1000, 1, 8)"


def _pictures_sql(steps: list[str]) -> str:
    """Steps within one another, and SQL for the pixels ``u`` and ``v`` of their ``flat`` points; each step is computed once for a joint."""
    k1, k2, k3, k4 = map(number, DISTORTION)
    steps = [
        *steps,
        "select *, transform(flat, q -> sqrt(q.a * q.a + q.b * q.b)) as radii from ({}) s3",
        "select *, transform(radii, r -> atan(r)) as angles from ({}) s4",
        "select *, transform(angles, a -> a * a) as squares from ({}) s5",
        f"select *, transform(squares, (s, k) -> if(get(radii, k) = 0, {number(1.0)}, get(angles, k) * (1 + {k1} * s + {k2} * s * s + {k3} * s * s * s + {k4} * s * s * s * s) / get(radii, k))) as scales from ({{}}) s6",
        f"select *, zip_with(flat, scales, (q, s) -> {number(FOCAL)} * q.a * s + {number(CX)} + shift) as u, zip_with(flat, scales, (q, s) -> {number(FOCAL)} * q.b * s + {number(CY)} + shift) as v from ({{}}) s7",
    ]
    text = steps[0]
    for step in steps[1:]:
        text = step.replace("{}", text)
    return sql(text, "spark")


def _pictures(spark: SparkSession, damage: bool) -> DataFrame:
    """cam, i, u, v, conf: what a camera sees in the i-th frame. It is the same in every recording, so 3,000 rows say it for all of them."""
    names = [f"r{i}{j}" for i in range(3) for j in range(3)] + ["t0", "t1", "t2"]
    values = ", ".join("(" + ", ".join([str(c), *[number(v) for row in r for v in row], *map(number, t)]) + ")" for c, (r, t) in enumerate(POSES))
    cams = f"select * from (values {values}) as c(cam, {', '.join(names)})"
    body = [f"array({', '.join(number(b[k]) for b in BODY)})" for k in range(3)]
    swap = ", ".join(str(_SWAP.get(j, j)) for j in range(23))
    places = f"if(cam = 1 and i % 250 between 20 and 59, array({swap}), sequence(0, 22))" if damage else "sequence(0, 22)"
    shift = f"if(cam = 2 and i % 50 = 7, {number(80.0)}, {number(0.0)})" if damage else number(0.0)
    row = "(r{0}0 * p.x + r{0}1 * p.y + r{0}2 * p.z + t{0})"
    text = _pictures_sql([
        f"select cam, i, {places} as places, {shift} as shift, {tri(200)} as dx, {number(0.8)} * {tri(140)} as dy, {', '.join(names)} from ({NUMBERS}) f cross join ({cams}) c",
        f"select *, transform(places, j -> named_struct('x', get({body[0]}, j) + dx, 'y', get({body[1]}, j) + dy, 'z', get({body[2]}, j))) as points from ({{}}) s0",
        f"select *, transform(points, p -> named_struct('a', {row.format(0)}, 'b', {row.format(1)}, 'c', {row.format(2)})) as seen from ({{}}) s1",
        "select *, transform(seen, q -> named_struct('a', q.a / q.c, 'b', q.b / q.c)) as flat from ({}) s2",
    ])
    return spark.sql(text).selectExpr("cam", "i", "u", "v", "transform(sequence(0, 22), joint -> cast(0.5 as double) + cast((i * 7 + joint * 3 + cam) % 50 as double) / 100) as conf")


def keypoints(spark: SparkSession, sf_dir: str, damage: bool = True, offsets: bool = True) -> DataFrame:
    """The packed table: a row for each camera frame, arrays by joint, dealt by recording. A frame's joints come from one event, so only events are shuffled.

    The same numbers as ``keypoints_sql``; pictures are computed once for all recordings.
    """
    pictures = once(spark, "", f"pictures-{damage}", lambda: _pictures(spark, damage))
    cams = f"select * from (values {', '.join(f'({c}, {number(o)})' for c, o in enumerate(OFFSETS))}) as c(cam, shift_s)"
    drop = "where not ((i * 7 + cam * 13) % 97 < 2 or (cam = 1 and i between 300 and 320))" if damage else ""
    t = "cast(i as double) / 15 + cast((event_id + 3 * cam) % 7 as double) / 1000 + shift_s" if offsets else "tau"
    rows = spark.sql(f"select recording, cam, i, {t} as t from (select recording, {_FRAME} from {{events}}) f cross join ({cams}) c {drop}", events=by_recording(spark, sf_dir))
    return rows.join(F.broadcast(pictures), ["cam", "i"], "left").select("recording", "cam", "i", "t", "u", "v", "conf")


def camera_rows() -> list[dict]:
    """The rig as rows of the ``cameras`` table."""
    return [
        {"rig": "scene", "cam": c, "model": "fisheye", "width": WIDTH, "height": HEIGHT, "k": [FOCAL, 0.0, CX, 0.0, FOCAL, CY, 0.0, 0.0, 1.0], "d": list(DISTORTION), "r": [v for row in r for v in row], "t": t, "rms": 0.5}
        for c, (r, t) in enumerate(POSES)
    ]


def offsets_sql() -> str:
    return "select * from (values " + ", ".join(f"({c}, {number(o)})" for c, o in enumerate(OFFSETS)) + ") as o(cam, offset_s)"


def tracks_sql(engine: str) -> str:
    """recording, cam, i, t, frame_index, track_id, x1, y1, x2, y2, score: a walker whose id changes after a hole, a sitter, doubles and untracked boxes."""
    cams = f"select explode(sequence(0, {CAMERAS - 1})) as cam" if engine == "spark" else f"select cast(range as int) as cam from range({CAMERAS})"
    kinds = "select explode(sequence(0, 3)) as kind" if engine == "spark" else "select cast(range as int) as kind from range(4)"
    u, v = _fisheye("a", "b")
    x, y, zero = tri(200), f"({number(0.8)} * {tri(140)})", number(0.0)
    depth = _camera("2", x, y, zero)
    return sql(
        f"""
        select recording, cam, i, t, frame_index, track_id, foot_u - 40 as x1, foot_v - 200 as y1, foot_u + 40 as x2, foot_v as y2, score from (
          select recording, cam, i, cast(i as double) / 15 + cast(cam as double) / 100 as t, cast(2 * i as bigint) as frame_index,
            case kind when 1 then (case cam when 0 then 2 when 1 then 4 else 7 end) when 3 then -1 else (case cam when 0 then 5 when 1 then 3 else 9 end) + (case when i >= 510 then 100 else 0 end) end as track_id,
            case when kind = 1 then cast(300 + cam * 50 + i % 3 as double) when kind = 3 then cast(i % 700 as double) else {u} + (case when kind = 2 then {number(5.0)} else {number(0.0)} end) end as foot_u,
            case when kind = 1 then cast(700 + i % 2 as double) when kind = 3 then cast(500 as double) else {v} end as foot_v,
            case when kind = 2 then {number(0.3)} else cast(0.5 as double) + cast(i % 50 as double) / 100 end as score
          from (select f.*, c.cam, k.kind, {_camera("0", x, y, zero)} / {depth} as a, {_camera("1", x, y, zero)} / {depth} as b from ({FRAMES}) f cross join ({cams}) c cross join ({kinds}) k) w
          where kind = 1 or (kind = 0 and i not between 500 and 509) or (kind = 2 and i % 31 = 0 and i not between 500 and 509) or (kind = 3 and i % 17 = 0)) r""",
        engine,
    )


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(spark, sf_dir, tracks_sql("spark"))


#: Board views: a view is an order, its points are the lines; places and sharpness by arithmetic.
BOARD = "select cast(l_orderkey % 3 as int) as cam, l_orderkey as view, cast(l_orderkey as double) / 10 as t, cast(l_linenumber as int) as point_id, cast((l_partkey * 37) % 1280 as double) as u, cast((l_suppkey * 53) % 1024 as double) as v, cast(l_quantity as double) * 3 as sharpness from lineitem"
MOTION = "select cast(l_orderkey % 3 as int) as cam, cast(l_partkey % 1280 as int) as x, cast((l_suppkey * 7) % 1024 as int) as y, cast(count(*) as double) as hits from lineitem group by 1, 2, 3"
BOARD_POINTS = "select * from (values (1, 0.0D, 0.0D), (2, 1.0D, 0.0D), (3, 2.0D, 0.0D), (4, 0.0D, 1.0D), (5, 1.0D, 1.0D), (6, 2.0D, 2.0D), (7, 4.0D, 0.1D)) as p(point_id, x, y)"
BOARD_SIZE = (1280, 1024)


def from_lineitem(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return spark.sql(text.replace("from lineitem", "from {lineitem}"), lineitem=rows)


# A studio: recordings and cameras known by name, a walker who swings arms and legs, and clocks that differ from recording to recording.
STUDIO_CAMERAS = ["cam1", "cam3", "cam4"]
#: How far each joint goes along x with the swing of the arms, and of the legs.
ARMS = [{7: 0.12, 8: -0.12, 9: 0.2, 10: -0.2}.get(j, 0.0) for j in range(23)]
LEGS = [{13: -0.1, 14: 0.1, **dict.fromkeys((15, 17, 18, 19), -0.2), **dict.fromkeys((16, 20, 21, 22), 0.2)}.get(j, 0.0) for j in range(23)]
RECORDING = "concat('take-', lpad(cast(event_id DIV 1000 as varchar(9)), 4, '0'))"
#: Offsets are whole thirtieths of a second, other ones in each recording.
OFFSET = f"(case cam when 0 then {number(0.0)} when 1 then cast((event_id DIV 1000 * 3) % 13 - 6 as double) / 30 else cast((event_id DIV 1000 * 5) % 17 - 8 as double) / 30 end)"
#: Frames that a camera lost.
LOST = "(i * 7 + cam * 13) % 97 < 2 or (cam = 1 and i between 300 and 320)"
CLOCK = "cast(i as double) / 15 + cast((event_id + 3 * cam) % 7 as double) / 1000"
#: The hole in the walker's boxes, after which the tracker gave another number.
HOLE = "i between 500 and 509"


def wave(s: str, period: float) -> str:
    """A smooth wave of height 1 by parabolas."""
    x = f"(2 * ({s} / {number(period)} - floor({s} / {number(period)})) - 1)"
    return f"(4 * {x} * (1 - abs({x})))"


def swing(s: str) -> tuple[str, str, str, str]:
    """SQL for the walker's place on the floor and the swings of arms and legs at time ``s`` of the first camera's clock."""
    return (
        f"({number(0.9)} * {wave(s, 29.0)})", f"({number(0.7)} * {wave(s, 19.3)})",
        f"({wave(s, 1.25)} * ({number(0.6)} + {number(0.4)} * {wave(s, 7.3)}))", f"({wave(s, 1.1)} * ({number(0.6)} + {number(0.4)} * {wave(s, 5.9)}))",
    )


def studio_frames_sql(engine: str) -> str:
    """recording, cam (0, 1, 2), i, t (the camera's clock), s (the first camera's) of every frame that was kept."""
    cams = f"select explode(sequence(0, {CAMERAS - 1})) as cam" if engine == "spark" else f"select cast(range as int) as cam from range({CAMERAS})"
    return sql(f"select {RECORDING} as recording, event_id DIV 1000 as take, cam, i, {CLOCK} + {OFFSET} as t, {CLOCK} as s from (select event_id, cast(event_id % 1000 as int) as i from events) f cross join ({cams}) c where not ({LOST})", engine)


def studio_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``studio_frames_sql`` with event_id, dealt by recording."""
    text = studio_frames_sql("spark").replace(f"select {RECORDING.replace(' DIV ', ' div ')} as recording", "select recording, event_id").replace("select event_id, cast", "select recording, event_id, cast").replace("from events", "from {events}")
    return spark.sql(text, events=by_recording(spark, sf_dir, RECORDING))


def studio_offsets_sql(engine: str) -> str:
    """recording, cam (a name), offset_s."""
    cams = f"select explode(sequence(1, {CAMERAS - 1})) as cam" if engine == "spark" else f"select cast(range as int) as cam from range(1, {CAMERAS})"
    return sql(f"select distinct {RECORDING} as recording, case cam {' '.join(f'when {c} then {n!r}' for c, n in enumerate(STUDIO_CAMERAS))} end as cam, {OFFSET} as offset_s from events cross join ({cams}) c", engine)


def _studio_camera() -> str:
    return "element_at(array(" + ", ".join(map(repr, STUDIO_CAMERAS)) + "), cam + 1)"


def _studio_pictures(spark: SparkSession, damage: bool) -> DataFrame:
    """cam (0, 1, 2), i, phase, u, v: what a camera sees at the moment ``i / 15 + phase / 1000`` of the first camera's clock, the same in every recording."""
    names = [f"r{i}{j}" for i in range(3) for j in range(3)] + ["t0", "t1", "t2"]
    values = ", ".join("(" + ", ".join([str(c), *[number(v) for row in r for v in row], *map(number, t)]) + ")" for c, (r, t) in enumerate(POSES))
    poses = f"select * from (values {values}) as p(cam, {', '.join(names)})"
    body = [f"array({', '.join(number(b[k]) for b in BODY)})" for k in range(3)]
    arms, legs = (f"array({', '.join(map(number, x))})" for x in (ARMS, LEGS))
    swap = ", ".join(str(_SWAP.get(j, j)) for j in range(23))
    places = f"if(cam = 1 and i % 250 between 20 and 59, array({swap}), sequence(0, 22))" if damage else "sequence(0, 22)"
    shift = f"if(cam = 2 and i % 50 = 7, {number(80.0)}, {number(0.0)})" if damage else number(0.0)
    row = "(r{0}0 * p.x + r{0}1 * p.y + r{0}2 * p.z + t{0})"
    x, y, arm, leg = swing("s")
    moments = f"select cam, i, phase, cast(i as double) / 15 + cast(phase as double) / 1000 as s, {', '.join(names)} from ({NUMBERS}) f cross join (select explode(sequence(0, 6)) as phase) h cross join ({poses}) p"
    text = _pictures_sql([
        f"select *, {places} as places, {shift} as shift, {x} as dx, {y} as dy, {arm} as arm, {leg} as leg from ({moments}) f",
        f"select *, transform(places, j -> named_struct('x', get({body[0]}, j) + dx + arm * get({arms}, j) + leg * get({legs}, j), 'y', get({body[1]}, j) + dy, 'z', get({body[2]}, j))) as points from ({{}}) s0",
        f"select *, transform(points, p -> named_struct('a', {row.format(0)} / {row.format(2)}, 'b', {row.format(1)} / {row.format(2)})) as flat from ({{}}) s1",
    ])
    return spark.sql(text).select("cam", "i", "phase", "u", "v")


def studio_keypoints(spark: SparkSession, sf_dir: str, damage: bool = True) -> DataFrame:
    """recording, cam (names), t, u, v, conf: the packed keypoints, dealt by recording. With ``damage``: outlier views in the third camera and swapped arms in the second."""
    pictures = once(spark, "", f"studio-{damage}", lambda: _studio_pictures(spark, damage))
    sure = spark.sql("select cast(id as int) as level, transform(sequence(0, 22), joint -> cast(0.6 as double) + cast((id + joint * 3) % 40 as double) / 100) as conf from range(40)")
    rows = studio_frames(spark, sf_dir).selectExpr("*", "cast((event_id + 3 * cam) % 7 as int) as phase", "cast((i * 7 + take) % 40 as int) as level")
    rows = rows.join(F.broadcast(pictures), ["cam", "i", "phase"], "left").join(F.broadcast(sure), "level", "left")
    return rows.select("recording", F.expr(_studio_camera()).alias("cam"), "t", "u", "v", "conf")


def studio_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording, cam (names), t, frame_index, track_id, x1, y1, x2, y2, score: the walker, whose number changes after a hole, and a sitter, of whom each camera sees another part."""
    u, v = _fisheye("a", "b")
    x, y, _, _ = swing("s")
    x, y, zero = f"(if(kind = 0, {x}, {number(-1.0)} + cast(i % 3 as double) / 300))", f"(if(kind = 0, {y}, {number(1.0)}))", number(0.0)
    depth = _camera("2", x, y, zero)
    return spark.sql(
        f"""
        select recording, {_studio_camera()} as cam, t, cast(i as bigint) as frame_index, track_id, foot_u - 40 as x1, foot_v - 200 as y1, foot_u + 40 as x2, foot_v as y2, score from (
          select recording, cam, i, t, if(kind = 1, element_at(array(2, 4, 7), cam + 1), element_at(array(5, 3, 9), cam + 1) + if(i >= 510, 100, 0)) as track_id, {u} as foot_u, {v} - if(kind = 1, cast(90 + 40 * cam as double), {zero}) as foot_v, cast(0.5 as double) + cast(i % 50 as double) / 100 as score
          from (select f.*, k.kind, {_camera("0", x, y, zero)} / {depth} as a, {_camera("1", x, y, zero)} / {depth} as b from {{frames}} f cross join (select explode(sequence(0, 1)) as kind) k) w
          where kind = 1 or not ({HOLE})) r""",
        frames=studio_frames(spark, sf_dir),
    )
