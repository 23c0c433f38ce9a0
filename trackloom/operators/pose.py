"""2D keypoints: joint maps, confidences, quality and agreement of models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import confidence
from ..skeleton import JOINTS

#: Which joint names a backend gives and how its scores become confidences. Add a backend by adding a row.
BACKENDS: dict[str, dict] = {"identity": {"names": JOINTS, "rule": "identity"}, "logit": {"names": list(reversed(JOINTS)), "rule": "logit"}}


def joint_map(names: list[str]) -> list[int]:
    """Places of our joints in a model's list, by name; KeyError if one is missing."""
    places = {n: i for i, n in enumerate(names)}
    missing = [j for j in JOINTS if j not in places]
    if missing:
        raise KeyError(f"the model has no {', '.join(missing)}")
    return [places[j] for j in JOINTS]


def map_joints(df: DataFrame, names: list[str]) -> DataFrame:
    """Arrays in a model's order to ours."""
    places = ", ".join(map(str, joint_map(names)))
    return df.withColumns({c: F.expr(f"transform(array({places}), i -> get({c}, i))") for c in ("u", "v", "conf")})


def normalize_conf(df: DataFrame, rule: str) -> DataFrame:
    return df.withColumn("conf", F.transform("conf", lambda s: confidence(s, rule)))


def valid_obs(df: DataFrame, min_conf: float) -> DataFrame:
    """recording, cam, t, joint, u, v, weight of the observations that count."""
    rows = df.select("recording", "cam", "t", F.posexplode(F.arrays_zip("u", "v", "conf")).alias("joint", "o"))
    return rows.where((F.col("o.conf") >= min_conf) & F.col("o.u").isNotNull() & F.col("o.v").isNotNull()).select("recording", "cam", "t", "joint", "o.u", "o.v", F.col("o.conf").alias("weight"))


def pose_quality(df: DataFrame) -> DataFrame:
    """recording, cam, mean_conf, jitter: the median size of the second difference of all joints (pixels)."""
    order = W.partitionBy("recording", "cam").orderBy("t")
    rows = df.select("recording", "cam", "t", "u", "v", "conf", *[f(c).over(order).alias(f"{n}_{c}") for n, f in (("a", F.lag), ("b", F.lead)) for c in ("u", "v")])
    jump = F.expr("transform(sequence(0, size(u) - 1), j -> sqrt(pow(get(b_u, j) - 2 * get(u, j) + get(a_u, j), 2) + pow(get(b_v, j) - 2 * get(v, j) + get(a_v, j), 2)))")
    long = rows.select("recording", "cam", F.explode(F.arrays_zip("conf", jump.alias("jump"))).alias("o"))
    return long.groupBy("recording", "cam").agg(F.avg("o.conf").alias("mean_conf"), F.percentile("o.jump", F.lit(0.5)).alias("jitter"))


def backend_agreement(a: DataFrame, b: DataFrame, k: int = 4096) -> DataFrame:
    """cam, joint, median distance of two models' keypoints of the same moments (times equal to 0.1 ms).

    The median is over all recordings, so it comes from a mergeable KLL sketch of size ``k``: its rank is off by less than 0.1 %.
    """
    key = F.round(F.col("t") * 10000).cast("long").alias("k")
    def side(df: DataFrame, name: str) -> DataFrame:
        own, other = F.struct("u", "v"), F.lit(None).cast("struct<u:array<double>,v:array<double>>")
        return df.select(F.col("recording").alias("__r"), "cam", key, *[(own if c == name else other).alias(c) for c in "ab"]).where("__r is not null and cam is not null and k is not null")

    # a union in place of a join: tables that are dealt by recording already are not shuffled
    both = side(a, "a").unionByName(side(b, "b")).groupBy("__r", "cam", "k").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    pairs = both.select("cam", F.explode("a").alias("a"), "b").select("cam", "a", F.explode("b").alias("b"))
    rows = pairs.select("cam", F.posexplode(F.arrays_zip(F.col("a.u").alias("ua"), F.col("a.v").alias("va"), F.col("b.u").alias("ub"), F.col("b.v").alias("vb"))).alias("joint", "o"))
    return rows.groupBy("cam", "joint").agg(F.kll_sketch_agg_double(F.hypot(F.col("o.ua") - F.col("o.ub"), F.col("o.va") - F.col("o.vb")), k).alias("s")).select("cam", "joint", F.kll_sketch_get_quantile_double("s", F.lit(0.5)).alias("median_px"))
