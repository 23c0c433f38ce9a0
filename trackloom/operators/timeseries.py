"""Joins and windows over time. Every table is keyed by ``recording`` and ``cam``; time is seconds as double; missing is NULL."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ["recording", "cam"]


def _both_sides(obs: DataFrame, queries: DataFrame, keys: list[str], carried: list[str]) -> DataFrame:
    """Each query row with ``before`` (last observation strictly before it) and ``after`` (first at or after it), and the first and last times.

    Queries sort before observations of the same time; two sorted windows over one exchange, linear in the rows.
    """
    row = F.struct("t", *carried)
    left = obs.select(*keys, "t", F.lit(1).alias("__kind"), row.alias("__o"), F.lit(None).cast("struct<x:int>").alias("__q"))
    asked = F.struct(*[F.col(c) for c in queries.columns])
    right = queries.select(*keys, "t", F.lit(0).alias("__kind"), F.lit(None).cast(left.schema["__o"].dataType).alias("__o"), asked.alias("__q"))
    both = left.withColumn("__q", F.lit(None).cast(right.schema["__q"].dataType)).unionByName(right)
    up = W.partitionBy(*keys).orderBy("t", "__kind").rowsBetween(W.unboundedPreceding, -1)
    down = W.partitionBy(*keys).orderBy(F.desc("t"), F.desc("__kind")).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(*keys)
    return (
        both.withColumn("before", F.last("__o", ignorenulls=True).over(up))
        .withColumn("after", F.last("__o", ignorenulls=True).over(down))
        .withColumn("t_first", F.min("__o.t").over(every))
        .withColumn("t_last", F.max("__o.t").over(every))
        .where("__kind = 0")
        .select("__q.*", "before", "after", "t_first", "t_last")
    )


def _packed(column: pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as (rows, length); NULL is NaN."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _interpolated(seen: pa.Table, at: np.ndarray, first, size: int, max_gap: float) -> np.ndarray:
    """(3, times, size): u, v, conf of one camera's rows ``seen`` at times, as ``asof_interpolate`` says; ``first`` is the time of its first observation."""
    values = np.full((3, len(at), size), np.nan)
    values[2] = 0.0
    if not (seen.num_rows and size):
        return values
    t, place = np.unique(seen.column("t").to_numpy(), return_index=True)
    known = np.stack([_packed(seen.column(c))[place] for c in ("u", "v", "conf")])
    i = np.searchsorted(t, at, "left")
    inside = (i < len(t)) & ~np.isnan(at)
    b = np.minimum(i, len(t) - 1)
    a = np.maximum(b - 1, 0)
    alone = inside & (t[b] == at) & (at == first)
    ok = np.flatnonzero(alone | inside & (i > 0) & (t[b] - t[a] <= max_gap))
    a, b, alone = np.where(alone, b, a)[ok], b[ok], alone[ok]
    w = np.where(alone, 1.0, (at[ok] - t[a]) / np.where(alone, 1.0, t[b] - t[a]))[:, None]
    values[:2, ok] = np.where(alone[:, None], known[:2, b], (1 - w) * known[:2, a] + w * known[:2, b])
    low = known[2]
    values[2, ok] = np.fmin(low[a], low[b])
    return values


def _listed(x: np.ndarray) -> pa.Array:
    """(rows, length) as a list column; NaN is NULL."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * np.int32(x.shape[1])), pa.array(x.ravel(), from_pandas=True))


def asof_interpolate(tracks: DataFrame, queries: DataFrame, max_gap: float = 0.15, block_s: float = 60.0) -> DataFrame:
    """Queries (recording, cam, t, ...) with u, v, conf interpolated linearly, never across a gap above ``max_gap``.

    An exact hit still needs a small gap before it and takes the lesser of the two confidences; the first observation stands alone. A
    missing neighbour makes the value missing. Outside: u and v hold NULLs, conf 0. A camera without observations gives NULL arrays.

    Only neighbours within the gap matter, so both sides meet in blocks of ``block_s`` of one camera, to whose observations those ``max_gap`` around are added; packed
    rows are shuffled once and never sorted.
    """
    block = lambda t: F.floor(t / block_s).cast("long")
    about = tracks.groupBy(*KEYS).agg(F.min("t").alias("__first"), F.max(F.size("u")).alias("__n"))
    left = tracks.select(*KEYS, F.explode(F.sequence(block(F.col("t") - max_gap), block(F.col("t") + max_gap))).alias("block"), "t", "u", "v", "conf")
    asked = queries.withColumn("__block", block(F.col("t"))).join(about, KEYS, "left")
    asked = asked.select(*[F.col(c).alias(f"__{c}") for c in KEYS], F.col("__block").alias("__b"), F.col("__first").alias("__f"), F.col("__n").alias("__size"), *[F.col(c).alias(c) for c in queries.columns])
    schema, names = T.StructType([*queries.schema, *(T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("u", "v", "conf"))]), queries.columns

    def work(seen: pa.Table, rows: pa.Table) -> pa.Table:
        own, n, size = rows.select(names), rows.num_rows, rows.column("__size")[0].as_py() if rows.num_rows else None
        if size is None:
            for c in ("u", "v", "conf"):
                own = own.append_column(c, pa.nulls(n, pa.list_(pa.float64())))
            return own
        values = _interpolated(seen, rows.column("t").to_numpy(), rows.column("__f").to_numpy(), size, max_gap)
        for c, x in zip(("u", "v", "conf"), values, strict=True):
            own = own.append_column(c, _listed(x))
        return own

    return left.groupBy(*KEYS, "block").cogroup(asked.groupBy("__recording", "__cam", "__b")).applyInArrow(work, schema)


def on_common_clock(tracks: DataFrame, offsets: DataFrame, times: DataFrame, cams: int, max_gap: float = 0.15, block_s: float = 60.0) -> DataFrame:
    """(recording, tau) with all cameras' arrays one after the other: index = cam * joints + joint; interpolated as by ``asof_interpolate``.

    ``offsets`` has (cam, offset_s), for all recordings, or (recording, cam, offset_s), for each; a missing offset is 0. A recording in which a camera has no observations has NULL arrays.

    Times and the observations around them meet in blocks of ``block_s`` of a recording, all cameras at once, so packed rows are shuffled once, and not at all if both tables
    are dealt by recording already.
    """
    block = lambda t: F.floor(t / block_s).cast("long")
    tracks = tracks.where(F.col("cam").between(0, cams - 1))
    offset = F.coalesce("offset_s", F.lit(0.0))
    about = tracks.groupBy(*KEYS).agg(F.min("t").alias("first"), F.max(F.size("u")).alias("size"))
    if "recording" in offsets.columns:
        about = about.join(offsets.select(*KEYS, "offset_s"), KEYS, "left")
    else:
        about = about.join(F.broadcast(offsets.select("cam", "offset_s")), "cam", "left")
    clocks = about.groupBy("recording").agg(F.array_sort(F.collect_list(F.struct("cam", offset.alias("offset"), "first", "size"))).alias("clocks"))
    if "recording" in offsets.columns:
        shifts = clocks.select("recording", F.map_from_entries(F.transform("clocks", lambda c: F.struct(c.cam, c.offset))).alias("__s"))
        shifted = tracks.join(shifts, "recording", "left").withColumn("__t", F.col("t") - F.element_at("__s", F.col("cam")))
    else:
        shifted = tracks.join(F.broadcast(offsets.select("cam", "offset_s")), "cam", "left").withColumn("__t", F.col("t") - offset)
    reach = max_gap + 1e-6  # sums of times are rounded
    none = lambda kind: F.lit(None).cast(kind)
    left = shifted.select(F.col("recording").alias("__r"), F.explode(F.sequence(block(F.col("__t") - reach), block(F.col("__t") + reach))).alias("block"), F.col("cam").cast("int").alias("cam"), "t", "u", "v", "conf", none(clocks.schema["clocks"].dataType).alias("clocks"))
    asked = times.select("recording", "tau").join(clocks, "recording", "left")
    asked = asked.select(F.col("recording").alias("__r"), block(F.col("tau")).alias("block"), none("int").alias("cam"), F.col("tau").alias("t"), *[none("array<double>").alias(c) for c in ("u", "v", "conf")], "clocks")
    schema = T.StructType([times.schema["recording"], T.StructField("tau", T.DoubleType()), *(T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("u", "v", "conf"))])

    def work(part: pa.Table) -> pa.Table:
        cam = part.column("cam").to_numpy()
        rows = part.filter(pa.array(np.isnan(cam)))
        tau = np.unique(rows.column("t").to_numpy())
        names = pa.chunked_array([pa.repeat(part.column("__r")[0], len(tau))])
        own = (rows.column("clocks")[0].as_py() or []) if len(tau) else []
        if len(own) < cams:
            return pa.Table.from_arrays([names, pa.chunked_array([pa.array(tau, from_pandas=True)]), *(pa.chunked_array([pa.nulls(len(tau), pa.list_(pa.float64()))]) for _ in range(3))], names=schema.names)
        found = np.concatenate([_interpolated(part.filter(pa.array(cam == c["cam"])), tau + c["offset"], c["first"], c["size"], max_gap) for c in own], axis=2)
        return pa.Table.from_arrays([names, pa.chunked_array([pa.array(tau, from_pandas=True)]), *(pa.chunked_array([_listed(x)]) for x in found)], names=schema.names)

    return left.unionByName(asked).groupBy("__r", "block").applyInArrow(work, schema)


def asof_nearest(left: DataFrame, right: DataFrame, keys: list[str], carried: list[str], tol_s: float = 0.1) -> DataFrame:
    """Left rows with the columns ``carried`` of the right row nearest in time, under ``tol_s`` away (a tie goes to the later row)."""
    found = _both_sides(right, left, keys, carried)
    early = F.coalesce(F.abs(F.col("before.t") - F.col("t")) < F.abs(F.col("after.t") - F.col("t")), F.col("after").isNull())
    near = F.when(early, F.col("before")).otherwise(F.col("after"))
    return found.withColumn("__n", near).where(F.abs(F.col("__n.t") - F.col("t")) < tol_s).select(*left.columns, F.col("__n.t").alias("t_near"), *[F.col(f"__n.{c}").alias(c) for c in carried])


def frame_at(frames: DataFrame, requests: DataFrame, tol_s: float = 0.025) -> DataFrame:
    """The frame (t, frame_index) nearest to each requested time (the earlier of two as near), within ``tol_s``; past the end the last; else no row."""
    found = _both_sides(frames, requests, KEYS, ["frame_index"])
    late = F.col("t") > F.col("t_last")
    early = F.coalesce(F.col("t") - F.col("before.t") <= F.col("after.t") - F.col("t"), F.col("after").isNull())
    pick = F.when(early, F.col("before")).otherwise(F.col("after"))
    return found.withColumn("__n", pick).where(late | (F.abs(F.col("__n.t") - F.col("t")) <= tol_s)).select(*requests.columns, F.col("__n.t").alias("t_frame"), F.col("__n.frame_index").alias("frame_index"))


def select_frames(df: DataFrame, start_s: float | None = None, end_s: float | None = None, every: int = 1) -> DataFrame:
    """Rows in the time range, then every n-th of them."""
    if start_s is not None:
        df = df.where(F.col("t") >= start_s)
    if end_s is not None:
        df = df.where(F.col("t") <= end_s)
    nr = F.row_number().over(W.partitionBy(*KEYS).orderBy("t"))
    return df.withColumn("__nr", nr).where((F.col("__nr") - 1) % every == 0).drop("__nr")


def reference_times(df: DataFrame, cam, start_s: float | None = None, end_s: float | None = None, margin_s: float = 0.5) -> DataFrame:
    """(recording, tau): times of the reference camera, a margin inside its own range and the given one."""
    own = df.where(F.col("cam") == cam).select("recording", F.col("t").alias("tau"))
    every = W.partitionBy("recording")
    low, high = F.min("tau").over(every), F.max("tau").over(every)
    if start_s is not None:
        low = F.greatest(low, F.lit(start_s))
    if end_s is not None:
        high = F.least(high, F.lit(end_s))
    return own.withColumn("__a", low + margin_s).withColumn("__b", high - margin_s).where("tau >= __a and tau <= __b").select("recording", "tau")


def thin_by_time(frames: DataFrame, every_s: float, start_s: float = 0.0, end_s: float | None = None) -> DataFrame:
    """Greedy thinning: a frame is kept when it reaches ``every_s`` after the last kept one. Sequential per video, so it runs in one task per video."""
    chosen = frames.where(F.col("t") >= start_s) if end_s is None else frames.where(F.col("t").between(start_s, end_s))

    def keep(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("t", kind="stable")
        rows, due = [], float("-inf")
        for i, t in enumerate(part["t"].to_numpy()):
            if t + 1e-6 >= due:
                rows.append(i)
                due = t + every_s
        return part.iloc[rows]

    return chosen.groupBy(*KEYS).applyInPandas(keep, chosen.schema)


def _order(keys: list[str]):
    return W.partitionBy(*keys).orderBy("t")


def rolling_median(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Centred median of five with the ends repeated; series of five rows or fewer stay."""
    order = _order(keys)
    full = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    out = df.withColumn("__n", F.count("*").over(W.partitionBy(*keys)))
    for c in columns:
        first, last = F.first(c).over(full), F.last(c).over(full)
        near = [F.coalesce(F.lag(c, k).over(order), first) for k in (2, 1)] + [F.col(c)] + [F.coalesce(F.lead(c, k).over(order), last) for k in (1, 2)]
        out = out.withColumn(f"__{c}", F.when(F.col("__n") > 5, F.array_sort(F.array(*near))[2]).otherwise(F.col(c)))
    for c in columns:
        out = out.withColumn(c, F.col(f"__{c}")).drop(f"__{c}")
    return out.drop("__n")


def path_step(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """Add ``step``: the distance to the previous row, 0 for the first."""
    order = _order(keys)
    return df.withColumn("step", F.coalesce(F.hypot(F.col(x) - F.lag(x).over(order), F.col(y) - F.lag(y).over(order)), F.lit(0.0)))


def gradient(df: DataFrame, column: str, keys: list[str], out: str) -> DataFrame:
    """Central difference per sample, one-sided at the ends."""
    order = _order(keys)
    before, after = F.lag(column).over(order), F.lead(column).over(order)
    return df.withColumn(out, F.coalesce((after - before) / 2, after - F.col(column), F.col(column) - before))


def detrend(df: DataFrame, column: str, keys: list[str], out: str, n: int = 31) -> DataFrame:
    """Minus the centred mean of n samples, zeros beyond the ends: always divided by n."""
    around = _order(keys).rowsBetween(-(n // 2), n // 2)
    return df.withColumn(out, F.col(column) - F.sum(column).over(around) / n)


def zscore(df: DataFrame, column: str, keys: list[str], out: str) -> DataFrame:
    every = W.partitionBy(*keys)
    return df.withColumn(out, (F.col(column) - F.avg(column).over(every)) / (F.stddev_pop(column).over(every) + 1e-12))


def second_difference(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """``d2_<column>`` at the middle of three rows; NULL at the ends."""
    order = _order(keys)
    return df.select("*", *[(F.lead(c).over(order) - 2 * F.col(c) + F.lag(c).over(order)).alias(f"d2_{c}") for c in columns])
