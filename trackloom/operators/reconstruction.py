"""Triangulation of packed rows: one row holds all cameras and joints of a moment, so nothing is shuffled."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions import geometry as G
from ..skeleton import JOINTS, side
from .timeseries import on_common_clock

GROUPS = {"arm": ["shoulder", "elbow", "wrist"], "leg": ["hip", "knee", "ankle", "heel", "big_toe", "small_toe"]}
PAIRS = [(side(parts, "left"), side(parts, "right")) for parts in GROUPS.values()]

_ARRAYS = ["x", "y", "z"]
LANDMARKS = (
    [T.StructField("tau", T.DoubleType())]
    + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in _ARRAYS]
    + [T.StructField("views", T.ArrayType(T.IntegerType())), T.StructField("err", T.ArrayType(T.DoubleType())), T.StructField("swaps", T.ArrayType(T.IntegerType()))]
)


def camera_list(cameras) -> list[G.Camera]:
    """The rig on the driver: a handful of rows, one for each camera."""
    rows = cameras if isinstance(cameras, list) else [r.asDict() for r in cameras.collect()]
    return [G.Camera.from_row(r) for r in sorted(rows, key=lambda r: r["cam"])]


def _numbers(column: pa.Array, n: int) -> np.ndarray:
    """A list column of equal lengths as (rows, length); NULL is NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)


def _lists(values: np.ndarray, kind=None) -> pa.Array:
    n, size = values.shape
    flat = pa.array(values.ravel(), kind, from_pandas=True)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * size + 1, size, dtype=np.int32)), flat)


def triangulated(synced: DataFrame, cameras, min_conf: float = 0.5, max_reproj_px: float = 15.0, fix_swaps: bool = True, drop_bad: bool = True) -> DataFrame:
    """recording, tau, x, y, z, views (arrays by joint), err (cam * joints + joint), swaps (group * cams + cam) of ``synced`` rows.

    Left/right repair, robust triangulation and the final check in one pass. A point is NULL if under two cameras see it or a used
    view is off by more than the limit.
    """
    rig = camera_list(cameras)
    count = len(rig)

    def work(batches):
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            u, v, conf = (_numbers(batch.column(batch.schema.get_field_index(c)), n) for c in ("u", "v", "conf"))
            joints = u.shape[1] // count
            uv = np.stack((u, v), axis=-1).reshape(n, count, joints, 2).transpose(1, 0, 2, 3)
            sure = np.nan_to_num(conf).reshape(n, count, joints).transpose(1, 0, 2)
            swaps = np.zeros((n, len(PAIRS), count), bool)
            if fix_swaps and joints == len(JOINTS):
                uv, sure, swaps = G.swap_repair(rig, uv, sure, PAIRS, min_conf, max_reproj_px, 0.6, 5.0)
            points, error = G.triangulate(rig, uv.reshape(count, -1, 2), sure.reshape(count, -1), min_conf, max_reproj_px)
            views = np.isfinite(error).sum(axis=0)
            if drop_bad:
                points[np.where(np.isnan(error), -1, error).max(axis=0) > max_reproj_px] = np.nan
            error = error.reshape(count, n, joints).transpose(1, 0, 2).reshape(n, -1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1)] + [_lists(points[:, d].reshape(n, joints)) for d in range(3)]
                + [_lists(views.reshape(n, joints).astype(np.int32)), _lists(error), _lists(swaps.reshape(n, -1).astype(np.int32))],
                names=schema.names,
            )

    schema = T.StructType([synced.schema["recording"], *LANDMARKS])
    return synced.select("recording", "tau", "u", "v", "conf").mapInArrow(work, schema)


def reconstruct(tracks: DataFrame, cameras, offsets: DataFrame, times: DataFrame, min_conf: float = 0.5, max_reproj_px: float = 15.0, fix_swaps: bool = True) -> DataFrame:
    """All cameras on the reference clock, repaired and triangulated."""
    rig = cameras if isinstance(cameras, list) else [r.asDict() for r in cameras.collect()]
    return triangulated(on_common_clock(tracks, offsets, times, len(rig)), rig, min_conf, max_reproj_px, fix_swaps)
