"""Readers and writers of the tables. Parquet is the common form; ``npz`` files are read as binary rows and decoded in tasks."""

from __future__ import annotations

import io
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRACKS = "recording string, cam string, t double, frame_index long, track_id long, x1 double, y1 double, x2 double, y2 double, score double"
KEYPOINTS = "recording string, cam string, t double, u array<double>, v array<double>, conf array<double>"
BOARD = "recording string, cam string, view long, t double, frame_index long, sharpness double, ids array<int>, u array<double>, v array<double>"


def _decoded(spark: SparkSession, path: str, schema: str, decode) -> DataFrame:
    """Files .../<recording>/<cam>.npz, one row each of name and content, to table rows."""

    def work(parts):
        for part in parts:
            for name, content in zip(part["path"], part["content"], strict=True):
                with np.load(io.BytesIO(content)) as z:
                    rows = decode(z)
                rows.insert(0, "cam", name.rsplit("/", 1)[1].removesuffix(".npz"))
                rows.insert(0, "recording", name.rsplit("/", 2)[1])
                yield rows

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npz").load(path)
    return files.select("path", "content").mapInPandas(work, schema)


def read_person_tracks(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    if fmt == "parquet":
        return spark.read.parquet(path)
    return _decoded(spark, path, TRACKS, lambda z: pd.DataFrame({"t": z["t"].astype(float), "frame_index": z["frame_index"].astype(int), "track_id": z["track_id"].astype(int), **dict(zip(("x1", "y1", "x2", "y2"), z["bbox"].astype(float).T, strict=True)), "score": z["score"].astype(float)}))


def read_keypoints(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Sorted by time; NaN becomes NULL."""
    if fmt == "parquet":
        return spark.read.parquet(path)

    def decode(z):
        order = np.argsort(z["t"], kind="stable")
        k = z["kpts"].astype(float)[order]
        return pd.DataFrame({"t": z["t"].astype(float)[order], "u": list(k[..., 0]), "v": list(k[..., 1]), "conf": list(z["conf"].astype(float)[order])})

    rows = _decoded(spark, path, KEYPOINTS, decode)
    return rows.withColumns({c: F.transform(c, lambda x: F.when(F.isnan(x), F.lit(None)).otherwise(x)) for c in ("u", "v")})


def read_board_views(spark: SparkSession, path: str) -> DataFrame:
    """One row for each view; the ragged arrays are cut by their counts."""

    def decode(z):
        ends = np.cumsum(z["counts"])
        cut = [slice(e - n, e) for e, n in zip(ends, z["counts"], strict=True)]
        return pd.DataFrame(
            {"view": range(len(cut)), "t": z["t"].astype(float), "frame_index": z["frame_index"].astype(int), "sharpness": z["sharpness"].astype(float), "ids": [z["ids"][c].astype(int) for c in cut],
             "u": [z["corners"][c, 0].astype(float) for c in cut], "v": [z["corners"][c, 1].astype(float) for c in cut]}
        )

    return _decoded(spark, path, BOARD, decode)


CAMERAS = "rig string, cam string, model string, width int, height int, k array<double>, d array<double>, r array<double>, t array<double>, rms double"


def camera_row(d: dict, rig: str = "") -> dict:
    """A camera of a rig file as a table row; without a pose it stands at the origin."""
    flat = lambda x: [float(v) for row in x for v in (row if isinstance(row, list) else [row])]
    w, h = d["size"]
    return {"rig": rig, "cam": d["name"], "model": d["model"], "width": int(w), "height": int(h), "k": flat(d["K"]), "d": flat(d["D"]), "r": flat(d.get("R") or np.eye(3).tolist()), "t": flat(d.get("t") or [0.0, 0.0, 0.0]), "rms": d.get("rms")}


def read_cameras(spark: SparkSession, path: str) -> DataFrame:
    """Rig or single-camera YAML files, read through Spark; a rig is a few rows."""
    import yaml

    rows = []
    for name, content in spark.read.format("binaryFile").load(path).select("path", "content").collect():
        parsed = yaml.safe_load(bytes(content).decode())
        rows += [camera_row(c, name) for c in parsed.get("cameras", [parsed])]
    return spark.createDataFrame([tuple(r.values()) for r in rows], CAMERAS)


def write_landmarks(df: DataFrame, path: str) -> None:
    """Long landmarks, small types, by recording."""
    narrow = {"float": ("x", "y", "z", "x_raw", "y_raw", "z_raw"), "byte": ("views",), "boolean": ("filled",)}
    for kind, names in narrow.items():
        df = df.withColumns({c: F.col(c).cast(kind) for c in names if c in df.columns})
    df.write.mode("overwrite").partitionBy("recording").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_wide_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_rig(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def board_points(views: DataFrame) -> DataFrame:
    """Packed board views as the calibration operators take them: recording, cam, view, t, frame_index, sharpness, point_id, u, v; a row for each corner."""
    rows = views.select("recording", "cam", "view", "t", "frame_index", "sharpness", F.explode(F.arrays_zip("ids", "u", "v")).alias("p"))
    return rows.select("recording", "cam", "view", "t", "frame_index", "sharpness", F.col("p.ids").alias("point_id"), "p.u", "p.v")


def shared_folder(spark: SparkSession) -> str:
    """A new folder in ``spark.checkpoint.dir``, which the cluster shares; on a local master without that setting, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{folder or tempfile.mkdtemp(prefix='spark-shared-')}/{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def removed(spark: SparkSession, path: str) -> None:
    """Remove a folder that the caller wrote and that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def kept(df: DataFrame) -> DataFrame:
    """The table, written in the shared folder and read again: its lineage is cut, and what is built on it does not compute it anew. The folder's owner clears it."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
