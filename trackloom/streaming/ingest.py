"""Incremental ingest of pose chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.pose import BACKENDS, map_joints, normalize_conf
from ..sources.files import exists

KEY = ["recording", "cam", "backend", "config", "t"]
#: Recordings are dealt in so many parts, by which the target is laid out; a batch reads only the parts of its own recordings.
PARTS = 256


def to_canonical(df: DataFrame) -> DataFrame:
    """Joint order and confidence rule of each row's backend. A row whose backend is unknown or null fails the job; it is never dropped."""
    name = F.coalesce("backend", F.lit("null"))
    out = df.where(~name.isin(list(BACKENDS))).withColumn("backend", F.raise_error(F.concat(F.lit("unknown backend: "), name)).cast("string"))
    for backend, rule in BACKENDS.items():
        out = out.unionByName(normalize_conf(map_joints(df.where(F.col("backend") == backend), rule["names"]), rule["rule"]))
    return out


def add_batch(spark: SparkSession, batch: DataFrame, number: int, target: str) -> None:
    """Write what is new in a batch to its own folder, ``batch=<number>``, in place of what an earlier try of the same batch left there.

    New is what no other batch has under the same key; null keys are equal. Only the parts that the batch's recordings fall in are read, and of them
    the key columns.
    """
    key = [k for k in KEY if k in batch.columns]  # not every source has a config
    fresh = batch.dropDuplicates(key).withColumn("part", F.pmod(F.xxhash64("recording"), F.lit(PARTS)).cast("int"))
    if exists(spark, target):
        parts = [r.part for r in fresh.select("part").distinct().collect()]  # PARTS at most
        there = spark.read.schema(T.StructType([*fresh.schema, T.StructField("batch", T.LongType())])).parquet(target)
        old = there.where((F.col("batch") != number) & F.col("part").isin(parts)).select(*[F.col(k).alias(f"__{k}") for k in key])
        fresh = fresh.join(old, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key]), "left_anti")
    to_canonical(fresh).write.mode("overwrite").partitionBy("part").parquet(f"{target}/batch={number}")


def ingested(spark: SparkSession, target: str) -> DataFrame:
    """The rows of all batches."""
    return spark.read.parquet(target).drop("batch", "part")


def ingest_pose_chunks(spark: SparkSession, source: str, target: str, checkpoint: str, schema) -> None:
    """Add what is new in ``source`` to ``target`` and return.

    The checkpoint lists the files that were read and numbers the batches; a batch that is run again after a loss overwrites its own folder. A frame that came
    before, in another file, is left out, and nothing has to be kept as state. A row of an unknown backend stops the ingest.
    """
    add = lambda batch, number: add_batch(spark, batch, number, target)
    spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
