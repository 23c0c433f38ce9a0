"""Small helpers that the text operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def id_key(docs: DataFrame, null_last: bool = True) -> Column:
    """``doc_id`` without nulls, of a type that sorts: whole numbers as long, others as text; a null comes last, or first."""
    if isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        return F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1 if null_last else -(1 << 63)))
    return F.coalesce(F.col("doc_id").cast("string"), F.lit("\U0010ffff" if null_last else ""))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, ``spark.checkpoint.dir``; on a local master without that setting, a temporary one.

    On a cluster without it this raises, since executors do not see each other's local folders.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def _release(spark: SparkSession) -> None:
    """Have the driver collect its garbage, on which Spark removes the shuffle files of finished plans; else they stay on the executors' disks."""
    spark.sparkContext._jvm.System.gc()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the shared folder; Spark removes it when it is no longer used."""
    shared_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    _release(df.sparkSession)
    return out


def _write(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    _release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage of a large table by Parquet files in the shared folder: compressed, and only the columns in use are read again.

    The result of a query is lazy and reads them, so whoever owns that folder clears them; what is needed only on the way goes in a ``Scratch``.
    """
    return _write(df, f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}")


class Scratch:
    """Tables in the shared folder that are needed for a while."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.path, self.count = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        return _write(df, f"{self.path}/{self.count}")

    def drop(self) -> None:
        """Remove the tables; nothing that is still to be computed may read them."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
