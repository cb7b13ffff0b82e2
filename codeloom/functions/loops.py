"""Cutting lineage in loops, through the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> None:
    if not spark.conf.get("spark.checkpoint.dir", None):
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="codeloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the folder of spark.checkpoint.dir, which survives the loss of any executor. Where the setting
    is absent (a local master in tests) a temporary folder is made; elsewhere that is an error."""
    _folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As ``cut``, but as Parquet, for large tables: it is compressed, and columns that aren't asked for aren't read. The files are deleted when
    the driver's JVM ends."""
    spark = df.sparkSession
    _folder(spark)
    path = f"{spark.conf.get('spark.checkpoint.dir')}/codeloom/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)
