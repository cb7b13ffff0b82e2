"""Dumps as they come: a file stream that keeps the function table up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources import dumps
from ..sources.export import upsert


def class_updates(spark: SparkSession, root: str, out: str, checkpoint: str):
    """A stream of class dumps below ``root`` into the Parquet table ``out``, by (module_name, class_name), the last one holding.
    Each batch is written beside the table and then put in its place by two renames; the table that was there goes last, and is put back
    if the work ended between the two. So no crash loses rows, and a batch that is run again changes nothing."""
    from pyspark.sql import functions as F

    kind = "array<struct<className:string,classDefinition:string,classLocation:string,line_number:array<int>>>"
    rows = dumps.files(spark, root, ".hs.class_code.json", stream=True).select("module", F.explode(F.from_json("value", kind)).alias("r"))
    rows = rows.select(F.col("module").alias("module_name"), F.col("r.className").alias("class_name"), F.col("r.classDefinition").alias("class_definition"), F.col("r.classLocation").alias("src_location"))

    def merge(batch: DataFrame, number: int) -> None:
        batch = batch.groupBy("module_name", "class_name").agg(F.max(F.struct("class_definition", "src_location")).alias("r")).select("module_name", "class_name", "r.*")
        session = batch.sparkSession
        jvm = session.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path
        fs = path(out).getFileSystem(session.sparkContext._jsc.hadoopConfiguration())
        here, new, last = path(out), path(f"{out}.new"), path(f"{out}.last")
        if fs.exists(last):
            if fs.exists(here):
                fs.delete(last, True)
            else:
                fs.rename(last, here)
        old = session.read.schema(batch.schema).parquet(out) if fs.exists(here) else batch.limit(0)
        upsert(old, batch, "module_name", "class_name").write.mode("overwrite").parquet(f"{out}.new")
        if fs.exists(here):
            fs.rename(here, last)
        fs.rename(new, here)
        fs.delete(last, True)

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
