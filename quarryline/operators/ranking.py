"""A global row number without a task that sees all rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shared_folder(df: DataFrame) -> str:
    """A new folder under spark.checkpoint.dir, removed when the application ends; under a temporary one where a
    local session has none."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = tempfile.mkdtemp(prefix="quarryline-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/quarryline-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(hadoop)
    system.deleteOnExit(hadoop)
    return path


def global_row_number(df: DataFrame, *order: Column, name: str = "rn") -> DataFrame:
    """df plus `name`, 1 to n in the order given; ties are numbered in any order.

    Rows are dealt into ranges of the order and written with their range's number, so that it can't
    change when an executor is lost. A row's number is its place in its range plus the rows of earlier
    ranges, of which there are as many as shuffle partitions.
    """
    path = f"{shared_folder(df)}/ranked"
    df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("__range").agg(F.count("*").alias("__n"))
    starts = starts.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return rows.withColumn("__k", inside).join(F.broadcast(starts), "__range").withColumn(name, F.col("__start") + F.col("__k")).drop("__range", "__k", "__start")
