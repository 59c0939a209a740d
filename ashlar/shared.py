"""What operators share: the cluster's shared folder, reliable checkpoints, and numbering without a single task."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Most rows and bytes of an Arrow batch that Python functions get, unless the session sets its own.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def bounded(spark: SparkSession) -> None:
    """Small Arrow batches for this session: a batch is held by the JVM and by a Python worker at once.

    A single row above the bound is a batch of its own.
    """
    for key, most in BATCH.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, most)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share.

    Where that setting is empty, a folder of our own is taken if the session runs on one machine; a cluster must set it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="ckpt")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def numbered(df: DataFrame, *order: str | Column, name: str = "number") -> DataFrame:
    """df with the place of each row from 1 in the order given, by range partitions whose sizes are added up.

    Rows that tie in the order go to one task and are numbered as they come: end the order with a column that parts them.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    # a row for each range
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = ranged.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    own = Window.partitionBy("_part").orderBy(*order)
    out = ranged.withColumn("_rn", F.row_number().over(own)).join(F.broadcast(base.select("_part", "_base")), "_part")
    return out.select(*df.columns, (F.col("_base") + F.col("_rn")).alias(name))
