"""Papers or chunks that arrive as files: seen ids are dropped within a watermark, batches go to a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arriving(spark: SparkSession, folder: str, schema: str, per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


def unseen(stream: DataFrame, key: str = "id", time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each id once, as long as its copies are no later than the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def counts(stream: DataFrame, by: str, time: str = "ts", late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"))


def into(stream: DataFrame, path: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Appends prepared batches; a batch that is run again overwrites its own folder, so none is written twice."""

    def put(df: DataFrame, n: int) -> None:
        prepare(df).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={n}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
