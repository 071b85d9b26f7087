"""Structured Streaming operators over event streams. Event time is ``timestamp``; NTZ columns are cast by ``as_stream``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def as_stream(spark: SparkSession, sf_dir: str, name: str, time: str = "ts") -> DataFrame:
    """A table as a stream, be it one file or a folder of files (a stream reads a folder, or what a pattern finds)."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]").withColumn(time, F.col(time).cast("timestamp"))


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", time: str = "ts", by: list[str] | None = None) -> DataFrame:
    """Counts per window; rows later than ``late`` behind the newest are dropped."""
    grouped = events.withWatermark(time, late).groupBy(F.window(time, width), *(by or [])).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("window.start").alias("start"), *(by or []), "n")


def session_counts(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "10 minutes", time: str = "ts") -> DataFrame:
    grouped = events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(key, F.col("session_window.start").alias("start"), "n")


def interval_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, within: str, late: str = "10 minutes") -> DataFrame:
    """Pairs of the same key with right at or after left by less than ``within``; state is kept only as long as rows can match."""
    a = left.withWatermark(left_time, late).alias("a")
    b = right.withWatermark(right_time, late).withColumnRenamed(key, f"__{key}").alias("b")
    time = (F.col(right_time) >= F.col(left_time)) & (F.col(right_time) < F.col(left_time) + F.expr(f"INTERVAL {within}"))
    return a.join(b, (F.col(key) == F.col(f"__{key}")) & time).drop(f"__{key}")


def drop_repeats(events: DataFrame, key: list[str], time: str = "ts", late: str = "1 hour") -> DataFrame:
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def drain(spark: SparkSession, stream: DataFrame, mode: str, folder: str, each: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Runs a stream over what there is now and returns its result as a table of ``folder`` (which all executors share).

    In complete mode each batch replaces the result; in append mode it adds to it. Batches are written under
    their number, so that a batch that runs twice after a failure counts once.
    """
    run = f"{folder}/stream-{uuid.uuid4().hex}"
    last = [-1]

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{run}/batch={number}")
        last[0] = number
        if each:
            each(batch, number)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{run}-state").foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()
    if last[0] < 0:
        return spark.createDataFrame([], stream.schema)
    path = f"{run}/batch={last[0]}" if mode == "complete" else f"{run}/batch=*"
    return spark.read.schema(stream.schema).parquet(path)
