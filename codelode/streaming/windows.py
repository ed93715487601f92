"""Streams of engine events: step latencies by window, sessions, deduplication, and incremental indexing.

Sources are file streams; timestamps without a zone become UTC instants, as watermarks ask for.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_folder


def read_events(spark: SparkSession, folder: str, pattern: str = "events*.parquet", delay: str = "1 hour") -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)


def tumbling(events: DataFrame, width: str = "1 day") -> DataFrame:
    return events.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("max_ms"))


def sliding(events: DataFrame, width: str = "2 days", step: str = "1 day") -> DataFrame:
    return events.groupBy(F.window("at", width, step), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("max_ms"))


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    return events.groupBy(F.session_window("at", gap).alias("window"), "user_id").agg(F.count("*").alias("n"))


def deduplicated(events: DataFrame, keys: list[str]) -> DataFrame:
    return events.dropDuplicates(keys)


def drain(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over what there is and returns its result table, from the shared folder.

    Each micro-batch's output goes to a folder of its own, so a repeated batch overwrites itself; in complete mode the last is the result.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    last: dict[str, int] = {}

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/b={n}")
        last["n"] = n

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    at = f"{base}/out/b={last['n']}" if mode == "complete" else f"{base}/out"
    return spark.read.schema(stream.schema).parquet(at).select(*stream.columns)
