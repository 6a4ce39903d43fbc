"""Structured streams: resumable ingestion and workers that have gone silent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def ingest_new(spark: SparkSession, source: str, schema: StructType | str, target: str, checkpoint: str, change: Callable[[DataFrame], DataFrame] | None = None, form: str = "json", files: int = 1000) -> StreamingQuery:
    """Files that no earlier call has taken in, in batches of `files`; a call that was cut off goes on where it was."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(form).load(source)
    out = change(rows) if change else rows
    return out.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_beats(beats: DataFrame, late: str = "1 minute") -> DataFrame:
    """worker, and when it was last heard of, in windows of half a minute: state goes with the watermark."""
    w = F.window("ts", "30 seconds")
    return beats.withWatermark("ts", late).groupBy(w.alias("window"), "worker").agg(F.max("ts").alias("seen"), F.count("*").alias("beats"))


def silent(seen: DataFrame, limit: int = 30) -> DataFrame:
    """Workers silent for more than `limit` seconds before the last beat of all; for a table of beats."""
    last = seen.groupBy("worker").agg(F.max("seen").alias("seen"))
    now = last.agg(F.max("seen").alias("now"))
    return last.crossJoin(F.broadcast(now)).select("worker", "seen", (F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("seen").cast("timestamp")) > limit * 1_000_000).alias("expired"))


def remaining(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a run that was cut off has left to do."""
    return todo.join(done.select(key), key, "left_anti")


def episode_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user, closed after a gap; an extension, as agents' logs may lack episode ids."""
    s = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(s.alias("session"), "user_id").agg(F.count("*").alias("steps"), F.approx_count_distinct("event_type").alias("kinds"))
