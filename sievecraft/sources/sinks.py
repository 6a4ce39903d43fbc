"""Writers: sample sets with samples and figures, chunks, rejects, splits and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import windows as O


def json_lines(rows: DataFrame, path: str, gzip: bool = False) -> None:
    rows.write.mode("overwrite").json(path, compression="gzip" if gzip else "none")


def sample_set(rows: DataFrame, path: str, key: str, figures: list[Column], sample: int = 128) -> None:
    """Three outputs: all rows, a sample by hash, and figures over all.

    The last two read what the first wrote, so the rows are computed once.
    """
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{path}/full")
    full = spark.read.schema(rows.schema).parquet(f"{path}/full")
    full.orderBy(O.hash_rank("sample", key), key).limit(sample).write.mode("overwrite").json(f"{path}/sample")
    full.agg(*figures).write.mode("overwrite").json(f"{path}/info")


def chunks(rows: DataFrame, path: str, chunk: str) -> None:
    """A folder for each chunk; writing a chunk again replaces it and leaves the others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(chunk).parquet(path)


def chunk_totals(spark: SparkSession, path: str, by: list[str], counts: list[str]) -> DataFrame:
    """Sums over all chunks that have been written."""
    return spark.read.parquet(path).groupBy(*by).agg(*[F.sum(c).alias(c) for c in counts])


def split_by_status(rows: DataFrame, path: str, status: str = "reject_reason") -> None:
    """Kept and rejected rows below one path, by one pass over the rows."""
    rows.withColumn("part", F.when(F.col(status).isNull(), "kept").otherwise("rejected")).write.mode("overwrite").partitionBy("part").parquet(path)


def append_rejects(rows: DataFrame, path: str, key: str, status: str = "reject_reason") -> None:
    """Adds reason and key of rejected rows to the registry."""
    rows.where(F.col(status).isNotNull()).select(F.col(status).alias("reason"), F.col(key).cast("string").alias("sample_key")).write.mode("append").parquet(path)


def without_known(rows: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in the registry; duplicates there don't matter."""
    return rows.join(registry.select(F.col("sample_key").alias("__key")), F.col(key).cast("string") == F.col("__key"), "left_anti")


def report(metrics: DataFrame, logs: DataFrame, meta: dict[str, str], path: str) -> None:
    """Metrics with the run's description, and the rows that they come from."""
    metrics.withColumns({k: F.lit(v) for k, v in meta.items()}).write.mode("overwrite").json(f"{path}/metrics")
    logs.write.mode("overwrite").json(f"{path}/logs")
