"""Bucketed counts of logs that keep arriving.

The batch functions count whole tables; these take a streaming DataFrame of new entries
and keep only the buckets that the watermark leaves open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_log_stream(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """New files of a log table written by ``write_table``."""
    return spark.readStream.schema(schema).parquet(path)


def stream_log_counts(logs: DataFrame, bucket: int = 60, lateness: str = "10 minutes") -> DataFrame:
    """ERROR and WARN lines per bundle and bucket of seconds; state is a row per open bucket."""
    hits = logs.filter(F.col("level").isin("ERROR", "WARN")).withWatermark("ts", lateness)
    window = F.window("ts", f"{bucket if bucket > 0 else 60} seconds")
    counts = hits.groupBy("bundle_id", window.alias("w")).agg(F.count("*").alias("count"))
    return counts.select("bundle_id", F.col("w.start").alias("bucket"), "count")
