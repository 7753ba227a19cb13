"""Cluster anomalies: one schema (bundle_id, type, severity, subject, value, message)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.plans.replication import ABNORMAL_INDEX

# Phrase, count that must be exceeded, type.
PATTERN_RULES = [("ghost_record_batch", 10, "Log Pattern"), ("reactor_stalled", 5, "Performance")]


def _rows(df: DataFrame, kind, severity: str, subject, value, message) -> DataFrame:
    return df.select(
        "bundle_id", F.lit(kind).alias("type"), F.lit(severity).alias("severity"),
        subject.cast("string").alias("subject"), value.cast("bigint").alias("value"), message.alias("message"),
    )


def index_anomalies(debug_followers: DataFrame) -> DataFrame:
    """Followers whose flushed index is far below zero."""
    bad = debug_followers.filter(F.col("last_flushed_log_index") < ABNORMAL_INDEX)
    where = F.concat_ws("/", "ns", "topic", F.col("partition_id").cast("string"))
    return _rows(
        bad, "Raft Index", "Critical", where, F.col("last_flushed_log_index"),
        F.concat(F.lit("abnormal log index of follower "), F.col("follower_id").cast("string")),
    )


def stale_health(health: DataFrame, kafka: DataFrame) -> DataFrame:
    """Health names leaderless partitions while client metadata has none."""
    gone = kafka.groupBy("bundle_id").agg(F.count_if(F.col("leader") == -1).alias("kafka_leaderless"))
    both = health.join(gone, "bundle_id", "left")
    odd = both.filter((F.col("leaderless_count") > 0) & (F.coalesce("kafka_leaderless", F.lit(0)) == 0))
    return _rows(
        odd, "Stale Health", "Warning", F.lit("cluster"), F.col("leaderless_count"),
        F.lit("health reports leaderless partitions, client metadata none"),
    )


def pattern_anomalies(patterns: DataFrame, rules=PATTERN_RULES) -> DataFrame:
    """Templates that name a phrase too often; a template may meet several rules."""
    lowered = F.lower("sample")
    found = F.array_compact(
        F.array(
            *[
                F.when(F.contains(lowered, F.lit(phrase)) & (F.col("count") > limit), F.struct(F.lit(kind).alias("type"), F.lit(phrase).alias("phrase")))
                for phrase, limit, kind in rules
            ]
        )
    )
    hits = patterns.select("bundle_id", "count", F.explode(found).alias("f"))
    return hits.select(
        "bundle_id", F.col("f.type").alias("type"), F.lit("Warning").alias("severity"), F.col("f.phrase").alias("subject"),
        F.col("count").cast("bigint").alias("value"), F.concat(F.lit("frequent log pattern: "), F.col("f.phrase")).alias("message"),
    )


def detect_anomalies(
    debug_followers: DataFrame | None = None, kafka: DataFrame | None = None,
    health: DataFrame | None = None, patterns: DataFrame | None = None,
) -> DataFrame:
    """The union over the inputs that are given."""
    parts = []
    if debug_followers is not None:
        parts.append(index_anomalies(debug_followers))
    if health is not None and kafka is not None:
        parts.append(stale_health(health, kafka))
    if patterns is not None:
        parts.append(pattern_anomalies(patterns))
    return reduce(DataFrame.unionByName, parts)
