"""Consumer lag and group parallelism."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTITION = ["bundle_id", "topic", "partition_id"]


def partition_lag(commits: DataFrame, high_watermarks: DataFrame) -> DataFrame:
    """Lag of every commit: high watermark minus position, never below 0; a partition
    without a watermark adds none."""
    marks = high_watermarks.select(*PARTITION, "hwm")
    joined = commits.join(marks, PARTITION, "left")
    lag = F.coalesce(F.greatest(F.col("hwm") - F.col("at"), F.lit(0).cast("bigint")), F.lit(0).cast("bigint"))
    return joined.select("bundle_id", "group_id", "topic", "partition_id", "at", "hwm", lag.alias("lag"))


def consumer_lag(
    commits: DataFrame, high_watermarks: DataFrame, groups: DataFrame | None = None, level: str = "group"
) -> DataFrame:
    """Lag per ``partition``, ``topic`` or ``group``. Groups without commits are kept with
    no lag; commits of an unlisted group have the state Unknown."""
    lag = partition_lag(commits, high_watermarks)
    if level == "partition":
        return lag
    if level == "topic":
        return lag.groupBy("bundle_id", "group_id", "topic").agg(F.sum("lag").alias("lag"))
    totals = lag.groupBy("bundle_id", "group_id").agg(F.sum("lag").alias("total_lag"))
    if groups is None:
        return totals
    known = groups.select("bundle_id", "group_id", "state")
    out = totals.join(known, ["bundle_id", "group_id"], "full")
    return out.select(
        "bundle_id", "group_id", F.coalesce("state", F.lit("Unknown")).alias("state"),
        F.coalesce("total_lag", F.lit(0).cast("bigint")).alias("total_lag"),
    )


def group_parallelism(members: DataFrame, topic_sizes: DataFrame) -> DataFrame:
    """Groups whose member count differs from the partition count of a topic they read.

    ``members``: (bundle_id, group_id, state, member_id, assigned MAP<topic, partitions>).
    """
    active = members.filter((F.col("state") != "Empty") & F.col("member_id").isNotNull())
    sizes = active.groupBy("bundle_id", "group_id").agg(F.count("*").alias("members"))
    topics = active.select("bundle_id", "group_id", F.explode(F.map_keys("assigned")).alias("topic")).distinct()
    out = topics.join(topic_sizes.select("bundle_id", "topic", "partitions"), ["bundle_id", "topic"])
    out = out.join(sizes, ["bundle_id", "group_id"])
    kind = F.when(F.col("members") < F.col("partitions"), "under").when(F.col("members") > F.col("partitions"), "over")
    return out.filter(F.col("partitions") > 0).withColumn("finding", kind).filter(F.col("finding").isNotNull())


def topic_sizes(kafka_partitions: DataFrame) -> DataFrame:
    return kafka_partitions.groupBy("bundle_id", "topic").agg(F.count("*").alias("partitions"))
