"""Why a partition is unhealthy: the first of seven rules that holds.

Inputs, all flat: ``partitions`` (bundle_id, ns, topic, partition_id, status, leader_id),
``replicas`` (.., node_id), ``debug_replicas`` (.., node_id, committed_offset, is_leader),
``debug_followers`` (.., node_id, follower_id, ms_since_last_heartbeat,
last_flushed_log_index) and ``kafka`` (bundle_id, topic, partition_id, leader).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["bundle_id", "ns", "topic", "partition_id"]

# Fixed values.
ABNORMAL_INDEX = -1_000_000
SILENT_MS = 10_000


def partition_details(
    partitions: DataFrame, replicas: DataFrame, debug_replicas: DataFrame, debug_followers: DataFrame, kafka: DataFrame
) -> DataFrame:
    """Partitions with what their replicas, debug records and client metadata say.

    Each source is first reduced to one row per partition, so every join is one to one.
    A source that lacks the partition leaves NULL.
    """
    assigned = replicas.groupBy(*KEY).agg(
        F.count("*").alias("replica_count"), F.array_sort(F.collect_set("node_id")).alias("nodes")
    )
    reports = debug_replicas.groupBy(*KEY).agg(
        F.count("*").alias("reports"),
        F.max("committed_offset").alias("max_offset"),
        F.min("committed_offset").alias("min_offset"),
        F.min_by("node_id", F.struct("committed_offset", "node_id")).alias("lagging_node"),
        F.count_if("is_leader").alias("claimed_leaders"),
    )
    silent = F.when(F.col("ms_since_last_heartbeat") > SILENT_MS, F.struct("ms_since_last_heartbeat", "follower_id"))
    followers = debug_followers.groupBy(*KEY).agg(
        F.count_if(F.col("last_flushed_log_index") < ABNORMAL_INDEX).alias("abnormal_indices"),
        F.max(silent).alias("silent"),
    )
    told = kafka.select("bundle_id", "topic", "partition_id", F.col("leader").alias("kafka_leader"))
    # Client metadata knows no namespace, so its key differs: that join comes first, while
    # the rows are narrow; the other three share one partitioning.
    return (
        partitions.join(told, ["bundle_id", "topic", "partition_id"], "left")
        .join(assigned, KEY, "left")
        .join(reports, KEY, "left")
        .join(followers, KEY, "left")
    )


def topic_details(topic: str, partitions: DataFrame, *sources: DataFrame) -> DataFrame:
    """The same for one topic, with findings; the topic filter reaches every source."""
    tables = [df.filter(F.col("topic") == topic) for df in (partitions, *sources)]
    details = partition_details(*tables)
    found = replication_insight(details).select(*KEY, "rule", "severity", "summary", "remediation")
    return details.join(found, KEY, "left")


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def replication_insight(details: DataFrame) -> DataFrame:
    """(bundle_id, ns, topic, partition_id, rule, severity, summary, remediation), one row
    per partition with a finding."""
    leader, said = F.col("leader_id"), F.col("kafka_leader")
    under = F.col("status") == "under_replicated"
    lags = F.col("max_offset") > F.col("min_offset")
    rules = [
        ("R1", "warn", said.isNotNull() & (leader != said),
         _text("leader is ", leader, " by the cluster but ", said, " by client metadata")),
        ("R2", "error", leader == -1,
         F.concat(
             F.lit("no leader"),
             F.when(F.col("reports") < F.col("replica_count"), _text("; only ", F.col("reports"), "/", F.col("replica_count"), " replicas reported")).otherwise(""),
             F.when(F.col("claimed_leaders") > 0, _text("; nodes that claim to lead: ", F.col("claimed_leaders"))).otherwise(""),
             F.when(F.col("abnormal_indices") > 0, _text("; abnormal log indices: ", F.col("abnormal_indices"))).otherwise(""),
         )),
        ("R3", "info", F.contains(F.lower("status"), F.lit("reconfig")), F.lit("replicas are being changed")),
        ("R4", None, ~under, F.lit(None).cast("string")),
        ("R5", "warn", lags, _text("node ", F.col("lagging_node"), " lags by ", F.col("max_offset") - F.col("min_offset"), " offsets")),
        ("R6", "error", F.col("silent").isNotNull(),
         _text("no heartbeat from node ", F.col("silent.follower_id"), " for ", F.floor(F.col("silent.ms_since_last_heartbeat") / 1000), " s")),
        ("R7", "warn", under, F.lit("replicas are catching up")),
    ]
    chain = F.when(F.lit(False), F.lit(None).cast("struct<rule:string,severity:string,summary:string>"))
    for name, severity, test, summary in rules:
        found = F.struct(
            F.lit(name).alias("rule"), F.lit(severity).cast("string").alias("severity"), summary.alias("summary")
        )
        chain = chain.when(test, found)
    others = F.array_join(F.array_remove("nodes", F.col("lagging_node")).cast("array<string>"), ",")
    move = _text("rpk cluster partitions move -p ", F.col("topic"), "/", F.col("partition_id"), ":", others)
    advice = (
        F.when((F.col("rule") == "R5") & (others != ""), move)
        .when(F.col("rule") == "R1", F.lit("check the reporting node for load and stalls"))
        .when(F.col("rule") == "R2", F.lit("follow the partition's leadership events"))
        .when(F.col("rule") == "R3", F.lit("if stuck, check disk space and the network between replicas"))
        .otherwise("")
    )
    out = details.withColumn("_found", chain).withColumns(
        {name: F.col(f"_found.{name}") for name in ("rule", "severity", "summary")}
    )
    return out.filter(F.col("severity").isNotNull()).select(*KEY, "rule", "severity", "summary", advice.alias("remediation"))
