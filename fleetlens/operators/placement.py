"""Partition placement: skew over nodes, racks and topics, scores, disks, hints.

``replicas`` has a row per replica (bundle_id, ns, topic, partition_id, node_id, core);
``brokers`` a row per broker (bundle_id, node_id, rack, num_cores, is_alive, draining);
``disks`` (bundle_id, node_id, total_bytes, free_bytes); ``settings`` one row per bundle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Configuration defaults.
SETTING_DEFAULTS = {
    "topic_partitions_per_shard": 5000,
    "topic_partitions_reserve_shard0": 0,
    "partition_autobalancing_mode": "node_add",
    "enable_rack_awareness": False,
    "space_management_enabled": True,
    "disk_reservation_percent": 20,
    "retention_local_target_capacity_percent": 80,
    "retention_local_target_capacity_bytes": 0,
    "partition_autobalancing_max_disk_usage_percent": 80,
    "storage_space_alert_free_threshold_percent": 15,
}


def settings_table(config: DataFrame) -> DataFrame:
    """Key/value configuration to one typed row per bundle, with defaults."""
    columns = []
    for key, default in SETTING_DEFAULTS.items():
        kind = {bool: "boolean", int: "bigint", str: "string"}[type(default)]
        value = F.max(F.when(F.col("key") == key, F.col("value"))).try_cast(kind)
        columns.append(F.coalesce(value, F.lit(default)).alias(key))
    return config.groupBy("bundle_id").agg(*columns)


def with_settings(df: DataFrame, settings: DataFrame | None) -> DataFrame:
    """Adds the setting columns; a bundle without configuration gets the defaults."""
    if settings is None:
        return df.withColumns({k: F.lit(v) for k, v in SETTING_DEFAULTS.items()})
    joined = df.join(settings, "bundle_id", "left")
    return joined.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in SETTING_DEFAULTS.items()})


def node_counts(replicas: DataFrame, brokers: DataFrame) -> DataFrame:
    """Replicas and topics per node, with zeros for brokers that hold none.

    Two steps: first per (node, topic), which shrinks the data before the shuffle, then
    per node, so that the distinct topics are counted rows and not a set in memory.
    """
    per_topic = replicas.groupBy("bundle_id", "node_id", "topic").agg(F.count("*").alias("n"))
    per_node = per_topic.groupBy("bundle_id", "node_id").agg(
        F.sum("n").alias("partition_count"), F.count("*").alias("topic_count")
    )
    known = brokers.select("bundle_id", "node_id", "rack", "num_cores", "is_alive", "draining")
    zero = F.lit(0).cast("bigint")
    return per_node.join(known, ["bundle_id", "node_id"], "full").withColumns(
        {
            "partition_count": F.coalesce("partition_count", zero),
            "topic_count": F.coalesce("topic_count", zero),
        }
    )


def cluster_moments(counts: DataFrame) -> DataFrame:
    return counts.groupBy("bundle_id").agg(
        F.count("*").alias("total_nodes"),
        F.sum("partition_count").alias("total_partitions"),
        F.avg("partition_count").alias("mean"),
        F.stddev_pop("partition_count").alias("sigma"),
    )


def node_skew(replicas: DataFrame, brokers: DataFrame) -> DataFrame:
    """Deviation of each node from its cluster's mean; skewed over 1.5 sigma or 20 %."""
    counts = node_counts(replicas, brokers)
    scored = counts.join(cluster_moments(counts), "bundle_id")
    deviation = F.when(F.col("sigma") > 0, (F.col("partition_count") - F.col("mean")) / F.col("sigma")).otherwise(0.0)
    pct = F.when(F.col("mean") > 0, (F.col("partition_count") - F.col("mean")) / F.col("mean") * 100).otherwise(0.0)
    return scored.withColumns({"deviation": deviation, "skew_pct": pct}).select(
        "bundle_id", "node_id", "partition_count", "topic_count", "num_cores", "deviation", "skew_pct",
        ((F.abs("deviation") > 1.5) | (F.abs("skew_pct") > 20)).alias("is_skewed"),
    )


def rack_skew(replicas: DataFrame, brokers: DataFrame) -> DataFrame:
    """Racks of two or more brokers; skewed if max > 2 min and the gap is over 100."""
    rack = F.coalesce(F.nullif(F.col("rack"), F.lit("")), F.lit("default"))
    known = brokers.select("bundle_id", "node_id", rack.alias("rack"))
    per_node = replicas.groupBy("bundle_id", "node_id").agg(F.count("*").alias("n"))
    counts = known.join(per_node, ["bundle_id", "node_id"], "left")
    n = F.coalesce("n", F.lit(0).cast("bigint"))
    racks = counts.groupBy("bundle_id", "rack").agg(
        F.count("*").alias("node_count"), F.sum(n).alias("partition_count"),
        F.min(n).alias("min_count"), F.max(n).alias("max_count"),
    )
    skewed = (F.col("max_count") > F.col("min_count") * 2) & (F.col("max_count") - F.col("min_count") > 100)
    return racks.filter(F.col("node_count") >= 2).withColumn("is_skewed", skewed)


def topic_skew(replicas: DataFrame, brokers: DataFrame) -> DataFrame:
    """Topics whose busiest node holds over 20 % more than the mean over all nodes.

    Nodes without the topic count as 0. They are accounted for by number - mean over
    the cluster's node count, minimum 0 if some node lacks the topic - so no row per
    (node, topic) pair is ever made.
    """
    nodes = brokers.select("bundle_id", "node_id").union(replicas.select("bundle_id", "node_id")).distinct()
    sizes = nodes.groupBy("bundle_id").agg(F.count("*").alias("total_nodes"))
    per_node = replicas.groupBy("bundle_id", "topic", "node_id").agg(F.count("*").alias("n"))
    topics = per_node.groupBy("bundle_id", "topic").agg(
        F.sum("n").alias("replicas"), F.max("n").alias("max_replicas"),
        F.min("n").alias("min_present"), F.count("*").alias("nodes_present"),
    )
    low = F.when(F.col("nodes_present") < F.col("total_nodes"), F.lit(0).cast("bigint")).otherwise(F.col("min_present"))
    mean = F.col("replicas") / F.col("total_nodes")
    out = topics.join(sizes, "bundle_id").withColumns({"min_replicas": low, "mean": mean})
    out = out.withColumn("max_skew", (F.col("max_replicas") - F.col("mean")) / F.col("mean") * 100)
    skewed = (F.col("max_replicas") - F.col("min_replicas") > 1) & (F.col("max_skew") > 20)
    return out.filter(skewed).select("bundle_id", "topic", "replicas", "min_replicas", "max_replicas", "max_skew")


def balancing_score(replicas: DataFrame, brokers: DataFrame, settings: DataFrame | None = None) -> DataFrame:
    """Partitions (or topics, in topic-aware mode) over the node's capacity."""
    counts = with_settings(node_counts(replicas, brokers).filter(F.col("num_cores").isNotNull()), settings)
    capacity = F.col("num_cores") * F.col("topic_partitions_per_shard") - F.col("topic_partitions_reserve_shard0")
    load = F.when(F.col("partition_autobalancing_mode") == "topic_aware", F.col("topic_count")).otherwise(F.col("partition_count"))
    return counts.withColumn("max_capacity", F.when(capacity <= 0, F.lit(1)).otherwise(capacity).cast("bigint")).select(
        "bundle_id", "node_id", "num_cores", "max_capacity", (load / F.col("max_capacity")).alias("score")
    )


def _part(amount: Column, percent: str) -> Column:
    return (amount.cast("double") * (F.col(percent) / 100.0)).cast("bigint")


def disk_analysis(disks: DataFrame, settings: DataFrame | None = None) -> DataFrame:
    """Reserved, usable and target space, thresholds, head-rooms and flags per node."""
    total = F.col("total_bytes")
    managed = F.col("space_management_enabled")
    out = with_settings(disks, settings).withColumns(
        {
            "used_bytes": total - F.col("free_bytes"),
            "reserved_bytes": F.when(managed, _part(total, "disk_reservation_percent")).otherwise(F.lit(0).cast("bigint")),
        }
    )
    out = out.withColumn("usable_bytes", F.greatest(total - F.col("reserved_bytes"), F.lit(0).cast("bigint")))
    by_pct = _part(F.col("usable_bytes"), "retention_local_target_capacity_percent")
    fixed = F.col("retention_local_target_capacity_bytes")
    zero = F.lit(0).cast("bigint")
    # Of the two limits the smaller one that is set; none set means no target.
    smaller = F.coalesce(F.least(F.when(by_pct > 0, by_pct), F.when(fixed > 0, fixed)), zero)
    out = out.withColumn("target_bytes", F.when(managed, smaller).otherwise(total))
    base = F.when(F.col("target_bytes") > 0, F.col("target_bytes")).otherwise(total)
    out = out.withColumns(
        {
            "rebalance_threshold": _part(base, "partition_autobalancing_max_disk_usage_percent"),
            "alert_threshold": _part(total, "storage_space_alert_free_threshold_percent"),
        }
    )
    used = F.col("used_bytes")
    return out.select(
        "bundle_id", "node_id", "total_bytes", "free_bytes", "used_bytes", "reserved_bytes", "usable_bytes",
        "target_bytes", "rebalance_threshold", "alert_threshold",
        (F.col("rebalance_threshold") - used).alias("available_to_rebalance"),
        (total - F.col("alert_threshold") - used).alias("available_to_alert"),
        (F.col("free_bytes") < F.col("alert_threshold")).alias("is_full"),
        (used > F.col("rebalance_threshold")).alias("is_rebalancing"),
    )


def constraint_checks(
    replicas: DataFrame, brokers: DataFrame, disks: DataFrame, settings: DataFrame | None = None
) -> DataFrame:
    """Why nodes below 80 % of the mean cannot take more: dead, draining, disk over limit."""
    counts = node_counts(replicas, brokers)
    low = counts.join(cluster_moments(counts), "bundle_id").filter(F.col("partition_count") < F.col("mean") * 0.8)
    space = disks.select("bundle_id", "node_id", "total_bytes", "free_bytes")
    out = with_settings(low.join(space, ["bundle_id", "node_id"], "left"), settings)
    used = (F.col("total_bytes") - F.col("free_bytes")) / F.col("total_bytes") * 100
    limit = F.col("partition_autobalancing_max_disk_usage_percent").cast("double")
    out = out.withColumns(
        {
            "disk_pct": F.when(F.col("total_bytes") > 0, used).otherwise(F.lit(0.0)),
            "is_alive": F.coalesce("is_alive", F.lit(False)),
            "draining": F.coalesce("draining", F.lit(False)),
        }
    )
    reasons = F.array_compact(
        F.array(
            F.when(~F.col("is_alive"), F.lit("node is not alive")),
            F.when(F.col("draining"), F.lit("node is draining")),
            F.when((F.col("total_bytes") > 0) & (F.col("disk_pct") >= limit), F.lit("disk usage over limit")),
        )
    )
    out = out.withColumn("reasons", reasons)
    return out.select(
        "bundle_id", "node_id", "partition_count", "disk_pct", "is_alive", "draining", "reasons",
        (F.size("reasons") == 0).alias("is_valid_target"),
    )


def skew_hint(nodes: DataFrame, racks: DataFrame, balancer: DataFrame) -> DataFrame:
    """Per bundle: is the cluster skewed, and what to do about it."""
    by_node = nodes.groupBy("bundle_id").agg(F.bool_or("is_skewed").alias("node_skew"))
    by_rack = racks.groupBy("bundle_id").agg(F.bool_or("is_skewed").alias("rack_skew"))
    status = balancer.select("bundle_id", F.col("status").alias("balancer_status"))
    out = by_node.join(by_rack, "bundle_id", "left").join(status, "bundle_id", "left")
    rack = F.coalesce("rack_skew", F.lit(False))
    state = F.coalesce("balancer_status", F.lit(""))
    idle = state.isin("ready", "off")
    advice = F.when(rack, "likely masked by satisfied rack constraints: rebalance on demand").otherwise(
        "check constraints or rebalance"
    )
    skewed = F.col("node_skew") | rack
    hint = F.when(
        skewed,
        F.concat(F.lit("Cluster is skewed; balancer is '"), state, F.lit("'"), F.when(idle, F.concat(F.lit("; "), advice)).otherwise("")),
    ).otherwise("")
    return out.select("bundle_id", skewed.alias("is_skewed"), hint.alias("hint"))


def partition_counts(replicas: DataFrame, leaders: DataFrame) -> DataFrame:
    """Replicas and leaders per node and core.

    A leader counts on the core of its own replica, so one left join on the replica's
    full key settles all four counts; sum over cores for the per-node numbers.
    """
    lead = leaders.filter(F.col("leader") >= 0).select(
        "bundle_id", "ns", "topic", "partition_id", F.col("leader").alias("node_id"), F.lit(1).alias("lead")
    )
    joined = replicas.join(lead, ["bundle_id", "ns", "topic", "partition_id", "node_id"], "left")
    return joined.groupBy("bundle_id", "node_id", "core").agg(
        F.count("*").alias("partitions"), F.count("lead").alias("leaders")
    )


def leader_imbalance(leaders: DataFrame, brokers: DataFrame) -> DataFrame:
    """Nodes that lead over 1.5 times the average over all nodes."""
    sizes = brokers.groupBy("bundle_id").agg(F.count("*").alias("nodes"))
    counts = leaders.groupBy("bundle_id", "leader").agg(F.count("*").alias("leaders"))
    totals = counts.groupBy("bundle_id").agg(F.sum("leaders").alias("total"))
    out = counts.join(totals, "bundle_id").join(sizes, "bundle_id")
    out = out.withColumn("avg_leaders", F.col("total") / F.col("nodes"))
    return out.filter((F.col("leader") >= 0) & (F.col("leaders") > F.col("avg_leaders") * 1.5)).select(
        "bundle_id", F.col("leader").alias("node_id"), "leaders", "avg_leaders"
    )
