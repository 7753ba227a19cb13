"""Storage per topic, disk roll-ups, mounts, CPU profiles, sockets, segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.rules import PROFILE_RULES, profile_insight
from fleetlens.functions.text import address_port, segment_path
from fleetlens.operators.windows import share_of_total, top_per_key


def storage_by_topic(files: DataFrame, partitions: DataFrame) -> DataFrame:
    """Segment count, bytes and stale bytes per topic.

    ``files``: (bundle_id, path, size_bytes); ``partitions``: (bundle_id, topic,
    partition_id, revision) of the data namespace. Bytes are stale if the partition
    lives under another revision or the topic is gone altogether. Files are summed per
    (topic, partition, revision) before any join.
    """
    segments = files.select("bundle_id", "size_bytes", segment_path(F.col("path")).alias("s")).filter(
        F.col("s.topic").isNotNull()
    )
    parts = segments.groupBy("bundle_id", F.col("s.topic").alias("topic"), F.col("s.partition_id").alias("partition_id"), F.col("s.revision").alias("revision")).agg(
        F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"), F.min("s.data_dir").alias("data_dir")
    )
    active = partitions.select(
        "bundle_id", "topic", "partition_id", F.col("revision").alias("active_revision")
    )
    topics = partitions.select("bundle_id", "topic", F.lit(True).alias("active")).distinct()
    joined = parts.join(active, ["bundle_id", "topic", "partition_id"], "left").join(topics, ["bundle_id", "topic"], "left")
    is_active = F.coalesce("active", F.lit(False))
    stale = ~is_active | (F.col("active_revision") != F.col("revision"))
    return joined.groupBy("bundle_id", "topic").agg(
        F.bool_or(is_active).alias("active"),
        F.sum("files").alias("segment_count"),
        F.sum("bytes").alias("size_bytes"),
        F.sum(F.when(stale, F.col("bytes")).otherwise(F.lit(0).cast("bigint"))).alias("stale_bytes"),
        F.min("data_dir").alias("data_dir"),
    )


def storage_summary(topics: DataFrame) -> DataFrame:
    """Active and orphaned topics and the effective data directory, per bundle."""
    return topics.groupBy("bundle_id").agg(
        F.count_if("active").alias("active_count"), F.count_if(~F.col("active")).alias("orphaned_count"),
        F.min("data_dir").alias("data_dir"),
    )


def _topic_path(path: Column) -> Column:
    """What follows the ``/kafka/`` directory; the data directory in front may be any."""
    return F.nullif(F.regexp_extract(path, r"\A.*?/kafka/(.+)\z", 1), F.lit(""))


def disk_by_partition(du: DataFrame) -> DataFrame:
    """Sizes that the disk-usage listing gives, summed per topic and partition directory."""
    rows = du.select("bundle_id", "size_bytes", F.split(_topic_path(F.col("path")), "/").alias("p")).filter(
        F.col("p").isNotNull()
    )
    return rows.groupBy(
        "bundle_id", F.get("p", 0).alias("topic"), F.get("p", 1).alias("partition")
    ).agg(F.sum("size_bytes").alias("bytes"))


def disk_rollup(du: DataFrame, storage: DataFrame) -> DataFrame:
    """Disk usage per topic; topics the listing lacks take their size from the segments."""
    listed = disk_by_partition(du).groupBy("bundle_id", "topic").agg(F.sum("bytes").alias("du_bytes"))
    seen = storage.select("bundle_id", "topic", "active", "segment_count", "size_bytes")
    out = listed.join(seen, ["bundle_id", "topic"], "full")
    return out.select(
        "bundle_id", "topic", F.coalesce("du_bytes", "size_bytes").alias("total_bytes"),
        F.coalesce("active", F.lit(False)).alias("active"),
        F.coalesce("segment_count", F.lit(0).cast("bigint")).alias("segment_count"),
    )


def disk_totals(disks: DataFrame) -> DataFrame:
    """Cluster totals; ``disks`` has a ``kind`` of data or cache."""
    return disks.groupBy("bundle_id", "kind").agg(
        F.sum("total_bytes").alias("total_bytes"), F.sum("free_bytes").alias("free_bytes")
    )


def longest_prefix(paths: DataFrame, prefixes: DataFrame, path: str, prefix: str, keys: list[str]) -> DataFrame:
    """Each path with its longest matching prefix (a data directory with its mount).

    Only the lengths that occur among a bundle's prefixes are tried: every path is cut
    to those lengths and matched by a hash join, not compared with every prefix.
    """
    lengths = prefixes.groupBy(*keys).agg(F.collect_set(F.length(prefix)).alias("_lengths"))
    tried = paths.join(lengths, keys)
    cuts = F.filter(F.array_sort("_lengths"), lambda n: n <= F.length(path))
    tried = tried.withColumn("_cut", F.explode(F.transform(cuts, lambda n: F.substring(F.col(path), F.lit(1), n))))
    hits = tried.drop("_lengths").join(prefixes.withColumnRenamed(prefix, "_cut"), [*keys, "_cut"])
    by = [*keys, path]
    rest = [c for c in hits.columns if c not in by]
    best = hits.groupBy(*by).agg(F.max_by(F.struct(*rest), F.length("_cut")).alias("_best"))
    return best.select(*by, "_best.*").withColumnRenamed("_cut", prefix)


def match_hosts(files: DataFrame, brokers: DataFrame) -> DataFrame:
    """Disk-stat files to brokers: the longest broker host that occurs in the file name.

    A file name is cut into all pieces of the lengths that hosts have, so this too is a
    hash join. Both tables have a few rows per bundle.
    """
    hosts = brokers.select("bundle_id", "node_id", F.col("internal_rpc_address").alias("_host")).filter("_host != ''")
    lengths = hosts.groupBy("bundle_id").agg(F.collect_set(F.length("_host")).alias("_lengths"))
    tried = files.join(lengths, "bundle_id")
    name = F.col("file_name")
    pieces = F.flatten(
        F.transform(
            F.filter("_lengths", lambda n: n <= F.length(name)),
            lambda n: F.transform(F.sequence(F.lit(1), F.length(name) - n + 1), lambda at: F.substring(name, at, n)),
        )
    )
    tried = tried.withColumn("_host", F.explode(F.array_distinct(pieces))).drop("_lengths")
    hits = tried.join(hosts, ["bundle_id", "_host"])
    by = ["bundle_id", "kind", "file_name"]
    best = hits.groupBy(*by).agg(
        F.max_by(F.struct("node_id", "total_bytes", "free_bytes"), F.struct(F.length("_host"), "_host")).alias("b")
    )
    return best.select(*by, "b.*")


def cpu_profile_summary(profiles: DataFrame) -> DataFrame:
    """Samples by node, shard and group with the group's share of the shard."""
    sums = profiles.groupBy("bundle_id", "node", "shard_id", "scheduling_group").agg(
        F.sum("occurrences").alias("total_samples")
    )
    return share_of_total(sums, ["bundle_id", "node", "shard_id"], "total_samples", "percentage")


def cpu_profile_top(
    profiles: DataFrame, n: int = 50, node: str | None = None, shard_id: int | None = None,
    group: str | None = None, rules=PROFILE_RULES,
) -> DataFrame:
    """The ``n`` most frequent backtraces of every (node, shard, group), or of one."""
    for column, value in (("node", node), ("shard_id", shard_id), ("scheduling_group", group)):
        if value is not None:
            profiles = profiles.filter(F.col(column) == value)
    keys = ["bundle_id", "node", "shard_id", "scheduling_group"]
    sums = profiles.groupBy(*keys, "user_backtrace").agg(F.sum("occurrences").alias("occurrences"))
    shared = share_of_total(sums, keys, "occurrences", "percentage")
    top = top_per_key(shared, keys, [F.col("occurrences").desc(), F.col("user_backtrace")], n)
    return top.withColumn("insight", profile_insight(F.col("user_backtrace"), F.col("scheduling_group"), rules))


def connection_summary(sockets: DataFrame) -> DataFrame:
    """(bundle_id, kind, name, count): sockets by state and by local port, in one pass."""
    pairs = F.array(
        F.struct(F.lit("state").alias("kind"), F.col("state").alias("name")),
        F.struct(F.lit("port").alias("kind"), address_port(F.col("local_addr")).alias("name")),
    )
    return sockets.select("bundle_id", F.explode(pairs).alias("p")).groupBy(
        "bundle_id", F.col("p.kind").alias("kind"), F.col("p.name").alias("name")
    ).agg(F.count("*").alias("count"))


def segment_summary(batches: DataFrame) -> DataFrame:
    """Batches by type and compression with offset and time span."""
    return batches.groupBy("bundle_id", "type_name", "compression").agg(
        F.count("*").alias("batches"), F.sum("record_count").alias("records"),
        F.sum("batch_length").alias("bytes"), F.min("base_offset").alias("first_offset"),
        F.max("max_offset").alias("last_offset"), F.min("first_timestamp").alias("first_timestamp"),
        F.max("max_timestamp").alias("last_timestamp"),
    )
