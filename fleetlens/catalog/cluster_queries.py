"""Queries over metrics, placement, consumers, storage and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.catalog.log_queries import micros
from fleetlens.catalog.registry import query
from fleetlens.functions import text
from fleetlens.operators import consumers, metrics, placement, storage
from fleetlens.plans import anomalies, replication
from fleetlens.operators.logs import log_patterns


def r6(*names: str):
    return {n: F.round(n, 6) for n in names}


def samples(t, name: str = "v_metrics", keys: tuple[str, ...] = ("shard", "class")):
    """Metric samples with the label map that the readers give."""
    labels = F.create_map(*[x for key in keys for x in (F.lit(key), F.col(key))])
    return getattr(t, name).withColumn("labels", labels).drop(*keys)


_SERIES = "concat('class=', class, ', shard=', shard)"


@query(
    "metric_filter",
    f"SELECT bundle_id, id, value FROM v_metrics WHERE name = 'metric_click' AND class = 'read' AND shard = '4' "
    "AND ts >= TIMESTAMP '2024-01-03 00:00:00' AND ts <= TIMESTAMP '2024-01-25 00:00:00'",
)
def metric_filter(t):
    out = metrics.filter_metrics(samples(t), "metric_click", {"class": "read", "shard": "4"}, "2024-01-03T00:00", "2024-01-25T00:00")
    return out.select("bundle_id", "id", "value")


@query("metric_names", "SELECT DISTINCT bundle_id, name FROM v_metrics")
def metric_names(t):
    return metrics.metric_names(samples(t))


@query(
    "metric_series",
    f"SELECT bundle_id, {_SERIES} AS series, epoch_us(ts) AS ts, id, value FROM v_metrics WHERE name = 'metric_view'",
)
def metric_series(t):
    return metrics.metric_series(samples(t), "metric_view").withColumn("ts", micros("ts"))


@query(
    "metric_rate",
    "SELECT bundle_id, name, series, id, round((value - pv) / s, 6) AS rate FROM (SELECT *, (epoch_us(ts) - epoch_us(pt)) / 1e6 AS s FROM "
    f"(SELECT bundle_id, name, series, id, ts, value, lag(ts) OVER w AS pt, lag(value) OVER w AS pv FROM (SELECT *, {_SERIES} AS series FROM v_metrics) a "
    "WINDOW w AS (PARTITION BY bundle_id, name, series ORDER BY ts, id)) b) c WHERE s > 0 AND (value - pv) / s >= 0",
)
def metric_rate(t):
    out = metrics.metric_rate(metrics.metric_series(samples(t), None))
    return out.select("bundle_id", "name", "series", "id", F.round("rate", 6).alias("rate"))


_ENDS = (
    f"SELECT bundle_id, name, shard, {_SERIES} AS series, arg_min(value, (ts, id)) AS v0, arg_max(value, (ts, id)) AS v1, "
    "(epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS s FROM v_metrics GROUP BY 1, 2, 3, 4"
)


@query("first_last_rate", f"SELECT bundle_id, name, shard, round(sum((v1 - v0) / s), 6) AS rate FROM ({_ENDS}) e WHERE s > 0 GROUP BY 1, 2, 3")
def first_last_rate(t):
    out = metrics.first_last_rate(samples(t), by="shard", names=True)
    return out.withColumns(r6("rate"))


@query("worst_rate", f"SELECT bundle_id, name, shard, round(max((v1 - v0) / s), 6) AS rate FROM ({_ENDS}) e WHERE s > 0 GROUP BY 1, 2, 3")
def worst_rate(t):
    out = metrics.first_last_rate(samples(t), by="shard", how="max", names=True)
    return out.withColumns(r6("rate"))


@query(
    "shard_cpu",
    f"SELECT bundle_id, shard, CASE WHEN arg_max(value, (ts, id)) <= 1 THEN arg_max(value, (ts, id)) * 100 ELSE arg_max(value, (ts, id)) END AS usage "
    "FROM v_metrics WHERE name = 'metric_error' GROUP BY 1, 2",
)
def shard_cpu(t):
    renamed = samples(t).withColumn(
        "name", F.when(F.col("name") == "metric_error", metrics.UTILIZATION).otherwise(F.col("name"))
    )
    return metrics.shard_cpu(renamed)


@query(
    "io_pivot",
    f"SELECT bundle_id, shard, class, "
    "coalesce(arg_max(value, (ts, id)) FILTER (name = 'metric_view'), 0) AS read_ops, coalesce(arg_max(value, (ts, id)) FILTER (name = 'metric_click'), 0) AS write_ops "
    "FROM v_metrics WHERE name IN ('metric_view', 'metric_click') GROUP BY 1, 2, 3",
)
def io_pivot(t):
    return metrics.io_by_class(samples(t), "metric_view", "metric_click")


@query(
    "latency_ratio",
    f"SELECT bundle_id, class AS request, round(sum(value) FILTER (name = 'metric_view'), 6) AS total, "
    "round(sum(value) FILTER (name = 'metric_click'), 6) AS requests, "
    "round(sum(value) FILTER (name = 'metric_view') / sum(value) FILTER (name = 'metric_click'), 6) AS avg_latency "
    "FROM v_metrics WHERE name IN ('metric_view', 'metric_click') GROUP BY 1, 2",
)
def latency_ratio(t):
    out = metrics.request_latency(samples(t), "class", "metric_view", "metric_click")
    return out.withColumns(r6("total", "requests", "avg_latency"))


@query(
    "recovery_totals",
    "SELECT bundle_id, round(coalesce(sum(value) FILTER (name = 'metric_view'), 0), 6) AS a, round(coalesce(sum(value) FILTER (name = 'metric_error'), 0), 6) AS b "
    "FROM v_metrics WHERE name IN ('metric_view', 'metric_error') GROUP BY 1",
)
def recovery_totals(t):
    out = metrics.raft_recovery(samples(t), {"a": "metric_view", "b": "metric_error"})
    return out.withColumns(r6("a", "b"))


@query(
    "connection_totals",
    "SELECT bundle_id, round(coalesce(sum(value) FILTER (name = 'metric_click'), 0), 4) AS active_connections, round(coalesce(sum(value) FILTER (name = 'metric_error'), 0), 4) AS rpc_errors "
    "FROM v_metrics WHERE name IN ('metric_click', 'metric_error') GROUP BY 1",
)
def connection_totals(t):
    name = F.when(F.col("name") == "metric_click", metrics.CONNECTIONS).when(F.col("name") == "metric_error", metrics.RPC_ERRORS).otherwise(F.col("name"))
    out = metrics.connection_totals(samples(t).withColumn("name", name))
    return out.withColumns({n: F.round(n, 4) for n in ("active_connections", "rpc_errors")})


@query(
    "topic_details",
    "SELECT p.bundle_id, p.partition_id, p.leader_id, r.n AS replica_count, k.leader AS kafka_leader FROM v_partitions p JOIN (SELECT bundle_id, topic, partition_id, count(*) AS n FROM v_replicas GROUP BY 1, 2, 3) r "
    "USING (bundle_id, topic, partition_id) JOIN v_kafka k USING (bundle_id, topic, partition_id) WHERE topic = 'topic-7'",
)
def topic_details(t):
    reports = t.v_replicas.withColumn("is_leader", F.lit(False))
    out = replication.topic_details("topic-7", t.v_partitions, t.v_replicas, reports, t.v_followers, t.v_kafka)
    return out.select("bundle_id", "partition_id", "leader_id", "replica_count", "kafka_leader")


_TOPIC_BYTES = f"SELECT bundle_id, topic, sum(value) :: BIGINT AS bytes FROM v_topic_bytes GROUP BY 1, 2"


@query("topic_throughput", _TOPIC_BYTES)
def topic_throughput(t):
    return metrics.topic_throughput(samples(t, "v_topic_bytes", ("topic",)), "written_bytes")


@query(
    "hot_topics",
    "SELECT bundle_id, topic, bytes, round((bytes - m) / s, 6) AS deviation FROM (SELECT *, avg(bytes) OVER (PARTITION BY bundle_id) AS m, "
    f"stddev_pop(bytes) OVER (PARTITION BY bundle_id) AS s FROM ({_TOPIC_BYTES}) a) b WHERE s > 0 AND (bytes - m) / s > 2 AND bytes > 1048576",
)
def hot_topics(t):
    out = metrics.hot_topics(metrics.topic_throughput(samples(t, "v_topic_bytes", ("topic",)), "written_bytes"))
    return out.withColumns(r6("deviation"))


_NODES = (
    "SELECT coalesce(b.bundle_id, r.bundle_id) AS bundle_id, coalesce(b.node_id, r.node_id) AS node_id, coalesce(r.n, 0) AS partition_count, "
    "coalesce(r.topics, 0) AS topic_count, b.rack, b.num_cores, b.is_alive, b.draining, b.total_bytes, b.free_bytes FROM v_brokers b FULL JOIN "
    "(SELECT bundle_id, node_id, count(*) AS n, count(DISTINCT topic) AS topics FROM v_replicas GROUP BY 1, 2) r "
    "ON r.bundle_id = b.bundle_id AND r.node_id = b.node_id"
)
_SCORED = f"SELECT *, avg(partition_count) OVER w AS mean, stddev_pop(partition_count) OVER w AS sigma FROM ({_NODES}) n WINDOW w AS (PARTITION BY bundle_id)"


@query(
    "node_skew",
    "SELECT bundle_id, node_id, partition_count, topic_count, num_cores, round((partition_count - mean) / sigma, 6) AS deviation, "
    "round((partition_count - mean) / mean * 100, 6) AS skew_pct, abs((partition_count - mean) / sigma) > 1.5 OR abs((partition_count - mean) / mean * 100) > 20 AS is_skewed "
    f"FROM ({_SCORED}) s",
)
def node_skew(t):
    return placement.node_skew(t.v_replicas, t.v_brokers).withColumns(r6("deviation", "skew_pct"))


@query(
    "rack_skew",
    "SELECT bundle_id, coalesce(nullif(rack, ''), 'default') AS rack, count(*) AS node_count, sum(partition_count) :: BIGINT AS partition_count, "
    "min(partition_count) AS min_count, max(partition_count) AS max_count, max(partition_count) > 2 * min(partition_count) AND max(partition_count) - min(partition_count) > 100 AS is_skewed "
    f"FROM ({_NODES}) n WHERE rack IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2",
)
def rack_skew(t):
    return placement.rack_skew(t.v_replicas, t.v_brokers)


@query(
    "topic_skew",
    "SELECT bundle_id, topic, sum(n) :: BIGINT AS replicas, min(n) AS min_replicas, max(n) AS max_replicas, round((max(n) - avg(n)) / avg(n) * 100, 4) AS max_skew FROM "
    f"(SELECT k.bundle_id, k.topic, k.node_id, coalesce(c.n, 0) AS n FROM (SELECT t.bundle_id, t.topic, d.node_id FROM (SELECT DISTINCT bundle_id, topic FROM v_replicas) t JOIN ({_NODES}) d ON d.bundle_id = t.bundle_id) k "
    "LEFT JOIN (SELECT bundle_id, topic, node_id, count(*) AS n FROM v_replicas GROUP BY 1, 2, 3) c ON c.bundle_id = k.bundle_id AND c.topic = k.topic AND c.node_id = k.node_id) z "
    "GROUP BY 1, 2 HAVING max(n) - min(n) > 1 AND (max(n) - avg(n)) / avg(n) * 100 > 20",
)
def topic_skew(t):
    out = placement.topic_skew(t.v_replicas, t.v_brokers)
    return out.withColumn("max_skew", F.round("max_skew", 4))


@query(
    "balancing_score",
    f"SELECT bundle_id, node_id, num_cores, num_cores * 5000 AS max_capacity, round(partition_count / (num_cores * 5000), 6) AS score FROM ({_NODES}) n WHERE num_cores IS NOT NULL",
)
def balancing_score(t):
    return placement.balancing_score(t.v_replicas, t.v_brokers).withColumns(r6("score"))


@query(
    "disk_analysis",
    "SELECT bundle_id, node_id, total_bytes, free_bytes, total_bytes - free_bytes AS used_bytes, 20000000000 AS reserved_bytes, 80000000000 AS usable_bytes, 64000000000 AS target_bytes, "
    "51200000000 AS rebalance_threshold, 15000000000 AS alert_threshold, 51200000000 - (total_bytes - free_bytes) AS available_to_rebalance, "
    "85000000000 - (total_bytes - free_bytes) AS available_to_alert, free_bytes < 15000000000 AS is_full, total_bytes - free_bytes > 51200000000 AS is_rebalancing FROM v_brokers",
)
def disk_analysis(t):
    return placement.disk_analysis(t.v_brokers)


@query(
    "constraint_checks",
    "SELECT bundle_id, node_id, partition_count, round(coalesce((total_bytes - free_bytes) / total_bytes * 100, 0), 6) AS disk_pct, coalesce(is_alive, false) AS is_alive, "
    "coalesce(draining, false) AS draining, concat_ws('; ', CASE WHEN NOT coalesce(is_alive, false) THEN 'node is not alive' END, CASE WHEN draining THEN 'node is draining' END, "
    "CASE WHEN (total_bytes - free_bytes) / total_bytes * 100 >= 80 THEN 'disk usage over limit' END) AS reasons, "
    "coalesce(is_alive AND NOT draining AND (total_bytes - free_bytes) / total_bytes * 100 < 80, false) AS is_valid_target "
    f"FROM ({_SCORED}) s WHERE partition_count < mean * 0.8",
)
def constraint_checks(t):
    out = placement.constraint_checks(t.v_replicas, t.v_brokers, t.v_brokers)
    return out.withColumn("reasons", F.array_join("reasons", "; ")).withColumns(r6("disk_pct"))


@query(
    "partition_counts",
    "SELECT r.bundle_id, r.node_id, r.core, count(*) AS partitions, count(l.leader) AS leaders FROM v_replicas r LEFT JOIN v_leaders l ON l.bundle_id = r.bundle_id "
    "AND l.topic = r.topic AND l.partition_id = r.partition_id AND l.leader = r.node_id GROUP BY 1, 2, 3",
)
def partition_counts(t):
    return placement.partition_counts(t.v_replicas, t.v_leaders)


@query(
    "leader_imbalance",
    "SELECT l.bundle_id, l.leader AS node_id, count(*) AS leaders, round((SELECT count(*) FROM v_leaders x WHERE x.bundle_id = l.bundle_id) / (SELECT count(*) FROM v_brokers b WHERE b.bundle_id = l.bundle_id), 6) AS avg_leaders "
    "FROM v_leaders l GROUP BY 1, 2 HAVING l.leader >= 0 AND count(*) > 1.5 * (SELECT count(*) FROM v_leaders x WHERE x.bundle_id = l.bundle_id) / (SELECT count(*) FROM v_brokers b WHERE b.bundle_id = l.bundle_id)",
)
def leader_imbalance(t):
    return placement.leader_imbalance(t.v_leaders, t.v_brokers).withColumns(r6("avg_leaders"))


@query(
    "skew_hint",
    f"WITH s AS (SELECT bundle_id, bool_or(abs((partition_count - mean) / sigma) > 1.5 OR abs((partition_count - mean) / mean * 100) > 20) AS k FROM ({_SCORED}) a GROUP BY 1), "
    f"c AS (SELECT bundle_id, coalesce(bool_or(x), false) AS k FROM (SELECT bundle_id, max(partition_count) > 2 * min(partition_count) AND max(partition_count) - min(partition_count) > 100 AS x FROM ({_NODES}) n "
    "WHERE rack IS NOT NULL GROUP BY bundle_id, coalesce(nullif(rack, ''), 'default') HAVING count(*) >= 2) d GROUP BY 1) "
    "SELECT s.bundle_id, s.k OR coalesce(c.k, false) AS is_skewed, CASE WHEN s.k OR coalesce(c.k, false) THEN 'Cluster is skewed; balancer is ''ready''; ' || "
    "CASE WHEN coalesce(c.k, false) THEN 'likely masked by satisfied rack constraints: rebalance on demand' ELSE 'check constraints or rebalance' END ELSE '' END AS hint FROM s LEFT JOIN c ON c.bundle_id = s.bundle_id",
)
def skew_hint(t):
    nodes = placement.node_skew(t.v_replicas, t.v_brokers)
    racks = placement.rack_skew(t.v_replicas, t.v_brokers)
    balancer = t.v_brokers.select("bundle_id").distinct().withColumn("status", F.lit("ready"))
    return placement.skew_hint(nodes, racks, balancer)


_LAG = (
    "SELECT c.*, h.hwm, coalesce(greatest(h.hwm - c.at, 0), 0) AS lag FROM v_commits c LEFT JOIN v_hwm h "
    "ON h.bundle_id = c.bundle_id AND h.topic = c.topic AND h.partition_id = c.partition_id"
)


@query("consumer_lag_partition", _LAG)
def consumer_lag_partition(t):
    return consumers.consumer_lag(t.v_commits, t.v_hwm, level="partition")


@query("consumer_lag_topic", f"SELECT bundle_id, group_id, topic, sum(lag) :: BIGINT AS lag FROM ({_LAG}) l GROUP BY 1, 2, 3")
def consumer_lag_topic(t):
    return consumers.consumer_lag(t.v_commits, t.v_hwm, level="topic")


@query(
    "consumer_lag_group",
    "SELECT coalesce(g.bundle_id, l.bundle_id) AS bundle_id, coalesce(g.group_id, l.group_id) AS group_id, coalesce(g.state, 'Unknown') AS state, coalesce(l.lag, 0) AS total_lag "
    f"FROM v_groups g FULL JOIN (SELECT bundle_id, group_id, sum(lag) :: BIGINT AS lag FROM ({_LAG}) a GROUP BY 1, 2) l ON l.bundle_id = g.bundle_id AND l.group_id = g.group_id",
)
def consumer_lag_group(t):
    return consumers.consumer_lag(t.v_commits, t.v_hwm, t.v_groups)


_MEMBERS = "SELECT DISTINCT bundle_id, group_id, concat('m-', CAST(partition_id % 7 AS STRING)) AS member_id, topic FROM v_commits"


@query(
    "consumer_parallelism",
    "SELECT t.bundle_id, t.group_id, t.topic, p.partitions, m.members, CASE WHEN m.members < p.partitions THEN 'under' ELSE 'over' END AS finding FROM "
    f"(SELECT DISTINCT bundle_id, group_id, topic FROM ({_MEMBERS}) a) t JOIN (SELECT bundle_id, group_id, count(DISTINCT member_id) AS members FROM ({_MEMBERS}) b GROUP BY 1, 2) m "
    "ON m.bundle_id = t.bundle_id AND m.group_id = t.group_id JOIN (SELECT bundle_id, topic, count(*) AS partitions FROM v_kafka GROUP BY 1, 2) p "
    "ON p.bundle_id = t.bundle_id AND p.topic = t.topic WHERE m.members <> p.partitions",
)
def consumer_parallelism(t):
    rows = t.v_commits.select("bundle_id", "group_id", F.concat(F.lit("m-"), (F.col("partition_id") % 7).cast("string")).alias("member_id"), "topic", "partition_id")
    assigned = rows.groupBy("bundle_id", "group_id", "member_id", "topic").agg(F.collect_set("partition_id").alias("p"))
    members = assigned.groupBy("bundle_id", "group_id", "member_id").agg(
        F.map_from_entries(F.collect_list(F.struct("topic", "p"))).alias("assigned")
    ).withColumn("state", F.lit("Stable"))
    return consumers.group_parallelism(members, consumers.topic_sizes(t.v_kafka))


_SEGMENT = "regexp_extract(path, '/kafka/([^/]+)/(\\d+)_(\\d+)/[^/]+\\.log\\z', {0})"
_STORAGE = (
    "SELECT s.bundle_id, s.topic, bool_or(k.topic IS NOT NULL) AS active, count(*) AS segment_count, sum(size_bytes) :: BIGINT AS size_bytes, "
    "sum(CASE WHEN k.topic IS NULL OR a.revision <> s.revision THEN size_bytes ELSE 0 END) :: BIGINT AS stale_bytes FROM "
    f"(SELECT bundle_id, {_SEGMENT.format(1)} AS topic, CAST({_SEGMENT.format(2)} AS BIGINT) AS partition_id, CAST({_SEGMENT.format(3)} AS BIGINT) AS revision, size_bytes FROM v_segments) s "
    "LEFT JOIN v_active_partitions a ON a.bundle_id = s.bundle_id AND a.topic = s.topic AND a.partition_id = s.partition_id "
    "LEFT JOIN (SELECT DISTINCT bundle_id, topic FROM v_active_partitions) k ON k.bundle_id = s.bundle_id AND k.topic = s.topic GROUP BY 1, 2"
)


@query("storage_by_topic", _STORAGE)
def storage_by_topic(t):
    return storage.storage_by_topic(t.v_segments, t.v_active_partitions).drop("data_dir")


@query(
    "storage_summary",
    f"SELECT bundle_id, count(*) FILTER (active) AS active_count, count(*) FILTER (NOT active) AS orphaned_count, '/var/lib/data' AS data_dir FROM ({_STORAGE}) s GROUP BY 1",
)
def storage_summary(t):
    return storage.storage_summary(storage.storage_by_topic(t.v_segments, t.v_active_partitions))


@query(
    "disk_by_partition",
    "SELECT bundle_id, split_part(split_part(path, '/kafka/', 2), '/', 1) AS topic, split_part(split_part(path, '/kafka/', 2), '/', 2) AS partition, sum(size_bytes) :: BIGINT AS bytes FROM v_segments GROUP BY 1, 2, 3",
)
def disk_by_partition(t):
    return storage.disk_by_partition(t.v_segments)


@query(
    "disk_rollup",
    f"WITH s AS ({_STORAGE}), d AS (SELECT bundle_id, split_part(split_part(path, '/kafka/', 2), '/', 1) AS topic, sum(size_bytes) :: BIGINT AS b FROM v_du WHERE contains(path, '/kafka/') GROUP BY 1, 2) "
    "SELECT coalesce(s.bundle_id, d.bundle_id) AS bundle_id, coalesce(s.topic, d.topic) AS topic, coalesce(d.b, s.size_bytes) AS total_bytes, coalesce(s.active, false) AS active, "
    "coalesce(s.segment_count, 0) AS segment_count FROM s FULL JOIN d ON d.bundle_id = s.bundle_id AND d.topic = s.topic",
)
def disk_rollup(t):
    return storage.disk_rollup(t.v_du, storage.storage_by_topic(t.v_segments, t.v_active_partitions))


@query("disk_totals", "SELECT bundle_id, 'data' AS kind, sum(total_bytes) :: BIGINT AS total_bytes, sum(free_bytes) :: BIGINT AS free_bytes FROM v_brokers GROUP BY 1")
def disk_totals(t):
    return storage.disk_totals(t.v_brokers.withColumn("kind", F.lit("data")))


@query(
    "mount_match",
    "SELECT bundle_id, url, max(mount) AS mount FROM (SELECT p.bundle_id, p.url, m.mount, row_number() OVER (PARTITION BY p.bundle_id, p.url ORDER BY length(m.mount) DESC) AS rn "
    "FROM (SELECT DISTINCT concat('bundle-', CAST(page_id % 3 AS STRING)) AS bundle_id, url FROM pages) p JOIN v_mounts m ON m.bundle_id = p.bundle_id AND starts_with(p.url, m.mount)) r "
    "WHERE rn = 1 GROUP BY bundle_id, url",
)
def mount_match(t):
    paths = t.pages.select(F.concat(F.lit("bundle-"), (F.col("page_id") % 3).cast("string")).alias("bundle_id"), "url")
    return storage.longest_prefix(paths, t.v_mounts, "url", "mount", ["bundle_id"]).select("bundle_id", "url", "mount")


_PROFILE = "SELECT bundle_id, node, shard_id, scheduling_group, sum(occurrences) :: BIGINT AS total_samples FROM v_cpu_profiles GROUP BY 1, 2, 3, 4"


@query(
    "cpu_profile_summary",
    f"SELECT *, round(total_samples / (sum(total_samples) OVER (PARTITION BY bundle_id, node, shard_id)) * 100, 6) AS percentage FROM ({_PROFILE}) p",
)
def cpu_profile_summary(t):
    return storage.cpu_profile_summary(t.v_cpu_profiles).withColumns(r6("percentage"))


@query(
    "cpu_profile_top",
    "SELECT bundle_id, node, shard_id, scheduling_group, user_backtrace, occurrences, round(occurrences / total * 100, 6) AS percentage, "
    "CASE WHEN contains(lower(user_backtrace), 'persistent_size') AND scheduling_group = 'main' THEN 'Segments: size computation over many small files' "
    "WHEN contains(lower(user_backtrace), 'ssl_accept') THEN 'TLS: many handshakes, clients without pooling' ELSE '' END AS insight FROM "
    "(SELECT *, sum(occurrences) OVER (PARTITION BY bundle_id, node, shard_id, scheduling_group) AS total, "
    "row_number() OVER (PARTITION BY bundle_id, node, shard_id, scheduling_group ORDER BY occurrences DESC, user_backtrace) AS rn FROM "
    "(SELECT bundle_id, node, shard_id, scheduling_group, user_backtrace, sum(occurrences) :: BIGINT AS occurrences FROM v_cpu_profiles GROUP BY 1, 2, 3, 4, 5) a) b WHERE rn <= 50",
)
def cpu_profile_top(t):
    return storage.cpu_profile_top(t.v_cpu_profiles).withColumns(r6("percentage"))


@query(
    "connection_summary",
    "SELECT bundle_id, 'state' AS kind, state AS name, count(*) AS count FROM v_sockets GROUP BY 1, 3 UNION ALL "
    "SELECT bundle_id, 'port', split_part(local_addr, ':', 2), count(*) FROM v_sockets GROUP BY 1, 3",
)
def connection_summary(t):
    return storage.connection_summary(t.v_sockets)


_DETAIL = (
    "SELECT p.*, r.n AS replica_count, r.nodes, d.max_offset, d.min_offset, d.lagging_node, f.abnormal, f.silent_ms, f.silent_id, k.leader AS kafka_leader FROM v_partitions p "
    "JOIN (SELECT bundle_id, topic, partition_id, count(*) AS n, list(node_id ORDER BY node_id) AS nodes FROM v_replicas GROUP BY 1, 2, 3) r USING (bundle_id, topic, partition_id) "
    "JOIN (SELECT bundle_id, topic, partition_id, max(committed_offset) AS max_offset, min(committed_offset) AS min_offset, arg_min(node_id, (committed_offset, node_id)) AS lagging_node FROM v_replicas GROUP BY 1, 2, 3) d USING (bundle_id, topic, partition_id) "
    "JOIN (SELECT bundle_id, topic, partition_id, count(*) FILTER (last_flushed_log_index < -1000000) AS abnormal, max(ms_since_last_heartbeat) FILTER (ms_since_last_heartbeat > 10000) AS silent_ms, "
    "arg_max(follower_id, (ms_since_last_heartbeat, follower_id)) AS silent_id FROM v_followers GROUP BY 1, 2, 3) f USING (bundle_id, topic, partition_id) "
    "JOIN v_kafka k USING (bundle_id, topic, partition_id)"
)


@query(
    "replication_insight",
    f"WITH d AS ({_DETAIL}), c AS (SELECT *, CASE WHEN leader_id <> kafka_leader THEN 'R1' WHEN leader_id = -1 THEN 'R2' WHEN contains(status, 'reconfig') THEN 'R3' WHEN status <> 'under_replicated' THEN 'R4' "
    "WHEN max_offset > min_offset THEN 'R5' WHEN silent_ms IS NOT NULL THEN 'R6' ELSE 'R7' END AS rule FROM d) "
    "SELECT bundle_id, ns, topic, partition_id, rule, CASE rule WHEN 'R2' THEN 'error' WHEN 'R6' THEN 'error' WHEN 'R3' THEN 'info' ELSE 'warn' END AS severity, CASE rule "
    "WHEN 'R1' THEN concat('leader is ', leader_id, ' by the cluster but ', kafka_leader, ' by client metadata') "
    "WHEN 'R2' THEN concat('no leader', CASE WHEN abnormal > 0 THEN concat('; abnormal log indices: ', abnormal) ELSE '' END) WHEN 'R3' THEN 'replicas are being changed' "
    "WHEN 'R5' THEN concat('node ', lagging_node, ' lags by ', max_offset - min_offset, ' offsets') WHEN 'R6' THEN concat('no heartbeat from node ', silent_id, ' for ', silent_ms // 1000, ' s') "
    "ELSE 'replicas are catching up' END AS summary, CASE rule WHEN 'R5' THEN concat('rpk cluster partitions move -p ', topic, '/', partition_id, ':', array_to_string(list_filter(nodes, lambda x: x <> lagging_node), ',')) "
    "WHEN 'R1' THEN 'check the reporting node for load and stalls' WHEN 'R2' THEN 'follow the partition''s leadership events' WHEN 'R3' THEN 'if stuck, check disk space and the network between replicas' ELSE '' END AS remediation "
    "FROM c WHERE rule <> 'R4'",
)
def replication_insight(t):
    reports = t.v_replicas.withColumn("is_leader", F.lit(False))
    details = replication.partition_details(t.v_partitions, t.v_replicas, reports, t.v_followers, t.v_kafka)
    return replication.replication_insight(details)


@query(
    "anomalies",
    "SELECT bundle_id, 'Raft Index' AS type, 'Critical' AS severity, concat(ns, '/', topic, '/', partition_id) AS subject, last_flushed_log_index AS value, concat('abnormal log index of follower ', follower_id) AS message "
    "FROM v_followers WHERE last_flushed_log_index < -1000000 UNION ALL "
    "SELECT bundle_id, 'Performance', 'Warning', 'reactor_stalled', count(*), 'frequent log pattern: reactor_stalled' FROM v_logs WHERE contains(lower(message), 'reactor_stalled') GROUP BY bundle_id, level HAVING count(*) > 5 UNION ALL "
    "SELECT h.bundle_id, 'Stale Health', 'Warning', 'cluster', h.n, 'health reports leaderless partitions, client metadata none' FROM (SELECT bundle_id, count(*) AS n FROM v_brokers WHERE NOT is_alive GROUP BY 1) h "
    "WHERE NOT EXISTS (SELECT 1 FROM v_kafka k WHERE k.bundle_id = h.bundle_id AND k.leader = -1)",
)
def anomaly_union(t):
    health = t.v_brokers.filter("NOT is_alive").groupBy("bundle_id").agg(F.count("*").alias("leaderless_count"))
    return anomalies.detect_anomalies(t.v_followers, t.v_kafka, health, log_patterns(t.v_logs))


@query(
    "size_to_bytes",
    "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN CAST(trunc(c_nationkey * 1024.0) AS BIGINT) WHEN 1 THEN CAST(trunc(c_nationkey * 1048576.0) AS BIGINT) "
    "WHEN 2 THEN CAST(trunc(c_nationkey * 1073741824.0) AS BIGINT) ELSE c_nationkey END AS bytes FROM customer",
)
def sizes(t):
    unit = F.element_at(F.array(F.lit("K"), F.lit("MB"), F.lit("G"), F.lit("")), (F.col("c_custkey") % 4 + 1).cast("int"))
    shown = F.concat(F.col("c_nationkey").cast("string"), unit)
    return t.customer.select("c_custkey", text.size_to_bytes(shown).alias("bytes"))


@query(
    "public_address",
    "SELECT c_custkey, NOT (a = 10 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 100 AND b BETWEEN 64 AND 127)) AS is_public "
    "FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 10 WHEN 1 THEN 172 WHEN 2 THEN 192 WHEN 3 THEN 100 ELSE 8 END AS a, CASE WHEN c_custkey % 5 = 2 THEN 160 + c_nationkey ELSE c_nationkey + 10 END AS b FROM customer) t",
)
def public_address(t):
    first = F.element_at(F.array(*[F.lit(n) for n in (10, 172, 192, 100, 8)]), (F.col("c_custkey") % 5 + 1).cast("int"))
    second = F.when(F.col("c_custkey") % 5 == 2, F.col("c_nationkey") + 160).otherwise(F.col("c_nationkey") + 10)
    host = F.concat_ws(".", first.cast("string"), second.cast("string"), F.lit("0"), F.lit("7"))
    return t.customer.select("c_custkey", text.is_public_address(host).alias("is_public"))


@query(
    "version_compare",
    "SELECT p_partkey, p_size > 25 OR (p_size = 25 AND (p_partkey % 3 > 1 OR (p_partkey % 3 = 1 AND p_partkey % 9 >= 5))) AS at_least FROM part",
)
def version_compare(t):
    version = F.concat(F.lit("v"), F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 3).cast("string"), (F.col("p_partkey") % 9).cast("string")))
    return t.part.select("p_partkey", text.version_at_least(version, "25.1.5").alias("at_least"))


@query(
    "json_paths",
    "SELECT event_id, regexp_extract(props, '([0-9]+)', 1) AS at_key, NULL :: VARCHAR AS at_missing FROM events",
)
def json_paths(t):
    props = F.col("props")
    return t.events.select("event_id", text.json_at(props, "k").alias("at_key"), text.json_at(props, "a.[0].b").alias("at_missing"))


@query(
    "format_units",
    "SELECT doc_id, CASE WHEN n_chars >= 1024 THEN printf('%.2f KB', n_chars / 1024) ELSE printf('%.0f B', n_chars :: DOUBLE) END AS shown FROM documents",
)
def format_units(t):
    return t.documents.select("doc_id", text.format_bytes(F.col("n_chars")).alias("shown"))
