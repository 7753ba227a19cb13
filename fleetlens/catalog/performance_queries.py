"""Queries over the rules on metrics: samples in which every limit is crossed by some bundles and kept by others."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.catalog.registry import query
from fleetlens.catalog.rule_queries import BUNDLE, expect, judge, setting, union
from fleetlens.plans.performance import performance_report

K, N = "c_custkey", "c_nationkey"
MIB = 1048576


def sample(name: str, value: str, where: str = "true", at: int = 0, **labels: str) -> str:
    """One sample of every bundle, ``at`` seconds after the first."""
    pairs = ", ".join(f"'{k}', '{v}'" for k, v in labels.items()) or "'x', 'y'"
    return (
        f"SELECT {BUNDLE}, '' AS node, {K} * 1000 + {at} AS id, '{name}' AS name, map({pairs}) AS labels, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL {at} SECONDS AS ts, CAST({value} AS DOUBLE) AS value "
        f"FROM customer WHERE {where}"
    )


UTIL = f"2 * ({K} % 51)"
RUNTIME, HANDLED = "vectorized_scheduler_runtime_ms", "vectorized_kafka_handler_latency_microseconds_count"
FREE, RECLAIMABLE = f"CASE {N} % 3 WHEN 0 THEN 10 WHEN 1 THEN 100 ELSE 300 END", f"300 * ({K} % 2)"
SAMPLES = union(
    sample("vectorized_reactor_utilization", UTIL, shard="0"), sample("vectorized_reactor_utilization", "10", shard="1"),
    sample("redpanda_cpu_busy_seconds_total", "5", f"{N} % 3 = 0"), sample("vectorized_reactor_cpu_busy_ms", "7", f"{N} % 3 < 2"),
    # Workloads by nation: fetches, produces, both, fetches by count of requests, none.
    sample(RUNTIME, "80", f"{N} % 5 = 0", group="fetch"), sample(RUNTIME, "20", f"{N} % 5 = 0", group="main"), sample(RUNTIME, "1", f"{N} % 5 = 1", group="fetch"),
    sample(RUNTIME, "9", f"{N} % 5 = 1", group="raft_send"), sample(RUNTIME, "50", f"{N} % 5 = 2", group="fetch"), sample(RUNTIME, "50", f"{N} % 5 = 2", group="produce"),
    sample(RUNTIME, "5", f"{N} % 5 IN (1, 2)", group="archival_upload"), sample(HANDLED, "100", f"{N} % 5 = 3", handler="fetch"), sample(HANDLED, "10", f"{N} % 5 = 3", handler="produce"),
    sample("vectorized_kafka_handler_sent_bytes_total", f"{K} * 100", handler="fetch"), sample("vectorized_storage_log_batches_written", "1"), sample("vectorized_storage_log_written_bytes", f"1024 * ({K} % 13)"),
    sample("vectorized_io_queue_queue_length", f"20 * ({N} % 4)"), sample("vectorized_io_queue_total_operations", "1000"), sample("vectorized_io_queue_total_exec_sec", f"IF({K} % 2 = 0, 30, 5)"),
    sample("vectorized_io_queue_total_delay_sec", "20"), sample("vectorized_batch_cache_hits", f"{K} % 10"), sample("vectorized_batch_cache_accesses", "10"),
    sample("vectorized_reactor_stalls", "1", f"{K} % 7 = 0"), sample("vectorized_reactor_threaded_fallbacks", f"{K} % 3"), sample("vectorized_scheduler_time_spent_on_task_quota_violations_ms", f"1000 * ({K} % 3)"),
    sample("vectorized_network_bytes_received", "10"), sample("vectorized_network_bytes_sent", f"10 * ({K} % 7)"), sample("vectorized_host_snmp_tcp_established", f"10000 * ({K} % 8)"),
    sample("vectorized_raft_replicate_ack_all_requests", f"{K} % 5"), sample("vectorized_raft_replicate_ack_leader_requests", "2"), sample("vectorized_raft_leadership_changes", f"500 * ({K} % 4)"),
    sample("vectorized_raft_recovery_partitions_to_recover", f"{K} % 3"), sample("vectorized_memory_allocated_bytes", f"900 * {MIB}"), sample("vectorized_memory_free_bytes", f"({FREE}) * {MIB}"),
    sample("vectorized_storage_batch_cache_reclaimable_bytes", f"{RECLAIMABLE} * {MIB}"), sample("redpanda_memory_available_memory_low_water_mark", f"IF({K} % 4 = 0, 32, 128) * {MIB}"),
    sample("vectorized_reactor_uptime", "700000", f"{K} % 5 < 3"),
)
TESTS = union(*[f"SELECT {BUNDLE}, 'disk' AS type, '{name}' AS name, CAST({rate} * {MIB} AS BIGINT) AS throughput FROM customer" for name, rate in (("4KB sequential write", f"({K} % 6)"), ("16KB sequential r/w", f"10 * ({K} % 5)"))])

CPU, DISK, NET = f"({UTIL} > 95)", f"({N} % 4 = 3 AND {K} % 2 = 0)", f"({K} % 7 > 5)"
FETCH_HEAVY = f"{N} % 5 IN (0, 3)"
LOW = f"({N} % 3 = 0 AND {K} % 2 = 0)"
WORKLOAD = f"CASE {N} % 5 WHEN 0 THEN 'Fetch-Heavy' WHEN 1 THEN 'Produce-Heavy' WHEN 2 THEN 'Balanced' WHEN 3 THEN 'Fetch-Heavy' ELSE 'Idle' END"
IMBALANCE, THROTTLED, STALE = f"{UTIL} > 70", f"{N} % 4 = 3 AND {K} % 2 = 1", f"{K} % 10 < 8 AND {FETCH_HEAVY}"
EMPTY_POLLS, FRAGMENTED = f"{N} % 5 = 3 AND {K} < 500", f"{K} % 5 < 3 AND {K} % 2 = 1 AND {N} % 3 < 2"
HEADROOM = f"{UTIL} < 20 AND {N} % 5 = 3 AND NOT {DISK} AND NOT {NET}"
SLOW = f"({K} % 6 < 4 OR {K} % 5 < 3)"


def says(text: str, where: str = "true") -> str:
    return f"SELECT {BUNDLE}, {text} AS text FROM customer WHERE {where}"


def report(t):
    """Each customer is a bundle, and a small file of customers is one split: samples are dealt to tasks before they are aggregated."""
    samples = t.sql(SAMPLES)
    dealt = samples.repartition(int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bundle_id")
    return performance_report(dealt, self_test=t.sql(TESTS))


@query("performance_states", f"SELECT {BUNDLE}, {CPU} AS is_cpu_bound, {DISK} AS is_disk_bound, {NET} AS is_network_bound, {WORKLOAD} AS workload FROM customer")
def performance_states(t):
    """All three bounds and every workload, both ways."""
    return report(t).select("bundle_id", "is_cpu_bound", "is_disk_bound", "is_network_bound", "workload")


@query(
    "performance_observations",
    union(
        says("'CPU busy counters found (5s in total)'", f"{N} % 3 = 0"), says("'CPU busy counters found (7ms in total)'", f"{N} % 3 = 1"),
        says("'Critical: Reactor utilization is at 100%'", f"{UTIL} = 100"), says(f"concat('Warning: High reactor utilization: ', {UTIL}, '.00%')", f"{UTIL} BETWEEN 96 AND 99"),
        says(f"concat('Shard imbalance: busiest shard ', {UTIL}, '%, average ', {K} % 51 + 5, '%')", IMBALANCE),
        says("'Workload is Fetch-Heavy by scheduler time'", f"{N} % 5 = 0"), says("'Workload is Produce-Heavy by scheduler time'", f"{N} % 5 = 1"), says("'Workload is Fetch-Heavy by request count'", f"{N} % 5 = 3"),
        says("'Possible reactor spinning: full utilization with little scheduled work'", f"{UTIL} = 100 AND {N} % 5 = 1"),
        says(f"concat('Warning: Empty fetch polls: ', {K}, ' bytes per response')", EMPTY_POLLS), says(f"concat('Average batch size: ', {K} % 13, '.00 KB')"),
        says(f"concat('Warning: Batches below the 4 KB block (efficiency ', 25 * ({K} % 13), '.0%)')", f"{K} % 13 < 4"), says("'Small average batch size (< 10 KB)'", f"{K} % 13 BETWEEN 4 AND 9"),
        says("'High disk queue length: 60'", f"{N} % 4 = 3"), says("'Critical: Slow disk: 30.00 ms per operation'", DISK), says("'Warning: I/O held back by the scheduler: 20.00 ms (disk 5.00 ms)'", THROTTLED),
        says(f"concat('Warning: Low batch cache hit ratio (', 10 * ({K} % 10), '.0%)')", STALE), says("'Warning: Uploads take over half of the produce CPU time'", f"{N} % 5 = 1"),
        says("'Reactor stalls over 1 ms were recorded'", f"{K} % 7 = 0"), says(f"concat('Threaded fallbacks: ', {K} % 3, ' calls')", f"{K} % 3 > 0"), says("'Task quota violations: 2000 ms'", f"{K} % 3 = 2"),
        says("'Critical: Extreme network fan-out (6.0x)'", NET), says(f"concat('High network fan-out (', {K} % 7, '.0x)')", f"{K} % 7 IN (4, 5)"),
        says("'Tiered-storage uploads are active'", f"{N} % 5 IN (1, 2)"), says("'Heavy tiered-storage uploads'", f"{N} % 5 = 1"), says(f"concat('High connection count: ', {K} % 8, '0000')", f"{K} % 8 > 5"),
        says("'Most produce requests wait for all replicas'", f"{K} % 5 > 2"), says("'Most produce requests wait for the leader or nobody'", f"{K} % 5 <= 2"), says("'Frequent leadership changes: 1500'", f"{K} % 4 = 3"),
        says(f"concat('Recovery: ', {K} % 3, ' partitions')", f"{K} % 3 > 0"), says("'Critical: Low effective memory: 1.1% available'", LOW),
        says("'Memory is healthy: little is free, but much is reclaimable'", f"{N} % 3 < 2 AND {K} % 2 = 1"), says("'Warning: Low free memory'", f"{N} % 3 = 1 AND {K} % 2 = 0"),
        says("'Memory fragmentation is likely after a week of uptime'", FRAGMENTED), says("'Memory ran almost out in the past'", f"{K} % 4 = 0"),
        says(f"concat('Unsupported disk: small-block writes at ', {K} % 6, '.00 MB/s (minimum 4)')", f"{K} % 6 < 4"), says(f"concat('Unsupported disk: medium-block writes at ', 10 * ({K} % 5), '.00 MB/s (minimum 30)')", f"{K} % 5 < 3"),
        says("'Headroom: below 20% CPU, throughput is limited by demand'", HEADROOM),
    ),
)
def performance_observations(t):
    """Every observation of every bundle."""
    return report(t).select("bundle_id", F.explode("observations").alias("text"))


@query(
    "performance_advice",
    union(
        says("'Look for a heavy partition that pins one core.'", IMBALANCE), says("'Raise the minimum fetch size on clients or the fetch debounce on brokers.'", EMPTY_POLLS),
        says("'Let producers linger longer or use larger batches.'", f"{K} % 13 < 4 OR ({K} % 13 < 10 AND {CPU})"), says("'Check the volume for throttling or slow hardware.'", DISK),
        says("'Measure the disks again: the I/O limits may be too low.'", THROTTLED), says("'Consumers read old data; consider a larger batch cache.'", STALE),
        says("'High fan-out stresses the network; use private endpoints or fewer consumers.'", NET), says("'Uploads compete with consumers for egress.'", f"{N} % 5 = 1"), says("'Add memory or run fewer shards.'", LOW),
        says("'If allocations fail, consider a rolling restart.'", FRAGMENTED), says("'Upgrade the storage volume.'", SLOW), says("'Look at the producers: the limit is upstream.'", HEADROOM),
    ),
)
def performance_advice(t):
    return report(t).select("bundle_id", F.explode("recommendations").alias("text"))


@query(
    "bottleneck_audit",
    union(
        expect("'CPU Saturation'", f"CASE WHEN {CPU} THEN 'Critical' ELSE 'Pass' END", f"CASE WHEN {CPU} THEN 'bound' ELSE 'not bound' END"),
        expect("'Disk Saturation'", f"CASE WHEN {DISK} THEN 'Warning' ELSE 'Pass' END", f"CASE WHEN {DISK} THEN 'bound' ELSE 'not bound' END"),
        expect("'Workload Type'", "'Info'", WORKLOAD),
        expect("'Observation'", "'Critical'", "'Critical: Extreme network fan-out (6.0x)'", NET), expect("'Observation'", "'Info'", "'Reactor stalls over 1 ms were recorded'", f"{K} % 7 = 0"),
        expect("'Observation'", "'Warning'", "'Warning: Low free memory'", f"{N} % 3 = 1 AND {K} % 2 = 0"), expect("'Observation'", "'Warning'", "'Small average batch size (< 10 KB)'", f"{K} % 13 BETWEEN 4 AND 9"),
    ),
)
def bottleneck_audit(t):
    """C7; of the observations one of each severity, and the one that warns without the word."""
    sar = f"SELECT {BUNDLE}, TIMESTAMP '2024-01-01 00:00:00' AS ts, 1.0D AS cpu_system, 0.0D AS tcp_retrans, 0.0D AS tcp_in_errs, 0.0D AS tcp_in_segs, 0.0D AS tcp_out_segs FROM customer"
    net = f"SELECT {BUNDLE}, TIMESTAMP '2024-01-01 00:00:00' AS ts, 'eth0' AS iface, 0.0D AS rx_kb, 0.0D AS tx_kb, 0.0D AS if_util FROM customer"
    found = judge(t, {"bottleneck_checks"}, metrics=SAMPLES, sar=sar, sar_net=net, self_test=TESTS)
    some = F.col("current_value").startswith("Critical: Extreme") | F.col("current_value").startswith("Reactor stalls") | F.contains("current_value", F.lit("Low free memory")) | F.col("current_value").startswith("Small average")
    return found.filter((F.col("name") != "Observation") | some)


REQUESTS = "redpanda_kafka_request_latency_seconds_count"


@query(
    "integrity_audit",
    union(
        expect("'Log Storage Errors'", "'Critical'", f"concat({K} % 3, ' not parsed, ', {K} % 2, ' not written')", f"{K} % 3 > 0 OR {K} % 2 > 0"),
        expect("'Compaction Index Corruption'", "'Warning'", f"concat({K} % 4, ' indices')", f"{K} % 4 > 0"),
        expect("'High Memory Reclaim Rate'", "'Warning'", "'reclaimed 15000 times'", f"{K} % 4 = 3"), expect("'Node Status RPC Timeouts'", "'Warning'", f"concat({K} % 5, ' calls')", f"{K} % 5 > 0"),
        expect("'RPC Memory Backpressure'", "'Warning'", "'1 calls waited'", f"{K} % 2 = 1"),
        expect("'Metadata Request Overload'", "'Warning'", f"CASE WHEN {K} % 5 = 3 THEN '20.0% of the produce requests' ELSE '15.0% of the produce requests' END", f"{K} % 5 > 2 AND {K} % 2 = 1"),
    ),
)
def integrity_audit(t):
    """C34 and C23; sums over several series, and at the limit of 10 000 reclaims nothing is said."""
    return judge(t, {"integrity_checks"}, metrics=union(
        sample("vectorized_storage_log_batch_parse_errors", f"{K} % 3"), sample("vectorized_storage_log_batch_write_errors", f"{K} % 2"), sample("vectorized_storage_log_corrupted_compaction_indices", f"{K} % 4"),
        sample("vectorized_memory_reclaims_operations", f"2000 * ({K} % 4)", shard="0"), sample("redpanda_memory_reclaims_operations", f"3000 * ({K} % 4)", shard="1"), sample("redpanda_node_status_rpcs_timed_out_total", f"{K} % 5"),
        sample("redpanda_rpc_client_requests_blocked_memory_total", f"{K} % 2"), sample(REQUESTS, f"500 * ({K} % 5)", request="produce"), sample(REQUESTS, f"300 * ({K} % 2)", request="metadata"), sample(REQUESTS, "9999", request="fetch")))


@query("pending_audit", expect("'Pending Partition Operations'", "'Warning'", f"CAST({K} % 20 AS VARCHAR)", f"{K} % 20 > 10"))
def pending_audit(t):
    """The newest sample counts, whatever the earlier one says."""
    name = "vectorized_cluster_controller_pending_partition_operations"
    return judge(t, {"pending_checks"}, metrics=union(sample(name, "99"), sample(name, f"{K} % 20", at=60)))


_LIMIT = f"CASE WHEN {N} % 3 = 0 THEN 5000 WHEN {N} % 3 = 1 THEN 20000 ELSE 10000 END"
_USE = f"({K} % 12) * 100000.0 / ({_LIMIT})"


@query(
    "connection_audit",
    expect("'Network AIO Concurrency'", f"CASE WHEN {_USE} > 95 THEN 'Critical' WHEN {_USE} > 80 THEN 'Warning' ELSE 'Pass' END",
           f"CASE WHEN {_USE} > 80 THEN concat({K} % 12, '000 of ', {_LIMIT}, ' on shard 1') ELSE concat(CAST({_USE} AS DECIMAL(9, 1)), '% in use') END", f"{K} % 12 > 0"),
)
def connection_audit(t):
    """The limit comes from the command line, else from the configuration, else it is 10 000."""
    return judge(
        t, {"connection_limit_checks"}, metrics=union(sample("redpanda_rpc_active_connections", f"1000 * ({K} % 12)", shard="1"), sample("redpanda_rpc_active_connections", "0", shard="0")),
        command_lines=f"SELECT {BUNDLE}, 'redpanda --max-networking-io-control-blocks=5000' AS cmdline FROM customer WHERE {N} % 3 = 0", broker_config=setting("rpk.additional_start_flags.0", "'--max-networking-io-control-blocks=20000'", f"{N} % 3 < 2"))


@query("volume_audit", expect("'AWS GP3 IOPS Cliff'", "'Warning'", f"concat({K} % 100, '.0% of the provisioned rate')", f"{N} % 2 = 0 AND {K} % 100 > 70"))
def volume_audit(t):
    """The rates of both shards together; bundles of other clouds are not judged."""
    name = "vectorized_io_queue_total_write_ops"
    return judge(
        t, {"volume_checks"}, metrics=union(*[sample(name, value, at=at, shard=s) for s, at, value in (("0", 0, "7"), ("0", 100, f"7 + 600 * ({K} % 100)"), ("1", 0, "0"), ("1", 100, f"400 * ({K} % 100)"))]),
        uname=f"SELECT {BUNDLE}, IF({N} % 2 = 0, 'AWS', 'GCP') AS cloud FROM customer", broker_config=setting("redpanda.write_iops", "'1000'"))
