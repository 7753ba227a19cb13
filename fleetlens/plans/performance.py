"""Performance report per bundle: one pass over the samples, then rules on one row."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.text import series_label
from fleetlens.operators.metrics import network_health


class Measure(NamedTuple):
    """A sum, maximum or minimum over the samples of some metrics, optionally only those
    whose ``label`` has one of ``values``."""

    how: str
    names: tuple[str, ...]
    label: str | None = None
    values: tuple[str, ...] = ()


# Metric names and label values.
_RUNTIME = ("vectorized_scheduler_runtime_ms",)
_REQUESTS = ("vectorized_kafka_handler_latency_microseconds_count",)
MEASURES: dict[str, Measure] = {
    "max_util": Measure("max", ("vectorized_reactor_utilization",)),
    "sum_util": Measure("sum", ("vectorized_reactor_utilization",)),
    "n_util": Measure("count", ("vectorized_reactor_utilization",)),
    "busy_seconds": Measure("sum", ("redpanda_cpu_busy_seconds_total",)),
    "busy_ms": Measure("sum", ("vectorized_reactor_cpu_busy_ms",)),
    "stall_histogram": Measure("sum", ("vectorized_reactor_stalls",)),
    "fallbacks": Measure("sum", ("vectorized_reactor_threaded_fallbacks",)),
    "n_runtime": Measure("count", _RUNTIME),
    "produce_ms": Measure("sum", _RUNTIME, "group", ("produce", "main", "raft_send", "raft_receive")),
    "fetch_ms": Measure("sum", _RUNTIME, "group", ("fetch",)),
    "upload_ms": Measure("sum", _RUNTIME, "group", ("archival_upload",)),
    "free_mem": Measure("sum", ("vectorized_memory_free_bytes", "redpanda_memory_free_memory")),
    "used_mem": Measure("sum", ("vectorized_memory_allocated_bytes", "redpanda_memory_allocated_memory")),
    "reclaimable_mem": Measure("sum", ("vectorized_storage_batch_cache_reclaimable_bytes", "redpanda_storage_batch_cache_reclaimable_bytes")),
    "low_water": Measure("min", ("redpanda_memory_available_memory_low_water_mark",)),
    "uptime": Measure("max", ("vectorized_reactor_uptime",)),
    "produce_count": Measure("sum", _REQUESTS, "handler", ("produce",)),
    "fetch_count": Measure("sum", _REQUESTS, "handler", ("fetch",)),
    "sent_bytes": Measure("sum", ("vectorized_kafka_handler_sent_bytes_total",), "handler", ("fetch",)),
    "received_bytes": Measure("sum", ("vectorized_kafka_handler_received_bytes_total",), "handler", ("produce",)),
    "batches": Measure("sum", ("vectorized_storage_log_batches_written",)),
    "written_bytes": Measure("sum", ("vectorized_storage_log_written_bytes",)),
    "max_queue": Measure("max", ("vectorized_io_queue_queue_length",)),
    "io_delay": Measure("sum", ("vectorized_io_queue_total_delay_sec",)),
    "io_exec": Measure("sum", ("vectorized_io_queue_total_exec_sec",)),
    "io_ops": Measure("sum", ("vectorized_io_queue_total_operations",)),
    "cache_hits": Measure("sum", ("vectorized_batch_cache_hits",)),
    "cache_accesses": Measure("sum", ("vectorized_batch_cache_accesses",)),
    "quota_ms": Measure("sum", ("vectorized_scheduler_time_spent_on_task_quota_violations_ms",)),
    "net_rx": Measure("sum", ("vectorized_network_bytes_received",)),
    "net_tx": Measure("sum", ("vectorized_network_bytes_sent",)),
    "tcp_connections": Measure("max", ("vectorized_host_snmp_tcp_established",)),
    "leader_changes": Measure("sum", ("vectorized_raft_leadership_changes",)),
    "to_recover": Measure("max", ("vectorized_raft_recovery_partitions_to_recover",)),
    "ack_all": Measure("sum", ("vectorized_raft_replicate_ack_all_requests",)),
    "ack_leader": Measure("sum", ("vectorized_raft_replicate_ack_leader_requests",)),
}
MIB = 1024.0 * 1024.0
WEEK_SECONDS = 7 * 24 * 3600
SMALL_BLOCK_MBPS, MEDIUM_BLOCK_MBPS = 4.0, 30.0


DIGEST_LABELS = ["shard", "group", "handler", "request"]


def metric_digest(metrics: DataFrame, names: list[str]) -> DataFrame:
    """One row per series of the named metrics: n, total, low, high, first and last sample.

    This is the only pass over the samples; every rule works on its rows, whose number is
    that of the series and does not grow with the time span.
    """
    label = lambda key: F.col("labels")[key]
    node = F.col("node") if "node" in metrics.columns else F.lit("")
    rows = metrics.filter(F.col("name").isin(names)).select(
        "bundle_id", F.coalesce(node, F.lit("")).alias("node"), "name", series_label(F.col("labels")).alias("series"),
        F.coalesce(label("shard"), label("reactor"), label("cpu")).alias("shard"),
        *[label(key).alias(key) for key in DIGEST_LABELS[1:]], "ts", "id", "value",
    )
    order, sample = F.struct("ts", "id"), F.struct("ts", "id", "value")
    return rows.groupBy("bundle_id", "node", "name", "series", *DIGEST_LABELS).agg(
        F.count("value").alias("n"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.min_by(sample, order).alias("first"), F.max_by(sample, order).alias("last"),
    )


def single_samples(metrics: DataFrame) -> DataFrame:
    """Samples as rows of a digest, of one sample each: for totals per bundle, which need no series. Their aggregation
    holds a row per bundle and task, not one per series."""
    value = F.col("value")
    return metrics.select(
        "bundle_id", "name", *[F.col("labels")[key].alias(key) for key in DIGEST_LABELS],
        F.when(value.isNotNull(), 1).otherwise(0).cast("bigint").alias("n"), value.alias("total"), value.alias("low"), value.alias("high"),
    )


def measure_names(*tables: dict[str, Measure]) -> list[str]:
    return sorted({n for table in tables for m in table.values() for n in m.names})


def measure_totals(digest: DataFrame, measures: dict[str, Measure]) -> DataFrame:
    """One row per bundle with a column per measure, as conditional aggregates."""
    source = {"sum": (F.sum, "total"), "max": (F.max, "high"), "min": (F.min, "low"), "count": (F.sum, "n")}
    columns = []
    for alias, m in measures.items():
        test = F.col("name").isin(list(m.names))
        if m.label:
            test = test & F.col(m.label).isin(list(m.values))
        how, column = source[m.how]
        value = how(F.when(test, F.col(column))).cast("double")
        # A minimum stays NULL without samples; all else starts from 0.
        columns.append((value if m.how == "min" else F.coalesce(value, F.lit(0.0))).alias(alias))
    wanted = digest.filter(F.col("name").isin(measure_names(measures)))
    return wanted.groupBy("bundle_id").agg(*columns)


def _say(template: str, *values: Column) -> Column:
    return F.format_string(template, *values) if values else F.lit(template)


def workload_type(f) -> Column:
    """Fetch share of scheduler time, else of requests."""
    by_time, by_count = f("produce_ms") + f("fetch_ms"), f("produce_count") + f("fetch_count")
    share = F.when((f("n_runtime") > 0) & (by_time > 0), f("fetch_ms") / by_time).when(by_count > 0, f("fetch_count") / by_count)
    return (
        F.when(share > 0.7, "Fetch-Heavy").when(share < 0.3, "Produce-Heavy").when(share.isNotNull(), "Balanced").otherwise("Idle")
    )


def self_test_facts(self_test: DataFrame) -> DataFrame:
    """Disk tests below the small- and medium-block minimum, per bundle."""
    rate = F.col("throughput") / MIB
    disk = self_test.filter(F.col("type") == "disk").withColumns({"rate": rate, "lowered": F.lower("name")})
    small = F.contains("lowered", F.lit("4kb")) & (F.col("rate") < SMALL_BLOCK_MBPS)
    medium = F.contains("lowered", F.lit("16kb")) & (F.col("rate") < MEDIUM_BLOCK_MBPS)
    return disk.groupBy("bundle_id").agg(
        F.min(F.when(small, F.col("rate"))).alias("slow_small"), F.min(F.when(medium, F.col("rate"))).alias("slow_medium")
    )


def performance_report(
    metrics: DataFrame, sar: DataFrame | None = None, sar_net: DataFrame | None = None, self_test: DataFrame | None = None
) -> DataFrame:
    """The report from metric samples; see ``report_from_digest``."""
    return report_from_digest(single_samples(metrics), sar, sar_net, self_test)


def report_from_digest(
    digest: DataFrame, sar: DataFrame | None = None, sar_net: DataFrame | None = None, self_test: DataFrame | None = None
) -> DataFrame:
    """(bundle_id, is_cpu_bound, is_disk_bound, is_network_bound, workload,
    observations ARRAY<STRING>, recommendations ARRAY<STRING>)."""
    f = F.col
    df = measure_totals(digest, MEASURES)
    no_findings = F.array().cast("array<string>")
    if sar is not None and sar_net is not None:
        df = df.join(network_health(sar, sar_net).select("bundle_id", f("findings").alias("network")), "bundle_id", "left")
        df = df.withColumn("network", F.coalesce("network", no_findings))
    else:
        df = df.withColumn("network", no_findings)
    if self_test is not None:
        df = df.join(self_test_facts(self_test), "bundle_id", "left")
    else:
        df = df.withColumns({"slow_small": F.lit(None).cast("double"), "slow_medium": F.lit(None).cast("double")})

    def ratio(top: str, bottom: str, scale: float = 1.0) -> Column:
        return F.when(f(bottom) > 0, f(top) / f(bottom) * scale)

    df = df.withColumns(
        {
            "workload": workload_type(f),
            "avg_util": ratio("sum_util", "n_util"),
            "fetch_size": ratio("sent_bytes", "fetch_count"),
            "batch_size": ratio("written_bytes", "batches"),
            "exec_ms": F.coalesce(ratio("io_exec", "io_ops", 1000.0), F.lit(0.0)),
            "delay_ms": F.coalesce(ratio("io_delay", "io_ops", 1000.0), F.lit(0.0)),
            "hit_ratio": ratio("cache_hits", "cache_accesses"),
            "fanout": ratio("net_tx", "net_rx"),
            "total_mem": f("used_mem") + f("free_mem"),
            "ack_share": F.when(f("ack_all") + f("ack_leader") > 0, f("ack_all") / (f("ack_all") + f("ack_leader"))),
        }
    )
    # Total memory is allocated plus free; without allocation samples nothing is known.
    df = df.withColumns(
        {
            "free_ratio": F.when((f("used_mem") > 0) & (f("total_mem") > 0), (f("free_mem") + f("reclaimable_mem")) / f("total_mem")),
            "is_cpu_bound": f("max_util") > 95,
            "is_disk_bound": (f("max_queue") > 50) & (f("exec_ms") > 20),
            "is_network_bound": F.coalesce(f("fanout") > 5, F.lit(False)),
        }
    )
    scheduled = f("n_runtime") > 0
    spinning = (f("max_util") >= 100) & scheduled & (f("produce_ms") + f("fetch_ms") < 100)
    imbalance = (f("n_util") > 1) & (f("max_util") > 20) & (f("max_util") - f("avg_util") > 30)
    small_batch, medium_batch = f("batch_size") < 4096, (f("batch_size") >= 4096) & (f("batch_size") < 10 * 1024)
    throttled = (f("max_queue") > 50) & ~(f("exec_ms") > 20) & (f("delay_ms") > f("exec_ms") * 2)
    stale_reads = (f("hit_ratio") < 0.8) & (f("workload") == "Fetch-Heavy")
    uploads_heavy = (f("produce_ms") > 0) & (f("upload_ms") > f("produce_ms") * 0.5)
    low_memory = f("free_ratio") < 0.05
    low_raw = ~low_memory & (f("free_mem") < 128 * MIB)
    cached = f("reclaimable_mem") > f("total_mem") * 0.2
    fragmented = (f("uptime") > WEEK_SECONDS) & (f("free_ratio") > 0.2) & (f("free_mem") < 256 * MIB)
    headroom = ~f("is_cpu_bound") & ~f("is_disk_bound") & ~f("is_network_bound") & (f("max_util") < 20) & (f("produce_count") > 0)
    basis = F.when(scheduled & (f("produce_ms") + f("fetch_ms") > 0), "scheduler time").otherwise("request count")
    observations = [
        F.when(f("busy_seconds") > 0, _say("CPU busy counters found (%.0fs in total)", f("busy_seconds")))
        .when(f("busy_ms") > 0, _say("CPU busy counters found (%.0fms in total)", f("busy_ms"))),
        F.when(f("max_util") >= 100, _say("Critical: Reactor utilization is at 100%"))
        .when(f("max_util") > 95, _say("Warning: High reactor utilization: %.2f%%", f("max_util"))),
        F.when(imbalance, _say("Shard imbalance: busiest shard %.0f%%, average %.0f%%", f("max_util"), f("avg_util"))),
        F.when(f("workload").isin("Fetch-Heavy", "Produce-Heavy"), F.concat(F.lit("Workload is "), f("workload"), F.lit(" by "), basis)),
        F.when(spinning, _say("Possible reactor spinning: full utilization with little scheduled work")),
        F.when(f("fetch_size") < 500, _say("Warning: Empty fetch polls: %.0f bytes per response", f("fetch_size"))),
        F.when(f("batch_size").isNotNull(), _say("Average batch size: %.2f KB", f("batch_size") / 1024)),
        F.when(small_batch, _say("Warning: Batches below the 4 KB block (efficiency %.1f%%)", f("batch_size") / 4096 * 100))
        .when(medium_batch, _say("Small average batch size (< 10 KB)")),
        F.when(f("max_queue") > 50, _say("High disk queue length: %.0f", f("max_queue"))),
        F.when(f("is_disk_bound"), _say("Critical: Slow disk: %.2f ms per operation", f("exec_ms")))
        .when(throttled, _say("Warning: I/O held back by the scheduler: %.2f ms (disk %.2f ms)", f("delay_ms"), f("exec_ms"))),
        F.when(stale_reads, _say("Warning: Low batch cache hit ratio (%.1f%%)", f("hit_ratio") * 100)),
        F.when(scheduled & uploads_heavy, _say("Warning: Uploads take over half of the produce CPU time")),
        F.when(f("stall_histogram") > 0, _say("Reactor stalls over 1 ms were recorded")),
        F.when(f("fallbacks") > 0, _say("Threaded fallbacks: %.0f calls", f("fallbacks"))),
        F.when(f("quota_ms") > 1000, _say("Task quota violations: %.0f ms", f("quota_ms"))),
        F.when(f("fanout") > 5, _say("Critical: Extreme network fan-out (%.1fx)", f("fanout")))
        .when(f("fanout") > 3, _say("High network fan-out (%.1fx)", f("fanout"))),
        F.when(f("upload_ms") > 0, _say("Tiered-storage uploads are active")),
        F.when((f("upload_ms") > 0) & uploads_heavy, _say("Heavy tiered-storage uploads")),
        F.when(f("tcp_connections") > 50_000, _say("High connection count: %.0f", f("tcp_connections"))),
        F.when(f("ack_share") > 0.5, _say("Most produce requests wait for all replicas"))
        .when(f("ack_share").isNotNull(), _say("Most produce requests wait for the leader or nobody")),
        F.when(f("leader_changes") > 1000, _say("Frequent leadership changes: %.0f", f("leader_changes"))),
        F.when(f("to_recover") > 0, _say("Recovery: %.0f partitions", f("to_recover"))),
        F.when(low_memory, _say("Critical: Low effective memory: %.1f%% available", f("free_ratio") * 100))
        .when(low_raw & cached, _say("Memory is healthy: little is free, but much is reclaimable"))
        .when(low_raw, _say("Warning: Low free memory")),
        F.when(fragmented, _say("Memory fragmentation is likely after a week of uptime")),
        F.when(f("free_ratio").isNotNull() & (f("low_water") < 64 * MIB), _say("Memory ran almost out in the past")),
        F.when(f("slow_small").isNotNull(), _say("Unsupported disk: small-block writes at %.2f MB/s (minimum 4)", f("slow_small"))),
        F.when(f("slow_medium").isNotNull(), _say("Unsupported disk: medium-block writes at %.2f MB/s (minimum 30)", f("slow_medium"))),
        F.when(headroom, _say("Headroom: below 20% CPU, throughput is limited by demand")),
    ]
    recommendations = [
        F.when(imbalance, "Look for a heavy partition that pins one core."),
        F.when(f("fetch_size") < 500, "Raise the minimum fetch size on clients or the fetch debounce on brokers."),
        F.when(small_batch | (medium_batch & f("is_cpu_bound")), "Let producers linger longer or use larger batches."),
        F.when(f("is_disk_bound"), "Check the volume for throttling or slow hardware."),
        F.when(throttled, "Measure the disks again: the I/O limits may be too low."),
        F.when(stale_reads, "Consumers read old data; consider a larger batch cache."),
        F.when(f("fanout") > 5, "High fan-out stresses the network; use private endpoints or fewer consumers."),
        F.when((f("upload_ms") > 0) & uploads_heavy, "Uploads compete with consumers for egress."),
        F.when(low_memory, "Add memory or run fewer shards."),
        F.when(fragmented, "If allocations fail, consider a rolling restart."),
        F.when(f("slow_small").isNotNull() | f("slow_medium").isNotNull(), "Upgrade the storage volume."),
        F.when(headroom, "Look at the producers: the limit is upstream."),
    ]
    return df.select(
        "bundle_id", "is_cpu_bound", "is_disk_bound", "is_network_bound", "workload",
        F.concat("network", F.array_compact(F.array(*observations))).alias("observations"),
        F.array_compact(F.array(*recommendations)).alias("recommendations"),
    )


def observation_severity(text: Column) -> Column:
    return (
        F.when(F.contains(text, F.lit("Small average batch size")) | F.contains(text, F.lit("Warning:")), "Warning")
        .when(F.contains(text, F.lit("Critical:")), "Critical")
        .otherwise("Info")
    )
