"""Metric samples ``bundle_id, id, name, labels MAP<STRING,STRING>, ts, value``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.text import series_label
from fleetlens.operators.logs import in_time_range
from fleetlens.operators.windows import previous_in_order

# Metric names.
UTILIZATION = "vectorized_reactor_utilization"
BUSY_SECONDS = "vectorized_reactor_busy_seconds_total"
UPTIME = "redpanda_application_uptime_seconds_total"
READ_OPS = "vectorized_io_queue_total_read_ops"
WRITE_OPS = "vectorized_io_queue_total_write_ops"
LATENCY_SUM = "redpanda_kafka_request_latency_seconds_sum"
LATENCY_COUNT = "redpanda_kafka_request_latency_seconds_count"
CONNECTIONS = "redpanda_rpc_active_connections"
RPC_ERRORS = "redpanda_rpc_request_errors_total"
WRITTEN_BYTES = "vectorized_storage_log_written_bytes"
RECOVERY = {
    "partitions_to_recover": "vectorized_raft_recovery_partitions_to_recover",
    "partitions_active": "vectorized_raft_recovery_partitions_active",
    "pending_offsets": "vectorized_raft_recovery_offsets_pending",
}


def node_keys(df: DataFrame) -> list[str]:
    """Series of different nodes are different series, wherever the table tells nodes apart."""
    return [c for c in ("bundle_id", "node") if c in df.columns]


def label(key: str) -> Column:
    return F.col("labels")[key]


def filter_metrics(
    metrics: DataFrame, name: str, labels: dict[str, str] | None = None, start=None, end=None,
    limit: int = 0, offset: int = 0,
) -> DataFrame:
    """One metric by name, label values and time range; a page of it if limited."""
    out = in_time_range(metrics.filter(F.col("name") == name), start, end)
    for key, value in (labels or {}).items():
        out = out.filter(label(key) == value)
    if limit > 0:
        out = out.orderBy("ts", "id").offset(offset).limit(limit)
    return out


def metric_names(metrics: DataFrame) -> DataFrame:
    return metrics.select("bundle_id", "name").distinct().orderBy("bundle_id", "name")


def metric_series(metrics: DataFrame, name: str | None, start=None, end=None) -> DataFrame:
    """Long form (bundle_id, series, ts, id, value): a point per row. A series is never
    gathered into one array, whose size would grow with the time span. Without a name, the series of all
    metrics, with their ``name``."""
    rows = in_time_range(metrics, start, end) if name is None else filter_metrics(metrics, name, None, start, end)
    return rows.select(*node_keys(rows), *(["name"] if name is None else []), series_label(F.col("labels")).alias("series"), "ts", "id", "value")


def metric_rate(series: DataFrame, partitions: int | None = None) -> DataFrame:
    """Per-second change between neighbouring points of a series.

    Pairs without time between them and falls (a counter reset) give no row.
    """
    keys = [c for c in (*node_keys(series), "name") if c in series.columns] + ["series"]
    paired = previous_in_order(series, keys, "ts", "id", ["ts", "value"], partitions)
    seconds = (F.unix_micros("ts") - F.unix_micros("prev.ts")) / 1e6
    rate = (F.col("value") - F.col("prev.value")) / F.col("seconds")
    return (
        paired.withColumn("seconds", seconds)
        .filter(F.col("seconds") > 0)
        .withColumn("rate", rate)
        .filter(F.col("rate") >= 0)
        .select(*keys, "ts", "id", "rate")
    )


def first_last_rate(metrics: DataFrame, by: str | None = None, how: str = "sum", names: bool = False) -> DataFrame:
    """(last - first) / seconds of every series, then summed (or the worst) per ``by`` label.

    ``metrics`` holds one metric name, or with ``names`` any, whose results are kept apart. First and last come from one aggregation with
    partial results per task, not from ordered windows.
    """
    order = F.struct("ts", "id")
    point = F.struct("ts", "value")
    own = node_keys(metrics) + (["name"] if names else [])
    ends = metrics.groupBy(*own, series_label(F.col("labels")).alias("series")).agg(
        *([F.first(label(by)).alias(by)] if by else []),
        F.min_by(point, order).alias("first"),
        F.max_by(point, order).alias("last"),
    )
    seconds = (F.unix_micros("last.ts") - F.unix_micros("first.ts")) / 1e6
    rates = ends.withColumn("seconds", seconds).filter(F.col("seconds") > 0)
    rates = rates.withColumn("rate", (F.col("last.value") - F.col("first.value")) / F.col("seconds"))
    keys = own + ([by] if by else ["series"])
    return rates.groupBy(*keys).agg((F.sum if how == "sum" else F.max)("rate").alias("rate"))


def shard_cpu(metrics: DataFrame) -> DataFrame:
    """Percent per shard: the last gauge value (a ratio up to 1 is scaled), or, for a
    bundle without the gauge, busy seconds over uptime."""
    rows = metrics.filter(F.col("name").isin(UTILIZATION, BUSY_SECONDS, UPTIME))
    order = F.struct("ts", "id")
    keys = node_keys(rows)
    last = rows.groupBy(*keys, "name", label("shard").alias("shard")).agg(
        F.max_by("value", order).alias("value"), F.min_by("value", order).alias("earliest"), F.min(order).alias("at")
    )
    # A row per shard and metric is left; a node has no more shards than cores.
    bundle = Window.partitionBy(*keys)
    is_uptime = F.col("name") == UPTIME
    known = last.withColumns(
        {
            "has_gauge": F.max(F.col("name") == UTILIZATION).over(bundle),
            "uptime": F.min_by(F.when(is_uptime, F.col("earliest")), F.when(is_uptime, F.col("at"))).over(bundle),
        }
    )
    gauge = F.when(F.col("value") <= 1, F.col("value") * 100).otherwise(F.col("value"))
    busy = F.when(F.col("uptime") > 0, F.col("value") / F.col("uptime") * 100)
    usage = F.when(F.col("name") == UTILIZATION, gauge).when((F.col("name") == BUSY_SECONDS) & ~F.col("has_gauge"), busy)
    out = known.filter((F.col("shard") != "") & ~is_uptime).select(*keys, "shard", usage.alias("usage"))
    return in_shard_order(out.filter(F.col("usage").isNotNull()))


def numeric_order(column: str) -> Column:
    """Sort key for ids kept as text; what is no number sorts as 0."""
    return F.coalesce(F.col(column).try_cast("int"), F.lit(0))


def in_shard_order(df: DataFrame, *then: str) -> DataFrame:
    """Sorted by bundle and shard number; for results with a row per shard."""
    return df.orderBy("bundle_id", numeric_order("shard"), *then)


def io_by_class(metrics: DataFrame, read: str = READ_OPS, write: str = WRITE_OPS) -> DataFrame:
    """Last read and write counts per shard and class, pivoted in one aggregation."""
    rows = metrics.filter(F.col("name").isin(read, write))
    order = F.struct("ts", "id")
    out = rows.groupBy("bundle_id", label("shard").alias("shard"), label("class").alias("class")).agg(
        *[
            F.coalesce(
                F.max_by(F.when(F.col("name") == name, F.col("value")), F.when(F.col("name") == name, order)),
                F.lit(0.0),
            ).alias(alias)
            for name, alias in ((read, "read_ops"), (write, "write_ops"))
        ]
    )
    return in_shard_order(out.filter((F.col("shard") != "") & (F.col("class") != "")), "class")


def sum_of(name: str) -> Column:
    return F.sum(F.when(F.col("name") == name, F.col("value")))


def request_latency(
    metrics: DataFrame, key: str = "request", total: str = LATENCY_SUM, count: str = LATENCY_COUNT
) -> DataFrame:
    """Mean latency by request type: summed sums over summed counts."""
    rows = metrics.filter(F.col("name").isin(total, count))
    out = rows.groupBy("bundle_id", label(key).alias("request")).agg(
        F.coalesce(sum_of(total), F.lit(0.0)).alias("total"), sum_of(count).alias("requests")
    )
    out = out.filter((F.col("request") != "") & (F.col("requests") > 0))
    return out.withColumn("avg_latency", F.col("total") / F.col("requests"))


def connection_totals(metrics: DataFrame) -> DataFrame:
    """Open connections and RPC errors, summed over shards."""
    rows = metrics.filter(F.col("name").isin(CONNECTIONS, RPC_ERRORS))
    return rows.groupBy("bundle_id").agg(
        F.coalesce(sum_of(CONNECTIONS), F.lit(0.0)).alias("active_connections"),
        F.coalesce(sum_of(RPC_ERRORS), F.lit(0.0)).alias("rpc_errors"),
    )


def raft_recovery(metrics: DataFrame, names: dict[str, str] = RECOVERY) -> DataFrame:
    rows = metrics.filter(F.col("name").isin(list(names.values())))
    return rows.groupBy("bundle_id").agg(
        *[F.coalesce(sum_of(name), F.lit(0.0)).alias(alias) for alias, name in names.items()]
    )


def topic_throughput(metrics: DataFrame, name: str = WRITTEN_BYTES) -> DataFrame:
    rows = metrics.filter((F.col("name") == name) & (label("topic") != ""))
    return rows.groupBy("bundle_id", label("topic").alias("topic")).agg(F.sum("value").alias("bytes"))


def hot_topics(throughput: DataFrame, z: float = 2.0, min_value: float = 1024 * 1024) -> DataFrame:
    """Topics more than ``z`` population deviations above their bundle's mean and over
    a floor. The moments are one small row per bundle, joined back."""
    moments = throughput.groupBy("bundle_id").agg(
        F.avg("bytes").alias("mean"), F.stddev_pop("bytes").alias("sigma")
    )
    deviation = F.when(F.col("sigma") > 0, (F.col("bytes") - F.col("mean")) / F.col("sigma")).otherwise(F.lit(0.0))
    scored = throughput.join(moments, "bundle_id").withColumn("deviation", deviation)
    return scored.filter((F.col("deviation") > z) & (F.col("bytes") > min_value)).select(
        "bundle_id", "topic", "bytes", "deviation"
    )


# Thresholds of the network rules.
RETRANS_WARN, RETRANS_CRIT = 1.0, 5.0
USE_WARN, USE_CRIT = 50.0, 80.0
STORM_CPU, STORM_SEGMENTS = 20.0, 50_000.0


def sar_peak_throughput(net: DataFrame) -> DataFrame:
    """Largest rx+tx of an interface per sample, in MB/s, without loopback."""
    traffic = (F.col("rx_kb") + F.col("tx_kb")) / 1024
    return net.filter(F.col("iface") != "lo").groupBy("bundle_id", "ts").agg(F.max(traffic).alias("peak_mbps"))


def network_health(sar: DataFrame, net: DataFrame) -> DataFrame:
    """One row per bundle with SAR samples: extremes and the list of findings."""
    storm = (F.col("cpu_system") > STORM_CPU) & (F.col("tcp_in_segs") + F.col("tcp_out_segs") > STORM_SEGMENTS)
    host = sar.groupBy("bundle_id").agg(
        F.max("tcp_retrans").alias("max_retrans"),
        (F.sum(F.coalesce("tcp_retrans", F.lit(0.0))) / F.count("*")).alias("avg_retrans"),
        F.coalesce(F.sum("tcp_in_errs"), F.lit(0.0)).alias("in_errs"),
        F.coalesce(F.bool_or(storm), F.lit(False)).alias("interrupt_storm"),
    )
    links = net.filter(F.col("iface") != "lo").groupBy("bundle_id").agg(
        F.max("if_util").alias("max_if_util"),
        (F.max(F.col("rx_kb") + F.col("tx_kb")) / 1024).alias("peak_mbps"),
    )
    # A row per bundle on both sides: few bytes when shuffled, too many to broadcast for a large fleet.
    joined = host.join(links.hint("merge"), "bundle_id", "left")
    findings = F.array_compact(
        F.array(
            F.when(F.col("max_retrans") > RETRANS_CRIT, F.format_string("Critical: High TCP retransmission rate (peak %.2f/s)", "max_retrans"))
            .when(F.col("max_retrans") > RETRANS_WARN, F.format_string("Warning: Elevated TCP retransmissions (peak %.2f/s)", "max_retrans")),
            F.when(F.col("max_if_util") > USE_CRIT, F.format_string("Critical: Network interface saturated (peak %.1f%%)", "max_if_util"))
            .when(F.col("max_if_util") > USE_WARN, F.format_string("Warning: High network interface use (peak %.1f%%)", "max_if_util")),
            F.when(F.col("in_errs") > 0, F.lit("TCP input errors: packets are dropped by the host")),
            F.when(F.col("interrupt_storm"), F.lit("Possible interrupt storm: busy kernel at a high packet rate")),
        )
    )
    return joined.withColumn("findings", findings)
