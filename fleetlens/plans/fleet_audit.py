"""From folders to findings: all tables of a fleet, and the audit over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.operators import consumers, storage as storage_ops
from fleetlens.operators.logs import detect_version
from fleetlens.plans.audit import audit
from fleetlens.session import cut_lineage
from fleetlens.sources import cluster, host, logs as log_files, metrics as metric_files, storage
from fleetlens.sources.fleet import Fleet, list_files


def data_directories(fleet: Fleet, broker_config: DataFrame, partitions: DataFrame) -> DataFrame:
    """(bundle_id, data_dir): where segments really lie, else what the configuration says."""
    active = partitions.filter("ns = 'kafka'").select("bundle_id", "topic", "partition_id", "revision")
    topics = storage_ops.storage_by_topic(storage.scan_data_dir(fleet), active)
    found = storage_ops.storage_summary(topics).select("bundle_id", F.col("data_dir").alias("_found"))
    both = cluster.data_directory(broker_config).join(found, "bundle_id", "full")
    return both.select("bundle_id", F.coalesce("_found", "data_dir").alias("data_dir"))


def load_tables(fleet: Fleet, logs_only: bool = False, materialize: bool = True) -> dict[str, DataFrame]:
    """Every table of the fleet by the name that rules and operators use. Reading is lazy
    but for logs, which are staged once with ``materialize``."""
    logs = log_files.scan_logs(fleet, logs_only, materialize)
    if logs_only:
        return {"logs": logs}
    # Facts and settings feed many rules; kept, they are read once and the plan stays short.
    keep = cut_lineage if materialize else (lambda df: df)
    facts = keep(host.scan_host_facts(fleet))
    config = keep(cluster.scan_yaml_config(fleet))
    partitions = cluster.scan_partitions(fleet)
    debug = cluster.scan_partition_debug(fleet)
    kafka = cluster.scan_kafka_dump(fleet, materialize)
    brokers = cluster.scan_brokers(fleet)
    k8s = cluster.scan_k8s(fleet)
    # Both search the log table, so they are worked out once.
    versions, commands = keep(detect_version(brokers, logs)), keep(host.command_lines(facts, logs))
    sar, sar_net = host.scan_sar(fleet)
    return {
        "logs": logs, "metrics": metric_files.scan_prometheus(fleet), "facts": facts, "uname": host.uname_facts(facts),
        "command_lines": commands, "core_counts": host.scan_core_counts(fleet), "oom": host.scan_oom(fleet),
        "raid": host.scan_raid(fleet), "filesystems": host.scan_filesystems(fleet), "sockets": host.scan_sockets(fleet),
        "processes": host.scan_processes(fleet), "irqs": host.scan_irqs(fleet), "softirqs": host.scan_irqs(fleet, "softirqs"),
        "sar": sar, "sar_net": sar_net, "core_dumps": list_files(fleet, "core.*"), "broker_config": config,
        "cluster_config": cluster.scan_cluster_config(fleet), "brokers": brokers, "versions": versions,
        "health": cluster.scan_health(fleet), "balancer": cluster.scan_balancer(fleet), "self_test": cluster.scan_self_test(fleet),
        "disks": storage_ops.match_hosts(cluster.scan_disk_stats(fleet), brokers), "leaders": cluster.scan_leaders(fleet),
        "partitions": partitions, "replicas": cluster.partition_replicas(partitions), "debug_replicas": cluster.debug_replicas(debug),
        "debug_followers": cluster.debug_followers(debug), "kafka_brokers": kafka["brokers"], "kafka_partitions": kafka["partitions"],
        "groups": kafka["groups"], "members": kafka["members"], "commits": kafka["commits"], "high_watermarks": kafka["high_watermarks"],
        "topic_sizes": consumers.topic_sizes(kafka["partitions"]), "topic_configs": kafka["topic_configs"], "k8s": k8s,
        "pods": cluster.k8s_kind(k8s, "pods"), "k8s_events": cluster.k8s_events(k8s), "cpu_profiles": cluster.scan_cpu_profiles(fleet),
        "du": storage.scan_du(fleet), "data_dirs": data_directories(fleet, config, partitions),
    }


def audit_fleet(fleet: Fleet, materialize: bool = True) -> DataFrame:
    """CheckResult rows of all checks over all bundles of the fleet."""
    return audit(load_tables(fleet, materialize=materialize), materialize=materialize)
