"""The rule audit: 34 groups of checks, all in one schema.

``audit(tables)`` takes the tables by name (see ``NEEDS`` of each group) and runs the
groups whose tables are there. Most groups reduce their input to one row per bundle and
emit all their findings from that row, so the audit costs one aggregation per input and
no join of rules with bundles.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import text
from fleetlens.operators import consumers, logs as log_ops, metrics as metric_ops, placement, storage
from fleetlens.operators.windows import top_per_key
from fleetlens.plans.performance import (
    MEASURES, MIB, Measure, measure_names, measure_totals, metric_digest, observation_severity, report_from_digest,
)
from fleetlens.session import cut_lineage

PASS, INFO, WARNING, CRITICAL = "Pass", "Info", "Warning", "Critical"
FIELDS = ["check", "category", "name", "description", "current_value", "expected_value", "status", "remediation"]
EMPTY = "bundle_id string, " + ", ".join(f"{f} string" for f in FIELDS)

GROUPS: list[tuple[tuple[str, ...], Callable]] = []


def group(*needs: str):
    """Registers a group with the tables it needs."""

    def add(fn):
        GROUPS.append((needs, fn))
        return fn

    return add


def _string(value) -> Column:
    return value.cast("string") if isinstance(value, Column) else F.lit(str(value))


def finding(check, category, name, description, current, expected, status, remediation="") -> Column:
    values = (check, category, name, description, current, expected, status, remediation)
    return F.struct(*[_string(v).alias(f) for f, v in zip(FIELDS, values)])


# Categories and names of the checks; {} stands for what a check is about.
TITLES = {
    "transparent_hugepages": ("OS Tuning", "Transparent Hugepages"),
    "virtualization_detected": ("Platform", "Virtualization Detected"),
    "oom_killer_invoked": ("System Stability", "OOM Killer Invoked"),
    "core_dumps_found": ("Crash Evidence", "Core Dumps Found"),
    "io_properties_missing": ("Disk Performance", "IO Properties Missing"),
    "default_io_properties": ("Disk Performance", "Default IO Properties"),
    "io_cost_function": ("Disk Performance", "IO Cost Function"),
    "public_advertised_addresses": ("Network Configuration", "Public Advertised Addresses"),
    "k8s_shard_tax_n_1": ("Kubernetes Performance", "K8s Shard Tax (N-1)"),
    "large_core_node_interference": ("Kubernetes Performance", "Large Core Node Interference"),
    "busy_spinning_mode": ("Kubernetes Performance", "Busy Spinning Mode"),
    "data_directory_on_root": ("Disk Configuration", "Data Directory on Root"),
    "time_wait_sockets": ("Network Evidence", "TIME_WAIT Sockets"),
    "socket_retransmissions": ("Network Stack", "Socket Retransmissions"),
    "under_replicated_partitions": ("Cluster Health", "Under Replicated Partitions"),
    "partition_balancer_stalled": ("Cluster Balance", "Partition Balancer Stalled"),
    "inconsistent_rack_configuration": ("Configuration", "Inconsistent Rack Configuration"),
    "controller_leader": ("Controller Health", "Controller Leader"),
    "reactor_stalls_in_logs": ("Reactor Health", "Reactor Stalls in Logs"),
    "rebalance_failure_hard_constraints": ("Cluster Balance", "Rebalance Failure (Hard Constraints)"),
    "partition_move_failed": ("Cluster Balance", "Partition Move Failed"),
    "high_connection_churn": ("Client Behavior", "High Connection Churn"),
    "log_storage_errors": ("Data Integrity", "Log Storage Errors"),
    "compaction_index_corruption": ("Storage", "Compaction Index Corruption"),
    "high_memory_reclaim_rate": ("Performance", "High Memory Reclaim Rate"),
    "node_status_rpc_timeouts": ("Consensus", "Node Status RPC Timeouts"),
    "rpc_memory_backpressure": ("Performance", "RPC Memory Backpressure"),
    "metadata_request_overload": ("Client Behavior", "Metadata Request Overload"),
    "aio_context_saturation": ("Disk Performance", "AIO Context Saturation"),
    "network_aio_concurrency": ("Network Performance", "Network AIO Concurrency"),
    "shard_0_overload": ("CPU Balance", "Shard 0 Overload"),
    "pending_partition_operations": ("Controller Health", "Pending Partition Operations"),
    "high_cpu_steal_time": ("Kubernetes Performance", "High CPU Steal Time"),
    "aws_gp3_iops_cliff": ("Disk Performance", "AWS GP3 IOPS Cliff"),
    "cpu_saturation": ("Performance Bottleneck", "CPU Saturation"),
    "disk_saturation": ("Performance Bottleneck", "Disk Saturation"),
    "workload_type": ("Workload Characterization", "Workload Type"),
    "observation": ("Performance Insights", "Observation"),
    "raid": ("Hardware Integrity", "RAID {} Status"),
    "filesystem": ("Disk Configuration", "{} Filesystem"),
    "disk_usage": ("Disk Usage", "{}"),
    "balancing_trigger": ("Cluster Balance", "Disk Balancing Trigger ({})"),
    "disk_test": ("Hardware Performance", "Disk Write Performance ({} Block) - Node {}"),
    "softirq": ("Kernel Performance", "SoftIRQ Imbalance ({})"),
    "queues": ("Hardware & IRQ", "MQ Imbalance ({})"),
    "empty_node": ("Cluster Balance", "Empty Node (ID {})"),
    "leader_imbalance": ("Cluster Balance", "Leader Imbalance (Node {})"),
    "consumer": ("Consumer Efficiency", "{}-provisioned Consumer ({})"),
    "pod_killed": ("Kubernetes Events", "Pod {} OOMKilled"),
    "pod_crash": ("Kubernetes Events", "Pod {} Crash"),
    "pod_qos": ("Kubernetes QoS", "Pod {} QoS"),
    "broker_flag": ("Broker Config", "{}"),
}


def titled(key: str, *about) -> tuple:
    """Category and name of a check."""
    category, name = TITLES[key]
    if not about:
        return category, name
    parts = name.split("{}")
    return category, F.concat(*[x for pair in zip(parts, [*about, F.lit("")], strict=True) for x in (F.lit(pair[0]), pair[1])])


def emit(df: DataFrame, *findings: Column) -> DataFrame:
    """A row per finding that is not NULL."""
    rows = df.select("bundle_id", F.explode(F.array_compact(F.array(*findings))).alias("r"))
    return rows.select("bundle_id", "r.*")


def whole(value: Column) -> Column:
    return F.format_string("%.0f", value.cast("double"))


def judged(check, category, name, description, current, expected, bad: Column, status, remediation) -> Column:
    """A finding when ``bad``, else a pass row (also when the test is NULL)."""
    return F.when(bad, finding(check, category, name, description, current, expected, status, remediation)).otherwise(
        finding(check, category, name, description, current, expected, PASS)
    )


def setting_map(rows: DataFrame, keys: list[str], by: tuple[str, ...] = ("bundle_id",)) -> DataFrame:
    """(bundle_id, kv) with the wanted keys only, so that a map stays small."""
    wanted = rows.filter(F.col("key").isin(keys)).groupBy(*by, "key").agg(F.min("value").alias("value"))
    return wanted.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("kv"))


def with_settings_map(bundles: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    empty = F.create_map().cast("map<string,string>")
    return bundles.join(setting_map(rows, keys), "bundle_id", "left").withColumn("kv", F.coalesce("kv", empty))


# --- operating system --------------------------------------------------------------------

# Key, minimum, status when below.
SYSCTL_MINIMA = [
    ("fs.aio-max-nr", 1048576, CRITICAL), ("fs.file-max", 500000, WARNING), ("net.core.somaxconn", 4096, WARNING),
    ("net.core.netdev_max_backlog", 2500, WARNING), ("net.ipv4.tcp_max_syn_backlog", 4096, WARNING), ("net.core.rmem_max", 2097152, INFO),
    ("net.core.wmem_max", 2097152, INFO), ("net.ipv4.tcp_timestamps", 1, INFO), ("net.ipv4.tcp_window_scaling", 1, CRITICAL),
    ("net.ipv4.tcp_sack", 1, WARNING),
]
SYSCTL_BUFFERS = [("net.ipv4.tcp_rmem", 16777216), ("net.ipv4.tcp_wmem", 16777216)]
PORT_RANGE, PORTS = "net.ipv4.ip_local_port_range", 28000
SLOW_START, TW_REUSE, SWAPPINESS = "net.ipv4.tcp_slow_start_after_idle", "net.ipv4.tcp_tw_reuse", "vm.swappiness"
GRANULARITY, GRANULARITY_LIMIT, MITIGATED = "kernel.sched_wakeup_granularity_ns", 10_000_000, "25.1.5"
SYSCTL_KEYS = [k for k, _, _ in SYSCTL_MINIMA] + [k for k, _ in SYSCTL_BUFFERS] + [PORT_RANGE, SLOW_START, TW_REUSE, SWAPPINESS, GRANULARITY]
OS = "OS Tuning"


@group("bundles", "facts")
def sysctl_checks(t) -> DataFrame:
    """C1 minima and C2 shapes, for every node where the facts tell nodes apart."""
    facts = t["facts"].filter("source = 'sysctl'")
    what = F.lit("kernel setting")
    if "node" in facts.columns:
        nodes = facts.select("bundle_id", "node").distinct()
        hosts = t["bundles"].select("bundle_id").join(nodes, "bundle_id", "left")
        kvs = setting_map(facts, SYSCTL_KEYS, ("bundle_id", "node"))
        df = hosts.join(kvs, ["bundle_id", "node"], "left").withColumn("kv", F.coalesce("kv", F.create_map().cast("map<string,string>")))
        what = F.when(F.coalesce("node", F.lit("")) == "", what).otherwise(F.concat(F.lit("kernel setting of "), "node"))
    else:
        df = with_settings_map(t["bundles"], facts, SYSCTL_KEYS)
    kv = F.col("kv")
    out = []
    for key, least, status in SYSCTL_MINIMA:
        value, number = kv[key], kv[key].try_cast("bigint")
        fix = f"raise {key}"
        out.append(
            F.when(value.isNull(), finding("C1", OS, key, what, "not set", f"{least} at least", WARNING, fix))
            .when(number.isNotNull(), judged("C1", OS, key, what, value, f"{least} at least", number < least, status, fix))
        )
    for key, least in SYSCTL_BUFFERS:
        fields = F.split(F.trim(kv[key]), r"\s+")
        third = F.coalesce(F.get(fields, 2).try_cast("bigint"), F.lit(0))
        out.append(F.when((F.size(fields) == 3) & (third < least), finding("C2", OS, key, "TCP buffer limits", kv[key], f"third value {least} at least", INFO, f"raise the third value of {key}")))
    ports = F.split(F.trim(kv[PORT_RANGE]), r"\s+")
    number_at = lambda i: F.coalesce(F.get(ports, i).try_cast("bigint"), F.lit(0))
    out.append(F.when((F.size(ports) == 2) & (number_at(1) - number_at(0) < PORTS), finding("C2", OS, PORT_RANGE, "ephemeral ports", kv[PORT_RANGE], f"over {PORTS} ports", WARNING, "widen the port range")))
    for key, good, status, expected in ((SLOW_START, lambda n: n == 0, WARNING, "0"), (TW_REUSE, lambda n: n == 1, INFO, "1"), (SWAPPINESS, lambda n: n <= 1, WARNING, "<= 1")):
        number = F.coalesce(kv[key].try_cast("bigint"), F.lit(0))
        out.append(F.when(kv[key].isNotNull(), judged("C2", OS, key, what, kv[key], expected, ~good(number), status, f"set {key} to {expected}")))
    return emit(df, *out)


@group("bundles", "facts", "uname", "versions")
def scheduler_checks(t) -> DataFrame:
    """A coarse scheduler granularity, milder on versions that work around it."""
    df = with_settings_map(t["bundles"], t["facts"].filter("source = 'sysctl'"), [GRANULARITY])
    df = df.join(t["uname"].select("bundle_id", "distro"), "bundle_id", "left").join(t["versions"], "bundle_id", "left")
    value = F.coalesce(F.col("kv")[GRANULARITY].try_cast("bigint"), F.lit(0))
    mitigated = F.coalesce((F.col("version") != "") & text.version_at_least(F.col("version"), MITIGATED), F.lit(False))
    note = F.when(F.col("distro") == "RHEL/CentOS 8", "scheduler granularity is too high (known profile of this distribution)").otherwise("scheduler granularity is too high")
    return emit(df, F.when(value >= GRANULARITY_LIMIT, finding(
        "C26", OS, GRANULARITY, note, F.concat(value.cast("string"), F.lit(" ns")), f"< {GRANULARITY_LIMIT} ns", F.when(mitigated, WARNING).otherwise(CRITICAL), "lower the granularity or share cores")))


@group("facts")
def host_fact_checks(t) -> DataFrame:
    """C15 huge pages and C10 virtual platform."""
    facts = t["facts"].filter(F.col("source").isin("thp", "dmi"))
    pick = lambda source, key: F.min(F.when((F.col("source") == source) & (F.col("key") == key), F.col("value")))
    df = facts.groupBy("bundle_id").agg(pick("thp", "enabled").alias("thp"), pick("dmi", "manufacturer").alias("maker"), pick("dmi", "product").alias("product"))
    off = F.contains("thp", F.lit("[never]"))
    both = F.lower(F.concat_ws(" ", "maker", "product"))
    return emit(
        df,
        F.when(F.col("thp") != "", judged("C15", *titled("transparent_hugepages"), "kernel feature that adds latency", text.selected_option(F.col("thp")), "never", ~off, WARNING, "disable transparent huge pages")),
        F.when(F.contains(both, F.lit("vmware")), finding("C10", *titled("virtualization_detected"), "runs on a virtual platform", F.coalesce("maker", F.lit("")), "no virtual platform", WARNING, "check disk latency and I/O wait")),
    )


@group("bundles", "oom")
def oom_checks(t) -> DataFrame:
    """Kernel out-of-memory kills."""
    counts = t["oom"].groupBy("bundle_id").agg(F.count("*").alias("n"))
    df = t["bundles"].join(counts, "bundle_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return emit(df, judged("C10", *titled("oom_killer_invoked"), "the kernel killed processes for memory", F.col("n"), "0", F.col("n") > 0, CRITICAL, "add memory or reduce load"))


@group("raid")
def raid_checks(t) -> DataFrame:
    """Degraded software RAID."""
    return emit(t["raid"], judged("C10", *titled("raid", "name"), "software RAID array", F.col("status"), "all members up", F.contains("status", F.lit("_")), CRITICAL, "replace the failed drive"))


@group("bundles", "core_dumps")
def core_dump_checks(t) -> DataFrame:
    """C8."""
    counts = t["core_dumps"].groupBy("bundle_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("file_name")), ", ").alias("names"))
    df = t["bundles"].join(counts, "bundle_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    shown = F.when(F.col("n") > 0, F.concat(F.col("n").cast("string"), F.lit(" dumps: "), "names")).otherwise("0")
    return emit(df, judged("C8", *titled("core_dumps_found"), "core dump files", shown, "0", F.col("n") > 0, CRITICAL, "inspect the dumps"))


# --- configuration -----------------------------------------------------------------------

# Key, bad value, status; then the I/O properties.
CONFIG_FLAGS = [
    ("redpanda.developer_mode", "developer_mode", "true", WARNING), ("rpk.overprovisioned", "rpk.overprovisioned", "true", INFO),
    ("auto_create_topics_enabled", "auto_create_topics_enabled", "true", WARNING),
]
AIO_EVENTS = "rpk.tune_aio_events"
IO_KEYS = ["redpanda.developer_mode", "redpanda.read_iops", "redpanda.write_iops", "redpanda.read_bandwidth", "redpanda.write_bandwidth"]
READ_IOPS, DEFAULT_IOPS, COST = "redpanda.read_iops", ["10000", "1000"], "redpanda.max_cost_function"
CONFIG_KEYS = sorted({k for k, _, _, _ in CONFIG_FLAGS} | set(IO_KEYS) | {AIO_EVENTS, COST})
ADVERTISED = ["advertised_kafka_api", "advertised_rpc_api", "advertised_pandaproxy_api"]
# The key itself, or the address of one of its entries, below whatever section.
ADVERTISED_PATH = rf"(^|\.)({'|'.join(ADVERTISED)})(\.\d+)?(\.address)?$"


@group("bundles", "broker_config")
def config_checks(t) -> DataFrame:
    """C3 flags and C27 I/O properties. Flags of the whole cluster are in its own configuration."""
    settings = t["broker_config"].select("bundle_id", "key", "value")
    if "cluster_config" in t:
        settings = settings.unionByName(t["cluster_config"].select("bundle_id", "key", "value"))
    df = with_settings_map(t["bundles"], settings, CONFIG_KEYS)
    kv = F.col("kv")
    low = lambda key: F.lower(F.coalesce(kv[key], F.lit("")))
    out = [
        judged("C3", *titled("broker_flag", F.lit(name)), "broker flag", F.when(low(key) == bad, "true").otherwise("false"), "false", low(key) == bad, status, f"turn {name} off in production")
        for key, name, bad, status in CONFIG_FLAGS
    ]
    out.append(F.when(low(AIO_EVENTS).isin("true", "false"), judged("C3", *titled("broker_flag", F.lit(AIO_EVENTS)), "tuner of AIO events", low(AIO_EVENTS), "true", low(AIO_EVENTS) == "false", WARNING, "run the tuner")))
    missing = reduce(lambda a, b: a & b, [kv[k].isNull() for k in IO_KEYS])
    out.append(
        F.when(missing, finding("C27", *titled("io_properties_missing"), "disk limits are not configured", "no limit is set", "measured limits", WARNING, "measure the disks"))
        .when(kv[READ_IOPS].isin(DEFAULT_IOPS), finding("C27", *titled("default_io_properties"), "disk limits look like defaults", "values of the defaults", "measured limits", INFO, "measure the disks on this hardware"))
    )
    out.append(F.when(low(COST) == "false", finding("C27", *titled("io_cost_function"), "standard cost function in use", "switched off", "switched on", WARNING, "turn it on")))
    return emit(df, *out)


@group("bundles", "broker_config", "kafka_brokers", "uname")
def public_address_checks(t) -> DataFrame:
    """Advertised and reported addresses outside the private ranges."""
    listed = t["broker_config"].filter(F.col("key").rlike(ADVERTISED_PATH)).select("bundle_id", F.explode(F.split("value", ",")).alias("a"))
    told = listed.select("bundle_id", F.regexp_replace(F.trim("a"), r":[^:]*\z", "").alias("host"))
    hosts = told.unionByName(t["kafka_brokers"].select("bundle_id", "host"))
    public = hosts.filter(text.is_public_address(F.col("host"))).groupBy("bundle_id").agg(
        F.array_join(F.array_sort(F.collect_set("host")), ", ").alias("hosts"))
    df = t["bundles"].join(public, "bundle_id", "left").join(t["uname"].select("bundle_id", "cloud"), "bundle_id", "left")
    cost = F.when(F.col("cloud") == "AWS", "use private addresses: public ones halve the bandwidth").when(
        F.col("cloud") == "GCP", "use private addresses: public egress is limited to 7 Gbps").otherwise("use private addresses: public ones cost bandwidth and latency")
    return emit(df, judged("C19", *titled("public_advertised_addresses"), "addresses that the cluster advertises", F.coalesce("hosts", F.lit("no public one")), "private addresses", F.col("hosts").isNotNull(), WARNING, cost))


@group("command_lines", "uname", "core_counts", "broker_config")
def container_checks(t) -> DataFrame:
    """Shards against cores in containers."""
    df = t["uname"].filter("is_container").select("bundle_id").join(t["core_counts"].filter("cores > 0"), "bundle_id")
    df = df.join(t["command_lines"], "bundle_id", "left").join(setting_map(t["broker_config"], ["redpanda.smp"]), "bundle_id", "left")
    line = F.lower(F.coalesce("cmdline", F.lit("")))
    flag = F.regexp_extract(line, r"--smp[= ]+(\d+)", 1).try_cast("bigint")
    configured = F.col("kv")["redpanda.smp"].try_cast("bigint")
    df = df.withColumns({"shards": F.coalesce(F.nullif(configured, F.lit(0).cast("bigint")), flag, F.lit(0)), "shared": F.contains(line, F.lit("--overprovisioned"))}).filter("shards > 0 and not shared")
    shards, cores = F.col("shards"), F.col("cores")
    shown = F.format_string("%d shards, %d cores", shards, cores)
    return emit(
        df,
        F.when((shards >= cores) & (cores > 1), finding("C25", *titled("k8s_shard_tax_n_1"), "all host cores are shards", shown, F.format_string("at most %d shards", cores - 1), WARNING, "leave one core to the system")),
        F.when((cores >= 32) & (shards < F.floor(cores / 2)), finding("C25", *titled("large_core_node_interference"), "few shards on a large host", shown, "shared cores", WARNING, "share cores on large hosts")),
        finding("C25", *titled("busy_spinning_mode"), "shards busy-spin on a host that may be shared", "shards spin", "shards sleep when idle", INFO, "share cores if throughput is low"),
    )


# --- disks -------------------------------------------------------------------------------

# Fixed values.
DEFAULT_DATA_DIR = "/var/lib/redpanda/data"
BROKER_MOUNT = "redpanda"
NOISY_MOUNTS = ["/etc/", "/dev/", "/proc/", "/sys/", "/run/secrets/", "/var/lib/kubelet/"]


@group("bundles", "filesystems", "data_dirs")
def disk_checks(t) -> DataFrame:
    """C4 file system and usage, C18 data directory on root, C12 usage that starts balancing."""
    dirs = t["bundles"].join(t["data_dirs"], "bundle_id", "left").select("bundle_id", F.coalesce("data_dir", F.lit(DEFAULT_DATA_DIR)).alias("data_dir"))
    mounts = t["filesystems"].select("bundle_id", "mount_point").distinct()
    best = storage.longest_prefix(dirs, mounts, "data_dir", "mount_point", ["bundle_id"])
    fs = t["filesystems"].join(best.select("bundle_id", F.col("mount_point").alias("data_mount")), "bundle_id", "left")
    mount, device = F.col("mount_point"), F.col("filesystem")
    ours = F.coalesce(mount == F.col("data_mount"), F.lit(False)) | F.contains(mount, F.lit(BROKER_MOUNT))
    noisy = reduce(lambda a, b: a | b, [mount.startswith(p) for p in NOISY_MOUNTS])
    physical = device.startswith("/dev/")
    used = F.coalesce(F.regexp_replace("use_percent", "%$", "").try_cast("int"), F.lit(0))
    rows = emit(
        fs,
        F.when(ours, judged("C4", *titled("filesystem", mount), "file system of the data directory", F.col("type"), "xfs", F.col("type") != "xfs", WARNING, "use xfs")),
        F.when((ours | (physical & ~noisy)) & (used > 85), finding("C4", *titled("disk_usage", mount), "disk space", F.col("use_percent"), "< 85%", F.when(used > 95, CRITICAL).otherwise(WARNING), "free or add space")),
        F.when((physical | F.contains(mount, F.lit(BROKER_MOUNT))) & (used >= 80), finding("C12", *titled("balancing_trigger", mount), "usage that starts balancing", F.col("use_percent"), "< 80%", INFO, "expect moves away from this node")),
    )
    root = emit(best, F.when(F.col("mount_point") == "/", finding("C18", *titled("data_directory_on_root"), "data lies on the root partition", F.concat("data_dir", F.lit(" lies on /")), "a partition of its own", WARNING, "use a partition of its own")))
    return rows.unionByName(root)


@group("self_test")
def self_test_checks(t) -> DataFrame:
    """Measured disk throughput against the minima."""
    df = t["self_test"].filter(F.col("type") == "disk").withColumn("rate", F.col("throughput") / MIB)
    shown = F.format_string("%.2f MB/s", "rate")

    def row(block: str, name: Column, info: Column, least: float) -> Column:
        return F.when(name & info, judged("C31", *titled("disk_test", F.lit(block), F.col("node_id").cast("string")), "self-test write throughput", shown, f">= {least:.2f} MB/s", F.col("rate") < least, CRITICAL, "use faster storage"))

    has = lambda column, words: F.contains(F.col(column), F.lit(words))
    return emit(df, row("Small", has("name", "4KB sequential write"), has("info", "dsync: true"), 4.0), row("Medium", has("name", "16KB sequential"), has("info", "dsync: false"), 30.0))


# --- sockets and interrupts ----------------------------------------------------------------

@group("bundles", "sockets")
def socket_checks(t) -> DataFrame:
    """C6 waiting sockets and C33 retransmitting sockets, from one aggregation."""
    high = F.col("retrans_total") > 50
    worst = F.max(F.when(high, F.struct("retrans_total", F.concat_ws(" -> ", "local_addr", "peer_addr").alias("pair"))))
    sums = t["sockets"].groupBy("bundle_id").agg(
        F.count("*").alias("sockets"), F.count_if(F.col("state").isin("TIME-WAIT", "TIME_WAIT")).alias("waiting"), F.count_if(high).alias("high"), worst.alias("worst"))
    df = t["bundles"].join(sums, "bundle_id", "left").withColumn("waiting", F.coalesce("waiting", F.lit(0)))
    bad = F.format_string("%d sockets, up to %d times on %s", "high", "worst.retrans_total", "worst.pair")
    return emit(
        df,
        judged("C6", *titled("time_wait_sockets"), "sockets waiting to close", F.col("waiting"), "< 10000", F.col("waiting") > 10000, WARNING, "allow reuse of waiting sockets"),
        F.when(F.col("sockets") > 0, judged("C33", *titled("socket_retransmissions"), "sockets with many retransmissions", F.when(F.col("high") > 0, bad).otherwise("no such socket"), "few", F.col("high") > 0, WARNING, "look for packet loss on these paths")),
    )


# Fixed values.
SOFT_IRQS, SOFT_IRQ_FLOOR = ["NET_RX", "BLOCK"], 1_000_000
IRQ_WORDS, IRQ_FLOOR = ["nvme", "eth", "ens", "eno", "scsi", "virtio", "mlx"], 10_000


def active_cpus(counts: Column, mode: str = "intended") -> Column:
    """CPUs with over a tenth of the mean count. ``running`` compares each CPU with the sum
    so far, in integer steps, as the compatible variant."""
    n = F.size(counts)
    zero = F.lit(0).cast("bigint")
    if mode == "running":
        start = F.struct(zero.alias("total"), zero.alias("active"))

        def step(acc, c):
            total = acc["total"] + c
            limit = F.floor(F.floor(total / n) / 10)
            return F.struct(total.alias("total"), (acc["active"] + (c > limit).cast("bigint")).alias("active"))

        return F.aggregate(counts, start, step)["active"]
    total = F.aggregate(counts, zero, lambda a, c: a + c)
    return F.size(F.filter(counts, lambda c: c > total / n / 10)).cast("bigint")


def softirq_spread(softirqs: DataFrame, mode: str = "intended") -> DataFrame:
    """(.., irq_id, total, active, cpus, active_pct) of the two loads that matter."""
    rows = softirqs.filter(F.col("irq_id").isin(SOFT_IRQS) & (F.size("counts") > 0))
    total = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, c: a + c)
    out = rows.withColumns({"total": total, "active": active_cpus(F.col("counts"), mode), "cpus": F.size("counts")})
    return out.withColumn("active_pct", F.col("active") / F.col("cpus") * 100)


@group("softirqs")
def softirq_checks(t) -> DataFrame:
    """C29."""
    df = softirq_spread(t["softirqs"]).filter(F.col("total") >= SOFT_IRQ_FLOOR)
    shown = F.format_string("on %.1f%% of CPUs", "active_pct")
    return emit(df, judged("C29", *titled("softirq", "irq_id"), "spread of soft interrupts", shown, "over 25% of CPUs", (F.col("active_pct") < 10) & (F.col("cpus") > 16), WARNING, "spread receive queues over cores"))


def irq_devices(irqs: DataFrame) -> DataFrame:
    """(bundle_id, device, queues, total, active_cpus, busiest_cpu) of network and disk devices."""
    words = F.lower(F.concat_ws(" ", "device", "controller"))
    relevant = irqs.filter(reduce(lambda a, b: a | b, [F.contains(words, F.lit(w)) for w in IRQ_WORDS]))
    base = text.irq_base_device(F.col("device"))
    queues = relevant.groupBy("bundle_id", base.alias("device")).agg(F.count("*").alias("queues"))
    per_cpu = relevant.select("bundle_id", base.alias("device"), F.posexplode("counts").alias("cpu", "n"))
    per_cpu = per_cpu.groupBy("bundle_id", "device", "cpu").agg(F.sum("n").alias("n"))
    sums = per_cpu.groupBy("bundle_id", "device").agg(
        F.sum("n").alias("total"), F.count_if(F.col("n") > 0).alias("active_cpus"), F.max_by("cpu", F.struct("n", -F.col("cpu"))).alias("busiest_cpu"))
    return queues.join(sums, ["bundle_id", "device"])


@group("irqs")
def irq_checks(t) -> DataFrame:
    """C17: all queues of a device on one CPU."""
    df = irq_devices(t["irqs"])
    bad = (F.col("total") >= IRQ_FLOOR) & (F.col("queues") > 1) & (F.col("active_cpus") == 1)
    return emit(df, F.when(bad, finding("C17", *titled("queues", "device"), F.format_string("%d queues on CPU%d", "queues", "busiest_cpu"), "one CPU takes all", "several CPUs", WARNING, "spread the queues")))


# --- cluster -----------------------------------------------------------------------------

@group("health")
def health_checks(t) -> DataFrame:
    """C5."""
    n = F.coalesce("under_replicated_count", F.lit(0))
    return emit(t["health"], judged("C5", *titled("under_replicated_partitions"), "partitions not fully replicated", n, "0", n > 0, CRITICAL, "look for offline nodes or a split network"))


@group("balancer")
def balancer_checks(t) -> DataFrame:
    """Stalled balancer."""
    return emit(t["balancer"], F.when(F.col("status") == "stalled", finding("C12", *titled("partition_balancer_stalled"), "required moves cannot be planned", "stalled", "ready or at work", CRITICAL, "check disk space, partition counts and quorum")))


@group("health", "replicas")
def empty_node_checks(t) -> DataFrame:
    """Nodes without partitions."""
    known = t["health"].select("bundle_id", F.explode("all_nodes").alias("node_id"))
    empty = known.join(t["replicas"].select("bundle_id", "node_id").distinct(), ["bundle_id", "node_id"], "left_anti")
    return emit(empty, finding("C12", *titled("empty_node", F.col("node_id").cast("string")), "node holds nothing", "holds none", "some partitions", WARNING, "rebalance the cluster"))


@group("kafka_brokers")
def rack_checks(t) -> DataFrame:
    """Racks set on some brokers only."""
    df = t["kafka_brokers"].groupBy("bundle_id").agg(F.count("*").alias("n"), F.count_if(F.coalesce("rack", F.lit("")) != "").alias("racked"))
    return emit(df, F.when((F.col("racked") > 0) & (F.col("racked") < F.col("n")), finding("C12", *titled("inconsistent_rack_configuration"), "only some brokers name a rack", F.format_string("racks on %d of %d brokers", "racked", "n"), "racks on all brokers or on none", WARNING, "set racks on all brokers")))


# Fixed value: where the controller lives.
CONTROLLER_NS, CONTROLLER_TOPIC = "redpanda", "controller"


@group("bundles", "leaders")
def controller_checks(t) -> DataFrame:
    """The controller has a leader."""
    mine = (F.col("ns") == CONTROLLER_NS) & (F.col("topic") == CONTROLLER_TOPIC) & (F.col("partition_id") == 0)
    led = t["leaders"].filter(mine).groupBy("bundle_id").agg(F.max("leader").alias("leader"), F.max("last_stable_leader_term").alias("term"))
    df = t["bundles"].join(led, "bundle_id", "left")
    none = F.coalesce(F.col("leader") == -1, F.lit(True))
    shown = F.when(none, "no leader").otherwise(F.format_string("node %d in term %d", "leader", F.coalesce("term", F.lit(0))))
    return emit(df, judged("C13", *titled("controller_leader"), "leadership of the controller", shown, "some node", none, CRITICAL, "management operations will fail: read the logs"))


@group("leaders", "health")
def leader_balance_checks(t) -> DataFrame:
    """Nodes that lead far more than the average."""
    nodes = t["health"].select("bundle_id", F.explode("all_nodes").alias("node_id"))
    df = placement.leader_imbalance(t["leaders"], nodes)
    return emit(df, finding("C13", *titled("leader_imbalance", F.col("node_id").cast("string")), "node leads too many partitions", F.format_string("leads %d, mean %.0f", "leaders", "avg_leaders"), "near the mean", WARNING, "check the leader balancer"))


@group("members", "topic_sizes")
def consumer_checks(t) -> DataFrame:
    """C20: more or fewer members than partitions."""
    df = consumers.group_parallelism(t["members"], t["topic_sizes"])
    under = F.col("finding") == "under"
    return emit(df, finding("C20", *titled("consumer", F.when(under, "Under").otherwise("Over"), "group_id"), F.format_string("%d members for %d partitions of %s", "members", "partitions", "topic"), F.format_string("%d members", "members"), F.format_string("%d members", "partitions"), INFO, F.when(under, "add consumers").otherwise("remove consumers or add partitions")))


@group("pods")
def pod_checks(t) -> DataFrame:
    """C9 crashed containers and C16 requests that differ from limits."""
    pods = t["pods"]
    pod = F.col("metadata.name").alias("pod")
    ended = pods.select("bundle_id", pod, F.explode("status.containerStatuses").alias("c")).select("bundle_id", "pod", F.col("c.lastState")["terminated"].alias("e"))
    code = F.concat(F.lit("ended with code "), F.coalesce("e.exitCode", F.lit(0)).cast("string"))
    crashes = emit(
        ended.filter("e is not null"),
        F.when(F.col("e.reason") == "OOMKilled", finding("C9", *titled("pod_killed", "pod"), "container ran out of memory", code, "a running container", CRITICAL, "raise the memory limit"))
        .when(F.col("e.reason") == "Error", finding("C9", *titled("pod_crash", "pod"), "container ended with an error", code, "a running container", CRITICAL, "read the logs around the end")),
    )
    box = pods.select("bundle_id", pod, F.explode("spec.containers").alias("c"))
    value = lambda kind, key: F.coalesce(F.col(f"c.resources.{kind}")[key], F.lit(""))
    differ = (value("requests", "cpu") != value("limits", "cpu")) | (value("requests", "memory") != value("limits", "memory"))
    shown = F.format_string("cpu %s of %s, memory %s of %s", value("requests", "cpu"), value("limits", "cpu"), value("requests", "memory"), value("limits", "memory"))
    return crashes.unionByName(emit(box, F.when(differ, finding("C16", *titled("pod_qos", "pod"), "requests and limits differ", shown, "equal requests and limits", WARNING, "set requests equal to limits"))))


# --- logs --------------------------------------------------------------------------------

# Search texts.
STALL_TEXT, NO_NODE_TEXT, MOVE_TEXT = "Reactor stalled", "no nodes are available to perform allocation", "attempt to move replica"
CHURN_TEXT = "Accepted new connection"


NEWEST, CHURN_HITS, CHURN_SECONDS = 100, 50, 10


@group("logs")
def log_checks(t) -> DataFrame:
    """C11, C14 and C22 from one scan: the newest hits of every search text per bundle, of moves those that
    failed, however many others follow. The limit per key is applied before the shuffle, so a chatty bundle costs no more."""
    message, f = F.col("message"), F.col
    tests = {"stalls": STALL_TEXT, "no_node": NO_NODE_TEXT, "moves": MOVE_TEXT, "churn": CHURN_TEXT}
    failed = F.contains(message, F.lit("failed"))
    found = lambda name, query: log_ops.search_predicate(query, message) & (failed if name == "moves" else F.lit(True))
    hits = [F.when(found(name, query), F.lit(name)) for name, query in tests.items()]
    rows = t["logs"].select("bundle_id", "ts", "id", F.explode(F.array_compact(F.array(*hits))).alias("text"))
    newest = top_per_key(rows, ["bundle_id", "text"], [f("ts").desc(), f("id").desc()], NEWEST, salt_by="id")
    churn = F.when(f("text") == "churn", f("ts"))
    df = newest.groupBy("bundle_id").agg(
        F.bool_or(f("text") == "stalls").alias("stalls"), F.bool_or(f("text") == "no_node").alias("no_node"),
        F.bool_or(f("text") == "moves").alias("failed"),
        F.count(churn).alias("hits"), ((F.unix_micros(F.max(churn)) - F.unix_micros(F.min(churn))) / 1e6).alias("seconds"))
    burst = (f("hits") >= CHURN_HITS) & (f("seconds") > 0) & (f("seconds") < CHURN_SECONDS)
    return emit(
        df,
        F.when(f("stalls"), finding("C11", *titled("reactor_stalls_in_logs"), "the reactor was blocked", "seen", "none in the log", WARNING, "look for long tasks or contention")),
        F.when(f("no_node"), finding("C14", *titled("rebalance_failure_hard_constraints"), "no node may take a partition", "allocation fails", "none in the log", CRITICAL, "check disk use and racks, or add nodes"))
        .when(f("failed"), finding("C14", *titled("partition_move_failed"), "replica moves fail", "a move failed", "none in the log", WARNING, "read the log lines for the reason")),
        F.when(burst, finding("C22", *titled("high_connection_churn"), "clients connect too often", F.format_string("%.1f a second", f("hits") / f("seconds")), "under 1 a second", WARNING, "reuse client instances")),
    )


# --- metrics -----------------------------------------------------------------------------

# Metric names.
STATUS_TIMEOUTS, BLOCKED_MEMORY = "redpanda_node_status_rpcs_timed_out_total", "redpanda_rpc_client_requests_blocked_memory_total"
PENDING_OPS = "vectorized_cluster_controller_pending_partition_operations"
QUEUE_LENGTH, STEAL_MS = "vectorized_io_queue_queue_length", "vectorized_reactor_cpu_steal_time_ms"
AUDIT_MEASURES: dict[str, Measure] = {
    "parse_errors": Measure("sum", ("vectorized_storage_log_batch_parse_errors",)),
    "write_errors": Measure("sum", ("vectorized_storage_log_batch_write_errors",)),
    "corrupt": Measure("sum", ("vectorized_storage_log_corrupted_compaction_indices",)),
    "reclaims": Measure("sum", ("vectorized_memory_reclaims_operations", "redpanda_memory_reclaims_operations")),
    "timeouts": Measure("sum", (STATUS_TIMEOUTS,)),
    "blocked": Measure("sum", (BLOCKED_MEMORY,)),
    "metadata": Measure("sum", (metric_ops.LATENCY_COUNT,), "request", ("metadata",)),
    "produce": Measure("sum", (metric_ops.LATENCY_COUNT,), "request", ("produce",)),
}


def integrity_findings(totals: DataFrame) -> DataFrame:
    """C34 and C23 on one row of sums per bundle."""
    c = F.col
    share = c("metadata") / c("produce")
    return emit(
        totals,
        F.when((c("parse_errors") > 0) | (c("write_errors") > 0), finding("C34", *titled("log_storage_errors"), "batches failed to parse or write", F.format_string("%.0f not parsed, %.0f not written", "parse_errors", "write_errors"), "0", CRITICAL, "look for disk or file system failure")),
        F.when(c("corrupt") > 0, finding("C34", *titled("compaction_index_corruption"), "compaction indices are corrupt", F.format_string("%.0f indices", "corrupt"), "0", WARNING, "find the segments whose index is rebuilt")),
        F.when(c("reclaims") > 10_000, finding("C34", *titled("high_memory_reclaim_rate"), "the batch cache is evicted often", F.format_string("reclaimed %.0f times", "reclaims"), "10000 times at most", WARNING, "add memory or run fewer shards")),
        F.when(c("timeouts") > 0, finding("C34", *titled("node_status_rpc_timeouts"), "liveness checks timed out", F.format_string("%.0f calls", "timeouts"), "0", WARNING, "lengthen the status interval")),
        F.when(c("blocked") > 0, finding("C34", *titled("rpc_memory_backpressure"), "calls waited for memory", F.format_string("%.0f calls waited", "blocked"), "0", WARNING, "check memory limits of the service")),
        F.when((c("produce") > 1000) & (share > 0.1), finding("C23", *titled("metadata_request_overload"), "too many metadata requests", F.format_string("%.1f%% of the produce requests", share * 100), "under 1%", WARNING, "look for client timeouts")),
    )


@group("digest")
def integrity_checks(t) -> DataFrame:
    return integrity_findings(measure_totals(t["digest"], AUDIT_MEASURES))


def shard_of_node() -> Column:
    """The shard as findings name it; with its node, if samples tell nodes apart."""
    shard = F.coalesce("shard", F.lit(""))
    return F.when(F.col("node") == "", shard).otherwise(F.concat(shard, F.lit(" of "), F.col("node")))


def worst_shard(digest: DataFrame, name: str) -> DataFrame:
    """(bundle_id, worst, shard): the largest value and the shard that shows it."""
    rows = digest.filter(F.col("name") == name)
    at = F.struct(F.col("high").alias("worst"), shard_of_node().alias("shard"))
    return rows.groupBy("bundle_id").agg(F.max(at).alias("w")).select("bundle_id", "w.*")


def series_rates(digest: DataFrame, name: str) -> DataFrame:
    """(bundle_id, node, shard, rate) of each series of one counter between its ends."""
    seconds = (F.unix_micros("last.ts") - F.unix_micros("first.ts")) / 1e6
    rows = digest.filter(F.col("name") == name).withColumn("seconds", seconds).filter("seconds > 0")
    return rows.select("bundle_id", "node", "shard", ((F.col("last.value") - F.col("first.value")) / F.col("seconds")).alias("rate"))


@group("digest")
def queue_checks(t) -> DataFrame:
    """The kernel's queue of asynchronous I/O is full."""
    df = worst_shard(t["digest"], QUEUE_LENGTH)
    shown = F.format_string("queue of %.0f on shard %s", "worst", "shard")
    return emit(df, F.when(F.col("worst") >= 1000, finding("C28", *titled("aio_context_saturation"), "I/O requests reach the context limit", shown, "< 1024", F.when(F.col("worst") >= 1024, CRITICAL).otherwise(WARNING), "look for an I/O bottleneck or tiny requests")))


@group("digest", "command_lines", "broker_config")
def connection_limit_checks(t) -> DataFrame:
    """Connections per shard against the control-block limit."""
    flag = r"--max-networking-io-control-blocks=(\d+)"
    asked = t["command_lines"].select("bundle_id", F.lit(0).alias("rank"), F.col("cmdline").alias("v")).unionByName(
        t["broker_config"].select("bundle_id", F.lit(1).alias("rank"), F.col("value").alias("v")))
    value = F.regexp_extract("v", flag, 1).try_cast("double")
    limits = asked.withColumn("n", value).filter("n > 0").groupBy("bundle_id").agg(F.min_by("n", F.struct("rank", "v")).alias("conn_limit"))
    df = worst_shard(t["digest"], metric_ops.CONNECTIONS).join(limits, "bundle_id", "left").withColumn("conn_limit", F.coalesce("conn_limit", F.lit(10_000.0))).filter("worst > 0")
    use = F.col("worst") / F.col("conn_limit") * 100
    shown = F.when(use > 80, F.format_string("%.0f of %.0f on shard %s", "worst", "conn_limit", "shard")).otherwise(F.format_string("%.1f%% in use", use))
    return emit(df, judged("C32", *titled("network_aio_concurrency"), "connections against the control-block limit", shown, "under 80% in use", use > 80, F.when(use > 95, CRITICAL).otherwise(WARNING), "raise the limit of control blocks"))


@group("digest")
def shard0_checks(t) -> DataFrame:
    """Shard 0 far above the mean of the others."""
    rows = t["digest"].filter(F.col("name") == metric_ops.UTILIZATION)
    zero = F.coalesce(F.col("shard") == "0", F.lit(False))
    other = lambda column: F.sum(F.when(~zero, F.col(column)))
    df = rows.groupBy("bundle_id", "node").agg(F.max(F.when(zero, F.col("last"))).alias("z"), (other("total") / other("n")).alias("others"))
    df = df.select("bundle_id", F.col("z.value").alias("zero"), "others")
    bad = (F.col("zero") > F.col("others") + 30) & (F.col("zero") > 50)
    return emit(df, F.when(bad, finding("C21", *titled("shard_0_overload"), "shard 0 is much busier than the rest", F.format_string("%.1f%%, the others %.1f%%", "zero", "others"), "within 30 points of the others", WARNING, "management work may be delayed")))


@group("digest")
def pending_checks(t) -> DataFrame:
    """Backlog of partition operations, by the newest sample."""
    rows = t["digest"].filter(F.col("name") == PENDING_OPS)
    df = rows.groupBy("bundle_id").agg(F.max("last").alias("last")).select("bundle_id", F.col("last.value").alias("n"))
    return emit(df, F.when(F.col("n") > 10, finding("C13", *titled("pending_partition_operations"), "partition operations pile up", whole(F.col("n")), "0", WARNING, "the controller is busy or stuck")))


@group("digest", "processes")
def steal_checks(t) -> DataFrame:
    """CPU time taken by the hypervisor, with the busy processes beside the broker."""
    rates = series_rates(t["digest"], STEAL_MS)
    worst = rates.groupBy("bundle_id").agg(F.max(F.struct("rate", shard_of_node().alias("shard"))).alias("w")).select("bundle_id", "w.*")
    worst = worst.withColumn("rate", F.when(F.col("rate") > 1000, F.col("rate") / 1000).otherwise(F.col("rate")))
    command = F.lower("command")
    own = F.contains(command, F.lit("redpanda")) | F.contains(command, F.lit("rp_")) | F.contains(command, F.lit("reactor"))
    kernel = command.startswith("[") & command.endswith("]")
    busy = t["processes"].filter((F.col("cpu") > 5) & ~own & ~kernel).groupBy("bundle_id", "command").agg(F.count("*").alias("n"), F.sum("cpu").alias("cpu"))
    line = F.when(F.col("n") > 1, F.format_string("%s x%d (avg %.1f%% CPU)", "command", "n", F.col("cpu") / F.col("n"))).otherwise(F.format_string("%s (%.1f%% CPU)", "command", "cpu"))
    listed = busy.groupBy("bundle_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("cpu")).alias("o"), line.alias("t")))), lambda x: x["t"]), "; ").alias("neighbours"))
    df = worst.join(listed, "bundle_id", "left")
    advice = F.concat(F.lit("give the broker cores of its own"), F.when(F.col("neighbours").isNotNull(), F.concat(F.lit("; busy: "), "neighbours")).otherwise(""))
    return emit(df, F.when(F.col("rate") > 10, finding("C24", *titled("high_cpu_steal_time"), "CPU time is taken from the shards", F.format_string("%.1f ms a second on shard %s", "rate", "shard"), "under 10 ms a second", F.when(F.col("rate") > 100, CRITICAL).otherwise(WARNING), advice)))


@group("digest", "uname", "broker_config")
def volume_checks(t) -> DataFrame:
    """Write operations near the provisioned rate of a cloud volume."""
    total = series_rates(t["digest"], metric_ops.WRITE_OPS).groupBy("bundle_id").agg(F.sum("rate").alias("rate"))
    limit = setting_map(t["broker_config"], ["redpanda.write_iops"]).select("bundle_id", F.col("kv")["redpanda.write_iops"].try_cast("double").alias("iops"))
    df = total.join(limit.filter("iops > 0"), "bundle_id").join(t["uname"].filter("cloud = 'AWS'").select("bundle_id"), "bundle_id")
    use = F.col("rate") / F.col("iops") * 100
    return emit(df, F.when(use > 70, finding("C30", *titled("aws_gp3_iops_cliff"), "the volume slows down near its limit", F.format_string("%.1f%% of the provisioned rate", use), "< 70%", WARNING, "provision more operations")))


@group("digest", "sar", "sar_net", "self_test")
def bottleneck_checks(t) -> DataFrame:
    """The performance report as findings."""
    df = report_from_digest(t["digest"], t["sar"], t["sar_net"], t["self_test"])
    state = lambda c: F.when(F.col(c), "bound").otherwise("not bound")
    fixed = emit(
        df,
        judged("C7", *titled("cpu_saturation"), "bound by CPU", state("is_cpu_bound"), "not bound", F.col("is_cpu_bound"), CRITICAL, "add CPU or lighten the load"),
        judged("C7", *titled("disk_saturation"), "bound by disk", state("is_disk_bound"), "not bound", F.col("is_disk_bound"), WARNING, "check the disks"),
        finding("C7", *titled("workload_type"), "dominant request type", F.col("workload"), "-", INFO, F.array_join("recommendations", " ")),
    )
    each = df.select("bundle_id", F.explode("observations").alias("text"))
    return fixed.unionByName(emit(each, finding("C7", *titled("observation"), "derived from metrics", F.col("text"), "-", observation_severity(F.col("text")))))


def bundle_list(tables: dict[str, DataFrame]) -> DataFrame:
    """Distinct bundles of the small tables that are at hand."""
    small = [t for name, t in tables.items() if name in ("facts", "health", "uname", "balancer", "broker_config", "kafka_brokers", "leaders", "filesystems")]
    parts = [t.select("bundle_id").distinct() for t in small or tables.values()]
    return reduce(DataFrame.unionByName, parts).distinct()


def audit_metric_names() -> list[str]:
    single = [QUEUE_LENGTH, STEAL_MS, PENDING_OPS, metric_ops.CONNECTIONS, metric_ops.UTILIZATION, metric_ops.WRITE_OPS]
    return sorted({*single, *measure_names(MEASURES, AUDIT_MEASURES)})


def audit(tables: dict[str, DataFrame], only: set[str] | None = None, materialize: bool | None = None) -> DataFrame:
    """CheckResult rows of every group whose tables are given.

    The metric rules share one digest of the samples, a row per series. It is checkpointed where several groups
    read it, so that the samples are scanned once in all; so is the list of bundles. ``materialize``
    asks for both or for none of it.
    """
    given = dict(tables)
    made = {*given, "bundles", *(["digest"] if "metrics" in given else [])}
    chosen = [(needs, fn) for needs, fn in GROUPS if made.issuperset(needs) and (only is None or fn.__name__ in only)]

    def kept(name: str, df: DataFrame) -> DataFrame:
        shared = sum(name in needs for needs, _ in chosen) > 1
        return cut_lineage(df) if (shared if materialize is None else materialize) else df

    if "bundles" not in given:
        given["bundles"] = kept("bundles", bundle_list(given))
    if "metrics" in given:
        given["digest"] = kept("digest", metric_digest(given["metrics"], audit_metric_names()))
    parts = [fn(given) for _, fn in chosen]
    if not parts:
        return next(iter(given.values())).sparkSession.createDataFrame([], EMPTY)
    return reduce(DataFrame.unionByName, parts).select("bundle_id", *FIELDS)


def audit_summary(results: DataFrame) -> DataFrame:
    """Findings by status and category."""
    return results.groupBy("bundle_id", "category", "status").agg(F.count("*").alias("count"))


def home_summary(
    brokers: DataFrame, health: DataFrame, kafka_partitions: DataFrame, kafka_brokers: DataFrame | None = None, config: DataFrame | None = None
) -> DataFrame:
    """One row per bundle: brokers, versions, maintenance, racks, nodes down, discrepancy."""
    racks = brokers.filter(F.coalesce("rack", F.lit("")) != "").groupBy("bundle_id", "rack").agg(F.count("*").alias("n"))
    racks = racks.groupBy("bundle_id").agg(F.map_from_entries(F.collect_list(F.struct("rack", "n"))).alias("racks"))
    base = brokers.groupBy("bundle_id").agg(
        F.count("*").alias("listed_brokers"), F.array_join(F.array_sort(F.collect_set("version")), ", ").alias("versions"),
        F.count_if("in_maintenance").alias("in_maintenance"), F.array_sort(F.collect_set(F.when(F.col("in_maintenance"), F.col("node_id")))).alias("maintenance_nodes"))
    gone = kafka_partitions.groupBy("bundle_id").agg(F.count_if(F.col("leader") == -1).alias("kafka_leaderless"))
    told = health.select("bundle_id", "is_healthy", "under_replicated_count", "leaderless_count", F.size("nodes_down").alias("nodes_down"), F.size("all_nodes").alias("all_nodes"))
    out = told.join(base, "bundle_id", "full").join(racks, "bundle_id", "left").join(gone, "bundle_id", "left")
    if kafka_brokers is not None:
        out = out.join(kafka_brokers.groupBy("bundle_id").agg(F.count("*").alias("kafka_brokers")), "bundle_id", "left")
    else:
        out = out.withColumn("kafka_brokers", F.lit(None).cast("bigint"))
    aware = F.lit(False)
    if config is not None:
        on = config.filter((F.col("key") == "enable_rack_awareness") & (F.col("value") == "true")).select("bundle_id", F.lit(True).alias("_on")).distinct()
        out = out.join(on, "bundle_id", "left")
        aware = F.coalesce("_on", F.lit(False))
    said, seen = F.coalesce("leaderless_count", F.lit(0)), F.coalesce("kafka_leaderless", F.lit(0))
    discrepancy = F.when((said > 0) & (seen == 0), "health reports leaderless partitions, client metadata none").when(
        (said == 0) & (seen > 0), "client metadata has leaderless partitions, health none").otherwise("")
    return out.select(
        "bundle_id", F.coalesce(F.nullif("kafka_brokers", F.lit(0).cast("bigint")), F.col("all_nodes").cast("bigint"), "listed_brokers").alias("total_brokers"),
        F.coalesce(F.nullif("versions", F.lit("")), F.lit("-")).alias("versions"), "is_healthy", "under_replicated_count", "leaderless_count",
        F.coalesce("in_maintenance", F.lit(0)).alias("in_maintenance"), "maintenance_nodes", "nodes_down", "racks", aware.alias("rack_awareness"), discrepancy.alias("discrepancy"))



