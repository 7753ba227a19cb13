"""Queries over the audit rules: tables in which every limit is crossed by some bundles and kept by others."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.catalog.registry import query
from fleetlens.plans import audit

BUNDLE = "concat('c-', c_custkey) AS bundle_id"


def judge(t, groups: set[str], **tables: str):
    """(bundle_id, name, status, current_value) of some groups over tables given as SQL."""
    given = {name: t.sql(text) for name, text in tables.items()}
    given.setdefault("bundles", t.sql(f"SELECT {BUNDLE} FROM customer"))
    return audit.audit(given, only=groups).select("bundle_id", "name", "status", "current_value")


def fact(source: str, key: str, value: str, where: str = "true") -> str:
    return f"SELECT {BUNDLE}, '{source}' AS source, '{key}' AS key, {value} AS value FROM customer WHERE {where}"


def expect(name: str, status: str, value: str, where: str = "true", table: str = "customer") -> str:
    """One rule of a check: literal name, status and shown value."""
    return f"SELECT {BUNDLE}, {name} AS name, {status} AS status, {value} AS current_value FROM {table} WHERE {where}"


def union(*parts: str) -> str:
    return " UNION ALL ".join(parts)


@query(
    "scheduler_audit",
    expect("'kernel.sched_wakeup_granularity_ns'", "CASE WHEN c_custkey % 3 = 0 THEN 'Warning' ELSE 'Critical' END", "concat(c_nationkey * 800000, ' ns')", "c_nationkey >= 13"),
)
def scheduler_audit(t):
    """Milder on versions from 25.1.5 on; a bundle in three tells no version."""
    return judge(
        t, {"scheduler_checks"}, facts=fact("sysctl", "kernel.sched_wakeup_granularity_ns", "CAST(c_nationkey * 800000 AS STRING)"),
        uname=f"SELECT {BUNDLE}, 'RHEL/CentOS 8' AS distro FROM customer WHERE c_nationkey % 2 = 0",
        versions=f"SELECT {BUNDLE}, IF(c_custkey % 3 = 0, 'v25.1.5', 'v24.3.1') AS version FROM customer WHERE c_custkey % 3 < 2",
    )


@query(
    "platform_audit",
    union(
        expect("'Transparent Hugepages'", "CASE WHEN c_nationkey % 3 = 0 THEN 'Warning' ELSE 'Pass' END", "CASE WHEN c_nationkey % 3 = 0 THEN 'always' ELSE 'never' END"),
        expect("'Virtualization Detected'", "'Warning'", "'VMware, Inc.'", "c_custkey % 2 = 0"),
    ),
)
def platform_audit(t):
    """C15 and C10."""
    return judge(t, {"host_fact_checks"}, facts=union(
        fact("thp", "enabled", "IF(c_nationkey % 3 = 0, '[always] madvise never', 'always madvise [never]')"), fact("dmi", "manufacturer", "IF(c_custkey % 2 = 0, 'VMware, Inc.', 'Dell')"), fact("dmi", "product", "'P'")))


_OOM = "SELECT concat('c-', o_custkey) AS bundle_id FROM orders WHERE o_orderstatus = 'F'"


@query(
    "oom_audit",
    f"SELECT b.bundle_id, 'OOM Killer Invoked' AS name, CASE WHEN count(o.bundle_id) > 0 THEN 'Critical' ELSE 'Pass' END AS status, CAST(count(o.bundle_id) AS VARCHAR) AS current_value "
    f"FROM (SELECT {BUNDLE} FROM customer) b LEFT JOIN ({_OOM}) o USING (bundle_id) GROUP BY 1",
)
def oom_audit(t):
    """C10."""
    return judge(t, {"oom_checks"}, oom=_OOM)


@query("raid_audit", expect("concat('RAID md', c_nationkey, ' Status')", "CASE WHEN c_nationkey % 4 = 0 THEN 'Critical' ELSE 'Pass' END", "CASE WHEN c_nationkey % 4 = 0 THEN '[2/1] [U_]' ELSE '[2/2] [UU]' END"))
def raid_audit(t):
    """C10."""
    return judge(t, {"raid_checks"}, raid=f"SELECT {BUNDLE}, concat('md', c_nationkey) AS name, IF(c_nationkey % 4 = 0, '[2/1] [U_]', '[2/2] [UU]') AS status FROM customer")


_CORES = "SELECT concat('c-', o_custkey) AS bundle_id, concat('core.', o_orderkey % 5) AS file_name FROM orders WHERE o_orderpriority = '1-URGENT'"


@query(
    "core_dump_audit",
    "SELECT b.bundle_id, 'Core Dumps Found' AS name, CASE WHEN count(file_name) > 0 THEN 'Critical' ELSE 'Pass' END AS status, "
    "CASE WHEN count(file_name) > 0 THEN concat(count(file_name), ' dumps: ', string_agg(DISTINCT file_name, ', ' ORDER BY file_name)) ELSE '0' END AS current_value "
    f"FROM (SELECT {BUNDLE} FROM customer) b LEFT JOIN ({_CORES}) o USING (bundle_id) GROUP BY 1",
)
def core_dump_audit(t):
    """All names."""
    return judge(t, {"core_dump_checks"}, core_dumps=_CORES)


def setting(key: str, value: str, where: str = "true") -> str:
    return f"SELECT {BUNDLE}, '{key}' AS key, {value} AS value FROM customer WHERE {where}"


def _flag(name: str, bad: str, status: str) -> str:
    return expect(f"'{name}'", f"CASE WHEN {bad} THEN '{status}' ELSE 'Pass' END", f"CASE WHEN {bad} THEN 'true' ELSE 'false' END")


@query(
    "config_audit",
    union(
        _flag("developer_mode", "c_custkey % 2 = 0 AND c_custkey % 5 > 0", "Warning"), _flag("rpk.overprovisioned", "c_nationkey % 2 = 0", "Info"), _flag("auto_create_topics_enabled", "c_nationkey % 5 = 0", "Warning"),
        expect("'rpk.tune_aio_events'", "CASE WHEN c_custkey % 3 = 0 THEN 'Warning' ELSE 'Pass' END", "CASE WHEN c_custkey % 3 = 0 THEN 'false' ELSE 'true' END", "c_custkey % 3 < 2"),
        expect("'IO Properties Missing'", "'Warning'", "'no limit is set'", "c_custkey % 5 = 0"),
        expect("'Default IO Properties'", "'Info'", "'values of the defaults'", "c_custkey % 5 = 1"),
        expect("'IO Cost Function'", "'Warning'", "'switched off'", "c_nationkey % 4 = 1"),
    ),
)
def config_audit(t):
    """C3 and C27; the flag of the whole cluster comes from the cluster's configuration. Every fifth bundle has no I/O property."""
    return judge(
        t, {"config_checks"}, cluster_config=setting("auto_create_topics_enabled", "IF(c_nationkey % 5 = 0, 'true', 'false')"),
        broker_config=union(
            setting("redpanda.developer_mode", "IF(c_custkey % 2 = 0, 'True', 'false')", "c_custkey % 5 > 0"), setting("rpk.overprovisioned", "'true'", "c_nationkey % 2 = 0"),
            setting("rpk.tune_aio_events", "IF(c_custkey % 3 = 0, 'false', 'true')", "c_custkey % 3 < 2"), setting("redpanda.read_iops", "IF(c_custkey % 5 = 1, '10000', '77')", "c_custkey % 5 > 0"),
            setting("redpanda.max_cost_function", "IF(c_nationkey % 4 = 1, 'false', 'true')")))


@query(
    "address_audit",
    expect("'Public Advertised Addresses'", "CASE WHEN c_nationkey % 2 = 0 OR c_custkey % 3 = 0 THEN 'Warning' ELSE 'Pass' END",
           "CASE WHEN c_nationkey % 2 = 0 AND c_custkey % 3 = 0 THEN '52.1.2.3, 8.8.8.8' WHEN c_nationkey % 2 = 0 THEN '8.8.8.8' WHEN c_custkey % 3 = 0 THEN '52.1.2.3' ELSE 'no public one' END"),
)
def address_audit(t):
    """Reported and advertised hosts."""
    return judge(
        t, {"public_address_checks"}, kafka_brokers=f"SELECT {BUNDLE}, IF(c_nationkey % 2 = 0, '8.8.8.8', '10.0.0.1') AS host FROM customer", uname=f"SELECT {BUNDLE}, 'AWS' AS cloud FROM customer WHERE c_nationkey = 1",
        broker_config=union(setting("redpanda.advertised_kafka_api.0.address", "IF(c_custkey % 3 = 0, '52.1.2.3', '192.168.1.1')"), setting("redpanda.advertised_rpc_api", "'172.16.0.1:33145'"), setting("redpanda.other.address", "'9.9.9.9'")))


_CONTAINER = "c_custkey % 2 = 0 AND c_custkey % 3 > 0"
_SHARDS, _CORE = "(c_nationkey % 9 + 1)", "(CASE WHEN c_nationkey >= 20 THEN 32 ELSE 4 END)"


@query(
    "container_audit",
    union(
        expect("'K8s Shard Tax (N-1)'", "'Warning'", f"concat({_SHARDS}, ' shards, ', {_CORE}, ' cores')", f"{_CONTAINER} AND {_SHARDS} >= {_CORE}"),
        expect("'Large Core Node Interference'", "'Warning'", f"concat({_SHARDS}, ' shards, ', {_CORE}, ' cores')", f"{_CONTAINER} AND {_CORE} >= 32 AND {_SHARDS} < {_CORE} // 2"),
        expect("'Busy Spinning Mode'", "'Info'", "'shards spin'", _CONTAINER),
    ),
)
def container_audit(t):
    """Odd bundles are no containers, every third one shares its cores."""
    return judge(
        t, {"container_checks"}, uname=f"SELECT {BUNDLE}, c_custkey % 2 = 0 AS is_container FROM customer", core_counts=f"SELECT {BUNDLE}, CAST({_CORE} AS BIGINT) AS cores FROM customer",
        command_lines=f"SELECT {BUNDLE}, concat('redpanda --smp ', {_SHARDS}, IF(c_custkey % 3 = 0, ' --overprovisioned', '')) AS cmdline FROM customer", broker_config=setting("redpanda.other", "'x'"))


_USED = "c_custkey % 101"


@query(
    "disk_audit",
    union(
        expect("'/data Filesystem'", "CASE WHEN c_nationkey % 2 = 0 THEN 'Pass' ELSE 'Warning' END", "CASE WHEN c_nationkey % 2 = 0 THEN 'xfs' ELSE 'ext4' END", "c_nationkey % 3 > 0"),
        expect("'/ Filesystem'", "'Warning'", "'ext4'", "c_nationkey % 3 = 0"),
        expect("'/data'", f"CASE WHEN {_USED} > 95 THEN 'Critical' ELSE 'Warning' END", f"concat({_USED}, '%')", f"{_USED} > 85 AND c_nationkey % 3 > 0"),
        expect("'Disk Balancing Trigger (/data)'", "'Info'", f"concat({_USED}, '%')", f"{_USED} >= 80 AND c_nationkey % 3 > 0"),
        expect("'Data Directory on Root'", "'Warning'", "'/data/redpanda lies on /'", "c_nationkey % 3 = 0"),
    ),
)
def disk_audit(t):
    """A bundle in three has no mount but the root; a noisy mount that is full does not count."""
    column = "AS filesystem, {} AS type, CAST(0 AS BIGINT) AS total, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS available, {} AS use_percent, {} AS mount_point FROM customer"
    return judge(
        t, {"disk_checks"}, data_dirs=f"SELECT {BUNDLE}, '/data/redpanda' AS data_dir FROM customer",
        filesystems=union(
            f"SELECT {BUNDLE}, '/dev/sda' " + column.format("IF(c_nationkey % 2 = 0, 'xfs', 'ext4')", f"concat({_USED}, '%')", "'/data'") + " WHERE c_nationkey % 3 > 0",
            f"SELECT {BUNDLE}, 'overlay' " + column.format("'ext4'", "'10%'", "'/'"), f"SELECT {BUNDLE}, 'tmpfs' " + column.format("'tmpfs'", "'99%'", "'/run/secrets/x'")))


_RATE = "(c_custkey % 60) * 1048576"


@query(
    "self_test_audit",
    union(
        expect("concat('Disk Write Performance (Small Block) - Node ', c_nationkey)", "CASE WHEN c_custkey % 60 < 4 THEN 'Critical' ELSE 'Pass' END", "concat(c_custkey % 60, '.00 MB/s')"),
        expect("concat('Disk Write Performance (Medium Block) - Node ', c_nationkey)", "CASE WHEN c_custkey % 60 < 30 THEN 'Critical' ELSE 'Pass' END", "concat(c_custkey % 60, '.00 MB/s')"),
    ),
)
def self_test_audit(t):
    """C31."""
    row = f"SELECT {BUNDLE}, c_nationkey AS node_id, '{{}}' AS type, '{{}}' AS name, '{{}}' AS info, CAST({_RATE} AS BIGINT) AS throughput FROM customer"
    return judge(t, {"self_test_checks"}, self_test=union(
        row.format("disk", "4KB sequential write", "write run (dsync: true)"), row.format("disk", "16KB sequential r/w", "write run (dsync: false)"), row.format("disk", "4KB sequential write", "dsync: false"), row.format("network", "4KB sequential write", "dsync: true")))


@query(
    "interrupt_audit",
    union(
        expect("concat('SoftIRQ Imbalance (', CASE WHEN c_custkey % 2 = 0 THEN 'NET_RX' ELSE 'BLOCK' END, ')')", "CASE WHEN c_nationkey % 2 = 0 THEN 'Warning' ELSE 'Pass' END",
               "CASE WHEN c_nationkey % 2 = 0 THEN 'on 5.0% of CPUs' ELSE 'on 100.0% of CPUs' END", "c_custkey % 3 > 0"),
        expect("'MQ Imbalance (nvme0)'", "'Warning'", "'one CPU takes all'", "c_nationkey % 4 = 1"),
    ),
)
def interrupt_audit(t):
    """One busy CPU of twenty, or all; a bundle in three has too few interrupts to judge. C17: both queues on one CPU."""
    counts = "transform(sequence(1, 20), i -> CAST(IF(c_nationkey % 2 = 1 OR i = 3, IF(c_custkey % 3 = 0, 100, 2000000), 0) AS BIGINT))"
    queue = f"SELECT {BUNDLE}, '2{{0}}' AS irq_id, array(CAST(0 AS BIGINT), CAST(20000 AS BIGINT), CAST(IF(c_nationkey % 4 = 1, 0, {{0}}) AS BIGINT)) AS counts, 'PCI-MSI' AS controller, 'nvme0q{{0}}' AS device FROM customer"
    return judge(
        t, {"softirq_checks", "irq_checks"}, irqs=union(queue.format(1), queue.format(2), f"SELECT {BUNDLE}, '9', array(CAST(9999999 AS BIGINT)), 'x', 'rtc0' FROM customer"),
        softirqs=union(f"SELECT {BUNDLE}, IF(c_custkey % 2 = 0, 'NET_RX', 'BLOCK') AS irq_id, {counts} AS counts FROM customer", f"SELECT {BUNDLE}, 'TIMER' AS irq_id, {counts} AS counts FROM customer"))


@query(
    "health_audit",
    union(
        expect("'Under Replicated Partitions'", "CASE WHEN c_custkey % 4 > 0 THEN 'Critical' ELSE 'Pass' END", "CAST(c_custkey % 4 AS VARCHAR)"),
        expect("'Partition Balancer Stalled'", "'Critical'", "'stalled'", "c_nationkey % 3 = 0"),
    ),
)
def health_audit(t):
    """C5 and C12."""
    return judge(t, {"health_checks", "balancer_checks"}, health=f"SELECT {BUNDLE}, IF(c_custkey % 4 = 0 AND c_nationkey % 2 = 0, NULL, c_custkey % 4) AS under_replicated_count FROM customer",
                 balancer=f"SELECT {BUNDLE}, IF(c_nationkey % 3 = 0, 'stalled', 'in_progress') AS status FROM customer")


_RACKS = "SELECT concat('n-', s_nationkey) AS bundle_id, CASE WHEN s_acctbal > 3000 OR s_nationkey % 4 = 1 THEN 'r1' ELSE '' END AS rack FROM supplier WHERE s_nationkey % 4 > 0 OR s_acctbal <= 3000"


@query(
    "rack_audit",
    "SELECT bundle_id, 'Inconsistent Rack Configuration' AS name, 'Warning' AS status, concat('racks on ', count(*) FILTER (rack <> ''), ' of ', count(*), ' brokers') AS current_value "
    f"FROM ({_RACKS}) r GROUP BY 1 HAVING count(*) FILTER (rack <> '') BETWEEN 1 AND count(*) - 1",
)
def rack_audit(t):
    """Racks on all, none or some brokers."""
    return judge(t, {"rack_checks"}, kafka_brokers=_RACKS)


@query(
    "pod_audit",
    union(
        expect("concat('Pod p-', c_custkey, CASE c_nationkey % 4 WHEN 0 THEN ' OOMKilled' ELSE ' Crash' END)", "'Critical'", "concat('ended with code ', CASE c_nationkey % 4 WHEN 0 THEN 137 ELSE 1 END)", "c_nationkey % 4 < 2"),
        expect("concat('Pod p-', c_custkey, ' QoS')", "'Warning'", "concat('cpu ', c_nationkey, ' of 4, memory 1Gi of ', CASE WHEN c_custkey % 2 = 0 THEN '2Gi' ELSE '1Gi' END)", "c_custkey % 2 = 0 OR c_nationkey <> 4"),
    ),
)
def pod_audit(t):
    """Killed, crashed, completed and running containers; requests that equal their limits or do not."""
    ended = "IF(c_nationkey % 4 = 3, CAST(NULL AS MAP<STRING, STRUCT<reason: STRING, exitCode: INT>>), map('terminated', named_struct('reason', CASE c_nationkey % 4 WHEN 0 THEN 'OOMKilled' WHEN 1 THEN 'Error' ELSE 'Completed' END, 'exitCode', CASE c_nationkey % 4 WHEN 0 THEN 137 WHEN 1 THEN 1 ELSE 0 END)))"
    resources = "named_struct('requests', map('cpu', CAST(c_nationkey AS STRING), 'memory', '1Gi'), 'limits', map('cpu', '4', 'memory', IF(c_custkey % 2 = 0, '2Gi', '1Gi')))"
    return judge(t, {"pod_checks"}, pods=(
        f"SELECT {BUNDLE}, named_struct('name', concat('p-', c_custkey)) AS metadata, named_struct('containers', array(named_struct('name', 'main', 'resources', {resources}))) AS spec, "
        f"named_struct('containerStatuses', array(named_struct('name', 'main', 'lastState', {ended}))) AS status FROM customer"))
