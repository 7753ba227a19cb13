"""Queries over the readers of a bundle's files: every row of a driver table is a bundle whose file holds its values."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.catalog.log_queries import micros
from fleetlens.catalog.registry import query
from fleetlens.operators import events as event_ops, metrics as metric_ops, storage as storage_ops
from fleetlens.operators.logs import detect_version
from fleetlens.sources import cluster, host, logs as log_files, metrics as metric_files, storage
from fleetlens.sources.fleet import TableFleet, list_files, scan_corpus

CUSTOMER, SUPPLIER, PART, ORDER = "concat('c-', c_custkey)", "concat('s-', s_suppkey)", "concat('p-', p_partkey)", "concat('o-', o_orderkey)"


def fleet_of(t, bundle: str, table: str, files: dict[str, str]) -> TableFleet:
    """One bundle per row of a table, with a file per expression; a null text is no file.

    A row of some bytes becomes texts of thousands, so rows are dealt to tasks before texts are made of them.
    """
    pairs = ", ".join(f"struct({path if path.startswith('concat(') else repr(path)} AS path, {text} AS content)" for path, text in files.items())
    rows = t.sql(f"SELECT * FROM {table}")
    # A given number is kept; else the rows' few bytes would be put together again.
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.expr(bundle))
    return TableFleet(rows.selectExpr(f"{bundle} AS bundle_id", f"explode(array({pairs})) AS f").filter("f.content IS NOT NULL").select("bundle_id", "f.path", "f.content"))


# --- admin JSON -----------------------------------------------------------------------------


@query(
    "partition_files",
    "SELECT concat('o-', o_orderkey) AS bundle_id, 'kafka' AS ns, concat('t-', o_custkey % 40) AS topic, o_orderkey % 9 AS partition_id, r AS node_id, o_custkey % 4 + r AS core "
    "FROM orders, (VALUES (0), (1), (2)) v(r) WHERE r <= o_orderkey % 3",
)
def partition_files(t):
    doc = (
        "to_json(array(named_struct('ns', 'kafka', 'topic', concat('t-', o_custkey % 40), 'partition_id', o_orderkey % 9, 'status', 'done', 'leader_id', 0, 'revision', 1, 'extra', true, "
        "'replicas', transform(sequence(0, CAST(o_orderkey % 3 AS INT)), r -> named_struct('node_id', r, 'core', o_custkey % 4 + r)))))"
    )
    return cluster.partition_replicas(cluster.scan_partitions(fleet_of(t, ORDER, "orders", {"admin/cluster_partitions.json": doc})))


@query(
    "leader_files",
    "SELECT concat('c-', c_custkey) AS bundle_id, 'kafka' AS ns, c_mktsegment AS topic, c_custkey % 7 AS partition_id, c_nationkey AS leader, c_nationkey - 1 AS previous_leader, c_custkey AS last_stable_leader_term FROM customer",
)
def leader_files(t):
    """The second file of a bundle repeats the first and does not count; empty ones are skipped."""
    row = "named_struct('ns', 'kafka', 'topic', c_mktsegment, 'partition_id', c_custkey % 7, 'leader', c_nationkey, 'previous_leader', c_nationkey - 1, 'last_stable_leader_term', {})"
    files = {f"admin/partition_leader_table_{n}.json": text for n, text in ((0, "'[]'"), (1, f"to_json(array({row.format('c_custkey')}))"), (2, f"to_json(array({row.format('-1')}))"))}
    return cluster.scan_leaders(fleet_of(t, CUSTOMER, "customer", files))


@query(
    "debug_files",
    "SELECT concat('c-', c_custkey) AS bundle_id, 'kafka' AS ns, lower(c_mktsegment) AS topic, c_custkey AS partition_id, 1 AS node_id, f AS follower_id, c_nationkey AS heartbeats_failed, "
    "f * 100 AS ms_since_last_heartbeat, c_custkey * 2 AS last_flushed_log_index, c_custkey * 3 AS last_dirty_log_index FROM customer, (VALUES (2), (3)) v(f)",
)
def debug_files(t):
    """Odd customers' records have no name of their own; it is told by the file's name."""
    named = "concat('\"ns\": \"kafka\", \"topic\": \"', lower(c_mktsegment), '\", \"partition_id\": ', c_custkey, ', ')"
    follower = "'{{\"id\": {0}, \"heartbeats_failed\": ', c_nationkey, ', \"ms_since_last_heartbeat\": {0}00, \"last_flushed_log_index\": ', c_custkey * 2, ', \"last_dirty_log_index\": ', c_custkey * 3, '}}'"
    text = f"concat('{{', IF(c_custkey % 2 = 0, {named}, ''), '\"replicas\": [{{\"committed_offset\": 5, \"raft_state\": {{\"node_id\": 1, \"term\": 2, \"is_leader\": true, \"followers\": [', {follower.format(2)}, ', ', {follower.format(3)}, ']}}}}]}}')"
    path = "concat('admin/debug_partition_kafka_', lower(c_mktsegment), '_', c_custkey, '.json')"
    return cluster.debug_followers(cluster.scan_partition_debug(fleet_of(t, CUSTOMER, "customer", {path: text})))


@query(
    "broker_files",
    "SELECT concat('s-', s_suppkey) AS bundle_id, s_suppkey AS node_id, s_nationkey AS num_cores, concat('rack-', s_nationkey) AS rack, s_nationkey % 4 <> 1 AS is_alive, s_suppkey % 5 = 2 AS draining, "
    "concat('v24.', s_suppkey % 3, '.', s_nationkey) AS version, 'h' AS internal_rpc_address, s_suppkey % 5 = 2 OR s_suppkey % 5 = 3 AS in_maintenance FROM supplier",
)
def broker_files(t):
    """Silence on is_alive counts as alive; maintenance is any true flag of the status."""
    alive = "CASE WHEN s_nationkey % 4 = 1 THEN ', \"is_alive\": false' WHEN s_nationkey % 4 = 2 THEN ', \"is_alive\": true' ELSE '' END"
    status = "CASE s_suppkey % 5 WHEN 2 THEN ', \"maintenance_status\": {\"draining\": true, \"finished\": false}' WHEN 3 THEN ', \"maintenance_status\": {\"draining\": false, \"errors\": true}' ELSE '' END"
    text = f"concat('[{{\"node_id\": ', s_suppkey, ', \"num_cores\": ', s_nationkey, ', \"rack\": \"rack-', s_nationkey, '\", \"internal_rpc_address\": \"h\", \"version\": \"v24.', s_suppkey % 3, '.', s_nationkey, '\"', {alive}, {status}, '}}]')"
    return cluster.scan_brokers(fleet_of(t, SUPPLIER, "supplier", {"admin/brokers.json": text}))


@query(
    "status_files",
    "SELECT concat('c-', c_custkey) AS bundle_id, c_nationkey % 2 = 0 AS is_healthy, c_custkey AS under_replicated_count, 0 AS leaderless_count, c_nationkey AS nodes_down, "
    "CASE WHEN c_nationkey % 3 = 0 THEN 'stalled' ELSE 'ready' END AS status, c_acctbal AS \"cpuPercentage\" FROM customer",
)
def status_files(t):
    files = fleet_of(t, CUSTOMER, "customer", {
        "admin/health_overview.json": "to_json(named_struct('is_healthy', c_nationkey % 2 = 0, 'under_replicated_count', c_custkey, 'leaderless_count', 0, 'nodes_down', array(c_nationkey), 'all_nodes', array(1, 2)))",
        "admin/partition_balancer_status.json": "to_json(named_struct('status', IF(c_nationkey % 3 = 0, 'stalled', 'ready'), 'seconds_since_last_tick', 3))",
        "resource-usage.json": "to_json(named_struct('cpuPercentage', c_acctbal, 'freeMemoryMB', 1.5))",
    })
    health = cluster.scan_health(files).select("bundle_id", "is_healthy", "under_replicated_count", "leaderless_count", F.element_at("nodes_down", 1).alias("nodes_down"))
    return health.join(cluster.scan_balancer(files).select("bundle_id", "status"), "bundle_id").join(cluster.scan_resource_usage(files).select("bundle_id", "cpuPercentage"), "bundle_id")


@query(
    "self_test_files",
    "SELECT concat('p-', p_partkey) AS bundle_id, p_size AS node_id, k AS name, CASE WHEN k = 'disk' THEN p_partkey ELSE p_partkey * 2 END AS throughput, p_retailprice AS iops, p_size * 10 AS latency_p99 "
    "FROM part, (VALUES ('disk'), ('net')) v(k) WHERE k = 'disk' OR p_size % 2 = 0",
)
def self_test_files(t):
    """Even sizes come as a list of nodes with two results, odd ones as one object."""
    test = "named_struct('name', '{}', 'type', 'x', 'throughput', {}, 'iops', p_retailprice, 'latency_p99', p_size * 10)"
    disk, net = test.format("disk", "p_partkey"), test.format("net", "p_partkey * 2")
    text = f"IF(p_size % 2 = 0, to_json(array(named_struct('node_id', p_size, 'status', 'idle', 'results', array({disk}, {net})))), to_json(named_struct('node_id', p_size, 'status', 'idle', 'results', array({disk}))))"
    return cluster.scan_self_test(fleet_of(t, PART, "part", {"admin/self_test_status_0.json": text})).select("bundle_id", "node_id", "name", "throughput", "iops", "latency_p99")


@query(
    "disk_stat_files",
    "SELECT concat('s-', s_suppkey) AS bundle_id, kind, concat('disk_stat_', kind, '_db-', s_nationkey, '.example.json') AS file_name, s_suppkey AS node_id, 1000 AS total_bytes, s_nationkey AS free_bytes "
    "FROM supplier, (VALUES ('data'), ('cache')) v(kind)",
)
def disk_stat_files(t):
    """Files to brokers by the longest host in their names: ``db-1`` also stands inside ``db-10``."""
    brokers = "to_json(array(named_struct('node_id', s_suppkey, 'internal_rpc_address', concat('db-', s_nationkey, '.example')), named_struct('node_id', -1, 'internal_rpc_address', 'db-')))"
    stat = "to_json(named_struct('free_bytes', s_nationkey, 'total_bytes', 1000))"
    files = fleet_of(t, SUPPLIER, "supplier", {"admin/brokers.json": brokers, **{f"concat('admin/disk_stat_{k}_db-', s_nationkey, '.example.json')": stat for k in ("data", "cache")}})
    return storage_ops.match_hosts(cluster.scan_disk_stats(files), cluster.scan_brokers(files))


@query(
    "cluster_config_files",
    "SELECT concat('c-', c_custkey) AS bundle_id, key, value, concat('https://docs.redpanda.com/current/reference/properties/cluster-properties/#', key) AS doc_link FROM "
    "(SELECT c_custkey, 'segment_size' AS key, CAST(c_custkey AS VARCHAR) AS value FROM customer UNION ALL SELECT c_custkey, 'seed', concat('[', c_nationkey, ',1]') FROM customer "
    "UNION ALL SELECT c_custkey, 'name', c_mktsegment FROM customer) x",
)
def cluster_config_files(t):
    text = "concat('{\"segment_size\": ', c_custkey, ', \"seed\": [', c_nationkey, ',1], \"name\": \"', c_mktsegment, '\"}')"
    return cluster.scan_cluster_config(fleet_of(t, CUSTOMER, "customer", {"admin/cluster_config.json": text}))


@query(
    "yaml_config_files",
    "SELECT concat('c-', c_custkey) AS bundle_id, key, value FROM (SELECT c_custkey, 'redpanda.node_id' AS key, CAST(c_custkey AS VARCHAR) AS value FROM customer "
    "UNION ALL SELECT c_custkey, 'redpanda.seed_servers.0.host', concat('db-', c_nationkey) FROM customer UNION ALL SELECT c_custkey, 'redpanda.seed_servers.1.host', 'db: x' FROM customer "
    "UNION ALL SELECT c_custkey, 'rpk.note', concat('first ', c_mktsegment) FROM customer UNION ALL SELECT c_custkey, 'rpk.flow', '[1, 2]' FROM customer) x",
)
def yaml_config_files(t):
    text = (
        "concat('# made\\nredpanda:\\n  node_id: ', c_custkey, ' # id\\n  seed_servers:\\n  - host: db-', c_nationkey, '\\n    \\n  - host: \"db: x\"\\nrpk:\\n    note: >\\n      first\\n      ', c_mktsegment, "
        "'\\n    flow: [1, 2]\\n')"
    )
    return cluster.scan_yaml_config(fleet_of(t, CUSTOMER, "customer", {"redpanda.yaml": text}))


@query(
    "profile_files",
    "SELECT concat('c-', c_custkey) AS bundle_id, concat('db-', c_nationkey) AS node, CASE WHEN c_custkey % 3 = 2 THEN 0 ELSE c_custkey % 3 END AS shard_id, "
    "CASE WHEN c_custkey % 3 = 0 THEN 'unknown' ELSE lower(c_mktsegment) END AS scheduling_group, concat('0x', c_custkey) AS user_backtrace, c_nationkey + 1 AS occurrences FROM customer",
)
def profile_files(t):
    """The three layouts: an object with shards, a list of shards, and one without a shard number."""
    sample = "named_struct('user_backtrace', concat('0x', c_custkey), '{}', {}, 'occurrences', c_nationkey + 1)"
    shard = lambda field, value: f"array({sample.format(field, value)})"
    whole = f"to_json(named_struct('wait_ms', 5, 'profile', array(named_struct('shard_id', 0, 'dropped_samples', 1, 'samples', {shard('scheduling_group', repr(''))}))))"
    listed = f"to_json(array(named_struct('shard_id', 1, 'samples', {shard('group', 'lower(c_mktsegment)')})))"
    bare = f"to_json(named_struct('samples', {shard('scheduling_group', 'lower(c_mktsegment)')}))"
    path = "concat('admin/cpu_profile_https---db-', c_nationkey, '.-example.com-9644.json')"
    return cluster.scan_cpu_profiles(fleet_of(t, CUSTOMER, "customer", {path: f"CASE c_custkey % 3 WHEN 0 THEN {whole} WHEN 1 THEN {listed} ELSE {bare} END"}))


# --- client dump and Kubernetes -----------------------------------------------------------


def _dump(t):
    topic = "concat('t-', c_nationkey)"
    meta = (
        f"to_json(named_struct('Cluster', c_name, 'Controller', c_nationkey, 'Brokers', array(named_struct('NodeID', c_nationkey, 'Port', 9092, 'Host', 'h', 'Rack', 'r')), 'Topics', map({topic}, "
        f"named_struct('Topic', {topic}, 'Partitions', map('0', named_struct('Partition', 0, 'Leader', c_nationkey, 'Replicas', array(1, 2), 'ISR', array(1)))))))"
    )
    groups = "to_json(map(concat('g-', c_custkey), named_struct('Group', 'g', 'State', IF(c_nationkey % 2 = 0, 'Stable', 'Empty'), 'Coordinator', named_struct('NodeID', 1, 'Host', 'h'), 'Members', array(named_struct('MemberID', 'm', 'ClientID', c_mktsegment, 'Assigned', map(" + topic + ", array(0)))))))"
    marks = f"to_json(map({topic}, map('0', named_struct('Topic', {topic}, 'Partition', 0, 'Offset', c_custkey * 10))))"
    commits = f"to_json(map({topic}, map('0', named_struct('Topic', {topic}, 'Partition', 0, 'At', c_custkey * 7))))"
    configs = f"to_json(array(named_struct('Name', {topic}, 'Configs', array(named_struct('Key', 'retention', 'Value', c_mktsegment, 'Source', 'DEFAULT', 'Sensitive', c_nationkey % 2 = 0)))))"
    item = lambda name, text: f"named_struct('Name', {name}, 'Response', {text})"
    items = [item("'metadata'", meta), item("'groups'", groups), item("'high_watermarks'", marks), item("concat('group_commits_g-', c_custkey)", commits), item("'topic_configs'", configs)]
    # Responses are JSON documents themselves.
    text = "concat('[', " + ", ',', ".join("concat('{\"Name\": \"', " + i.split("'Name', ")[1].split(", 'Response'")[0] + ", '\", \"Response\": ', " + i.split("'Response', ", 1)[1][:-1] + ", '}')" for i in items) + ", ']')"
    return cluster.scan_kafka_dump(fleet_of(t, CUSTOMER, "customer", {"kafka.json": text}), materialize=True)


@query(
    "dump_partitions",
    "SELECT concat('c-', c_custkey) AS bundle_id, concat('t-', c_nationkey) AS topic, 0 AS partition_id, c_nationkey AS leader, 2 AS replicas, 1 AS isr, c_name AS cluster, c_nationkey AS controller, 'h' AS host FROM customer",
)
def dump_partitions(t):
    dump = _dump(t)
    rows = dump["partitions"].withColumns({"replicas": F.size("replicas"), "isr": F.size("isr")})
    # Every side has a row per bundle or more: few bytes when shuffled, too many to broadcast for a large fleet.
    return rows.join(dump["metadata"].hint("merge"), "bundle_id").join(dump["brokers"].select("bundle_id", "host").hint("merge"), "bundle_id")


@query(
    "dump_groups",
    "SELECT concat('c-', c_custkey) AS bundle_id, concat('g-', c_custkey) AS group_id, CASE WHEN c_nationkey % 2 = 0 THEN 'Stable' ELSE 'Empty' END AS state, c_mktsegment AS client_id, concat('t-', c_nationkey) AS topic, "
    "0 AS partition_id, c_custkey * 7 AS at, c_custkey * 10 AS hwm, c_mktsegment AS retention, c_nationkey % 2 = 0 AS sensitive FROM customer",
)
def dump_groups(t):
    dump = _dump(t)
    rows = dump["members"].select("bundle_id", "group_id", "state", "client_id").join(dump["commits"].hint("merge"), ["bundle_id", "group_id"])
    rows = rows.join(dump["high_watermarks"].hint("merge"), ["bundle_id", "topic", "partition_id"])
    configs = dump["topic_configs"].select("bundle_id", F.col("name").alias("topic"), F.col("value").alias("retention"), "sensitive")
    return rows.join(configs.hint("merge"), ["bundle_id", "topic"])


def _pods(t):
    state = "concat('{\"name\": \"main\", \"ready\": true, \"restartCount\": ', c_custkey % 9, ', \"state\": {\"running\": {\"startedAt\": \"2024-01-01T00:00:05Z\"}}, \"lastState\": {\"terminated\": {\"reason\": \"', IF(c_nationkey % 2 = 0, 'OOMKilled', 'Completed'), '\", \"exitCode\": ', IF(c_nationkey % 2 = 0, 137, 0), ', \"finishedAt\": \"2024-01-01T00:00:01Z\"}}}')"
    pods = f"concat('{{\"kind\": \"PodList\", \"items\": [{{\"metadata\": {{\"name\": \"pod-', c_custkey, '\", \"namespace\": \"', lower(c_mktsegment), '\"}}, \"spec\": {{\"nodeName\": \"n-', c_nationkey, '\"}}, \"status\": {{\"phase\": \"Running\", \"containerStatuses\": [', {state}, ', {{\"name\": \"side\", \"restartCount\": 2}}]}}}}]}}')"
    events = "concat('{\"items\": [{\"type\": \"Warning\", \"reason\": \"BackOff\", \"message\": \"m ', c_custkey, '\", \"count\": ', c_nationkey, ', \"lastTimestamp\": \"2024-01-02T00:00:00Z\", \"involvedObject\": {\"kind\": \"Pod\", \"name\": \"pod-', c_custkey, '\"}, \"source\": {\"component\": \"kubelet\"}}]}')"
    return cluster.scan_k8s(fleet_of(t, CUSTOMER, "customer", {"k8s/pods.json": pods, "k8s/events.json": events}))


@query(
    "k8s_pod_files",
    "SELECT concat('c-', c_custkey) AS bundle_id, concat('pod-', c_custkey) AS pod, c_custkey % 9 + 2 AS restarts, lower(c_mktsegment) AS namespace, concat('n-', c_nationkey) AS node FROM customer",
)
def k8s_pod_files(t):
    pods = cluster.k8s_kind(_pods(t), "pods")
    more = pods.select("bundle_id", F.col("metadata.namespace").alias("namespace"), F.col("spec.nodeName").alias("node"))
    return event_ops.pod_restarts(pods).join(more, "bundle_id")


@query(
    "k8s_event_files",
    "SELECT concat('c-', c_custkey) AS bundle_id, 'Warning' AS type, 'BackOff' AS reason, concat('m ', c_custkey) AS message, c_nationkey AS count, 1704153600000000 AS last_timestamp, 'Pod' AS involved_kind, "
    "concat('pod-', c_custkey) AS involved_name, 'kubelet' AS source_component FROM customer",
)
def k8s_event_files(t):
    rows = cluster.k8s_events(_pods(t)).select("bundle_id", "type", "reason", "message", "count", "last_timestamp", "involved_kind", "involved_name", "source_component")
    return rows.withColumn("last_timestamp", micros("last_timestamp"))


@query(
    "pod_timeline",
    "SELECT concat('c-', c_custkey) AS bundle_id, 1704067205000000 AS ts, 'K8s' AS type, concat('pod-', c_custkey) AS source, 'Pod Started (Running)' AS description, 'Normal' AS severity, 'Container: main' AS details FROM customer "
    "UNION ALL SELECT concat('c-', c_custkey), 1704067201000000, 'Restart', concat('pod-', c_custkey), concat('Pod Terminated: ', CASE WHEN c_nationkey % 2 = 0 THEN 'OOMKilled' ELSE 'Completed' END), "
    "CASE WHEN c_nationkey % 2 = 0 THEN 'Critical' ELSE 'Warning' END, concat('Exit Code: ', CASE WHEN c_nationkey % 2 = 0 THEN 137 ELSE 0 END, chr(10), 'Container: main') FROM customer",
)
def pod_timeline(t):
    return event_ops.pod_timeline(cluster.k8s_kind(_pods(t), "pods")).withColumn("ts", micros("ts"))


# --- host files ---------------------------------------------------------------------------


@query(
    "host_fact_files",
    "SELECT concat('c-', c_custkey) AS bundle_id, node, 'sysctl' AS source, 'vm.swappiness' AS key, CAST(CASE WHEN node = '' THEN c_nationkey ELSE c_custkey END AS VARCHAR) AS value FROM customer, (VALUES (''), ('db-1')) v(node) WHERE node = '' OR c_custkey % 2 = 0 "
    "UNION ALL SELECT concat('c-', c_custkey), '', 'meminfo', 'Dirty', CAST(c_custkey * 1024 AS VARCHAR) FROM customer UNION ALL SELECT concat('c-', c_custkey), '', 'free', 'mem_total', CAST((c_custkey + 7) * 1024 AS VARCHAR) FROM customer "
    "UNION ALL SELECT concat('c-', c_custkey), '', 'thp', 'enabled', 'always [madvise] never' FROM customer UNION ALL SELECT concat('c-', c_custkey), '', 'cmdline', 'cmdline', concat('/bin/redpanda --smp ', c_nationkey) FROM customer "
    "UNION ALL SELECT concat('c-', c_custkey), '', 'dmi', 'manufacturer', c_mktsegment FROM customer UNION ALL SELECT concat('c-', c_custkey), '', 'top', 'load_5m', concat(c_nationkey, '.5') FROM customer",
)
def host_fact_files(t):
    keys = {"sysctl": ["vm.swappiness"], "meminfo": ["Dirty"], "free": ["mem_total"], "thp": ["enabled"], "cmdline": ["cmdline"], "dmi": ["manufacturer"], "top": ["load_5m"]}
    facts = host.scan_host_facts(fleet_of(t, CUSTOMER, "customer", {
        "utils/sysctl.txt": "concat('a.b = 1\\nvm.swappiness = ', c_nationkey, '\\n')", "utils/db-1/sysctl.txt": "IF(c_custkey % 2 = 0, concat('vm.swappiness=', c_custkey), NULL)",
        "proc/meminfo": "concat('MemTotal: 5 kB\\nDirty:    ', c_custkey, ' kB\\n')", "utils/free.txt": "concat('  total used\\nMem: ', c_custkey + 7, ' 1 2 3 4 5\\nSwap: 1 2 3\\n')",
        "sys/kernel/mm/transparent_hugepage/enabled": "'always [madvise] never\\n'", "proc/77/cmdline": "concat('/bin/redpanda', char(0), '--smp', char(0), c_nationkey)", "proc/78/cmdline": "'/bin/other'",
        "utils/dmidecode.txt": "concat('BIOS Information\\n\\tVendor: v\\n\\nSystem Information\\n\\tManufacturer: ', c_mktsegment, '\\n')", "utils/top.txt": "concat('top - up, load average: 1.0, ', c_nationkey, '.5, 3.0\\n')",
    }))
    wanted = F.lit(False)
    for source, names in keys.items():
        wanted = wanted | ((F.col("source") == source) & F.col("key").isin(names))
    return facts.filter(wanted)


@query(
    "uname_files",
    "SELECT concat('c-', c_custkey) AS bundle_id, 'Linux' AS kernel, CASE c_nationkey % 3 WHEN 0 THEN 'redpanda-0' WHEN 1 THEN 'ip-1.compute.internal' ELSE 'Host_A' END AS hostname, "
    "CASE c_nationkey % 2 WHEN 0 THEN '4.18.0.el8.x86_64' ELSE '6.1.0-amzn2023' END AS release, concat('#', c_custkey, ' SMP') AS version, CASE c_nationkey % 2 WHEN 0 THEN 'RHEL/CentOS 8' ELSE 'Amazon Linux 2023' END AS distro, "
    "'x86_64' AS machine, 'GNU/Linux' AS operating_system, c_nationkey % 3 = 0 AS is_container, CASE WHEN c_nationkey % 3 = 1 THEN 'AWS' ELSE '' END AS cloud FROM customer",
)
def uname_files(t):
    text = "concat('Linux ', CASE c_nationkey % 3 WHEN 0 THEN 'redpanda-0' WHEN 1 THEN 'ip-1.compute.internal' ELSE 'Host_A' END, ' ', IF(c_nationkey % 2 = 0, '4.18.0.el8.x86_64', '6.1.0-amzn2023'), ' #', c_custkey, ' SMP x86_64 GNU/Linux\\n')"
    return host.uname_facts(host.scan_host_facts(fleet_of(t, CUSTOMER, "customer", {"utils/uname.txt": text})))


@query(
    "filesystem_files",
    "SELECT concat('c-', c_custkey) AS bundle_id, '/dev/sda' AS filesystem, 'xfs' AS type, c_custkey * 1024 AS total, c_nationkey * 1024 AS used, 5120 AS available, concat(c_nationkey, '%') AS use_percent, '/data' AS mount_point FROM customer WHERE c_custkey % 2 = 0 "
    "UNION ALL SELECT concat('c-', c_custkey), concat('/dev/', lower(c_mktsegment)), 'ext4', 0, 0, 0, '-', '/m' FROM customer WHERE c_custkey % 2 = 1",
)
def filesystem_files(t):
    """Bundles without the disk listing give their mount table."""
    return host.scan_filesystems(fleet_of(t, CUSTOMER, "customer", {
        "utils/df.txt": "IF(c_custkey % 2 = 0, concat('Filesystem Type 1K-blocks Used Available Use% Mounted on\\n/dev/sda xfs ', c_custkey, ' ', c_nationkey, ' 5 ', c_nationkey, '% /data\\n'), NULL)",
        "proc/mounts": "concat('/dev/', lower(c_mktsegment), ' /m ext4 rw 0 0\\n')",
    }))


@query(
    "process_files",
    "SELECT concat('c-', c_custkey) AS bundle_id, CAST(c_custkey AS VARCHAR) AS pid, 'root' AS \"user\", c_nationkey + 0.5 AS cpu, 1.0 AS memory, concat('java -jar ', lower(c_mktsegment)) AS command FROM customer",
)
def process_files(t):
    text = "concat('top - 1:00 up\\n\\n  PID USER PR NI VIRT RES SHR S %CPU %MEM TIME+ COMMAND\\n ', c_custkey, ' root 20 0 1 1 1 S ', c_nationkey, '.5 1.0 0:01 java -jar ', lower(c_mktsegment), '\\n')"
    return host.scan_processes(fleet_of(t, CUSTOMER, "customer", {"utils/top.txt": text}))


@query(
    "socket_files",
    "SELECT concat('o-', o_orderkey) AS bundle_id, 'tcp' AS netid, s AS state, CASE WHEN s = 'ESTAB' THEN '0' ELSE '3' END AS recv_q, concat('10.0.0.', o_custkey % 250, ':9092') AS local_addr, "
    "CASE WHEN s = 'ESTAB' THEN o_custkey END AS retrans_total, CASE WHEN s = 'ESTAB' THEN 0.5 END AS rtt, CASE WHEN s = 'ESTAB' THEN 1448 END AS mss FROM orders, (VALUES ('ESTAB'), ('TIME-WAIT')) v(s)",
)
def socket_files(t):
    text = (
        "concat('Netid State Recv-Q Send-Q Local Peer\\ntcp ESTAB 0 1 10.0.0.', o_custkey % 250, ':9092 10.0.0.2:5\\n\\t cubic rto:204 rtt:0.5/0.25 mss:1448 cwnd:10 retrans:0/', o_custkey, '\\n"
        "TIME-WAIT 3 0 10.0.0.', o_custkey % 250, ':9092 10.0.0.3:6\\n')"
    )
    return host.scan_sockets(fleet_of(t, ORDER, "orders", {"utils/ss.txt": text})).select("bundle_id", "netid", "state", "recv_q", "local_addr", "retrans_total", "rtt", "mss")


@query(
    "device_files",
    "SELECT concat('c-', c_custkey) AS bundle_id, 'sda' AS name, 'disk' AS type, concat(c_nationkey, 'G') AS size, NULL AS mount_point FROM customer WHERE c_custkey % 2 = 0 "
    "UNION ALL SELECT concat('c-', c_custkey), 'sda1', 'part', concat(c_custkey, 'M'), '/data' FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT concat('c-', c_custkey), lower(c_mktsegment), 'disk', '1T', '/d' FROM customer WHERE c_custkey % 2 = 1",
)
def device_files(t):
    tree = "concat('NAME KNAME TYPE SIZE MOUNTPOINT\\nsda sda disk ', c_nationkey, 'G\\n└─sda1 sda1 part ', c_custkey, 'M /data\\n')"
    doc = "to_json(named_struct('blockdevices', array(named_struct('name', lower(c_mktsegment), 'type', 'disk', 'size', '1T', 'mountpoint', '/d'))))"
    return host.scan_block_devices(fleet_of(t, CUSTOMER, "customer", {"utils/lsblk.txt": f"IF(c_custkey % 2 = 0, {tree}, {doc})"}))


@query(
    "interface_files",
    "SELECT concat('c-', c_custkey) AS bundle_id, name, CASE WHEN name = 'lo' THEN 'LOOPBACK,UP' ELSE 'UP' END AS flags, CASE WHEN name = 'lo' THEN 65536 ELSE 9000 + c_nationkey END AS mtu, "
    "CASE WHEN name = 'lo' THEN '127.0.0.1/8 ::1/128' ELSE '' END AS addresses FROM customer, (VALUES ('lo'), ('eth0')) v(name)",
)
def interface_files(t):
    text = "concat('1: lo: <LOOPBACK,UP> mtu 65536 qdisc\\n    inet 127.0.0.1/8 scope host\\n    inet6 ::1/128 scope\\n2: eth0: <UP> mtu ', 9000 + c_nationkey, '\\n')"
    return host.scan_interfaces(fleet_of(t, CUSTOMER, "customer", {"utils/ip.txt": text})).withColumn("addresses", F.array_join("addresses", " "))


@query(
    "raid_files",
    "SELECT concat('c-', c_custkey) AS bundle_id, concat('md', c_nationkey) AS name, 'active raid0' AS state, 'sda1[0] sdb1[1]' AS devices, c_custkey AS blocks, '[2/2]' AS status FROM customer",
)
def raid_files(t):
    text = "concat('Personalities : [raid0]\\nmd', c_nationkey, ' : active raid0 sda1[0] sdb1[1]\\n      ', c_custkey, ' blocks 512k chunks [2/2]\\n\\nunused devices: <none>\\n')"
    return host.scan_raid(fleet_of(t, CUSTOMER, "customer", {"proc/mdstat": text})).withColumn("devices", F.array_join("devices", " "))


@query(
    "interrupt_files",
    "SELECT concat('c-', c_custkey) AS bundle_id, '24' AS irq_id, c_custkey AS first, c_custkey + c_nationkey AS total, 'PCI-MSI' AS controller, 'edge nvme0q1' AS device FROM customer "
    "UNION ALL SELECT concat('c-', c_custkey), 'NMI', 1, 1 + c_nationkey, 'Non-maskable', 'interrupts' FROM customer UNION ALL SELECT concat('c-', c_custkey), 'NET_RX', c_nationkey, c_nationkey + 3, NULL, NULL FROM customer",
)
def interrupt_files(t):
    files = fleet_of(t, CUSTOMER, "customer", {
        "proc/interrupts": "concat('           CPU0       CPU1\\n 24: ', c_custkey, ' ', c_nationkey, ' PCI-MSI edge nvme0q1\\nNMI: 1 ', c_nationkey, ' Non-maskable interrupts\\nERR: 0\\n')",
        "proc/softirqs": "concat('           CPU0       CPU1\\nNET_RX: ', c_nationkey, ' 3\\n')",
    })
    rows = host.scan_irqs(files).unionByName(host.scan_irqs(files, "softirqs"))
    total = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, c: a + c)
    return rows.select("bundle_id", "irq_id", F.get("counts", F.lit(0)).alias("first"), total.alias("total"), "controller", "device")


@query(
    "vmstat_files",
    "SELECT concat('c-', c_custkey) AS bundle_id, 2 AS samples, (c_custkey + c_nationkey) / 2.0 AS avg_runnable, 1.0 AS avg_blocked, 6.0 AS avg_iowait, greatest(c_custkey, c_nationkey) AS max_runnable, 2 AS max_blocked, 8 AS max_iowait FROM customer",
)
def vmstat_files(t):
    text = "concat('procs ---memory---\\n r  b swpd free buff cache si so bi bo in cs us sy id wa st\\n', c_custkey, ' 0 0 0 0 0 0 0 0 0 0 0 0 0 0 4 0\\n', c_nationkey, ' 2 0 0 0 0 0 0 0 0 0 0 0 0 0 8 0\\n')"
    return host.scan_vmstat(fleet_of(t, CUSTOMER, "customer", {"utils/vmstat.txt": text}))


@query("oom_files", "SELECT concat('c-', c_custkey) AS bundle_id, concat(c_custkey, '.25') AS kernel_time, lower(c_mktsegment) AS process FROM customer WHERE c_nationkey % 2 = 0")
def oom_files(t):
    text = "concat('[ 1.5] eth0 up\\n[ ', c_custkey, '.25] ', lower(c_mktsegment), IF(c_nationkey % 2 = 0, ' invoked oom-killer: gfp_mask=0x1', ' sleeps'), '\\n')"
    return host.scan_oom(fleet_of(t, CUSTOMER, "customer", {"utils/syslog.txt": text})).drop("message")


def _sar(t):
    cpu = "concat('00:10:01 CPU %user %nice %system %iowait %steal %idle\\n00:10:01 all ', o_custkey % 90, '.5 0.0 25.0 1.0 0.0 50.0\\n00:10:01 0 9.0 0.0 9.0 9.0 0.0 9.0\\n')"
    net = "concat('00:10:01 IFACE rxpck/s txpck/s rxkB/s txkB/s rxcmp/s txcmp/s rxmcst/s %ifutil\\n00:10:01 eth0 1.0 2.0 ', (o_custkey % 50) * 1024, ' 1024 0 0 3.0 ', o_custkey % 100, '.0\\n00:10:01 lo 1 1 9999999 9 0 0 0 99.0\\n')"
    tcp = "concat('00:10:01 active/s passive/s iseg/s oseg/s\\n00:10:01 1.0 2.0 40000.0 ', o_custkey * 20, '.0\\n00:10:01 atmptf/s estres/s retrans/s isegerr/s orsts/s\\n00:10:01 0.0 0.0 ', o_custkey % 8, '.25 ', o_custkey % 2, '.0 0.0\\nAverage: 0 0 9.0 0 0\\n')"
    text = f"concat('Linux 5.15.0 (db-0) 01/02/24 _x86_64_ (4 CPU)\\n\\n', {cpu}, '\\n', {net}, '\\n', {tcp})"
    return host.scan_sar(fleet_of(t, ORDER, "orders", {"utils/sar.txt": text}))


@query(
    "sar_samples",
    "SELECT concat('o-', o_orderkey) AS bundle_id, '00:10:01' AS clock, 1704154201000000 AS ts, o_custkey % 90 + 0.5 AS cpu_user, 25.0 AS cpu_system, 50.0 AS cpu_idle, 40000.0 AS tcp_in_segs, o_custkey * 20.0 AS tcp_out_segs, "
    "o_custkey % 8 + 0.25 AS tcp_retrans, o_custkey % 2 + 0.0 AS tcp_in_errs FROM orders",
)
def sar_samples(t):
    rows = _sar(t)[0].select("bundle_id", "clock", "ts", "cpu_user", "cpu_system", "cpu_idle", "tcp_in_segs", "tcp_out_segs", "tcp_retrans", "tcp_in_errs")
    return rows.withColumn("ts", micros("ts"))


@query(
    "sar_peaks",
    "SELECT concat('o-', o_orderkey) AS bundle_id, 1704154201000000 AS ts, o_custkey % 50 + 1.0 AS peak_mbps FROM orders",
)
def sar_peaks(t):
    return metric_ops.sar_peak_throughput(_sar(t)[1]).withColumn("ts", micros("ts"))


@query(
    "network_health_files",
    "SELECT concat('o-', o_orderkey) AS bundle_id, o_custkey % 8 + 0.25 AS max_retrans, o_custkey % 100 + 0.0 AS max_if_util, o_custkey * 20 + 40000 > 50000 AS interrupt_storm, "
    "CASE WHEN o_custkey % 8 >= 5 THEN 'Critical' WHEN o_custkey % 8 >= 1 THEN 'Warning' ELSE '' END AS retransmissions, CASE WHEN o_custkey % 100 > 80 THEN 'Critical' WHEN o_custkey % 100 > 50 THEN 'Warning' ELSE '' END AS use, "
    "o_custkey % 2 = 1 AS errors FROM orders",
)
def network_health_files(t):
    rows = metric_ops.network_health(*_sar(t))
    level = lambda text: F.coalesce(F.substring_index(F.get(F.filter("findings", lambda f: F.contains(f, F.lit(text))), F.lit(0)), ":", 1), F.lit(""))
    return rows.select("bundle_id", "max_retrans", "max_if_util", "interrupt_storm", level("retransmission").alias("retransmissions"), level("interface").alias("use"), F.exists("findings", lambda f: F.contains(f, F.lit("input errors"))).alias("errors"))


# --- storage, metrics, listings -------------------------------------------------------------


@query(
    "disk_usage_files",
    "SELECT concat('c-', c_custkey) AS bundle_id, concat('/data/kafka/t/', c_custkey) AS path, c_custkey * 1024 AS size_bytes FROM customer UNION ALL SELECT concat('c-', c_custkey), '/data', c_nationkey * 1048576 + 524288 FROM customer",
)
def disk_usage_files(t):
    text = "concat(c_custkey, 'K\\t/data/kafka/t/', c_custkey, '\\ndu: cannot read\\n', c_nationkey, '.5M\\t/data\\n')"
    return storage.scan_du(fleet_of(t, CUSTOMER, "customer", {"utils/du.txt": text}))


@query(
    "data_dir_files",
    "SELECT concat('o-', o_orderkey) AS bundle_id, concat('/data/kafka/t-', o_custkey, '/', p, '_1/0-1-v1.log') AS path, o_orderkey * p AS size_bytes FROM orders, (VALUES (0), (1), (2)) v(p)",
)
def data_dir_files(t):
    text = "to_json(map_from_entries(transform(sequence(0, 2), p -> struct(concat('/data/kafka/t-', o_custkey, '/', p, '_1/0-1-v1.log'), named_struct('size_bytes', o_orderkey * p)))))"
    return storage.scan_data_dir(fleet_of(t, ORDER, "orders", {"data-dir.txt": text}))


@query(
    "metric_files",
    "SELECT concat('c-', c_custkey) AS bundle_id, concat('n', c_nationkey) AS node, 'up_total' AS name, concat('shard=', c_nationkey) AS series, c_acctbal AS value, 'seconds up' AS help FROM customer",
)
def metric_files_query(t):
    """The flat file repeats samples of the node's own and does not count; the last help line wins."""
    text = "concat('# HELP up_total old\\n# HELP up_total seconds up\\n# TYPE up_total counter\\nup_total{shard=\"', c_nationkey, '\"} ', c_acctbal, '\\nup_total NaN\\n')"
    files = fleet_of(t, CUSTOMER, "customer", {"concat('metrics/n', c_nationkey, '/t0_metrics.txt')": text, "metrics/t0_metrics.txt": text})
    rows = metric_files.scan_prometheus(files).select("bundle_id", "node", "name", F.concat(F.lit("shard="), F.col("labels")["shard"]).alias("series"), "value")
    return rows.join(metric_files.scan_metric_help(files), ["bundle_id", "name"])


@query(
    "file_listing",
    "SELECT concat('c-', c_custkey) AS bundle_id, concat('core.', c_custkey) AS file_name, length(c_mktsegment) AS length, 'core' AS kind FROM customer WHERE c_nationkey % 2 = 0 "
    "UNION ALL SELECT concat('c-', c_custkey), f, 4, CASE f WHEN 'sysctl.txt' THEN 'db-0' ELSE '' END FROM customer, (VALUES ('top.log'), ('sysctl.txt')) v(f)",
)
def file_listing(t):
    files = fleet_of(t, CUSTOMER, "customer", {"concat('core.', c_custkey)": "IF(c_nationkey % 2 = 0, c_mktsegment, NULL)", "top.log": "'abc\\n'", "utils/db-0/sysctl.txt": "'x=1\\n'"})
    cores = list_files(files, "core.*").select("bundle_id", "file_name", "length", F.lit("core").alias("kind"))
    rest = files.manifest().filter("NOT startswith(file_name, 'core.')").select("bundle_id", "file_name", "length", F.col("node").alias("kind"))
    return cores.unionByName(rest)


@query(
    "corpus_files",
    "SELECT concat('p-', page_id) AS bundle_id, 'Utils' AS \"group\", 'page.txt' AS file_name, md5(html) AS digest, NULL AS error FROM pages "
    "UNION ALL SELECT concat('p-', page_id), 'Admin', 'a.json', md5(CASE WHEN page_id % 2 = 0 THEN '{\"a\": 1}' ELSE '{\"a\": ' END), CASE WHEN page_id % 2 = 0 THEN NULL ELSE 'not valid JSON' END FROM pages",
)
def corpus_files(t):
    files = fleet_of(t, "concat('p-', page_id)", "pages", {"utils/page.txt": "html", "admin/a.json": "IF(page_id % 2 = 0, '{\"a\": 1}', '{\"a\": ')", "other/x.txt": "'no'"})
    return scan_corpus(files).select("bundle_id", "group", "file_name", F.md5("text").alias("digest"), "error")


@query(
    "log_files",
    "SELECT concat('c-', c_custkey) AS bundle_id, node, n AS line_number, level, message FROM customer, (VALUES ('redpanda', 2, 'WARN'), ('deep', 1, 'INFO'), ('x', 1, 'ERROR')) v(node, n, level), "
    "LATERAL (SELECT CASE v.node WHEN 'redpanda' THEN concat('slow ', c_custkey, chr(10), 'more') WHEN 'deep' THEN concat('no header ', c_nationkey) ELSE lower(c_mktsegment) END AS message) m",
)
def log_files_query(t):
    files = fleet_of(t, CUSTOMER, "customer", {
        "redpanda.log": "concat('\\nWARN  2024-01-01 00:00:01,250 [shard 3:main] raft - slow ', c_custkey, '\\r\\nmore\\n')", "logs/a/deep.txt": "concat('no header ', c_nationkey, '\\n')",
        "logs/x.csv": "concat('2024-01-01T00:00:01Z,ERROR,', lower(c_mktsegment), '\\n')", "logs/skipped.json": "'x'", "other.log": "'x'",
    })
    return log_files.scan_logs(files).select("bundle_id", "node", "line_number", "level", "message")


@query(
    "detected_versions",
    "SELECT concat('c-', c_custkey) AS bundle_id, CASE c_custkey % 3 WHEN 0 THEN concat('v24.1.', c_nationkey) ELSE concat('23.2.', c_nationkey) END AS version FROM customer",
)
def detected_versions(t):
    """From the brokers, else from the first greeting in the log."""
    files = fleet_of(t, CUSTOMER, "customer", {
        "admin/brokers.json": "IF(c_custkey % 3 = 0, to_json(array(named_struct('node_id', 1, 'version', concat('v24.1.', c_nationkey)))), NULL)",
        "redpanda.log": "concat('INFO  2024-01-01 00:00:01,250 [shard 0:main] main - Welcome to Redpanda v23.2.', c_nationkey, '\\nINFO  2024-01-01 00:00:02,250 [shard 0:main] main - Welcome to Redpanda v99.0.0\\n')",
    })
    return detect_version(cluster.scan_brokers(files), log_files.scan_logs(files, materialize=False))


def _le(number: str, size: int) -> str:
    """A number from 0, which has to fit into ``size`` bytes, as little-endian hex."""
    whole = f"lpad(hex(CAST({number} AS BIGINT)), {2 * size}, '0')"
    return " || ".join(f"substring({whole}, {at}, 2)" for at in range(2 * size - 1, 0, -2))


def _batch(base: str, kind: str, code: str, records: str, payload: str) -> str:
    fields = [_le("1", 4), _le(f"(61 + {payload})", 4), _le(base, 8), f"lpad(hex({kind}), 2, '0')", _le("2", 4), _le(code, 2), _le("0", 4), _le("c_custkey", 8), _le("c_custkey + 5", 8), *[_le("0", n) for n in (8, 2, 4)], _le(records, 4)]
    return f"{' || '.join(fields)} || repeat('FF', {payload})"


@query(
    "segment_files",
    "SELECT concat('c-', c_custkey) AS bundle_id, CASE WHEN b = 0 THEN 'Raft Data' ELSE 'Raft Config' END AS type_name, CASE WHEN b = 1 THEN 'None' ELSE CASE c_nationkey % 6 WHEN 0 THEN 'None' WHEN 1 THEN 'Gzip' WHEN 2 THEN 'Snappy' "
    "WHEN 3 THEN 'LZ4' WHEN 4 THEN 'Zstd' ELSE 'Unknown(5)' END END AS compression, 1 AS batches, CASE WHEN b = 0 THEN c_nationkey + 1 ELSE 1 END AS records, CASE WHEN b = 0 THEN 61 + c_custkey % 90 ELSE 61 END AS bytes, "
    "CASE WHEN b = 0 THEN c_custkey ELSE c_custkey + 30 END AS first_offset, CASE WHEN b = 0 THEN c_custkey + c_nationkey ELSE c_custkey + 30 END AS last_offset FROM customer, (VALUES (0), (1)) v(b)",
)
def segment_files(t):
    """Two batches in a segment, payloads of any length between their headers, zeros at the end."""
    text = f"CAST(unhex({_batch('c_custkey', '1', '(c_nationkey % 6)', '(c_nationkey + 1)', 'CAST(c_custkey % 90 AS INT)')} || {_batch('(c_custkey + 30)', '2', '0', '1', '0')} || repeat('00', 70)) AS STRING)"
    rows = storage.scan_segments(fleet_of(t, CUSTOMER, "customer", {"data/kafka/t/0_1/0-1-v1.log": text})).filter("error IS NULL")
    return storage_ops.segment_summary(rows).select("bundle_id", "type_name", "compression", "batches", "records", "bytes", "first_offset", "last_offset")


@query(
    "snapshot_files",
    "SELECT concat('c-', c_custkey) AS bundle_id, CASE WHEN c_nationkey % 5 > 0 THEN 29 + c_nationkey ELSE 7 END AS size_bytes, CASE WHEN c_nationkey % 5 > 0 THEN c_custkey END AS last_included_index, "
    "CASE WHEN c_nationkey % 5 > 0 THEN c_nationkey END AS last_included_term, CASE WHEN c_nationkey % 5 > 0 THEN 1 END AS header_version, CASE WHEN c_nationkey % 5 = 0 THEN 'short header' END AS error FROM customer",
)
def snapshot_files(t):
    whole = " || ".join([_le("1", 4), _le("2", 4), "'01'", _le("9", 4), _le("c_custkey", 8), _le("c_nationkey", 8), "repeat('AB', c_nationkey)"])
    text = f"CAST(unhex(IF(c_nationkey % 5 > 0, {whole}, repeat('00', 7))) AS STRING)"
    return storage.scan_snapshots(fleet_of(t, CUSTOMER, "customer", {"data/kafka/t/0_1/snapshot": text})).select("bundle_id", "size_bytes", "last_included_index", "last_included_term", "header_version", "error")
