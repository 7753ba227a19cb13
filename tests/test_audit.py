"""Audit, performance and anomaly rules at, below and above their thresholds."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetlens.plans import audit as A
from fleetlens.plans.performance import performance_report

T0 = datetime(2024, 1, 1)


def bundles(spark, *names):
    return spark.createDataFrame([(n,) for n in names or ("b1",)], "bundle_id string")


def facts(spark, rows):
    return spark.createDataFrame([("b1", *r) for r in rows], "bundle_id string, source string, key string, value string")


def metrics(spark, rows):
    """(name, labels, value[, seconds]) rows of bundle b1."""
    data = [("b1", i, r[0], r[1], T0 + timedelta(seconds=r[3] if len(r) > 3 else 0), float(r[2])) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "bundle_id string, id bigint, name string, labels map<string,string>, ts timestamp, value double")


def config(spark, **kv):
    return spark.createDataFrame([("b1", k.replace("__", "."), v) for k, v in kv.items()] or [("b1", "x", "y")], "bundle_id string, key string, value string")


def uname(spark, distro="", container=False, cloud=""):
    return spark.createDataFrame([("b1", distro, container, cloud)], "bundle_id string, distro string, is_container boolean, cloud string")


def run(fn, **tables):
    got = A.audit(tables, only={fn}).collect()
    return {(r["name"], r["status"]) for r in got}


def test_sysctl(spark):
    rows = [("sysctl", "fs.aio-max-nr", "1048575"), ("sysctl", "fs.file-max", "500000"), ("sysctl", "net.core.somaxconn", "4095"),
            ("sysctl", "net.core.rmem_max", "1"), ("sysctl", "net.ipv4.tcp_sack", "text"), ("sysctl", "net.ipv4.tcp_rmem", "1 2 16777215"),
            ("sysctl", "net.ipv4.tcp_wmem", "1 2 16777216"), ("sysctl", "net.ipv4.ip_local_port_range", "1000 28999"),
            ("sysctl", "vm.swappiness", "2"), ("sysctl", "net.ipv4.tcp_tw_reuse", "1"), ("sysctl", "net.ipv4.tcp_slow_start_after_idle", "1"), ("meminfo", "vm.swappiness", "0")]
    got = run("sysctl_checks", bundles=bundles(spark), facts=facts(spark, rows))
    assert {("fs.aio-max-nr", "Critical"), ("fs.file-max", "Pass"), ("net.core.somaxconn", "Warning"), ("net.core.rmem_max", "Info"), ("net.ipv4.tcp_rmem", "Info"),
            ("net.ipv4.ip_local_port_range", "Warning"), ("vm.swappiness", "Warning"), ("net.ipv4.tcp_tw_reuse", "Pass"), ("net.ipv4.tcp_slow_start_after_idle", "Warning"),
            ("net.ipv4.tcp_window_scaling", "Warning")} <= got
    assert not {n for n, _ in got} & {"net.ipv4.tcp_sack", "net.ipv4.tcp_wmem"}


@pytest.mark.parametrize("value, version, expected", [("9999999", "25.1.5", None), ("10000000", "v25.1.5", "Warning"), ("10000000", "25.1.4", "Critical"), ("10000000", "", "Critical")])
def test_granularity(spark, value, version, expected):
    versions = spark.createDataFrame([("b1", version)], "bundle_id string, version string")
    got = run("scheduler_checks", bundles=bundles(spark), facts=facts(spark, [("sysctl", A.GRANULARITY, value)]), uname=uname(spark), versions=versions)
    assert got == ({(A.GRANULARITY, expected)} if expected else set())


def test_host_facts(spark):
    got = run("host_fact_checks", facts=facts(spark, [("thp", "enabled", "[always] never"), ("dmi", "manufacturer", "VMware, Inc.")]))
    assert got == {("Transparent Hugepages", "Warning"), ("Virtualization Detected", "Warning")}
    assert run("host_fact_checks", facts=facts(spark, [("thp", "enabled", "always [never]")])) == {("Transparent Hugepages", "Pass")}


def test_presence(spark):
    oom = spark.createDataFrame([("b1",)], "bundle_id string")
    assert {(r["bundle_id"], r["status"]) for r in A.audit({"bundles": bundles(spark, "b1", "b2"), "oom": oom}).collect()} == {("b1", "Critical"), ("b2", "Pass")}
    dumps = spark.createDataFrame([("b1", "core.1")], "bundle_id string, file_name string")
    rows = A.audit({"bundles": bundles(spark, "b1", "b2"), "core_dumps": dumps}).collect()
    assert {(r["bundle_id"], r["current_value"], r["status"]) for r in rows} == {("b1", "1 dumps: core.1", "Critical"), ("b2", "0", "Pass")}
    raid = spark.createDataFrame([("b1", "md0", "[_U]"), ("b1", "md1", "[UU]")], "bundle_id string, name string, status string")
    assert run("raid_checks", raid=raid) == {("RAID md0 Status", "Critical"), ("RAID md1 Status", "Pass")}


def test_config(spark):
    got = run("config_checks", bundles=bundles(spark), broker_config=config(spark, redpanda__developer_mode="TRUE", rpk__tune_aio_events="false", redpanda__read_iops="1000", redpanda__max_cost_function="False"))
    assert got == {("developer_mode", "Warning"), ("rpk.overprovisioned", "Pass"), ("auto_create_topics_enabled", "Pass"), ("rpk.tune_aio_events", "Warning"), ("Default IO Properties", "Info"), ("IO Cost Function", "Warning")}
    assert ("IO Properties Missing", "Warning") in run("config_checks", bundles=bundles(spark), broker_config=config(spark))


def test_public_addresses(spark):
    brokers = spark.createDataFrame([("b1", 1, "8.8.4.4", None), ("b1", 2, "10.0.0.1", "r")], "bundle_id string, node_id bigint, host string, rack string")
    tables = dict(bundles=bundles(spark, "b1", "b2"), broker_config=config(spark, advertised_kafka_api="172.16.0.1:9092, 1.2.3.4:9092"), kafka_brokers=brokers, uname=uname(spark, cloud="AWS"))
    rows = {r["bundle_id"]: r for r in A.audit(tables, only={"public_address_checks"}).collect()}
    assert (rows["b1"]["current_value"], rows["b1"]["status"], rows["b2"]["status"]) == ("1.2.3.4, 8.8.4.4", "Warning", "Pass")
    assert "halve" in rows["b1"]["remediation"]
    assert run("rack_checks", kafka_brokers=brokers) == {("Inconsistent Rack Configuration", "Warning")}


@pytest.mark.parametrize("cmd, cores, expected", [
    ("redpanda --smp 4", 4, {"K8s Shard Tax (N-1)", "Busy Spinning Mode"}), ("redpanda --smp=3", 4, {"Busy Spinning Mode"}),
    ("redpanda --smp=15", 32, {"Large Core Node Interference", "Busy Spinning Mode"}), ("redpanda --smp=16", 32, {"Busy Spinning Mode"}),
    ("redpanda --smp 4 --overprovisioned", 4, set()), ("redpanda", 4, set())])
def test_container(spark, cmd, cores, expected):
    tables = dict(command_lines=spark.createDataFrame([("b1", cmd)], "bundle_id string, cmdline string"), uname=uname(spark, container=True),
                  core_counts=spark.createDataFrame([("b1", cores)], "bundle_id string, cores bigint"), broker_config=config(spark))
    assert {n for n, _ in run("container_checks", **tables)} == expected


def test_disks(spark):
    fs = [("b1", "/dev/sda", "ext4", "80%", "/"), ("b1", "/dev/sdb", "xfs", "86%", "/mnt"), ("b1", "/dev/sdc", "xfs", "96%", "/mnt/redpanda"), ("b1", "/dev/sdd", "ext4", "99%", "/etc/x"), ("b1", "tmpfs", "tmpfs", "99%", "/run")]
    filesystems = spark.createDataFrame(fs, "bundle_id string, filesystem string, type string, use_percent string, mount_point string")
    dirs = spark.createDataFrame([("b1", "/data")], "bundle_id string, data_dir string")
    got = run("disk_checks", bundles=bundles(spark), filesystems=filesystems, data_dirs=dirs)
    assert got == {("/ Filesystem", "Warning"), ("/mnt/redpanda Filesystem", "Pass"), ("/mnt", "Warning"), ("/mnt/redpanda", "Critical"), ("Disk Balancing Trigger (/)", "Info"),
                   ("Disk Balancing Trigger (/mnt)", "Info"), ("Disk Balancing Trigger (/mnt/redpanda)", "Info"), ("Disk Balancing Trigger (/etc/x)", "Info"), ("Data Directory on Root", "Warning")}


def test_self_test(spark):
    mb = 1024 * 1024
    rows = [("b1", 1, "disk", "4KB sequential write", "dsync: true", 4 * mb), ("b1", 2, "disk", "4KB sequential write", "dsync: true", 4 * mb - 1), ("b1", 1, "disk", "16KB sequential r/w", "dsync: false", 30 * mb - 1), ("b1", 1, "network", "4KB sequential write", "dsync: true", 1)]
    df = spark.createDataFrame(rows, "bundle_id string, node_id bigint, type string, name string, info string, throughput bigint")
    assert run("self_test_checks", self_test=df) == {("Disk Write Performance (Small Block) - Node 1", "Pass"), ("Disk Write Performance (Small Block) - Node 2", "Critical"), ("Disk Write Performance (Medium Block) - Node 1", "Critical")}


def test_sockets(spark):
    rows = [("b1", "TIME-WAIT", "a", "b", 50)] * 6000 + [("b1", "TIME_WAIT", "a", "b", None)] * 4000
    schema = "bundle_id string, state string, local_addr string, peer_addr string, retrans_total bigint"
    ok = run("socket_checks", bundles=bundles(spark), sockets=spark.createDataFrame(rows, schema))
    assert ok == {("TIME_WAIT Sockets", "Pass"), ("Socket Retransmissions", "Pass")}
    bad = A.audit(dict(bundles=bundles(spark), sockets=spark.createDataFrame(rows + [("b1", "TIME_WAIT", "x", "y", 51)], schema))).collect()
    assert {r["name"]: (r["status"], r["current_value"]) for r in bad} == {"TIME_WAIT Sockets": ("Warning", "10001"), "Socket Retransmissions": ("Warning", "1 sockets, up to 51 times on x -> y")}


def test_irqs(spark):
    soft = [("b1", "NET_RX", [1_000_000] + [0] * 19), ("b1", "BLOCK", [100_000] * 20), ("b1", "TIMER", [9_000_000] + [0] * 19), ("b2", "NET_RX", [999_999] + [0] * 19)]
    df = spark.createDataFrame(soft, "bundle_id string, irq_id string, counts array<bigint>")
    assert run("softirq_checks", softirqs=df) == {("SoftIRQ Imbalance (NET_RX)", "Warning"), ("SoftIRQ Imbalance (BLOCK)", "Pass")}
    modes = spark.createDataFrame([("b1", "NET_RX", [10, 1, 0, 100])], df.schema)
    # intended: over 111/4/10; running: over each running total / 4 / 10 in whole steps
    assert [modes.select(A.active_cpus(F.col("counts"), m).alias("n")).first()["n"] for m in ("intended", "running")] == [2, 3]
    irqs = [("b1", "52", "PCI-MSI", "nvme0q1", [6000, 0]), ("b1", "53", "PCI-MSI", "nvme0q2", [4000, 0]), ("b1", "54", "x", "eth0-TxRx-0", [9000, 0]), ("b1", "55", "x", "eth0-TxRx-1", [0, 9000]), ("b1", "56", "x", "nvme1q0", [99999, 0]), ("b1", "57", "x", "timer", [99999, 0])]
    df = spark.createDataFrame(irqs, "bundle_id string, irq_id string, controller string, device string, counts array<bigint>")
    assert run("irq_checks", irqs=df) == {("MQ Imbalance (nvme0)", "Warning")}


def test_cluster(spark):
    health = spark.createDataFrame([("b1", 1, [1, 2, 3])], "bundle_id string, under_replicated_count bigint, all_nodes array<bigint>")
    assert run("health_checks", health=health) == {("Under Replicated Partitions", "Critical")}
    replicas = spark.createDataFrame([("b1", 1), ("b1", 2)], "bundle_id string, node_id bigint")
    assert run("empty_node_checks", health=health, replicas=replicas) == {("Empty Node (ID 3)", "Warning")}
    balancer = spark.createDataFrame([("b1", "stalled"), ("b2", "ready")], "bundle_id string, status string")
    assert run("balancer_checks", balancer=balancer) == {("Partition Balancer Stalled", "Critical")}
    schema = "bundle_id string, ns string, topic string, partition_id bigint, leader bigint, last_stable_leader_term bigint"
    leaders = spark.createDataFrame([("b1", "redpanda", "controller", 0, 2, 7)] + [("b1", "kafka", "t", i, 1, 1) for i in range(4)] + [("b1", "kafka", "t", 9, -1, 1)], schema)
    assert run("controller_checks", bundles=bundles(spark, "b1", "b2"), leaders=leaders) == {("Controller Leader", "Pass"), ("Controller Leader", "Critical")}
    # 6 leaders over 3 nodes: average 2; 3 is at the limit, 4 over it
    assert run("leader_balance_checks", leaders=leaders, health=health) == {("Leader Imbalance (Node 1)", "Warning")}
    assert run("leader_balance_checks", leaders=leaders.filter("partition_id != 3"), health=health) == {("Leader Imbalance (Node 1)", "Warning")}
    assert run("leader_balance_checks", leaders=leaders.filter("partition_id < 3 or partition_id = 9").unionByName(leaders.filter("partition_id = 9")), health=health) == set()


def test_logs(spark):
    def table(rows):
        return spark.createDataFrame([("b1", i, T0 + timedelta(milliseconds=m), text) for i, (m, text) in enumerate(rows)], "bundle_id string, id bigint, ts timestamp, message string")

    move = [(0, "attempt to move replica failed")]
    got = run("log_checks", logs=table(move + [(i + 1, "attempt to move replica ok") for i in range(9)] + [(0, "Reactor stalled for 5 ms")]))
    assert got == {("Partition Move Failed", "Warning"), ("Reactor Stalls in Logs", "Warning")}
    assert run("log_checks", logs=table(move + [(i + 1, "attempt to move replica ok") for i in range(300)])) == {("Partition Move Failed", "Warning")}
    assert run("log_checks", logs=table([(i + 1, "attempt to move replica ok") for i in range(10)])) == set()
    assert run("log_checks", logs=table(move + [(5, "No nodes are available to perform allocation")])) == {("Rebalance Failure (Hard Constraints)", "Critical")}
    conn = [(i * 200, "Accepted new connection") for i in range(50)]
    assert run("log_checks", logs=table(conn)) == {("High Connection Churn", "Warning")}
    assert run("log_checks", logs=table(conn[1:])) == set()
    assert run("log_checks", logs=table(conn[1:] + [(10_200, "accepted new connection")])) == set()


def test_metric_rules(spark):
    q = A.QUEUE_LENGTH
    assert run("queue_checks", metrics=metrics(spark, [(q, {"shard": "1"}, 999), (q, {"shard": "2"}, 5)])) == set()
    rows = A.audit(dict(metrics=metrics(spark, [(q, {"shard": "1"}, 1000), (q, {"shard": "2"}, 1024)])), only={"queue_checks"}).collect()
    assert [(r["status"], r["current_value"]) for r in rows] == [("Critical", "queue of 1024 on shard 2")]
    lat = "redpanda_kafka_request_latency_seconds_count"
    assert run("integrity_checks", metrics=metrics(spark, [(lat, {"request": "metadata"}, 101), (lat, {"request": "produce"}, 1000)])) == set()
    got = run("integrity_checks", metrics=metrics(spark, [
        (lat, {"request": "metadata"}, 201), (lat, {"request": "produce"}, 2000), ("vectorized_storage_log_batch_parse_errors", {}, 1), ("vectorized_storage_log_corrupted_compaction_indices", {}, 2),
        ("vectorized_memory_reclaims_operations", {}, 6000), ("redpanda_memory_reclaims_operations", {}, 4001), ("redpanda_node_status_rpcs_timed_out_total", {}, 1), ("redpanda_rpc_client_requests_blocked_memory_total", {}, 1)]))
    assert {n for n, _ in got} == {"Metadata Request Overload", "Log Storage Errors", "Compaction Index Corruption", "High Memory Reclaim Rate", "Node Status RPC Timeouts", "RPC Memory Backpressure"}
    u = "vectorized_reactor_utilization"
    others = [(u, {"shard": "1"}, 20), (u, {"shard": "2"}, 30)]
    assert run("shard0_checks", metrics=metrics(spark, [(u, {"shard": "0"}, 99, 0), (u, {"shard": "0"}, 55, 9)] + others)) == set()
    assert run("shard0_checks", metrics=metrics(spark, [(u, {"shard": "0"}, 1, 0), (u, {"shard": "0"}, 55.1, 9)] + others)) == {("Shard 0 Overload", "Warning")}
    p = A.PENDING_OPS
    assert run("pending_checks", metrics=metrics(spark, [(p, {}, 99, 0), (p, {}, 10, 5)])) == set()
    assert run("pending_checks", metrics=metrics(spark, [(p, {}, 0, 0), (p, {}, 11, 5)])) == {("Pending Partition Operations", "Warning")}


def test_connection_limit(spark):
    def go(value, cmd="redpanda"):
        cl = spark.createDataFrame([("b1", cmd)], "bundle_id string, cmdline string")
        return run("connection_limit_checks", metrics=metrics(spark, [("redpanda_rpc_active_connections", {"reactor": "3"}, value)]), command_lines=cl, broker_config=config(spark))

    name = "Network AIO Concurrency"
    assert go(8000) == {(name, "Pass")} and go(8001) == {(name, "Warning")} and go(9501) == {(name, "Critical")}
    assert go(8001, "redpanda --max-networking-io-control-blocks=50000") == {(name, "Pass")}


def test_rates(spark):
    s = A.STEAL_MS
    procs = spark.createDataFrame([("b1", "java", 50.0), ("b1", "java", 10.0), ("b1", "redpanda", 90.0), ("b1", "[kworker]", 60.0), ("b1", "idle", 5.0)], "bundle_id string, command string, cpu double")

    def steal(per_second):
        m = metrics(spark, [(s, {"shard": "1"}, 0, 0), (s, {"shard": "1"}, per_second * 10, 10), (s, {"shard": "2"}, 0, 0), (s, {"shard": "2"}, 1, 10)])
        return [(r["status"], r["current_value"], r["remediation"]) for r in A.audit(dict(metrics=m, processes=procs), only={"steal_checks"}).collect()]

    assert steal(10) == []
    assert steal(11) == [("Warning", "11.0 ms a second on shard 1", "give the broker cores of its own; busy: java x2 (avg 30.0% CPU)")]
    assert steal(1001) == [] and steal(1000)[0][0] == "Critical" and steal(20_000)[0][:2] == ("Warning", "20.0 ms a second on shard 1")
    w = "vectorized_io_queue_total_write_ops"

    def volume(rate, cloud="AWS"):
        m = metrics(spark, [(w, {"shard": "1"}, 0, 0), (w, {"shard": "1"}, rate * 5, 10), (w, {"shard": "2"}, 0, 0), (w, {"shard": "2"}, rate * 5, 10)])
        return run("volume_checks", metrics=m, uname=uname(spark, cloud=cloud), broker_config=config(spark, redpanda__write_iops="1000"))

    assert volume(700) == set() and volume(701) == {("AWS GP3 IOPS Cliff", "Warning")} and volume(701, "GCP") == set()


def observations(spark, rows):
    r = performance_report(metrics(spark, rows)).collect()[0]
    return r, " | ".join(r["observations"])


def test_performance(spark):
    u, runtime, req = "vectorized_reactor_utilization", "vectorized_scheduler_runtime_ms", "vectorized_kafka_handler_latency_microseconds_count"
    r, text = observations(spark, [(u, {"shard": "0"}, 100), (u, {"shard": "1"}, 10), (runtime, {"group": "fetch"}, 71), (runtime, {"group": "main"}, 28)])
    assert r["is_cpu_bound"] and r["workload"] == "Fetch-Heavy"
    assert "Critical: Reactor" in text and "Shard imbalance" in text and "spinning" in text
    r, text = observations(spark, [(u, {"shard": "0"}, 95), (req, {"handler": "produce"}, 71), (req, {"handler": "fetch"}, 29)])
    assert not r["is_cpu_bound"] and r["workload"] == "Produce-Heavy" and "Reactor" not in text
    r, text = observations(spark, [("vectorized_storage_log_batches_written", {}, 10), ("vectorized_storage_log_written_bytes", {}, 40_959), (u, {}, 1)])
    assert "below the 4 KB" in text and r["workload"] == "Idle"
    r, text = observations(spark, [("vectorized_storage_log_batches_written", {}, 10), ("vectorized_storage_log_written_bytes", {}, 40_960)])
    assert "Small average batch size" in text and "below the 4 KB" not in text
    io = "vectorized_io_queue_"
    r, text = observations(spark, [(io + "queue_length", {}, 51), (io + "total_operations", {}, 100), (io + "total_exec_sec", {}, 2.1)])
    assert r["is_disk_bound"] and "Critical: Slow disk" in text
    r, text = observations(spark, [(io + "queue_length", {}, 51), (io + "total_operations", {}, 100), (io + "total_exec_sec", {}, 1), (io + "total_delay_sec", {}, 2.1)])
    assert not r["is_disk_bound"] and "held back" in text
    r, text = observations(spark, [("vectorized_network_bytes_received", {}, 10), ("vectorized_network_bytes_sent", {}, 51)])
    assert r["is_network_bound"] and "Extreme" in text
    mib = 1024 * 1024
    r, text = observations(spark, [("vectorized_memory_free_bytes", {}, 100 * mib), ("vectorized_memory_allocated_bytes", {}, 900 * mib), ("vectorized_storage_batch_cache_reclaimable_bytes", {}, 201 * mib),
                                   ("vectorized_reactor_uptime", {}, 8 * 86400), ("redpanda_memory_available_memory_low_water_mark", {}, 1)])
    assert "Memory is healthy" in text and "fragmentation" in text and "almost out" in text
    r, text = observations(spark, [("vectorized_memory_free_bytes", {}, 4 * mib), ("vectorized_memory_allocated_bytes", {}, 96 * mib)])
    assert "Critical: Low effective memory" in text
    r, text = observations(spark, [(u, {}, 10), (req, {"handler": "produce"}, 1)])
    assert "Headroom" in text
    r, text = observations(spark, [("vectorized_raft_replicate_ack_all_requests", {}, 6), ("vectorized_raft_replicate_ack_leader_requests", {}, 4), ("vectorized_raft_leadership_changes", {}, 1001),
                                   ("vectorized_raft_recovery_partitions_to_recover", {}, 3), ("vectorized_host_snmp_tcp_established", {}, 50_001), ("vectorized_reactor_threaded_fallbacks", {}, 2)])
    for words in ("wait for all replicas", "Frequent leadership changes: 1001", "Recovery: 3", "High connection count", "Threaded fallbacks: 2"):
        assert words in text


def test_bottlenecks_and_summary(spark):
    sar = spark.createDataFrame([("b1", T0, 5.1, 1.0, 21.0, 50_000.0, 1.0)], "bundle_id string, ts timestamp, tcp_retrans double, tcp_in_errs double, cpu_system double, tcp_in_segs double, tcp_out_segs double")
    net = spark.createDataFrame([("b1", T0, "eth0", 80.0, 1024.0, 0.0)], "bundle_id string, ts timestamp, iface string, if_util double, rx_kb double, tx_kb double")
    st = spark.createDataFrame([("b1", 1, "disk", "4KB x", "i", 100)], "bundle_id string, node_id bigint, type string, name string, info string, throughput bigint")
    rows = A.audit(dict(metrics=metrics(spark, [("vectorized_reactor_utilization", {}, 96)]), sar=sar, sar_net=net, self_test=st), only={"bottleneck_checks"}, materialize=True)
    got = {(r["name"], r["status"]) for r in rows.collect()}
    assert {("CPU Saturation", "Critical"), ("Disk Saturation", "Pass"), ("Workload Type", "Info"), ("Observation", "Critical"), ("Observation", "Warning"), ("Observation", "Info")} == got
    assert A.audit_summary(rows).agg(F.sum("count")).first()[0] == rows.count()


def test_pods_and_consumers(spark):
    schema = ("bundle_id string, metadata struct<name:string>, spec struct<containers:array<struct<name:string,resources:struct<limits:map<string,string>,requests:map<string,string>>>>>, "
              "status struct<containerStatuses:array<struct<name:string,lastState:map<string,struct<reason:string,exitCode:int>>>>>")
    pods = spark.createDataFrame([
        ("b1", ("p",), ([("c", ({"cpu": "1"}, {"cpu": "1"}))],), ([("c", {"terminated": ("OOMKilled", 137)})],)),
        ("b1", ("q",), ([("c", ({"cpu": "1"}, {"cpu": "1000m"}))],), ([("c", {"terminated": ("Error", 1)}), ("d", {"terminated": ("Completed", 0)})],))], schema)
    assert run("pod_checks", pods=pods) == {("Pod p OOMKilled", "Critical"), ("Pod q Crash", "Critical"), ("Pod q QoS", "Warning")}


def test_home_summary(spark):
    brokers = spark.createDataFrame([("b1", 1, "r1", "v24", True), ("b1", 2, None, "v25", False)], "bundle_id string, node_id bigint, rack string, version string, in_maintenance boolean")
    health = spark.createDataFrame([("b1", True, 0, 2, [], [1, 2])], "bundle_id string, is_healthy boolean, under_replicated_count bigint, leaderless_count bigint, nodes_down array<bigint>, all_nodes array<bigint>")
    kafka = spark.createDataFrame([("b1", "t", 0, 1)], "bundle_id string, topic string, partition_id bigint, leader bigint")
    config_rows = spark.createDataFrame([("b1", "enable_rack_awareness", "true")], "bundle_id string, key string, value string")
    r = A.home_summary(brokers, health, kafka, config=config_rows).collect()[0]
    assert (r["total_brokers"], r["versions"], r["in_maintenance"], r["maintenance_nodes"], r["racks"], r["rack_awareness"], r["nodes_down"]) == (2, "v24, v25", 1, [1], {"r1": 1}, True, 0)
    assert "client metadata none" in r["discrepancy"]


def test_global_search(spark):
    from fleetlens.operators.search import global_search

    logs = spark.createDataFrame([("b1", 1, T0, "WARN", "<Topic-A> moved"), ("b1", 2, T0, "INFO", "other")], "bundle_id string, id bigint, ts timestamp, level string, message string")
    corpus = spark.createDataFrame([("b1", "Admin", "f.json", "x" * 80 + " TOPIC-a " + "y" * 80)], "bundle_id string, group string, file_name string, text string")
    k8s = spark.createDataFrame([("b1", "pods", ("my-topic-a-0",)), ("b1", "nodes", ("topic-a",))], "bundle_id string, kind string, metadata struct<name:string>")
    parts = spark.createDataFrame([("b1", "kafka", "topic-a", i, "done", 1) for i in range(30)], "bundle_id string, ns string, topic string, partition_id bigint, status string, leader_id bigint")
    rows = global_search("topic-a", logs, corpus, k8s, parts).collect()
    by = {}
    for r in rows:
        by.setdefault(r["category"], []).append(r)
    assert {k: len(v) for k, v in by.items()} == {"Logs": 1, "File: Admin": 1, "Kubernetes": 1, "Partition": 30}
    assert by["Logs"][0]["preview"] == "&lt;<mark>Topic-A</mark>&gt; moved" and "<mark>TOPIC-a</mark>" in by["File: Admin"][0]["preview"]
    assert len(by["File: Admin"][0]["preview"]) == 107 + len("<mark></mark>")


def test_samples_are_scanned_once(spark, tmp_path):
    """With several groups on metrics, their results come from the kept digest and not from the samples."""
    rows = [("b1", "n1", i, "vectorized_io_queue_queue_length", {"shard": "0"}, T0 + timedelta(seconds=i), 1100.0) for i in range(20)]
    spark.createDataFrame(rows, "bundle_id string, node string, id bigint, name string, labels map<string,string>, ts timestamp, value double").write.parquet(str(tmp_path / "samples"))
    metrics = spark.read.parquet(str(tmp_path / "samples"))
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("parquet")
    out = A.audit({"metrics": metrics})
    assert scans(out) == 0 and {r["name"] for r in out.collect()} == {"AIO Context Saturation"}
    assert scans(A.audit({"metrics": metrics}, only={"queue_checks"})) == 1 and scans(A.audit({"metrics": metrics}, materialize=False)) > 2
