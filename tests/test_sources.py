"""Readers of everything but logs, over made-up bundles."""

import json
import struct
from datetime import datetime

from pyspark.sql import functions as F

from fleetlens.operators import consumers, storage as ops
from fleetlens.sources import cluster, host, metrics, sinks, storage
from fleetlens.sources.fleet import Fleet, list_files, scan_corpus


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_prometheus(spark, fleet_dir):
    fleet_dir("b1", "metrics/n1/t0_metrics.txt", "\n".join([
        "# HELP io_ops Number of ops", "# TYPE io_ops counter", "# HELP io_ops Last text",
        'io_ops{shard="0",class="read"} 12', 'io_ops{path="a,b=\\"c\\"",shard="1"} 1.5e3', "plain 7",
        "bad NaN", "worse +Inf", "odd 1d", "", "lonely",
    ]))
    fleet = Fleet(spark, fleet_dir.root)
    got = metrics.scan_prometheus(fleet)
    assert rows(got, "bundle_id", "name", "labels", "value") == [
        ("b1", "io_ops", {"class": "read", "shard": "0"}, 12.0),
        ("b1", "io_ops", {"path": 'a,b="c"', "shard": "1"}, 1500.0),
        ("b1", "plain", {}, 7.0),
    ]
    assert got.first()["ts"] is not None
    assert rows(metrics.scan_prometheus(fleet, allowed=["plain"]), "name") == [("plain",)]
    assert rows(metrics.scan_metric_help(fleet), "bundle_id", "name", "help") == [("b1", "io_ops", "Last text")]


def test_admin_json(spark, fleet_dir):
    part = {"ns": "kafka", "topic": "t", "partition_id": 0, "status": "done", "leader_id": 1, "replicas": [{"node_id": 1, "core": 3}], "revision": 15, "new": 1}
    fleet_dir("b1", "admin/cluster_partitions.json", json.dumps([part]))
    fleet_dir("b1", "admin/partition_leader_table_a.json", '{"error": "x"}')
    fleet_dir("b1", "admin/partition_leader_table_b.json", json.dumps([{"ns": "kafka", "topic": "t", "partition_id": 0, "leader": 1}]))
    fleet_dir("b1", "admin/partition_leader_table_c.json", json.dumps([{"ns": "kafka", "topic": "t", "partition_id": 0, "leader": 2}]))
    follower = {"id": 2, "ms_since_last_heartbeat": 5, "last_flushed_log_index": -9223372036854775808}
    debug = {"replicas": [{"committed_offset": 9, "raft_state": {"node_id": 1, "term": 2, "is_elected_leader": True, "followers": [follower]}}]}
    fleet_dir("b1", "admin/debug_partition_kafka_t_7.json", json.dumps(debug))
    fleet_dir("b1", "admin/health_overview.json", '{"is_healthy":false,"leaderless_count":2,"all_nodes":[1,2]}')
    fleet_dir("b1", "admin/partition_balancer_status.json", '{"status":"stalled"}')
    fleet_dir("b1", "admin/self_test_status_1.json", '{"node_id":1,"results":[{"name":"4KB","type":"disk","throughput":5}]}')
    fleet_dir("b2", "admin/self_test_status_1.json", '[{"node_id":3,"results":[{"name":"16KB","type":"disk","throughput":6}]}]')
    fleet_dir("b1", "admin/brokers.json", json.dumps([
        {"node_id": 1, "num_cores": 4, "rack": "r1", "version": "v24.1.2", "internal_rpc_address": "host-1", "maintenance_status": {"draining": True}},
        {"node_id": 11, "num_cores": 4, "is_alive": False, "internal_rpc_address": "host-11"}]))
    fleet_dir("b1", "admin/disk_stat_data_host-11-9644.json", '{"free_bytes":1,"total_bytes":10}')
    fleet_dir("b1", "admin/disk_stat_cache_host-1-9644.json", '{"free_bytes":2,"total_bytes":20}')
    fleet_dir("b1", "admin/cluster_config.json", '{"enable_rack_awareness":true,"n":5,"l":["a"]}')
    fleet_dir("b1", "resource-usage.json", '{"cpuPercentage":1.5,"freeMemoryMB":2,"freeSpaceMB":3}')
    fleet = Fleet(spark, fleet_dir.root)
    partitions = cluster.scan_partitions(fleet)
    assert rows(cluster.partition_replicas(partitions), "bundle_id", "topic", "node_id", "core") == [("b1", "t", 1, 3)]
    assert rows(cluster.scan_leaders(fleet), "bundle_id", "leader") == [("b1", 1)]
    dbg = cluster.scan_partition_debug(fleet)
    assert rows(dbg, "ns", "topic", "partition_id") == [("kafka", "t", 7)]
    assert rows(cluster.debug_replicas(dbg), "node_id", "committed_offset", "is_leader") == [(1, 9, True)]
    assert rows(cluster.debug_followers(dbg), "follower_id", "last_flushed_log_index") == [(2, -9223372036854775808)]
    assert rows(cluster.scan_health(fleet), "is_healthy", "leaderless_count", "all_nodes") == [(False, 2, [1, 2])]
    assert rows(cluster.scan_balancer(fleet), "status") == [("stalled",)]
    assert rows(cluster.scan_self_test(fleet), "bundle_id", "node_id", "name", "throughput") == [("b1", 1, "4KB", 5), ("b2", 3, "16KB", 6)]
    brokers = cluster.scan_brokers(fleet)
    assert rows(brokers, "node_id", "is_alive", "draining", "in_maintenance") == [(1, True, True, True), (11, False, False, False)]
    matched = ops.match_hosts(cluster.scan_disk_stats(fleet), brokers)
    assert rows(matched, "kind", "node_id", "free_bytes") == [("cache", 1, 2), ("data", 11, 1)]
    assert rows(cluster.scan_cluster_config(fleet), "key", "value") == [("enable_rack_awareness", "true"), ("l", '["a"]'), ("n", "5")]
    assert rows(cluster.scan_resource_usage(fleet), "cpuPercentage") == [(1.5,)]


def test_yaml(spark, fleet_dir):
    fleet_dir("b1", "redpanda.yaml", "\n".join([
        "# head", "redpanda:", "  data_directory: /data  # here", "  developer_mode: true", "rpk:", "  tune_aio_events: false",
        "  additional_start_flags:", "    - --smp=4", "top: 1"]))
    got = cluster.scan_yaml_config(Fleet(spark, fleet_dir.root))
    assert rows(got, "key", "value") == [
        ("redpanda.data_directory", "/data"), ("redpanda.developer_mode", "true"), ("rpk.additional_start_flags.0", "--smp=4"),
        ("rpk.tune_aio_events", "false"), ("top", "1")]
    assert rows(cluster.data_directory(got), "data_dir") == [("/data",)]


def test_kafka_dump(spark, fleet_dir):
    dump = [
        {"Name": "metadata", "Response": {"Cluster": "c", "Controller": 1, "Brokers": [{"NodeID": 1, "Host": "h", "Port": 9, "Rack": None}],
         "Topics": {"t": {"Topic": "t", "Partitions": {"0": {"Partition": 0, "Leader": -1, "Replicas": [1], "ISR": [1]}, "1": {"Partition": 1, "Leader": 1}}}}}},
        {"Name": "topic_configs", "Response": [{"Name": "t", "Configs": [{"Key": "k", "Value": "v", "Synonyms": None}]}]},
        {"Name": "groups", "Response": {"g1": {"Group": "g1", "State": "Stable", "Members": [{"MemberID": "m", "Assigned": {"t": [0, 1]}}]}, "g2": {"Group": "g2", "State": "Empty"}}},
        {"Name": "high_watermarks", "Response": {"t": {"0": {"Partition": 0, "Offset": 9}}}},
        {"Name": "group_commits_g1", "Response": {"t": {"0": {"Partition": 0, "At": 4}, "1": {"Partition": 1, "At": 3}}}},
        {"Name": "group_commits_gone", "Response": {"t": {"0": {"Partition": 0, "At": 12}}}},
        {"Name": "other", "Response": "text"},
    ]
    fleet_dir("b1", "kafka.json", json.dumps(dump))
    got = cluster.scan_kafka_dump(Fleet(spark, fleet_dir.root))
    assert rows(got["metadata"], "cluster", "controller") == [("c", 1)]
    assert rows(got["brokers"], "node_id", "host", "rack") == [(1, "h", None)]
    assert rows(got["partitions"], "topic", "partition_id", "leader") == [("t", 0, -1), ("t", 1, 1)]
    assert rows(got["topic_configs"], "name", "key", "value") == [("t", "k", "v")]
    lag = consumers.consumer_lag(got["commits"], got["high_watermarks"], got["groups"])
    assert rows(lag, "group_id", "state", "total_lag") == [("g1", "Stable", 5), ("g2", "Empty", 0), ("gone", "Unknown", 0)]
    found = consumers.group_parallelism(got["members"], consumers.topic_sizes(got["partitions"]))
    assert rows(found, "group_id", "topic", "members", "partitions", "finding") == [("g1", "t", 1, 2, "under")]


def test_k8s(spark, fleet_dir):
    pod = {"metadata": {"name": "p-0", "namespace": "n"}, "spec": {"containers": [{"name": "c", "resources": {"limits": {"cpu": "2"}, "requests": {"cpu": "1"}}}]},
           "status": {"containerStatuses": [{"name": "c", "restartCount": 3, "state": {"running": {"startedAt": "2024-01-01T00:00:00Z"}},
                      "lastState": {"terminated": {"reason": "OOMKilled", "exitCode": 137, "finishedAt": "2023-12-31T23:00:00Z"}}}]}}
    event = {"type": "Warning", "reason": "R", "message": "m", "count": 2, "lastTimestamp": "2024-01-01T00:00:00Z", "involvedObject": {"kind": "Pod", "name": "p-0"}, "source": {"component": "kubelet"}}
    fleet_dir("b1", "k8s/pods.json", json.dumps({"kind": "List", "items": [pod]}))
    fleet_dir("b1", "k8s/events.json", json.dumps({"kind": "List", "items": [event]}))
    from fleetlens.operators import events

    res = cluster.scan_k8s(Fleet(spark, fleet_dir.root))
    pods = cluster.k8s_kind(res, "pods")
    assert rows(events.pod_restarts(pods), "pod", "restarts") == [("p-0", 3)]
    line = events.pod_timeline(pods)
    assert rows(line, "ts", "description", "severity") == [
        (datetime(2023, 12, 31, 23), "Pod Terminated: OOMKilled", "Critical"), (datetime(2024, 1, 1), "Pod Started (Running)", "Normal")]
    ev = cluster.k8s_events(res)
    assert rows(ev, "type", "count", "involved_name", "source_component") == [("Warning", 2, "p-0", "kubelet")]
    assert rows(events.k8s_timeline(ev), "source", "description", "details") == [("Pod/p-0", "R: m", "Source: kubelet\nCount: 2")]


def test_cpu_profiles(spark, fleet_dir):
    sample = {"user_backtrace": "0x1", "occurrences": 3}
    shard = {"shard_id": 2, "samples": [{**sample, "group": "main"}, sample]}
    fleet_dir("b1", "admin/cpu_profile_https---host.-9644.json", json.dumps({"profile": [shard]}))
    fleet_dir("b1", "admin/cpu_profile_two.json", json.dumps([{"profile": [shard]}]))
    fleet_dir("b1", "admin/cpu_profile_three.json", json.dumps([shard]))
    got = cluster.scan_cpu_profiles(Fleet(spark, fleet_dir.root))
    assert rows(got, "node", "shard_id", "scheduling_group", "occurrences") == [
        (n, 2, g, 3) for n in ("host", "three", "two") for g in ("main", "unknown")]


def test_storage_files(spark, fleet_dir):
    fleet_dir("b1", "utils/du.txt", "du: cannot read\n1.5K\t/d/kafka/t/0_15\n4.0K /d/kafka/t\nbad\n")
    fleet_dir("b1", "data-dir.txt", json.dumps({"/d/kafka/t/0_15/0-1-v1.log": {"size_bytes": 10}, "/d/kafka/t/0_9/0-1-v1.log": {"size_bytes": 4}, "/d/kafka/gone/0_1/0-1-v1.log": {"size_bytes": 5}, "/d/x": {"size_bytes": 1}}))
    fleet = Fleet(spark, fleet_dir.root)
    assert rows(storage.scan_du(fleet), "path", "size_bytes") == [("/d/kafka/t", 4096), ("/d/kafka/t/0_15", 1536)]
    parts = spark.createDataFrame([("b1", "t", 0, 15)], "bundle_id string, topic string, partition_id bigint, revision bigint")
    topics = ops.storage_by_topic(storage.scan_data_dir(fleet), parts)
    assert rows(topics, "topic", "active", "segment_count", "size_bytes", "stale_bytes", "data_dir") == [("gone", False, 1, 5, 5, "/d"), ("t", True, 2, 14, 4, "/d")]
    assert rows(ops.storage_summary(topics), "active_count", "orphaned_count") == [(1, 1)]
    assert rows(ops.disk_rollup(storage.scan_du(fleet), topics), "topic", "total_bytes", "active") == [("gone", 5, False), ("t", 5632, True)]


def batch(offset, records, kind=1, attributes=0, payload=b"abc", length=None):
    size = 61 + len(payload) if length is None else length
    return struct.pack("<Iiqbihiqqqhii", 7, size, offset, kind, -5, attributes, records - 1, 1000, 2000, -1, -1, -1, records) + payload


def test_segments_and_snapshots(spark, fleet_dir):
    good = batch(0, 3) + batch(3, 2, kind=2, attributes=4, payload=b"") + batch(5, 1, kind=9, attributes=7) + b"\0" * 200
    fleet_dir("b1", "data/kafka/t/0_1/0-1-v1.log", good)
    fleet_dir("b1", "data/kafka/t/0_1/9-1-v1.log", batch(9, 1) + batch(10, 1, length=20))
    fleet_dir("b1", "data/kafka/t/0_1/short-1-v1.log", b"abc")
    fleet_dir("b1", "data/kafka/t/0_1/snapshot", struct.pack("<IIbIqq", 4000000000, 2, 1, 3, -1, 5) + b"rest")
    fleet_dir("b2", "data/kafka/t/0_1/snapshot", b"tiny")
    fleet = Fleet(spark, fleet_dir.root)
    got = storage.scan_segments(fleet)
    assert [(r["base_offset"], r["max_offset"], r["type_name"], r["compression"], r["crc"]) for r in got.filter("error is null").orderBy("base_offset").collect()] == [
        (0, 2, "Raft Data", "None", -5), (3, 4, "Raft Config", "Zstd", -5), (5, 5, "9", "Unknown(7)", -5), (9, 9, "Raft Data", "None", -5)]
    assert rows(got.filter("error is not null"), "error") == [("invalid batch length 20 at 64",), ("short header at 0",)]
    total = ops.segment_summary(got.filter("error is null"))
    assert rows(total, "type_name", "compression", "batches", "records") == [("9", "Unknown(7)", 1, 1), ("Raft Config", "Zstd", 1, 2), ("Raft Data", "None", 2, 4)]
    snaps = storage.scan_snapshots(fleet)
    assert rows(snaps.filter("error is null"), "header_crc", "header_version", "metadata_size", "last_included_index", "last_included_term") == [(4000000000, 1, 3, -1, 5)]
    assert rows(snaps.filter("error is not null"), "bundle_id", "size_bytes") == [("b2", 4)]


def test_host_facts(spark, fleet_dir):
    fleet_dir("b1", "utils/sysctl.txt", "vm.swappiness = 1\nnet.ipv4.tcp_rmem = 1 2 3\nfs.aio-max-nr=5\n")
    fleet_dir("b1", "proc/meminfo", "MemTotal: 9 kB\nShmem:  10 kB\nActive: 2 kB\nActive(anon): 3 kB\n")
    fleet_dir("b1", "proc/cpuinfo", "model name\t: X\nflags\t\t: fpu avx sse4_2\nmodel name\t: Y\n")
    fleet_dir("b1", "utils/free.txt", "       total used\nMem:  100 60 10 1 30 40\nSwap: 5 0 5\n")
    fleet_dir("b1", "utils/dmidecode.txt", "BIOS Information\n\tVendor: V\n\nSystem Information\n\tManufacturer: VMware, Inc.\n\tProduct Name: P\n")
    fleet_dir("b1", "sys/kernel/mm/transparent_hugepage/enabled", "always [madvise] never\n")
    fleet_dir("b1", "utils/dig.txt", ";; ->>HEADER<<- opcode: QUERY, status: NOERROR, id: 1\n")
    fleet_dir("b1", "utils/ntp.txt", '{"host":"pool","offset":12}')
    fleet_dir("b1", "proc/12/cmdline", b"/opt/redpanda\0--smp\x004")
    fleet_dir("b1", "proc/cmdline", "BOOT_IMAGE=x")
    fleet_dir("b1", "utils/uname.txt", "Linux db-0 4.18.0-1.el8.x86_64 #1 SMP Mon x86_64 x86_64 GNU/Linux\n")
    fleet_dir("b2", "utils/uname.txt", "Linux ip.compute.internal 6.1.0-amzn2023.x #2 SMP aarch64\n")
    fleet_dir("b1", "utils/top.txt", "top - 1:00 up, load average: 1.5, 2.0, 3.25\n\n  PID USER PR NI VIRT RES SHR S %CPU %MEM TIME+ COMMAND\n 7 root 20 0 1 1 1 S 12.5 1.0 0:01 java -jar x\n")
    facts = host.scan_host_facts(Fleet(spark, fleet_dir.root)).cache()
    got = {(r["bundle_id"], r["source"], r["key"]): r["value"] for r in facts.collect()}
    expect = {
        ("sysctl", "vm.swappiness"): "1", ("sysctl", "net.ipv4.tcp_rmem"): "1 2 3", ("sysctl", "fs.aio-max-nr"): "5",
        ("meminfo", "Shmem"): "10240", ("meminfo", "Active"): "2048", ("cpuinfo", "model name"): "X", ("free", "mem_total"): "102400",
        ("free", "mem_available"): "40960", ("free", "swap_free"): "5120", ("dmi", "bios_vendor"): "V", ("dmi", "manufacturer"): "VMware, Inc.",
        ("dmi", "product"): "P", ("thp", "enabled"): "always [madvise] never", ("dig", "status"): "NOERROR", ("ntp", "host"): "pool", ("ntp", "offset"): "12",
        ("cmdline", "cmdline"): "/opt/redpanda --smp 4", ("top", "load_1m"): "1.5", ("top", "load_15m"): "3.25",
    }
    assert {k: got.get(("b1", *k)) for k in expect} == expect
    assert rows(host.cpu_flags(facts), "flags") == [(["avx", "sse4_2"],)]
    assert rows(host.uname_facts(facts), "bundle_id", "distro", "machine", "operating_system", "is_container", "cloud", "version") == [
        ("b1", "RHEL/CentOS 8", "x86_64", "GNU/Linux", True, "", "#1 SMP Mon"),
        ("b2", "Amazon Linux 2023", "aarch64", "Linux", False, "AWS", "#2 SMP")]
    procs = host.scan_processes(Fleet(spark, fleet_dir.root))
    assert rows(procs, "pid", "cpu", "command") == [("7", 12.5, "java -jar x")]


def test_host_tables(spark, fleet_dir):
    fleet_dir("b1", "utils/df.txt", "Filesystem Type 1K-blocks Used Available Use% Mounted on\n/dev/sda ext4 10 4 6 40% /\n")
    fleet_dir("b2", "proc/mounts", "/dev/sdb /data xfs rw 0 0\n")
    fleet_dir("b1", "proc/mounts", "/dev/sda / ext4 rw 0 0\n")
    fleet_dir("b1", "utils/ss.txt", "Netid State Recv-Q Send-Q Local Peer\ntcp ESTAB 0 1 10.0.0.1:9092 10.0.0.2:5\n\t cubic rto:204 rtt:0.5/0.25 mss:1448 cwnd:10 ssthresh:7 retrans:0/77 users:((\"rp\",pid=1))\nTIME-WAIT 0 0 10.0.0.1:9092 10.0.0.3:6\nnoise\n")
    fleet_dir("b1", "utils/lsblk.txt", "NAME KNAME TYPE SIZE MOUNTPOINT\nsda sda disk 20G\n└─sda1 sda1 part 19G /\n")
    fleet_dir("b2", "utils/lsblk.txt", '{"blockdevices":[{"name":"nvme0n1","type":"disk","size":"1T","mountpoint":"/d"}]}')
    fleet_dir("b1", "utils/ip.txt", "1: lo: <LOOPBACK,UP> mtu 65536 qdisc\n    inet 127.0.0.1/8 scope host\n    inet6 ::1/128 scope\n2: eth0: <UP> mtu 9001\n")
    fleet_dir("b1", "proc/mdstat", "Personalities : [raid1]\nmd0 : active raid1 sdb1[1] sda1[0]\n      123 blocks super 1.2 [2/1] [_U]\nunused devices: <none>\n")
    fleet_dir("b1", "proc/interrupts", "      CPU0  CPU1\n 1:  5  6  PCI-MSI 52-edge nvme0q1\nERR: 0\nNMI: 1 2 Non-maskable\n")
    fleet_dir("b1", "proc/softirqs", "      CPU0  CPU1\nNET_RX:  500  600\n")
    fleet_dir("b1", "utils/vmstat.txt", "procs memory\n r b swpd free buff cache si so bi bo in cs us sy id wa st\n 2 1 0 0 0 0 0 0 0 0 0 0 1 1 90 8 0\n 4 0 0 0 0 0 0 0 0 0 0 0 1 1 90 2 0\n")
    fleet_dir("b1", "utils/syslog.txt", "<4>[25850749.679985] prometheus invoked oom-killer: gfp_mask=0\nother\n")
    fleet_dir("b1", "core.123", "x" * 9)
    fleet = Fleet(spark, fleet_dir.root)
    assert rows(host.scan_filesystems(fleet), "bundle_id", "mount_point", "type", "total", "use_percent") == [("b1", "/", "ext4", 10240, "40%"), ("b2", "/data", "xfs", 0, "-")]
    sockets = host.scan_sockets(fleet)
    assert sorted(map(tuple, sockets.select("netid", "state", "local_addr", "peer_addr", "retrans_total", "rtt", "cwnd").collect()), key=str) == [
        ("tcp", "ESTAB", "10.0.0.1:9092", "10.0.0.2:5", 77, 0.5, 10), ("tcp", "TIME-WAIT", "10.0.0.1:9092", "10.0.0.3:6", None, None, None)]
    assert rows(ops.connection_summary(sockets), "kind", "name", "count") == [("port", "9092", 2), ("state", "ESTAB", 1), ("state", "TIME-WAIT", 1)]
    assert sorted(map(tuple, host.scan_block_devices(fleet).collect()), key=str) == [
        ("b1", "sda", "disk", "20G", None), ("b1", "sda1", "part", "19G", "/"), ("b2", "nvme0n1", "disk", "1T", "/d")]
    assert rows(host.scan_interfaces(fleet), "name", "flags", "mtu", "addresses") == [("eth0", "UP", 9001, []), ("lo", "LOOPBACK,UP", 65536, ["127.0.0.1/8", "::1/128"])]
    assert rows(host.scan_raid(fleet), "name", "state", "devices", "blocks", "status") == [("md0", "active raid1", ["sdb1[1]", "sda1[0]"], 123, "[_U]")]
    assert rows(host.scan_irqs(fleet), "irq_id", "counts", "controller", "device") == [("1", [5, 6], "PCI-MSI", "52-edge nvme0q1"), ("NMI", [1, 2], "Non-maskable", "Non-maskable")]
    assert rows(host.scan_irqs(fleet, "softirqs"), "irq_id", "counts") == [("NET_RX", [500, 600])]
    assert rows(host.scan_vmstat(fleet), "samples", "avg_runnable", "max_blocked", "avg_iowait") == [(2, 3.0, 1, 5.0)]
    assert rows(host.scan_oom(fleet), "kernel_time", "process") == [("25850749.679985", "prometheus")]
    assert rows(list_files(fleet, "core.*"), "file_name", "length") == [("core.123", 9)]


def test_sar(spark, fleet_dir):
    fleet_dir("b1", "utils/sar.txt", "\n".join([
        "Linux 5.15.0 (h)  02/12/26  _x86_64_ (8 CPU)", "", "00:00:01 CPU %user %nice %system %iowait %steal %idle",
        "00:10:01 all 5.0 0.0 25.0 0.1 0.0 92.9", "00:10:01 0 1 1 1 1 1 1", "Average: all 5.0 0.0 2.0 0.1 0.0 92.9",
        "00:00:01 kbmemfree kbmemused %memused", "00:10:01 100 200 66.67",
        "00:00:01 IFACE rxpck/s txpck/s rxkB/s txkB/s rxcmp/s txcmp/s rxmcst/s %ifutil", "00:10:01 lo 1 1 9999 9999 0 0 0 0.0", "00:10:01 eth0 1 2 1024 2048 0 0 3 81.5",
        "00:00:01 active/s passive/s iseg/s oseg/s", "00:10:01 1 2 30000 30001", "00:00:01 atmptf/s estres/s retrans/s isegerr/s orsts/s", "00:10:01 0 0 5.5 1.0 0"]))
    samples, net = host.scan_sar(Fleet(spark, fleet_dir.root))
    r = samples.collect()
    assert len(r) == 1 and r[0]["ts"] == datetime(2026, 2, 12, 0, 10, 1)
    assert (r[0]["cpu_system"], r[0]["cpu_idle"], r[0]["mem_used_pct"], r[0]["tcp_in_segs"], r[0]["tcp_retrans"], r[0]["tcp_in_errs"]) == (25.0, 92.9, 66.67, 30000.0, 5.5, 1.0)
    assert rows(net, "iface", "rx_kb", "if_util") == [("eth0", 1024.0, 81.5), ("lo", 9999.0, 0.0)]
    from fleetlens.operators import metrics as m

    assert rows(m.sar_peak_throughput(net), "peak_mbps") == [(3.0,)]
    two = "\n".join(f"Linux 5.15.0 (h)  02/{day}/26  _x86_64_ (8 CPU)\n00:00:01 CPU %user %nice %system %iowait %steal %idle\n00:10:01 all 5.0 0.0 {day}.0 0.1 0.0 92.9" for day in (12, 13))
    fleet_dir("b2", "utils/sar.txt", two)
    both = host.scan_sar(Fleet(spark, fleet_dir.root))[0].filter("bundle_id = 'b2'")
    assert rows(both, "ts", "cpu_system") == [(datetime(2026, 2, 12, 0, 10, 1), 12.0), (datetime(2026, 2, 13, 0, 10, 1), 13.0)]
    health = m.network_health(samples, net).collect()[0]
    assert (health["max_retrans"], health["avg_retrans"], health["max_if_util"], health["peak_mbps"], health["interrupt_storm"]) == (5.5, 5.5, 81.5, 3.0, True)
    assert [f.split(":")[0] for f in health["findings"]] == ["Critical", "Critical", "TCP input errors", "Possible interrupt storm"]


def test_corpus(spark, fleet_dir):
    fleet_dir("b1", "admin/x.json", '{"a":1}')
    fleet_dir("b1", "admin/y.json", "{broken")
    fleet_dir("b1", "utils/z.txt", "text")
    got = scan_corpus(Fleet(spark, fleet_dir.root))
    assert [tuple(r) for r in got.select("group", "file_name", "error").orderBy("file_name").collect()] == [
        ("Admin", "x.json", None), ("Admin", "y.json", "not valid JSON"), ("Utils", "z.txt", None)]


def test_sinks(spark, tmp_path):
    cols = "bundle_id string, id bigint, ts timestamp, level string, node string, component string, message string, file_path string, line_number bigint, note string, created_at bigint"
    data = [("b1", 1, datetime(2024, 1, 1, 1), "WARN", "n", "c", "first", "/f/a.log", 4, "why", 20), ("b1", 2, datetime(2024, 1, 2), "INFO", "n", "c", "second", "/f/a.log", 5, "", 10)]
    df = spark.createDataFrame(data, cols)
    sinks.write_table(df, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.filter("bundle_id = 'b1' and dt = date'2024-01-02'").count() == 1
    sinks.export_notebook(df, str(tmp_path / "n"))
    text = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "n"), wholetext=True).select("value").collect())
    assert text.index("## 1. 2024-01-02 00:00:00.000 [INFO]") < text.index("## 2. 2024-01-01") and "### Engineer Notes\nwhy" in text and "a.log:4" in text
    sinks.write_json(df.select("id"), str(tmp_path / "j"))
    assert rows(spark.read.json(str(tmp_path / "j")), "id") == [(1,), (2,)]
    assert sinks.to_json_rows(df.select("id")).count() == 2
    assert F is not None


def test_yaml_shapes():
    walk = cluster.yaml_walker()
    text = "\n".join([
        "# c", "redpanda:", "    empty_parent:", "    data_directory: /var/lib  # note", "    seed_servers:", "    - host:", "        address: 10.0.0.1", "        port: 33145", "    - host: {a: 1}",
        "    advertised_kafka_api:", "      - address: \"8.8.8.8\"", "        port: 9092", "      - name: 'x # y'", "        address: h#1", "    motd: |", "      a: b", "      c", "rpk:", "  list:", "  - one", "  - two", "  url: http://x:1"])
    assert walk(text) == [
        ("redpanda.data_directory", "/var/lib"), ("redpanda.seed_servers.0.host.address", "10.0.0.1"), ("redpanda.seed_servers.0.host.port", "33145"), ("redpanda.seed_servers.1.host", "{a: 1}"),
        ("redpanda.advertised_kafka_api.0.address", "8.8.8.8"), ("redpanda.advertised_kafka_api.0.port", "9092"), ("redpanda.advertised_kafka_api.1.name", "x # y"), ("redpanda.advertised_kafka_api.1.address", "h#1"),
        ("redpanda.motd", "a: b\nc"), ("rpk.list.0", "one"), ("rpk.list.1", "two"), ("rpk.url", "http://x:1")]
    assert walk("") == [] and walk("just text\n- 1\n") == [("0", "1")]


def test_advertised_address_of_a_file(spark, fleet_dir):
    from fleetlens.plans.audit import audit

    fleet_dir("b1", "redpanda.yaml", "redpanda:\n  empty:\n  advertised_kafka_api:\n  - address: 8.8.8.8\n    port: 9092\n")
    fleet_dir("b1", "admin/cluster_config.json", '{"auto_create_topics_enabled": true}')
    fleet = Fleet(spark, fleet_dir.root)
    uname = spark.createDataFrame([("b1", "x", "AWS", False)], "bundle_id string, distro string, cloud string, is_container boolean")
    brokers = spark.createDataFrame([], "bundle_id string, host string")
    tables = dict(broker_config=cluster.scan_yaml_config(fleet), cluster_config=cluster.scan_cluster_config(fleet), uname=uname, kafka_brokers=brokers)
    found = {r["name"]: r["status"] for r in audit(tables, only={"public_address_checks", "config_checks"}).collect()}
    assert found["Public Advertised Addresses"] == "Warning" and found["auto_create_topics_enabled"] == "Warning"


def test_nodes_are_series_of_their_own(spark, fleet_dir):
    from fleetlens.plans.audit import series_rates
    from fleetlens.plans.performance import metric_digest
    from fleetlens.sources.metrics import scan_prometheus

    fleet_dir("b1", "metrics/n1/t0_metrics.txt", 'c{shard="0"} 1\n')
    fleet_dir("b1", "metrics/n2/t0_metrics.txt", 'c{shard="0"} 1000000\n')
    fleet_dir("b1", "metrics/t0_metrics.txt", 'c{shard="0"} 5\n')
    fleet_dir("b2", "metrics/t0_metrics.txt", 'c{shard="0"} 7\n')
    got = scan_prometheus(Fleet(spark, fleet_dir.root))
    assert rows(got, "bundle_id", "node", "value") == [("b1", "n1", 1.0), ("b1", "n2", 1000000.0), ("b2", "", 7.0)]
    later = got.withColumn("ts", F.col("ts") + F.expr("INTERVAL 10 SECONDS")).withColumn("value", F.col("value") + 10)
    rates = series_rates(metric_digest(got.unionByName(later), ["c"]), "c")
    assert rows(rates, "bundle_id", "node", "rate") == [("b1", "n1", 1.0), ("b1", "n2", 1.0), ("b2", "", 1.0)]


def test_sections_at_any_split(spark, fleet_dir):
    """Sections and entries that begin in an earlier block: the same rows at every split size."""
    head = "Linux 5.15.0 (db-0) 01/02/24 _x86_64_ (4 CPU)\n\n"
    cpu = "00:00:01 CPU %user %nice %system %iowait %steal %idle\n" + "".join(f"00:{m:02d}:01 all {m}.5 0.0 25.0 1.0 0.0 50.0\n" for m in range(60))
    net = "00:00:01 IFACE rxpck/s txpck/s rxkB/s txkB/s rxcmp/s txcmp/s rxmcst/s %ifutil\n" + "".join(f"00:{m:02d}:01 eth0 1.0 2.0 {m} 1024 0 0 3.0 4.0\n" for m in range(60))
    fleet_dir("b1", "utils/sar.txt", head + cpu + "\n" + net)
    fleet_dir("b1", "utils/ss.txt", "Netid State Recv-Q Send-Q Local Peer\n" + "".join(f"tcp ESTAB 0 1 10.0.0.{i}:9 10.0.0.2:5\n\t cubic rto:204\n\t retrans:0/{i} mss:1448\n" for i in range(90)))
    fleet_dir("b1", "utils/ip.txt", "".join(f"{i}: eth{i}: <UP> mtu {i}\n    inet 10.0.0.{i}/8 scope\n    inet6 ::{i}/64 scope\n" for i in range(50)))
    old, found = spark.conf.get("spark.sql.files.maxPartitionBytes"), []
    try:
        for split in (150, 1000, 1 << 27):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            fleet = Fleet(spark, fleet_dir.root)
            sar, links = host.scan_sar(fleet)
            found.append([sorted(map(str, df.collect())) for df in (sar, links, host.scan_sockets(fleet), host.scan_interfaces(fleet))])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert found[0] == found[2] and found[1] == found[2] and [len(rows) for rows in found[0]] == [60, 60, 90, 50]


def test_large_notebook_is_written_by_many_tasks(spark, tmp_path):
    """One bundle with nearly all pins: numbers without gaps, and files that give the sections in order."""
    df = spark.range(20_000).selectExpr(
        "if(id = 7, 'b2', 'b1') AS bundle_id", "id", "timestamp '2024-01-01 00:00:00' AS ts", "'WARN' AS level", "'n' AS node", "'c' AS component", "concat('m', id) AS message", "'/x/f.log' AS file_path",
        "id AS line_number", "'' AS note", "20000 - id AS created_at")
    sinks.export_notebook(df, str(tmp_path / "n"))
    files = sorted((tmp_path / "n" / "bundle_id=b1").glob("part-*"))
    numbers = [int(line[3:].split(".")[0]) for f in files for line in f.read_text().splitlines() if line.startswith("## ")]
    messages = [int(line[1:]) for f in files for line in f.read_text().splitlines() if line[:1] == "m"]
    assert len(files) >= 6 and numbers == list(range(1, 20_000)) and messages == [i for i in range(19_999, -1, -1) if i != 7]
    assert files[0].read_text().startswith("# Debug Notebook") and "## 1. " in next((tmp_path / "n" / "bundle_id=b2").glob("part-*")).read_text()


def test_large_listing_is_split(spark, fleet_dir):
    """One JSON document on one line, and one on many, are read by several tasks; odd entries keep their meaning."""
    paths = {f"/data/kafka/t-{i % 50}/{i}_1/0-1-v1.log": {"size_bytes": i, "mode": "rw"} for i in range(60_000)}
    odd = {'/a "q" \u00e9\\n': {"size_bytes": 3}, "/none": {"mode": "x"}, "/empty": {}}
    fleet_dir("b1", "data-dir.txt", json.dumps(paths | odd))
    fleet_dir("b2", "data-dir.txt", json.dumps(dict(list(paths.items())[:500]), indent=2))
    fleet_dir("b3", "data-dir.txt", "no listing")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500000")
    try:
        df = storage.scan_data_dir(Fleet(spark, fleet_dir.root))
        got = df.collect()
        assert df.rdd.getNumPartitions() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    expected = {("b1", p, v.get("size_bytes", 0)) for p, v in (paths | odd).items()} | {("b2", p, v["size_bytes"]) for p, v in list(paths.items())[:500]}
    assert len(got) == len(expected) and {tuple(r) for r in got} == expected


def test_segment_payloads_are_not_read(spark, fleet_dir):
    """Headers of a file of 300 MB (a sparse one) by reads of 61 bytes; the same rows as from its content."""
    header = lambda base, length: storage.HEADER.pack(1, length, base, 1, 2, 4, 9, 1000, 2000, 5, 6, 7, 10)
    path = fleet_dir("b 1", "data/kafka/t/0_1/0-1-v1.log", b"")
    with open(path, "r+b") as f:
        for k in range(3):
            f.seek(k * 100_000_000)
            f.write(header(k * 10, 100_000_000))
        f.truncate(300_000_000)
    reads = []

    def read(at, n):
        reads.append(n)
        with open(path, "rb") as f:
            f.seek(at)
            return f.read(n)

    assert [f[2] for f, _ in storage.walk_headers(read, 300_000_000)] == [0, 10, 20] and reads == [61, 61, 61]
    got = storage.scan_segments(Fleet(spark, fleet_dir.root)).orderBy("batch_no").collect()
    assert [(r["bundle_id"], r["base_offset"], r["max_offset"], r["compression"], r["error"]) for r in got] == [(got[0]["bundle_id"], k * 10, k * 10 + 9, "Zstd", None) for k in range(3)]
    fleet_dir("b2", "data/kafka/t/0_1/0-1-v1.log", header(0, 70) + b"x" * 9 + header(10, 61) + b"short")
    one, two = (sorted(map(str, storage.scan_segments(Fleet(spark, fleet_dir.root), ranges=r).filter("bundle_id = 'b2'").collect())) for r in (True, False))
    assert one == two and len(one) == 3 and "short header at 131" in one[-1]
