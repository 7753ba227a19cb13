"""A small fleet on disk, from files to findings."""

import json

from fleetlens.operators.search import global_search
from fleetlens.plans.audit import home_summary
from fleetlens.plans.fleet_audit import audit_fleet, load_tables
from fleetlens.sources.fleet import Fleet, scan_corpus


def write_bundle(write, name: str, healthy: bool):
    write(name, "redpanda.log", "INFO  2024-01-01 00:00:01,250 [shard 0:main] main - Welcome to Redpanda v24.1.2\n" + ("" if healthy else "WARN  2024-01-01 00:00:02,250 [shard 0:main] seastar - Reactor stalled for 45 ms\n"))
    write(name, "metrics/n1/t0_metrics.txt", 'vectorized_reactor_utilization{shard="0"} %d\n' % (10 if healthy else 100))
    write(name, "utils/sysctl.txt", "vm.swappiness = %d\n" % (1 if healthy else 60))
    write(name, "utils/uname.txt", "Linux db-0 5.15.0 #1 SMP x86_64 GNU/Linux\n")
    write(name, "utils/df.txt", "Filesystem Type 1K-blocks Used Available Use%% Mounted on\n/dev/sda xfs 10 4 6 %d%% /data\n" % (40 if healthy else 97))
    write(name, "admin/health_overview.json", json.dumps({"is_healthy": healthy, "under_replicated_count": 0 if healthy else 3, "leaderless_count": 0, "nodes_down": [], "all_nodes": [1, 2]}))
    write(name, "admin/cluster_partitions.json", json.dumps([{"ns": "kafka", "topic": "t", "partition_id": 0, "status": "done", "leader_id": 1, "replicas": [{"node_id": 1, "core": 0}] + ([{"node_id": 2, "core": 0}] if healthy else []), "revision": 1}]))
    write(name, "admin/partition_leader_table_1.json", json.dumps([{"ns": "redpanda", "topic": "controller", "partition_id": 0, "leader": 1, "last_stable_leader_term": 2}]))
    write(name, "admin/brokers.json", json.dumps([{"node_id": n, "num_cores": 4, "version": "v24.1.2"} for n in (1, 2)]))
    write(name, "data-dir.txt", json.dumps({"/data/kafka/t/0_1/0-1-v1.log": {"size_bytes": 10}}))
    write(name, "redpanda.yaml", "redpanda:\n  data_directory: /link\n  developer_mode: %s\n" % str(not healthy).lower())
    if not healthy:
        write(name, "core.77", "x")


def test_audit_fleet(spark, fleet_dir):
    write_bundle(fleet_dir, "good", True)
    write_bundle(fleet_dir, "bad", False)
    fleet = Fleet(spark, fleet_dir.root)
    rows = audit_fleet(fleet).collect()
    status = {(r["bundle_id"], r["name"]): r["status"] for r in rows}
    expected = {
        "Reactor Stalls in Logs": (None, "Warning"), "CPU Saturation": ("Pass", "Critical"), "vm.swappiness": ("Pass", "Warning"), "/data Filesystem": ("Pass", "Pass"),
        "/data": (None, "Critical"), "Under Replicated Partitions": ("Pass", "Critical"), "Empty Node (ID 2)": (None, "Warning"), "Controller Leader": ("Pass", "Pass"),
        "developer_mode": ("Pass", "Warning"), "Core Dumps Found": ("Pass", "Critical"), "Data Directory on Root": (None, None), "OOM Killer Invoked": ("Pass", "Pass"),
    }
    assert {name: (status.get(("good", name)), status.get(("bad", name))) for name in expected} == expected
    tables = load_tables(fleet)
    assert {(r["bundle_id"], r["version"]) for r in tables["versions"].collect()} == {("good", "v24.1.2"), ("bad", "v24.1.2")}
    home = {r["bundle_id"]: r for r in home_summary(tables["brokers"], tables["health"], tables["kafka_partitions"], tables["kafka_brokers"], tables["cluster_config"]).collect()}
    assert home["good"]["total_brokers"] == 2 and home["bad"]["versions"] == "v24.1.2" and home["bad"]["is_healthy"] is False
    found = global_search("swappiness", tables["logs"], scan_corpus(fleet), tables["k8s"], tables["partitions"]).collect()
    assert {(r["bundle_id"], r["category"], r["title"]) for r in found} == {(b, "File: Utils", "sysctl.txt") for b in ("good", "bad")}
