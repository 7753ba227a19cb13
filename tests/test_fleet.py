"""The listing of a fleet: once, pruned by path, and the same readers over tables."""

from pyspark.sql import functions as F

from fleetlens.plans.fleet_audit import audit_fleet, load_tables
from fleetlens.sources import cluster, host, logs, metrics
from fleetlens.sources.fleet import Fleet, TableFleet, glob_pattern, list_files
from tests.test_fleet_audit import write_bundle


def test_globs():
    import re

    def hits(glob, *names):
        return [n for n in names if re.fullmatch(glob_pattern(glob), n)]

    assert hits("admin/*.json", "admin/a.json", "admin/b/a.json", "admin/ajson") == ["admin/a.json"]
    assert hits("*.{csv,CSV}", "a.csv", "b.CSV", "c.cSv") == ["a.csv", "b.CSV"]
    assert hits("[!.]*.l?g", "a.log", ".a.log", "a.lg") == ["a.log"] and hits("a+b(c)", "a+b(c)", "aab(c)") == ["a+b(c)"] and hits("a,b", "a,b") == ["a,b"]


def test_a_fleet_is_listed_once(spark, fleet_dir):
    """All tables of the audit come from one listing per kind of read (bytes before, lines and records here); later files belong to a new fleet."""
    for name in ("good", "bad"):
        write_bundle(fleet_dir, name, name == "good")
    fleet_dir("good", "admin/deep/er/brokers.json", "[]")
    fleet = Fleet(spark, fleet_dir.root)
    files = fleet.manifest().count()
    counter = spark._jvm.org.apache.spark.metrics.source.HiveCatalogMetrics.METRIC_FILES_DISCOVERED()
    before = counter.getCount()
    tables = load_tables(fleet, materialize=False)
    for name in ("brokers", "facts", "filesystems", "broker_config", "core_dumps", "logs", "metrics"):
        tables[name].collect()
    assert counter.getCount() - before == 2 * files
    fleet_dir("good", "core.99", "x")
    assert list_files(fleet, "core.*").count() == 1 and list_files(Fleet(spark, fleet_dir.root), "core.*").count() == 2


def test_only_matching_files_are_opened(spark, fleet_dir):
    for i in range(12):
        fleet_dir(f"b{i}", "admin/brokers.json", "[]")
        fleet_dir(f"b{i}", "logs/n.log", "x\n")
    df = Fleet(spark, fleet_dir.root).binary("logs/*.log")
    df.collect()
    scan = df._jdf.queryExecution().executedPlan()
    while scan.children().size():
        scan = scan.children().apply(0)
    assert scan.metrics().apply("numFiles").value() == 12


def test_manifest(spark, fleet_dir):
    fleet_dir("b 1", "utils/db-0/sysctl.txt", "vm.swappiness = 1\n")
    fleet_dir("b2", "redpanda.log", "x")
    got = {(r["bundle_id"], r["node"], r["kind"], r["file_name"], r["length"]) for r in Fleet(spark, fleet_dir.root).manifest().collect()}
    assert {g[1:] for g in got} == {("db-0", "utils", "sysctl.txt", 18), ("", "", "redpanda.log", 1)}


def test_two_nodes_of_a_bundle(spark, fleet_dir):
    """Settings of both nodes are judged, each under its own name."""
    write_bundle(fleet_dir, "b1", True)
    fleet_dir("b1", "utils/db-1/sysctl.txt", "vm.swappiness = 60\n")
    fleet_dir("b1", "utils/db-1/uname.txt", "Linux db-1 5.15.0 #1 SMP x86_64 GNU/Linux\n")
    fleet = Fleet(spark, fleet_dir.root)
    facts = host.scan_host_facts(fleet)
    assert {(r["node"], r["value"]) for r in facts.filter("key = 'vm.swappiness'").collect()} == {("", "1"), ("db-1", "60")}
    found = {(r["description"], r["status"]) for r in audit_fleet(fleet).filter("name = 'vm.swappiness'").collect()}
    assert found == {("kernel setting", "Pass"), ("kernel setting of db-1", "Warning")}
    assert host.uname_facts(facts).count() == 1


def test_tables_as_files(spark, fleet_dir):
    """Readers give the same rows for files on disk and for the same texts in a table."""
    texts = {
        "redpanda.log": "INFO  2024-01-01 00:00:01,250 [shard 0:main] main - a\nmore\n\nlast", "admin/brokers.json": '[{"node_id": 1, "num_cores": 4}]',
        "utils/sysctl.txt": "vm.swappiness = 1\n", "metrics/n1/t0_metrics.txt": '# HELP a_b what\na_b{shard="0"} 3\n', "utils/df.txt": "Filesystem Type 1K-blocks Used Available Use% Mounted on\n/dev/sda ext4 10 4 6 40% /\n",
    }
    for path, text in texts.items():
        fleet_dir("b1", path, text)
    both = [Fleet(spark, fleet_dir.root), TableFleet(spark.createDataFrame([("b1", p, t) for p, t in texts.items()], "bundle_id string, path string, content string"))]
    readers = [
        lambda f: logs.scan_logs(f).drop("file_path"), cluster.scan_brokers, host.scan_host_facts, metrics.scan_metric_help, host.scan_filesystems,
        lambda f: metrics.scan_prometheus(f).select("bundle_id", "node", "name", F.to_json("labels"), "value"),
    ]
    for read in readers:
        one, two = (sorted(map(str, read(f).collect())) for f in both)
        assert one == two and one
