"""What only shows in fleets of many bundles: no table with a row per bundle is broadcast, rows are dealt before texts are made of them, keys of any size."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from fleetlens.catalog import file_queries
from fleetlens.catalog.registry import Tables
from fleetlens.sources import host
from fleetlens.sources.fleet import Fleet, TableFleet
from tests.compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no driver tables")


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_sar_samples_and_peaks_broadcast_no_row_per_bundle(spark):
    for name in ("sar_samples", "sar_peaks"):
        assert "BroadcastExchange" not in final_plan(entry.queries()[name](spark, SF_DIR)), name


def test_rows_are_dealt_before_they_become_texts(spark):
    """A small file is one split, whatever number of bundles its rows are."""
    files = file_queries.fleet_of(Tables(spark, SF_DIR), file_queries.CUSTOMER, "customer", {"a.txt": "c_name"})._files
    assert files.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_network_health_broadcasts_no_row_per_bundle(spark):
    assert "BroadcastExchange" not in final_plan(entry.queries()["network_health_files"](spark, SF_DIR))


@pytest.mark.parametrize("name", ["sar_samples", "sar_peaks", "network_health_files"])
def test_sar_texts_stay_where_they_are(spark, name):
    """Only the rows that the texts are made of are shuffled: no line, no sample and no row per bundle."""
    plan = final_plan(entry.queries()[name](spark, SF_DIR)).split("== Initial Plan ==")[0]
    shuffles = [line for line in plan.splitlines() if "Exchange " in line]
    assert shuffles and all("hashpartitioning(concat(o-" in line for line in shuffles)
    assert "Window" not in plan and "file_path" not in "".join(line for line in plan.splitlines() if "Sort [" in line)


def test_sar_of_a_table_equals_that_of_files(spark, fleet_dir):
    """Odd reports: several and undated banners, sections that go on behind a banner, data before any header, no lines, another file of the bundle."""
    cpu, net = "00:00:01 CPU %user %nice %system %iowait %steal %idle", "00:00:01 IFACE rxpck/s txpck/s rxkB/s txkB/s rxcmp/s txcmp/s rxmcst/s %ifutil"
    row = lambda clock, v: f"{clock} all {v}.0 0.0 2.0 0.1 0.0 92.9"
    link = "00:10:01 eth0 1 2 1024 2048 0 0 3 81.5"
    day = "Linux 5.15.0 (h)  02/{}/26  _x86_64_ (8 CPU)"
    files = [
        ("b1", "utils/sar.txt", "\n".join([row("00:00:00", 1), day.format(12), row("00:05:00", 2), cpu, row("00:10:01", 3), day.format(13), row("00:10:01", 4), "Linux 5.15.0 (h) no date", row("00:20:01", 5), net, link])),
        ("b2", "utils/sar", "\n\nx\n"), ("b2", "sar.txt", f"{day.format(14)}\r\n{cpu}\r\n{row('00:10:01', 6)}\r\n"),
        ("b3", "utils/sar", f"{cpu}\n"), ("b3", "utils/sar.txt", f"{cpu}\n{row('00:10:01', 7)}\n"),
        ("b4", "sysstat/sar", f"Linux CPU %user x 2026-02-15\n{row('00:10:01', 8)}\n\n{net}\n{link}\nAverage: eth0 1 1 1 1 1 1 1 1\n{day.format(16)}\n{link}"), ("b5", "sar.txt", "\n"),
    ]
    for file in files:
        fleet_dir(*file)
    table = TableFleet(spark.createDataFrame(files, "bundle_id string, path string, content string"))
    for a, b in zip(host.scan_sar(Fleet(spark, fleet_dir.root)), host.scan_sar(table), strict=True):
        assert a.columns == b.columns and a.dtypes == b.dtypes
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    users = {(r.bundle_id, str(r.ts)): r.cpu_user for r in host.scan_sar(table)[0].collect()}
    assert users[("b1", "2026-02-13 00:10:01")] == 4.0 and users[("b1", "2026-02-13 00:20:01")] == 5.0 and users[("b1", "2026-02-12 00:05:00")] is None
    assert users[("b2", "2026-02-14 00:10:01")] == 6.0 and not any(b in ("b3", "b5") for b, _ in users)


@pytest.fixture(scope="module")
def large_keys(tmp_path_factory):
    """Tables whose customers' keys take one to four bytes."""
    folder = tmp_path_factory.mktemp("large")
    for name in os.listdir(SF_DIR):
        os.symlink(f"{SF_DIR}/{name}", folder / name)
    os.unlink(folder / "customer.parquet")
    keys = "(VALUES (0), (65000), (131072), (16777000)) v(k)"
    duckdb.sql(f"COPY (SELECT * REPLACE (c_custkey + k AS c_custkey) FROM '{SF_DIR}/customer.parquet', {keys}) TO '{folder}/customer.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", ["segment_files", "snapshot_files"])
def test_keys_of_any_size(spark, large_keys, name):
    assert compare(spark, connect(large_keys), entry.queries()[name], entry.oracle_sql()[name], large_keys) is None


@pytest.mark.parametrize("name", ["dump_partitions", "dump_groups", "log_files"])
def test_texts_are_made_and_split_once(spark, name):
    """What several branches of the plan read is staged; the final plan does not go back to the rows the texts are made of."""
    plan = final_plan(entry.queries()[name](spark, SF_DIR))
    assert "customer.parquet" not in plan and "parquet" in plan
    assert name == "log_files" or "BroadcastExchange" not in plan


def test_performance_report_holds_no_series(spark):
    """Samples are dealt by bundle and aggregated by bundle at once: a task holds a row per bundle of its share."""
    plan = final_plan(entry.queries()["performance_observations"](spark, SF_DIR))
    assert "series" not in plan and "REPARTITION_BY_NUM" in plan


def test_first_blocks_are_joined_with_nothing(spark):
    """Files of one block are read once: nothing is carried into them."""
    plan = final_plan(entry.queries()["socket_files"](spark, SF_DIR))
    final = plan.split("== Initial Plan ==")[0]
    assert "Join" not in final and final.count("orders.parquet") == 1


def test_socket_lines_travel_alone(spark):
    """Sorts are led by a number, not by paths that begin alike; no bundle and no fields are shuffled with a line; no empty text is tried as a number."""
    plan = final_plan(entry.queries()["socket_files"](spark, SF_DIR)).split("== Initial Plan ==")[0]
    assert "Sort [_file" in plan
    window = plan[plan.index("Window [") :]
    assert "bundle_id" not in window and " AS f#" not in window
    assert "try_cast(regexp_extract" not in plan and "cast(regexp_extract(info" not in plan
