"""Operators on small inputs: configuration other than the defaults, ties, skewed keys."""

import os
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from fleetlens.operators import logs, metrics, placement, storage
from fleetlens.operators.windows import previous_in_order
from fleetlens.plans import anomalies, replication
from fleetlens.sources import host
from fleetlens.sources.sinks import write_table
from fleetlens.streaming.counts import read_log_stream, stream_log_counts

T0 = datetime(2024, 1, 1)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def log_table(spark, entries):
    data = [("b1", i, T0 + timedelta(seconds=s), level, "n", "c", m, m, i, "/f/n.log") for i, (s, level, m) in enumerate(entries)]
    return spark.createDataFrame(data, "bundle_id string, id bigint, ts timestamp, level string, node string, component string, message string, raw string, line_number bigint, file_path string")


def test_rate_like_model(spark):
    rng = random.Random(5)
    data = [("b1", rng.choice(["hot", "hot", "cold"]), T0 + timedelta(seconds=rng.randint(0, 4000)), i, float(rng.randint(0, 50))) for i in range(3000)]
    df = spark.createDataFrame(data, "bundle_id string, series string, ts timestamp, id bigint, value double")
    expected = []
    for series in ("hot", "cold"):
        points = sorted((r for r in data if r[1] == series), key=lambda r: (r[2], r[3]))
        for a, b in zip(points, points[1:]):
            dt = (b[2] - a[2]).total_seconds()
            if dt > 0 and b[4] >= a[4]:
                expected.append((series, b[3], round((b[4] - a[4]) / dt, 9)))
    for partitions in (None, 1, 2, 40):
        got = metrics.metric_rate(df, partitions).withColumn("rate", F.round("rate", 9))
        assert rows(got, "series", "id", "rate") == sorted(expected, key=str), partitions


def test_previous_with_one_time(spark):
    """Rows that all have one time are cut by id; other columns pass, and partitions may be empty."""
    df = spark.range(500).select(F.lit("k").alias("k"), F.lit(T0).cast("timestamp").alias("ts"), "id", (F.col("id") * 2).alias("v"))
    got = previous_in_order(df.withColumn("m", F.create_map("k", "id")), ["k"], "ts", "id", ["v"], 700).select("id", F.col("prev.v").alias("p")).collect()
    assert sorted(tuple(r) for r in got) == [(i, None if i == 0 else 2 * (i - 1)) for i in range(500)]


def test_longest_prefix_like_model(spark):
    rng = random.Random(6)
    paths = ["/" + "/".join(rng.choice("ab") * rng.randint(1, 2) for _ in range(rng.randint(1, 4))) for _ in range(200)]
    prefixes = ["/", "/a", "/aa/b", "/b/b", "/bb/a/a", "/zz"]
    got = storage.longest_prefix(
        spark.createDataFrame([("k", p) for p in set(paths)], "bundle_id string, path string"),
        spark.createDataFrame([("k", p) for p in prefixes], "bundle_id string, mount string"), "path", "mount", ["bundle_id"])
    assert rows(got, "path", "mount") == sorted(((p, max((m for m in prefixes if p.startswith(m)), key=len)) for p in set(paths)), key=str)


def test_get_logs_and_context(spark):
    df = log_table(spark, [(i, "ERROR" if i % 2 else "INFO", f"message {i} bad_alloc") for i in range(30)])
    pins = spark.createDataFrame([("b1", 29, "why", 1)], "bundle_id string, log_id bigint, note string, created_at bigint")
    page, total, more = logs.get_logs(df, pins, limit=4, search="bad_alloc", level="ERROR")
    got = page.collect()
    assert total == 15 and more and [r["id"] for r in got] == [29, 27, 25, 23] and [r["is_pinned"] for r in got] == [True, False, False, False]
    assert got[0]["snippet"] == "message 29 <mark>bad_alloc</mark>" and got[0]["severity"] == "Critical"
    page, total, more = logs.get_logs(df, sort="asc", limit=4, offset=28)
    assert total == 30 and not more and [r["id"] for r in page.collect()] == [28, 29]
    assert logs.parse_bound("soon") is None and logs.parse_bound("2024-01-01T10:11") == datetime(2024, 1, 1, 10, 11)
    assert logs.get_logs(df, start="2024-01-01T00:00:05", end="2024-01-01T00:00:07")[1] == 3 and logs.get_logs(df, start="soon")[1] == 30
    ctx = logs.log_context(df, spark.createDataFrame([("b1", "/f/n.log", 1), ("b1", "/f/n.log", 3)], "bundle_id string, file_path string, line_number bigint"), k=1)
    assert rows(ctx, "anchor", "line_number", "is_match") == [(1, 0, False), (1, 1, True), (1, 2, False), (3, 2, False), (3, 3, True), (3, 4, False)]


def test_version(spark):
    brokers = spark.createDataFrame([("b1", 1, ""), ("b2", 2, "v24.2.1"), ("b2", 1, "v24.2.0")], "bundle_id string, node_id bigint, version string")
    df = log_table(spark, [(5, "INFO", "Welcome to Redpanda v23.3.5 - abc"), (9, "INFO", "Welcome to Redpanda v24.1.1")])
    assert rows(logs.detect_version(brokers, df), "bundle_id", "version") == [("b1", "23.3.5"), ("b2", "v24.2.0")]


def test_command_lines(spark):
    facts = spark.createDataFrame([("b2", "cmdline", "cmdline", "redpanda --smp 2")], "bundle_id string, source string, key string, value string")
    df = log_table(spark, [(1, "INFO", "x"), (2, "INFO", "command line: redpanda --smp 4")])
    assert rows(host.command_lines(facts, df), "bundle_id", "cmdline") == [("b1", "command line: redpanda --smp 4"), ("b2", "redpanda --smp 2")]


def test_placement_settings(spark):
    replicas = spark.createDataFrame([("b1", "kafka", t, p, n, 0) for t, p, n in [("a", 0, 1), ("a", 1, 1), ("b", 0, 1), ("b", 1, 2)]], "bundle_id string, ns string, topic string, partition_id bigint, node_id bigint, core bigint")
    brokers = spark.createDataFrame([("b1", 1, "r", 2, True, False), ("b1", 2, "r", 1, True, False), ("b1", 3, None, 1, False, True)], "bundle_id string, node_id bigint, rack string, num_cores bigint, is_alive boolean, draining boolean")
    config = spark.createDataFrame([("b1", k, v) for k, v in {
        "topic_partitions_per_shard": "10", "topic_partitions_reserve_shard0": "12", "partition_autobalancing_mode": "topic_aware", "space_management_enabled": "false",
        "partition_autobalancing_max_disk_usage_percent": "50"}.items()], "bundle_id string, key string, value string")
    settings = placement.settings_table(config)
    assert rows(placement.balancing_score(replicas, brokers, settings), "node_id", "max_capacity", "score") == [(1, 8, 0.25), (2, 1, 1.0), (3, 1, 0.0)]
    disks = spark.createDataFrame([("b1", 1, 1000, 400)], "bundle_id string, node_id bigint, total_bytes bigint, free_bytes bigint")
    free = placement.disk_analysis(disks, settings).collect()[0]
    assert (free["target_bytes"], free["usable_bytes"], free["reserved_bytes"], free["rebalance_threshold"], free["is_rebalancing"]) == (1000, 1000, 0, 500, True)
    for fixed, target in (("0", 640), ("100", 100), ("9999", 640)):
        conf = spark.createDataFrame([("b1", "retention_local_target_capacity_bytes", fixed)], "bundle_id string, key string, value string")
        assert placement.disk_analysis(disks, placement.settings_table(conf)).first()["target_bytes"] == target
    checks = placement.constraint_checks(replicas, brokers, disks.withColumn("node_id", F.lit(3)), settings)
    assert rows(checks, "node_id", "reasons", "is_valid_target") == [(2, [], True), (3, ["node is not alive", "node is draining", "disk usage over limit"], False)]
    assert rows(placement.node_skew(replicas, brokers), "node_id", "partition_count", "topic_count", "is_skewed") == [(1, 3, 2, True), (2, 1, 1, True), (3, 0, 0, True)]
    # topic a: 2, 0, 0 over three nodes; topic b: 1, 1, 0
    skew = placement.topic_skew(replicas, brokers).withColumn("max_skew", F.round("max_skew", 6))
    assert rows(skew, "topic", "min_replicas", "max_replicas", "max_skew") == [("a", 0, 2, 200.0)]


def test_replication_rules(spark):
    key = "bundle_id string, ns string, topic string, partition_id bigint"
    cases = {0: ("done", 1), 1: ("done", -1), 2: ("Reconfiguring", 1), 3: ("done", 1), 4: ("under_replicated", 1), 5: ("under_replicated", 1), 6: ("under_replicated", 1), 7: ("under_replicated", 1)}
    parts = spark.createDataFrame([("b1", "kafka", "t", p, s, lead) for p, (s, lead) in cases.items()], key + ", status string, leader_id bigint")
    replicas = spark.createDataFrame([("b1", "kafka", "t", p, n) for p in cases for n in (1, 2, 3)], key + ", node_id bigint")
    reports = spark.createDataFrame(
        [("b1", "kafka", "t", 1, 2, 5, True)] + [("b1", "kafka", "t", 4, n, 10 - n, False) for n in (1, 2, 3)] + [("b1", "kafka", "t", p, n, 7, False) for p in (5, 6) for n in (1, 2)],
        key + ", node_id bigint, committed_offset bigint, is_leader boolean")
    followers = spark.createDataFrame(
        [("b1", "kafka", "t", 1, 2, 3, 0, -9223372036854775808), ("b1", "kafka", "t", 5, 1, 2, 10_001, 5), ("b1", "kafka", "t", 5, 1, 3, 25_500, 5), ("b1", "kafka", "t", 6, 1, 2, 10_000, 5)],
        key + ", node_id bigint, follower_id bigint, ms_since_last_heartbeat bigint, last_flushed_log_index bigint")
    kafka = spark.createDataFrame([("b1", "t", 0, 2), ("b1", "t", 4, 1)], "bundle_id string, topic string, partition_id bigint, leader bigint")
    found = replication.replication_insight(replication.partition_details(parts, replicas, reports, followers, kafka))
    got = {r["partition_id"]: (r["rule"], r["severity"], r["summary"]) for r in found.collect()}
    assert got == {
        0: ("R1", "warn", "leader is 1 by the cluster but 2 by client metadata"),
        1: ("R2", "error", "no leader; only 1/3 replicas reported; nodes that claim to lead: 1; abnormal log indices: 1"),
        2: ("R3", "info", "replicas are being changed"), 4: ("R5", "warn", "node 3 lags by 2 offsets"),
        5: ("R6", "error", "no heartbeat from node 3 for 25 s"), 6: ("R7", "warn", "replicas are catching up"), 7: ("R7", "warn", "replicas are catching up")}
    assert {r["remediation"] for r in found.filter("rule = 'R5'").collect()} == {"rpk cluster partitions move -p t/4:1,2"}
    one = replication.topic_details("t", parts, replicas, reports, followers, kafka)
    assert one.count() == 8 and one.filter("rule is null").count() == 1
    assert anomalies.index_anomalies(followers).count() == 1


def test_anomaly_limits(spark):
    patterns = spark.createDataFrame([("b1", 10, "ghost_record_batch"), ("b1", 11, "a GHOST_record_batch"), ("b1", 5, "reactor_stalled"), ("b1", 6, "Reactor_stalled"), ("b2", 50, "ghost_record_batch reactor_stalled")], "bundle_id string, count bigint, sample string")
    assert rows(anomalies.pattern_anomalies(patterns), "bundle_id", "subject", "value") == [("b1", "ghost_record_batch", 11), ("b1", "reactor_stalled", 6), ("b2", "ghost_record_batch", 50), ("b2", "reactor_stalled", 50)]


def test_stream_counts(spark, tmp_path):
    df = log_table(spark, [(i * 7, ["ERROR", "WARN", "INFO"][i % 3], "m") for i in range(100)])
    write_table(df, str(tmp_path / "logs"))
    schema = spark.read.parquet(str(tmp_path / "logs")).schema
    stream = stream_log_counts(read_log_stream(spark, str(tmp_path / "logs"), schema), 60)
    running = stream.writeStream.outputMode("complete").format("memory").queryName("bucket_counts").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    got = rows(spark.sql("SELECT * FROM bucket_counts"), "bundle_id", "bucket", "count")
    assert got == rows(logs.log_counts_by_time(df, 60), "bundle_id", "bucket", "count") and got


def test_staged_tables_can_be_dropped(spark):
    from fleetlens import session

    kept = dict(session._STAGED)
    session._STAGED.clear()
    path = session.stage(spark.range(3), "staged").inputFiles()[0]
    assert session.drop_staged(spark) == 1 and not os.path.exists(path.removeprefix("file://"))
    session._STAGED.update(kept)


def test_hot_key_is_spread_by_one_shuffle(spark):
    """One key and one time for all rows but one: partitions of about equal size from one exchange of the rows."""
    df = spark.range(20_000).select(F.lit("k").alias("k"), F.lit(T0 + timedelta(days=1)).cast("timestamp").alias("ts"), "id").withColumn("ts", F.when(F.col("id") == 7, T0).otherwise(F.col("ts")))
    out = previous_in_order(df, ["k"], "ts", "id", ["id"], 8)
    sizes = [r["count"] for r in df.repartitionByRange(8, "k", "ts", "id").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 3 * 20_000 / 8 and out.filter("prev IS NULL").count() == 1
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "hashpartitioning" not in plan and "BroadcastHashJoin" in plan


