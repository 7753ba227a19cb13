"""Queries over the rules: audit groups, performance report, search over all tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.catalog.cluster_queries import samples
from fleetlens.catalog.registry import query
from fleetlens.operators.search import global_search as search_all
from fleetlens.plans import audit
from fleetlens.plans.performance import Measure, measure_names, measure_totals, metric_digest, performance_report

_MINIMA = (
    "('fs.aio-max-nr', 1048576, 'Critical'), ('fs.file-max', 500000, 'Warning'), ('net.core.somaxconn', 4096, 'Warning'), ('net.core.netdev_max_backlog', 2500, 'Warning'), "
    "('net.ipv4.tcp_max_syn_backlog', 4096, 'Warning'), ('net.core.rmem_max', 2097152, 'Info'), ('net.core.wmem_max', 2097152, 'Info'), ('net.ipv4.tcp_timestamps', 1, 'Info'), "
    "('net.ipv4.tcp_window_scaling', 1, 'Critical'), ('net.ipv4.tcp_sack', 1, 'Warning')"
)
_SYSCTL_SQL = f"""
WITH kv AS (SELECT bundle_id, node, key, min(value) AS value FROM v_sysctl GROUP BY 1, 2, 3), b AS (SELECT DISTINCT bundle_id, node FROM v_sysctl),
r(key, least, status) AS (VALUES {_MINIMA})
SELECT b.bundle_id, 'C1' AS "check", r.key AS name, coalesce(kv.value, 'not set') AS current_value,
       CASE WHEN kv.value IS NULL THEN 'Warning' WHEN CAST(kv.value AS BIGINT) < r.least THEN r.status ELSE 'Pass' END AS status
FROM b CROSS JOIN r LEFT JOIN kv ON kv.bundle_id = b.bundle_id AND kv.node = b.node AND kv.key = r.key
UNION ALL SELECT bundle_id, 'C2', key, value, 'Warning' FROM kv WHERE key = 'net.ipv4.ip_local_port_range' AND CAST(split_part(value, ' ', 2) AS INT) - 32768 < 28000
UNION ALL SELECT bundle_id, 'C2', key, value, CASE WHEN CAST(value AS INT) > 1 THEN 'Warning' ELSE 'Pass' END FROM kv WHERE key = 'vm.swappiness'"""


@query("sysctl_audit", _SYSCTL_SQL)
def sysctl_audit(t):
    facts = t.v_sysctl
    out = audit.audit({"facts": facts, "bundles": facts.select("bundle_id").distinct()}, only={"sysctl_checks"})
    return out.select("bundle_id", "check", "name", "current_value", "status")


MEASURES = {
    "parse_errors": Measure("sum", ("metric_error",)), "write_errors": Measure("count", ("metric_signup",)), "corrupt": Measure("max", ("metric_view",)),
    "reclaims": Measure("sum", ("metric_click", "metric_purchase")), "timeouts": Measure("min", ("metric_view",)), "blocked": Measure("count", ("metric_missing",)),
    "metadata": Measure("count", ("metric_click",)), "produce": Measure("count", ("metric_view",)),
}
_TOTALS_SQL = """
SELECT bundle_id, round(coalesce(sum(value) FILTER (name = 'metric_error'), 0), 4) AS parse_errors, (count(*) FILTER (name = 'metric_signup')) :: DOUBLE AS write_errors,
       coalesce(max(value) FILTER (name = 'metric_view'), 0) AS corrupt, round(coalesce(sum(value) FILTER (name IN ('metric_click', 'metric_purchase')), 0), 4) AS reclaims,
       min(value) FILTER (name = 'metric_view') AS timeouts, 0 :: DOUBLE AS blocked, (count(*) FILTER (name = 'metric_click')) :: DOUBLE AS metadata, (count(*) FILTER (name = 'metric_view')) :: DOUBLE AS produce
FROM v_metrics GROUP BY bundle_id"""


def _totals(t):
    totals = measure_totals(metric_digest(samples(t), measure_names(MEASURES)), MEASURES)
    return totals.withColumns({n: F.round(n, 4) for n in ("parse_errors", "reclaims")})


@query("metric_totals", _TOTALS_SQL)
def metric_totals(t):
    return _totals(t)


@query(
    "metrics_audit",
    f"WITH m AS ({_TOTALS_SQL}) SELECT bundle_id, 'Log Storage Errors' AS name, 'Critical' AS status FROM m WHERE parse_errors > 0 OR write_errors > 0 "
    "UNION ALL SELECT bundle_id, 'Compaction Index Corruption', 'Warning' FROM m WHERE corrupt > 0 UNION ALL SELECT bundle_id, 'High Memory Reclaim Rate', 'Warning' FROM m WHERE reclaims > 10000 "
    "UNION ALL SELECT bundle_id, 'Node Status RPC Timeouts', 'Warning' FROM m WHERE timeouts > 0 UNION ALL SELECT bundle_id, 'RPC Memory Backpressure', 'Warning' FROM m WHERE blocked > 0 "
    "UNION ALL SELECT bundle_id, 'Metadata Request Overload', 'Warning' FROM m WHERE produce > 1000 AND metadata / produce > 0.1",
)
def metrics_audit(t):
    return audit.integrity_findings(_totals(t)).select("bundle_id", "name", "status")


@query(
    "metric_digest",
    "SELECT bundle_id, name, shard, count(*) AS n, min(value) AS low, max(value) AS high, arg_min(value, (ts, id)) AS first_value, arg_max(value, (ts, id)) AS last_value "
    "FROM v_metrics GROUP BY 1, 2, 3",
)
def digest(t):
    rows = samples(t, keys=("shard",))
    out = metric_digest(rows, [f"metric_{k}" for k in ("signup", "error", "click", "view", "purchase")])
    return out.select("bundle_id", "name", "shard", "n", "low", "high", F.col("first.value").alias("first_value"), F.col("last.value").alias("last_value"))


@query(
    "performance_flags",
    "SELECT bundle_id, max(value) FILTER (name = 'metric_error') > 95 AS is_cpu_bound, coalesce(max(value) FILTER (name = 'metric_click') > 50 AND "
    "sum(value) FILTER (name = 'metric_view') / sum(value) FILTER (name = 'metric_purchase') * 1000 > 20, false) AS is_disk_bound, "
    "coalesce(sum(value) FILTER (name = 'metric_signup') > 5 * sum(value) FILTER (name = 'metric_view'), false) AS is_network_bound FROM "
    "(SELECT * FROM v_metrics) m GROUP BY 1",
)
def performance_flags(t):
    names = {
        "metric_error": "vectorized_reactor_utilization", "metric_click": "vectorized_io_queue_queue_length", "metric_view": "vectorized_io_queue_total_exec_sec",
        "metric_purchase": "vectorized_io_queue_total_operations", "metric_signup": "vectorized_network_bytes_sent",
    }
    rename = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    rows = samples(t).withColumn("name", rename[F.col("name")])
    received = rows.filter(F.col("name") == names["metric_view"]).withColumn("name", F.lit("vectorized_network_bytes_received"))
    return performance_report(rows.unionByName(received)).select("bundle_id", "is_cpu_bound", "is_disk_bound", "is_network_bound")


_SPREAD = (
    "SELECT bundle_id, irq_id, c.cpu, coalesce(s.n, 0) AS n FROM (SELECT DISTINCT bundle_id, irq_id FROM v_irqs) k CROSS JOIN (SELECT unnest(range(32)) AS cpu) c "
    "LEFT JOIN (SELECT bundle_id, irq_id, cpu, sum(count) :: BIGINT AS n FROM v_irqs GROUP BY 1, 2, 3) s USING (bundle_id, irq_id, cpu)"
)


def _counts(df, *keys):
    """Counts per CPU as the array that the readers give; 32 CPUs per host."""
    per_cpu = df.groupBy(*keys, "cpu").agg(F.sum("count").alias("n"))
    by_cpu = per_cpu.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col("cpu").cast("int"), "n"))).alias("m"))
    cpus = F.sequence(F.lit(0), F.lit(31))
    return by_cpu.select(*keys, F.transform(cpus, lambda c: F.coalesce(F.col("m")[c], F.lit(0).cast("bigint"))).alias("counts"))


@query(
    "softirq_imbalance",
    f"SELECT bundle_id, irq_id, sum(n) :: BIGINT AS total, count(*) FILTER (n > t / 32 / 10) AS active, 32 AS cpus FROM (SELECT *, sum(n) OVER (PARTITION BY bundle_id, irq_id) AS t FROM ({_SPREAD}) a) b GROUP BY 1, 2",
)
def softirq_imbalance(t):
    return audit.softirq_spread(_counts(t.v_irqs, "bundle_id", "irq_id")).drop("counts", "active_pct")


@query(
    "irq_balance",
    "SELECT bundle_id, device, max(q) AS queues, sum(n) :: BIGINT AS total, count(*) FILTER (n > 0) AS active_cpus, arg_max(cpu, (n, -cpu)) AS busiest_cpu FROM "
    "(SELECT v.bundle_id, split_part(v.device, 'q', 1) AS device, v.cpu, sum(v.count) :: BIGINT AS n FROM v_irqs v GROUP BY 1, 2, 3) a "
    "JOIN (SELECT bundle_id, split_part(device, 'q', 1) AS device, count(DISTINCT device || irq_id) AS q FROM v_irqs GROUP BY 1, 2) b USING (bundle_id, device) GROUP BY 1, 2",
)
def irq_balance(t):
    rows = _counts(t.v_irqs, "bundle_id", "irq_id", "device").withColumn("controller", F.lit("PCI-MSI"))
    return audit.irq_devices(rows)


@query(
    "socket_audit",
    "WITH s AS (SELECT bundle_id, count(*) FILTER (state = 'TIME-WAIT') AS w, count(*) FILTER (retrans_total > 50) AS h FROM v_sockets GROUP BY 1) "
    "SELECT bundle_id, 'TIME_WAIT Sockets' AS name, CASE WHEN w > 10000 THEN 'Warning' ELSE 'Pass' END AS status FROM s "
    "UNION ALL SELECT bundle_id, 'Socket Retransmissions', CASE WHEN h > 0 THEN 'Warning' ELSE 'Pass' END FROM s",
)
def socket_audit(t):
    sockets = t.v_sockets
    out = audit.audit({"sockets": sockets, "bundles": sockets.select("bundle_id").distinct()})
    return out.select("bundle_id", "name", "status")


@query(
    "log_audit",
    "SELECT bundle_id, 'Reactor Stalls in Logs' AS name, 'Warning' AS status FROM v_logs WHERE contains(lower(message), 'reactor') AND contains(lower(message), 'stalled') GROUP BY 1 "
    "UNION ALL SELECT bundle_id, 'High Connection Churn', 'Warning' FROM (SELECT * FROM v_logs WHERE contains(lower(message), 'accepted new connection') "
    "QUALIFY row_number() OVER (PARTITION BY bundle_id ORDER BY ts DESC, id DESC) <= 100) h GROUP BY 1 HAVING count(*) >= 50 AND epoch_us(max(ts)) - epoch_us(min(ts)) BETWEEN 1 AND 9999999",
)
def log_audit(t):
    return audit.audit({"logs": t.v_logs}, only={"log_checks"}).select("bundle_id", "name", "status")


_MOVES = (
    "SELECT bundle_id, id, ts, CASE WHEN level = 'ERROR' AND id % 41 = 7 AND bundle_id = 'bundle-1' THEN 'no nodes are available to perform allocation' "
    "WHEN level = 'INFO' THEN concat('attempt to move replica ', CAST(id AS STRING), CASE WHEN id % 89 = 3 AND bundle_id <> 'bundle-2' THEN ' failed' ELSE ' done' END) ELSE message END AS message FROM v_logs"
)


@query(
    "move_audit",
    f"SELECT bundle_id, CASE WHEN count(*) FILTER (contains(message, 'no nodes')) > 0 THEN 'Rebalance Failure (Hard Constraints)' ELSE 'Partition Move Failed' END AS name, "
    "CASE WHEN count(*) FILTER (contains(message, 'no nodes')) > 0 THEN 'Critical' ELSE 'Warning' END AS status "
    f"FROM ({_MOVES}) m WHERE contains(message, 'no nodes') OR contains(message, 'replica') AND contains(message, 'failed') GROUP BY 1",
)
def move_audit(t):
    """Failed moves of a bundle, most of them behind many that went well."""
    logs = t.sql(_MOVES)
    return audit.audit({"logs": logs}, only={"log_checks"}).filter("check = 'C14'").select("bundle_id", "name", "status")


@query(
    "leader_audit",
    "SELECT l.bundle_id, concat('Leader Imbalance (Node ', l.leader, ')') AS name FROM v_leaders l GROUP BY l.bundle_id, l.leader "
    "HAVING l.leader >= 0 AND count(*) > 1.5 * (SELECT count(*) FROM v_leaders x WHERE x.bundle_id = l.bundle_id) / (SELECT count(*) FROM v_brokers b WHERE b.bundle_id = l.bundle_id) "
    "UNION ALL SELECT DISTINCT bundle_id, 'Controller Leader' FROM v_brokers UNION ALL "
    "SELECT bundle_id, concat('Empty Node (ID ', node_id, ')') FROM v_brokers b WHERE NOT EXISTS (SELECT 1 FROM v_replicas r WHERE r.bundle_id = b.bundle_id AND r.node_id = b.node_id)",
)
def leader_audit(t):
    brokers = t.v_brokers
    health = brokers.groupBy("bundle_id").agg(F.collect_list("node_id").alias("all_nodes"))
    leaders = t.v_leaders.withColumn("last_stable_leader_term", F.lit(1).cast("bigint"))
    tables = {"health": health, "replicas": t.v_replicas, "leaders": leaders, "bundles": brokers.select("bundle_id").distinct()}
    out = audit.audit(tables, only={"controller_checks", "leader_balance_checks", "empty_node_checks"})
    return out.select("bundle_id", "name")


@query(
    "audit_summary",
    "WITH a AS (SELECT bundle_id, 'OS Tuning' AS category, status FROM ({sysctl}) s UNION ALL SELECT bundle_id, CASE name WHEN 'TIME_WAIT Sockets' THEN 'Network Evidence' ELSE 'Network Stack' END, status FROM "
    "(SELECT bundle_id, 'TIME_WAIT Sockets' AS name, CASE WHEN count(*) FILTER (state = 'TIME-WAIT') > 10000 THEN 'Warning' ELSE 'Pass' END AS status FROM v_sockets GROUP BY 1 UNION ALL "
    "SELECT bundle_id, 'Socket Retransmissions', CASE WHEN count(*) FILTER (retrans_total > 50) > 0 THEN 'Warning' ELSE 'Pass' END FROM v_sockets GROUP BY 1) k) "
    "SELECT bundle_id, category, status, count(*) AS count FROM a GROUP BY 1, 2, 3".replace("{sysctl}", _SYSCTL_SQL),
)
def audit_counts(t):
    facts, sockets = t.v_sysctl, t.v_sockets
    one = audit.audit({"facts": facts, "bundles": facts.select("bundle_id").distinct()}, only={"sysctl_checks"})
    two = audit.audit({"sockets": sockets, "bundles": sockets.select("bundle_id").distinct()}, only={"socket_checks"})
    return audit.audit_summary(one.unionByName(two))


@query(
    "home_summary",
    "SELECT b.bundle_id, count(*) AS total_brokers, string_agg(DISTINCT concat('v24.', b.node_id % 3), ', ' ORDER BY concat('v24.', b.node_id % 3)) AS versions, count(*) FILTER (b.draining) AS in_maintenance, "
    "count(*) FILTER (NOT b.is_alive) :: INT AS nodes_down FROM v_brokers b GROUP BY 1",
)
def home(t):
    b = t.v_brokers
    brokers = b.select("bundle_id", "node_id", "rack", F.concat(F.lit("v24."), (F.col("node_id") % 3).cast("string")).alias("version"), F.col("draining").alias("in_maintenance"))
    health = b.groupBy("bundle_id").agg(
        F.lit(True).alias("is_healthy"), F.lit(0).alias("under_replicated_count"), F.lit(0).alias("leaderless_count"),
        F.collect_list(F.when(~F.col("is_alive"), F.col("node_id"))).alias("nodes_down"), F.collect_list("node_id").alias("all_nodes"))
    out = audit.home_summary(brokers, health, t.v_kafka)
    return out.select("bundle_id", "total_brokers", "versions", "in_maintenance", "nodes_down")


@query(
    "global_search",
    "WITH l AS (SELECT bundle_id, level, ts FROM v_logs WHERE contains(lower(message), 'topic-3')), "
    "p AS (SELECT bundle_id, concat(ns, '/', topic, '/', partition_id) AS title FROM v_partitions WHERE contains(concat(ns, '/', topic, '/', partition_id), 'topic-3') "
    ") "
    "SELECT bundle_id, 'Logs' AS category, concat(strftime(ts, '%H:%M:%S'), ' [', level, ']') AS title FROM l UNION ALL SELECT bundle_id, 'Partition', title FROM p UNION ALL "
    "SELECT concat('bundle-', CAST(page_id % 3 AS STRING)), 'File: pages', url FROM pages WHERE contains(lower(html), 'topic-3')",
)
def global_search(t):
    corpus = t.pages.select(
        F.concat(F.lit("bundle-"), (F.col("page_id") % 3).cast("string")).alias("bundle_id"), F.lit("pages").alias("group"), F.col("url").alias("file_name"), F.col("html").alias("text"))
    return search_all("topic-3", t.v_logs, corpus, None, t.v_partitions).drop("preview")


@query(
    "file_search",
    "SELECT doc_id, source AS category, substr(text, greatest(strpos(lower(text), 'license') - 50, 1), strpos(lower(text), 'license') - greatest(strpos(lower(text), 'license') - 50, 1) + 57) AS shown "
    "FROM documents WHERE contains(lower(text), 'license')",
)
def file_search(t):
    from fleetlens.functions.text import snippet

    hits = t.documents.filter(F.contains(F.lower("text"), F.lit("license")))
    return hits.select("doc_id", F.col("source").alias("category"), snippet(F.col("text"), "license").alias("shown"))


# --- rules on samples of several nodes ------------------------------------------------------

_STEAL, _QUEUE = "vectorized_reactor_cpu_steal_time_ms", "vectorized_io_queue_queue_length"
_NODE_ENDS = (
    "SELECT bundle_id, node, shard, arg_min(value, (ts, id)) AS v0, arg_max(value, (ts, id)) AS v1, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS s "
    f"FROM v_node_metrics WHERE name = '{_STEAL}' GROUP BY 1, 2, 3"
)


def _node_audit(t, group: str):
    empty = t.v_node_metrics.sparkSession.createDataFrame([], "bundle_id string, command string, cpu double")
    return audit.audit({"metrics": samples(t, "v_node_metrics", keys=("shard",)), "processes": empty}, only={group})


@query("node_rates", f"SELECT bundle_id, node, shard, round((v1 - v0) / s, 4) AS rate FROM ({_NODE_ENDS}) e WHERE s > 0")
def node_rates(t):
    digest = metric_digest(samples(t, "v_node_metrics", keys=("shard",)), [_STEAL])
    return audit.series_rates(digest, _STEAL).select("bundle_id", "node", "shard", F.round("rate", 4).alias("rate"))


@query(
    "steal_audit",
    f"SELECT bundle_id, CASE WHEN max(r) > 100 THEN 'Critical' ELSE 'Warning' END AS status FROM (SELECT bundle_id, (v1 - v0) / s AS r FROM ({_NODE_ENDS}) e WHERE s > 0) x "
    "GROUP BY bundle_id HAVING max(r) > 10 AND max(r) <= 1000",
)
def steal_audit(t):
    return _node_audit(t, "steal_checks").select("bundle_id", "status")


@query(
    "queue_audit",
    "SELECT bundle_id, format('queue of {:.0f} on shard {} of {}', w, shard, node) AS current_value, CASE WHEN w >= 1024 THEN 'Critical' ELSE 'Warning' END AS status FROM "
    f"(SELECT bundle_id, value AS w, shard, node FROM v_node_metrics WHERE name = '{_QUEUE}' "
    "QUALIFY row_number() OVER (PARTITION BY bundle_id ORDER BY value DESC, concat(shard, ' of ', node) DESC) = 1) q WHERE w >= 1000",
)
def queue_audit(t):
    return _node_audit(t, "queue_checks").select("bundle_id", "current_value", "status")


@query(
    "shard0_audit",
    "SELECT bundle_id, format('{:.1f}%, the others {:.1f}%', zero, others) AS current_value FROM (SELECT bundle_id, node, arg_max(value, (ts, id)) FILTER (shard = '0') AS zero, "
    "avg(value) FILTER (shard <> '0') AS others FROM v_node_metrics WHERE name = 'vectorized_reactor_utilization' GROUP BY 1, 2) z WHERE zero > others + 30 AND zero > 50",
)
def shard0_audit(t):
    return _node_audit(t, "shard0_checks").select("bundle_id", "current_value")
