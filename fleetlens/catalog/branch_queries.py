"""Queries over branches that the data of the other queries does not reach: every rule text, every event type, rare forms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetlens.catalog.performance_queries import sample
from fleetlens.catalog.registry import query
from fleetlens.catalog.rule_queries import BUNDLE, judge, union
from fleetlens.functions import raft, rules, text
from fleetlens.operators import metrics as metric_ops
from fleetlens.operators.logs import log_patterns
from fleetlens.plans import anomalies


def values(rows: list[tuple], *names: str) -> str:
    """A table of literals that both engines read."""
    lit = lambda v: str(v) if isinstance(v, int) else "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS v({', '.join(names)})"


# One message for each insight rule, in their order, with the severity it must get.
MESSAGES = [
    ("vote_stm.cc:120 vote failed, error code: 10", "Warning"), ("raft::errc::timeout on append", "Warning"), ("std::bad_alloc thrown", "Critical"), ("cannot write: not_enough_free_space", "Critical"),
    ("Filesystem Error: EIO", "Critical"), ("replied not_leader_for_partition", "Info"), ("batch CRC mismatch at 7", "Critical"), ("segment_not_found 0-1", "Critical"), ("connect: Connection refused", "Warning"),
    ("write: broken pipe", "Warning"), ("accept: Too many open files", "Critical"), ("reactor_stalled 30 ms", "Warning"), ("SASL authentication failed", "Warning"), ("cloud_storage - manifest upload failed", "Warning"),
    ("cloud_storage - segment download failed", "Warning"), ("schema_registry - compile error", "Warning"), ("reconfiguration_stm - moving partition t/1", "Info"), ("reconfiguration_stm - finishing reconfiguration", "Info"),
    ("leadership_balancer - transferring leadership of 4", "Info"), ("health_monitor - detected node 3 is down", "Critical"), ("t/0 became the leader term 9", "Info"), ("Stepping down as leader in term 4, reasoning: leadership_transfer", "Info"),
    ("Stepping down as leader in term 4, reasoning: heartbeats_majority", "Warning"), ("wrote ghost_record_batch", "Info"), ("rejected oversized_record_batch", "Warning"), ("start: cluster_id_mismatch", "Critical"),
    ("loaded stored_wasm_binary", "Info"), ("datalake_throttle_manager - Translation status updated: throttling may be applied", "Warning"), ("in pandaproxy::schema_registry::build_file_with_refs", "Warning"),
    ("raft::state_machine_manager::apply loop", "Warning"), ("SSL_accept handshake failed", "Warning"), ("unclean_abort_reconfiguration of t/2", "Critical"), ("RPC timeout (x), time since: {send: 2}", "Warning"),
    ("Creating new segment /d/1.log", "Info"), ("controller_stm - taking snapshot", "Info"), ("an ordinary line", None), ("", None),
]
_MESSAGES = values([(i, m) for i, (m, _) in enumerate(MESSAGES)], "k", "message")
_INSIGHTS = values([(i, s, rules.INSIGHT_RULES[i].description if s else None) for i, (_, s) in enumerate(MESSAGES)], "k", "severity", "description")


@query("all_insights", f"SELECT {BUNDLE}, severity, description FROM customer JOIN {_INSIGHTS} ON k = c_custkey % {len(MESSAGES)}")
def all_insights(t):
    """each of the 35 rules, and two messages of none."""
    lines = t.sql(f"SELECT {BUNDLE}, message FROM customer JOIN {_MESSAGES} ON k = c_custkey % {len(MESSAGES)}")
    return rules.with_insight(lines).select("bundle_id", "severity", "description")


_TRACES = [("a schema_registry::build b", "x", 0), ("in raft::state_machine_manager::apply", "x", 1), ("log::persistent_size()", "main", 2), ("log::persistent_size()", "fetch", -1), ("SSL_do_handshake", "x", 3), ("reactor::run_some", "x", 4), ("memcpy", "main", -1)]


@query(
    "all_profile_insights",
    f"SELECT {BUNDLE}, insight FROM customer JOIN {values([(i, rules.PROFILE_RULES[n].text if n >= 0 else '') for i, (_, _, n) in enumerate(_TRACES)], 'k', 'insight')} ON k = c_custkey % {len(_TRACES)}",
)
def all_profile_insights(t):
    """each of the five rules; the one that is bound to a group, in that group and in another."""
    rows = t.sql(f"SELECT {BUNDLE}, trace, g FROM customer JOIN {values([(i, a, b) for i, (a, b, _) in enumerate(_TRACES)], 'k', 'trace', 'g')} ON k = c_custkey % {len(_TRACES)}")
    return rows.select("bundle_id", rules.profile_insight(F.col("trace"), F.col("g")).alias("insight"))


_EVENTS = [
    ("[kafka/t/3] became the leader term {n}", "Elected", "kafka/t/3", None), ("[kafka/t/4] [heartbeats_majority] Stepping down as leader in term {n}", "Stepdown", "kafka/t/4", "heartbeats_majority"),
    ("kafka/t-x/5 vote timeout in term {n}", "Timeout", "kafka/t-x/5", None), ("redpanda/controller/0 reply error code: 10 term {n}", "Timeout", "redpanda/controller/0", None),
    ("moving kafka/t/6 in term {n}", "Move", "kafka/t/6", None), ("transferring leadership of kafka/t/7, term {n}", "Move", "kafka/t/7", None), ("node 3 is down, term {n}", "Health", None, None), ("flushed term {n}", None, None, None),
]


@query("all_event_types", f"SELECT {BUNDLE}, type, ntp, reason, c_nationkey AS term FROM customer JOIN {values([(i, k, p, r) for i, (_, k, p, r) in enumerate(_EVENTS)], 'k', 'type', 'ntp', 'reason')} ON k = c_custkey % {len(_EVENTS)}")
def all_event_types(t):
    """All five types, and a line of none."""
    rows = t.sql(f"SELECT {BUNDLE}, replace(m, '{{n}}', c_nationkey) AS m FROM customer JOIN {values([(i, m) for i, (m, _, _, _) in enumerate(_EVENTS)], 'k', 'm')} ON k = c_custkey % {len(_EVENTS)}")
    m = F.col("m")
    return rows.select("bundle_id", raft.event_type(F.lower(m)).alias("type"), raft.ntp(m).alias("ntp"), raft.stepdown_reason(m).alias("reason"), raft.term(m).alias("term"))


@query(
    "health_anomalies",
    f"SELECT {BUNDLE}, 'Stale Health' AS type, c_custkey % 4 AS value FROM customer WHERE c_custkey % 4 > 0 AND c_nationkey % 2 = 0",
)
def health_anomalies(t):
    """Leaderless by health; odd nations are leaderless by the client's metadata too."""
    health = t.sql(f"SELECT {BUNDLE}, c_custkey % 4 AS leaderless_count FROM customer")
    kafka = t.sql(f"SELECT {BUNDLE}, IF(c_nationkey % 2 = 1, -1, 2) AS leader FROM customer UNION ALL SELECT {BUNDLE}, 1 FROM customer")
    return anomalies.stale_health(health, kafka).select("bundle_id", "type", "value")


_GHOSTS = "SELECT concat('n-', c_nationkey) AS bundle_id, c_custkey AS id, TIMESTAMP '2024-01-01 00:00:00' AS ts, 'WARN' AS level, 'n' AS node, 'c' AS component, '0' AS shard, CASE WHEN c_custkey % 9 < 2 THEN 'wrote ghost_record_batch' ELSE 'reactor_stalled' END AS message FROM customer"


@query(
    "pattern_anomalies",
    "SELECT bundle_id, CASE WHEN message = 'reactor_stalled' THEN 'Performance' ELSE 'Log Pattern' END AS type, CASE WHEN message = 'reactor_stalled' THEN 'reactor_stalled' ELSE 'ghost_record_batch' END AS subject, count(*) AS value "
    f"FROM ({_GHOSTS}) g GROUP BY bundle_id, message HAVING count(*) > CASE WHEN message = 'reactor_stalled' THEN 5 ELSE 10 END",
)
def pattern_anomalies(t):
    """More than ten, more than five."""
    return anomalies.pattern_anomalies(log_patterns(t.sql(_GHOSTS))).select("bundle_id", "type", "subject", "value")


@query(
    "json_pages",
    f"SELECT {BUNDLE}, CASE WHEN c_custkey % 2 = 0 THEN concat(c_nationkey, '|x') ELSE 'b|c' END AS page FROM customer",
)
def json_pages(t):
    """the second and third item of an array, or key of an object, in order."""
    rows = t.sql(f"SELECT {BUNDLE}, IF(c_custkey % 2 = 0, concat('[1, ', c_nationkey, ', \"x\", 4]'), '{{\"c\": 1, \"a\": 2, \"d\": [1], \"b\": 3}}') AS doc FROM customer")
    return rows.select("bundle_id", F.array_join(text.json_children(F.col("doc"), 1, 2), "|").alias("page"))


_SHARDS = "SELECT concat('n-', c_nationkey) AS bundle_id, c_custkey AS id, CASE WHEN c_custkey % 11 = 3 THEN 'x' ELSE CAST(c_custkey AS {}) END AS shard FROM customer"


@query(
    "shard_order",
    f"SELECT bundle_id, shard, row_number() OVER (PARTITION BY bundle_id ORDER BY coalesce(TRY_CAST(shard AS INTEGER), 0), id) AS place FROM ({_SHARDS.format('VARCHAR')}) s",
)
def shard_order(t):
    """10 comes after 9, and what is no number before 1."""
    place = F.row_number().over(Window.partitionBy("bundle_id").orderBy(metric_ops.numeric_order("shard"), "id"))
    return t.sql(_SHARDS.format("STRING")).select("bundle_id", "shard", place.alias("place"))


@query(
    "shard_cpu_busy",
    union(
        f"SELECT {BUNDLE}, '' AS node, '1' AS shard, c_nationkey * 10 / CAST(1000 AS DOUBLE) * 100 AS usage FROM customer WHERE c_custkey % 3 = 0", f"SELECT {BUNDLE}, '', '2', 50.0 FROM customer WHERE c_custkey % 3 = 0",
        f"SELECT {BUNDLE}, '', '1', CASE WHEN c_nationkey <= 1 THEN c_nationkey * 100.0 ELSE c_nationkey END FROM customer WHERE c_custkey % 3 = 1",
    ),
)
def shard_cpu_busy(t):
    """Busy seconds over uptime, where a bundle has no gauge; a gauge wins; without uptime nothing is known."""
    rows = union(
        sample(metric_ops.BUSY_SECONDS, "c_nationkey * 10", shard="1"), sample(metric_ops.BUSY_SECONDS, "500", "c_custkey % 3 <> 1", shard="2"), sample(metric_ops.UPTIME, "1000", "c_custkey % 3 < 2", shard="0"),
        sample(metric_ops.UPTIME, "9999", "c_custkey % 3 < 2", at=60, shard="0"), sample(metric_ops.UTILIZATION, "c_nationkey", "c_custkey % 3 = 1", shard="1"))
    return metric_ops.shard_cpu(t.sql(rows)).select("bundle_id", "node", "shard", "usage")


_CHURN = (
    "SELECT concat('n-', c_nationkey) AS bundle_id, c_custkey AS id, CASE WHEN c_nationkey % 2 = 0 THEN 'Accepted new connection from x' ELSE 'Closed connection' END AS message, "
    "TIMESTAMP '2024-01-01 00:00:00' + CAST(c_custkey * CASE WHEN c_nationkey % 4 = 0 THEN 1 ELSE 1000 END AS {}) * INTERVAL '1' MILLISECOND AS ts FROM customer WHERE c_nationkey < 12 OR c_custkey % 3 > 0"
)


@query(
    "churn_audit",
    "SELECT bundle_id, 'High Connection Churn' AS name, 'Warning' AS status FROM (SELECT *, row_number() OVER (PARTITION BY bundle_id ORDER BY ts DESC, id DESC) AS r FROM "
    f"({_CHURN.format('INTEGER')}) c WHERE contains(message, 'Accepted')) x WHERE r <= 100 GROUP BY 1 HAVING count(*) >= 50 AND epoch_ms(max(ts)) - epoch_ms(min(ts)) BETWEEN 1 AND 9999",
)
def churn_audit(t):
    """Fifty and more connections within seconds, or spread over many minutes."""
    return judge(t, {"log_checks"}, logs=_CHURN.format("INT")).select("bundle_id", "name", "status")


_DEVICES = [("nvme0q1", "nvme0"), ("nvme10n1q33", "nvme10n1"), ("eth0-TxRx-3", "eth0"), ("virtio1-input.0", "virtio1"), ("mlx5_comp1@pci:0000", "mlx5_comp1@pci:0000"), ("", "")]


@query("device_names", f"SELECT {BUNDLE}, device FROM customer JOIN {values([(i, d) for i, (_, d) in enumerate(_DEVICES)], 'k', 'device')} ON k = c_custkey % {len(_DEVICES)}")
def device_names(t):
    """E10."""
    rows = t.sql(f"SELECT {BUNDLE}, d FROM customer JOIN {values([(i, d) for i, (d, _) in enumerate(_DEVICES)], 'k', 'd')} ON k = c_custkey % {len(_DEVICES)}")
    return rows.select("bundle_id", text.irq_base_device(F.col("d")).alias("device"))
