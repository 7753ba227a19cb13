"""Diagnostic tables derived from the driver tables, as SQL that runs unchanged in
Spark and in the checking engine.

Every view reads its whole source table. ``bundle_id`` is skewed on purpose: one bundle
holds about a third of the rows or more.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from fleetlens.session import pin_utc

SOURCES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

_EVENT_BUNDLE = (
    "CASE WHEN user_id % 3 = 0 THEN 'bundle-0' ELSE concat('bundle-', CAST(user_id % 7 AS STRING)) END"
)
_DOC_BUNDLE = "concat('bundle-', CAST(CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id % 5 END AS STRING))"
_NODE = "CASE WHEN l_suppkey % 7 < 3 THEN 0 WHEN l_suppkey % 10 = 9 THEN l_suppkey - 1 ELSE l_suppkey END"

VIEWS: dict[str, str] = {
    "v_logs": f"""
SELECT bundle_id, event_id AS id, ts, level, node, shard, component, message,
       concat('/fleet/', bundle_id, '/logs/', node, '.log') AS file_path, event_id AS line_number
FROM (
  SELECT event_id, ts, event_type AS component, {_EVENT_BUNDLE} AS bundle_id,
    CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'signup' THEN 'INFO'
                    WHEN 'click' THEN 'DEBUG' ELSE 'TRACE' END AS level,
    concat('node-', CAST(user_id % 3 AS STRING)) AS node,
    CAST(user_id % 8 AS STRING) AS shard,
    CASE
      WHEN event_type = 'signup' THEN concat('[{{kafka/topic-', CAST(user_id % 10 AS STRING), '/', CAST(user_id % 5 AS STRING),
           '}}] became the leader term ', regexp_extract(props, '([0-9]+)', 1))
      WHEN event_type = 'purchase' THEN concat('{{kafka/topic-', CAST(user_id % 10 AS STRING), '/', CAST(user_id % 5 AS STRING),
           '}} [heartbeats_majority] Stepping down as leader in term ', regexp_extract(props, '([0-9]+)', 1))
      WHEN event_type = 'error' AND user_id % 2 = 0 THEN concat('raft::errc::timeout for kafka/topic-', CAST(user_id % 10 AS STRING),
           '/', CAST(user_id % 5 AS STRING), ' after ', regexp_extract(props, '([0-9]+)', 1), ' ms')
      WHEN event_type = 'error' THEN concat('Reactor stalled: reactor_stalled for ', regexp_extract(props, '([0-9]+)', 1), ' ms')
      WHEN event_type = 'click' THEN concat('Accepted new connection from 10.0.0.', CAST(user_id AS STRING), ':9092')
      ELSE concat('Creating new segment "/data/kafka/topic-', CAST(user_id % 10 AS STRING), '/0_1/', CAST(event_id AS STRING), '-1-v1.log"')
    END AS message
  FROM events) t""",
    "v_doc_logs": f"""
SELECT {_DOC_BUNDLE} AS bundle_id, doc_id AS id, text AS message, source AS node, lang AS component,
       CASE lang WHEN 'en' THEN 'INFO' WHEN 'fr' THEN 'WARN' ELSE 'ERROR' END AS level
FROM documents""",
    "v_pins": f"""
SELECT {_DOC_BUNDLE} AS bundle_id, doc_id AS log_id, concat('note ', CAST(doc_id AS STRING)) AS note,
       quality * 1000 + doc_id % 1000 AS created_at
FROM labels""",
    "v_metrics": f"""
SELECT {_EVENT_BUNDLE} AS bundle_id, event_id AS id, concat('metric_', event_type) AS name, ts, value,
       CAST(user_id % 8 AS STRING) AS shard, CASE WHEN user_id % 2 = 0 THEN 'read' ELSE 'write' END AS class
FROM events""",
    # Counters of several nodes per bundle that differ widely; values lie on both sides of the rules' limits.
    "v_node_metrics": f"""
SELECT {_EVENT_BUNDLE} AS bundle_id, concat('node-', CAST(event_id % 3 AS STRING)) AS node, event_id AS id, ts, CAST(user_id % 8 AS STRING) AS shard,
       CASE event_type WHEN 'click' THEN 'vectorized_reactor_cpu_steal_time_ms' WHEN 'view' THEN 'vectorized_io_queue_queue_length'
                       WHEN 'purchase' THEN 'vectorized_reactor_utilization' WHEN 'signup' THEN 'vectorized_io_queue_total_write_ops'
                       ELSE 'vectorized_reactor_busy_seconds_total' END AS name,
       CAST(CASE event_type
         WHEN 'click' THEN (CAST(extract(day FROM ts) AS BIGINT) * 86400 + CAST(extract(hour FROM ts) AS BIGINT) * 3600 + CAST(extract(minute FROM ts) AS BIGINT) * 60) * (CASE user_id % 7 WHEN 3 THEN 11 WHEN 6 THEN 150 ELSE 2 END) + (event_id % 3) * 1000000000
         WHEN 'view' THEN 970 + 20 * (user_id % 7 % 4)
         WHEN 'purchase' THEN CASE WHEN user_id % 8 = 0 THEN 90 ELSE 20 + 25 * (event_id % 3) END
         ELSE event_id % 50 END AS DOUBLE) AS value
FROM events""",
    "v_k8s_events": f"""
SELECT {_EVENT_BUNDLE} AS bundle_id, event_id AS id, CASE WHEN event_type = 'error' THEN 'Warning' ELSE 'Normal' END AS type,
       event_type AS reason, concat('event ', CAST(event_id AS STRING)) AS message,
       CAST(1 + event_id % 3 AS BIGINT) AS count, ts AS last_timestamp,
       'Pod' AS involved_kind, concat('pod-', CAST(user_id % 20 AS STRING)) AS involved_name
FROM events""",
    "v_replicas": f"""
SELECT concat('bundle-', CAST(node_id % 4 AS STRING)) AS bundle_id, 'kafka' AS ns, topic, partition_id, node_id,
       min(core) AS core, max(position) AS committed_offset, max(heartbeat) AS ms_since_last_heartbeat
FROM (
  SELECT concat('topic-', CAST(l_partkey % 40 AS STRING)) AS topic, l_orderkey % 30 AS partition_id, {_NODE} AS node_id,
         CAST(l_linenumber % 4 AS BIGINT) AS core, l_orderkey AS position, CAST(floor(l_quantity) AS BIGINT) * 300 AS heartbeat
  FROM lineitem) t
GROUP BY topic, partition_id, node_id""",
    "v_brokers": """
SELECT concat('bundle-', CAST(s_suppkey % 4 AS STRING)) AS bundle_id, s_suppkey AS node_id,
       CASE WHEN s_nationkey % 6 = 5 THEN '' ELSE concat('rack-', CAST(s_nationkey % 6 AS STRING)) END AS rack,
       CAST(4 + s_suppkey % 4 AS BIGINT) AS num_cores, s_nationkey % 5 <> 4 AS is_alive, s_nationkey % 5 = 3 AS draining,
       CAST(100000000000 AS BIGINT) AS total_bytes, CAST(floor(abs(s_acctbal) * 9000000) AS BIGINT) AS free_bytes
FROM supplier""",
    "v_leaders": """
SELECT bundle_id, ns, topic, partition_id, CASE WHEN partition_id % 17 = 0 THEN -1 ELSE min(node_id) END AS leader
FROM v_replicas GROUP BY bundle_id, ns, topic, partition_id""",
    "v_partitions": """
SELECT bundle_id, ns, topic, partition_id, leader AS leader_id,
       CASE WHEN partition_id % 3 = 0 THEN 'under_replicated' WHEN partition_id % 11 = 1 THEN 'reconfiguring' ELSE 'done' END AS status
FROM v_leaders""",
    "v_kafka": """
SELECT bundle_id, topic, partition_id, CASE WHEN partition_id % 23 = 1 THEN leader + 1 ELSE leader END AS leader
FROM v_leaders""",
    "v_followers": """
SELECT bundle_id, ns, topic, partition_id, node_id, node_id + 1 AS follower_id, ms_since_last_heartbeat,
       CASE WHEN committed_offset % 29 = 0 THEN -9223372036854775807 ELSE committed_offset END AS last_flushed_log_index
FROM v_replicas""",
    "v_commits": """
SELECT concat('bundle-', CAST(CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_custkey % 4 END AS STRING)) AS bundle_id,
       concat('g-', CAST(o_custkey % 50 AS STRING)) AS group_id, concat('topic-', CAST(o_orderkey % 100 AS STRING)) AS topic,
       o_orderkey % 60 AS partition_id, max(o_orderkey) AS at
FROM orders GROUP BY 1, 2, 3, 4""",
    "v_hwm": """
SELECT concat('bundle-', CAST(l_suppkey % 4 AS STRING)) AS bundle_id, concat('topic-', CAST(l_orderkey % 100 AS STRING)) AS topic,
       l_orderkey % 50 AS partition_id, max(l_orderkey) AS hwm
FROM lineitem GROUP BY 1, 2, 3""",
    "v_groups": """
SELECT DISTINCT concat('bundle-', CAST(c_nationkey % 4 AS STRING)) AS bundle_id,
       concat('g-', CAST(c_custkey % 60 AS STRING)) AS group_id, 'Stable' AS state
FROM customer""",
    "v_cpu_profiles": """
SELECT concat('bundle-', CAST(CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE l_suppkey % 4 END AS STRING)) AS bundle_id,
       concat('node-', CAST(l_suppkey % 3 AS STRING)) AS node, CAST(l_linenumber AS BIGINT) AS shard_id,
       CASE l_returnflag WHEN 'A' THEN 'main' WHEN 'R' THEN 'fetch' ELSE 'produce' END AS scheduling_group,
       concat(CASE WHEN l_partkey % 5 = 0 THEN 'persistent_size ' WHEN l_partkey % 7 = 0 THEN 'SSL_accept ' ELSE '' END,
              '0x', CAST(l_partkey % 197 AS STRING)) AS user_backtrace, CAST(floor(l_quantity) AS BIGINT) AS occurrences
FROM lineitem""",
    "v_segments": f"""
SELECT {_DOC_BUNDLE} AS bundle_id,
       concat('/var/lib/data/kafka/', source, '/', CAST(doc_id % 4 AS STRING), '_', CAST(doc_id % 3 AS STRING),
              '/', CAST(doc_id AS STRING), '-1-v1.log') AS path, n_chars AS size_bytes
FROM documents""",
    "v_du": f"""
SELECT {_DOC_BUNDLE} AS bundle_id,
       concat(CASE WHEN source = 'src2' THEN '/var/tmp/' ELSE '/var/lib/data/kafka/' END, source, '/', CAST(doc_id % 4 AS STRING), '_', CAST(doc_id % 3 AS STRING)) AS path,
       n_chars + 7 AS size_bytes
FROM documents""",
    "v_active_partitions": f"""
SELECT DISTINCT {_DOC_BUNDLE} AS bundle_id, CASE WHEN source = 'src0' THEN 'kept' ELSE source END AS topic,
       doc_id % 4 AS partition_id, CAST(1 AS BIGINT) AS revision
FROM documents""",
    "v_topic_bytes": """
SELECT concat('bundle-', CAST(CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE l_suppkey % 4 END AS STRING)) AS bundle_id,
       l_orderkey AS id, 'written_bytes' AS name, l_shipdate AS ts,
       floor(l_quantity * CASE WHEN l_partkey % 40 = 0 THEN 9000 ELSE 100 END) AS value,
       concat('topic-', CAST(l_partkey % 40 AS STRING)) AS topic
FROM lineitem""",
    "v_log_lines": """
SELECT concat('bundle-', CAST(conv_id % 3 AS STRING)) AS bundle_id, concat('file-', CAST(conv_id AS STRING)) AS file_path,
       turn AS line_number, text AS line, role
FROM conversations""",
    "v_mounts": """
SELECT DISTINCT concat('bundle-', CAST(page_id % 3 AS STRING)) AS bundle_id, regexp_extract(url, '^(https?://[^/]+)', 1) AS mount FROM pages
UNION
SELECT DISTINCT concat('bundle-', CAST(page_id % 3 AS STRING)) AS bundle_id, regexp_extract(url, '^(https?://[^/]+/[^/?#]*)', 1) AS mount FROM pages""",
    "v_sockets": f"""
SELECT {_EVENT_BUNDLE} AS bundle_id, CASE event_type WHEN 'error' THEN 'TIME-WAIT' WHEN 'view' THEN 'LISTEN' ELSE 'ESTAB' END AS state,
       concat('10.0.0.', CAST(user_id % 5 AS STRING), ':', CAST(9000 + user_id % 90 AS STRING)) AS local_addr,
       concat('10.1.0.', CAST(user_id AS STRING), ':', CAST(event_id % 60000 AS STRING)) AS peer_addr,
       CAST(floor(value) AS BIGINT) AS retrans_total
FROM events""",
    "v_irqs": """
SELECT concat('bundle-', CAST(l_suppkey % 4 AS STRING)) AS bundle_id, 'node-0' AS node,
       CASE WHEN l_partkey % 2 = 0 THEN 'NET_RX' ELSE 'BLOCK' END AS irq_id,
       concat('nvme', CAST(l_partkey % 3 AS STRING), 'q', CAST(l_partkey % 4 AS STRING)) AS device,
       l_linenumber * l_linenumber % 32 AS cpu, sum(CAST(floor(l_extendedprice) AS BIGINT)) AS count
FROM lineitem GROUP BY 1, 2, 3, 4, 5""",
    "v_sysctl": """
SELECT concat('bundle-', CAST(s_nationkey AS STRING)) AS bundle_id, concat('node-', CAST(s_suppkey AS STRING)) AS node, 'sysctl' AS source,
       CASE s_suppkey % 5 WHEN 0 THEN 'fs.aio-max-nr' WHEN 1 THEN 'net.core.somaxconn' WHEN 2 THEN 'vm.swappiness'
                          WHEN 3 THEN 'net.ipv4.ip_local_port_range' ELSE 'fs.file-max' END AS key,
       CASE s_suppkey % 5 WHEN 3 THEN concat('32768 ', CAST(50000 + s_suppkey % 15000 AS STRING))
                          WHEN 2 THEN CAST(s_suppkey % 60 AS STRING)
                          ELSE CAST(CAST(floor(abs(s_acctbal) * 300) AS BIGINT) AS STRING) END AS value
FROM supplier""",
}

_NAME = re.compile(r"\bv_[a-z_0-9]+\b")


def needed_views(sql: str) -> list[str]:
    """Names of the views that a text uses, those they build on first."""
    out: list[str] = []

    def visit(text: str) -> None:
        for name in _NAME.findall(text):
            if name in VIEWS and name not in out:
                visit(VIEWS[name])
                if name not in out:
                    out.append(name)

    visit(sql)
    return out


def with_views(sql: str) -> str:
    """The check's SQL with the views it needs in front."""
    names = needed_views(sql)
    if not names:
        return sql
    head = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
    body = sql.lstrip()
    return f"WITH {head},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head}\n{sql}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view (or driver table) as a DataFrame; only the tables it reads are opened."""
    return select(spark, sf_dir, f"SELECT * FROM {name}")


def select(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The rows of a query over views and driver tables."""
    pin_utc(spark)
    sql = with_views(text)
    for table in SOURCES:
        if re.search(rf"\b{table}\b", sql):
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    df = spark.sql(sql)
    for column, kind in df.dtypes:
        if kind == "timestamp_ntz":
            df = df.withColumn(column, df[column].cast("timestamp"))
    return df
