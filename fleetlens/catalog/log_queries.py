"""Queries over logs: templates, search, facets, events, timeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.catalog.registry import query
from fleetlens.functions import raft, text
from fleetlens.functions.rules import INSIGHT_RULES, with_insight
from fleetlens.operators import events, logs


def micros(name: str):
    return F.unix_micros(F.col(name)).alias(name)


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def fingerprint_sql(column: str) -> str:
    """The lexer in the checking engine's SQL: same pattern, same mapping."""
    return f"""array_to_string(list_transform(regexp_extract_all({column}, {_quoted(text.LEXEME)}, 0), lambda x:
      CASE WHEN regexp_matches(x, '^["'']') THEN '<STR>' WHEN NOT regexp_matches(x, '[0-9]') THEN x
           WHEN regexp_matches(x, '^0[xX]') THEN '<HEX>' WHEN regexp_matches(x, '^[0-9.]+$') THEN '<NUM>' ELSE '<*>' END), '')"""


_PATTERNS_SQL = """
SELECT bundle_id, level, fingerprint, count(*) AS count, {times} arg_min(message, id) AS sample
FROM (SELECT *, {fp} AS fingerprint FROM {table}) f GROUP BY bundle_id, level, fingerprint"""


@query(
    "log_patterns",
    _PATTERNS_SQL.format(
        fp=fingerprint_sql("message"), table="v_logs",
        times="epoch_us(min(ts)) AS first_seen, epoch_us(max(ts)) AS last_seen,",
    ),
)
def log_patterns(t):
    out = logs.log_patterns(t.v_logs)
    return out.withColumns({"first_seen": micros("first_seen"), "last_seen": micros("last_seen")})


@query(
    "document_patterns",
    _PATTERNS_SQL.format(fp=fingerprint_sql("message"), table="v_doc_logs", times=""),
)
def document_patterns(t):
    return logs.log_patterns(t.v_doc_logs.withColumn("ts", F.lit(None).cast("timestamp"))).drop("first_seen", "last_seen")


@query("fingerprint_documents", f"SELECT doc_id, {fingerprint_sql('text')} AS fingerprint FROM documents")
def fingerprint_documents(t):
    return t.documents.select("doc_id", text.fingerprint(F.col("text")).alias("fingerprint"))


def _insight_sql(field: str) -> str:
    whens = " ".join(
        f"WHEN regexp_matches(sample, {_quoted('(?i)' + r.pattern)}) THEN {_quoted(getattr(r, field))}" for r in INSIGHT_RULES
    )
    return f"CASE {whens} END"


@query(
    "log_insights",
    "SELECT bundle_id, level, fingerprint, count, "
    + ", ".join(f"{_insight_sql(f)} AS {f}" for f in ("description", "severity", "action"))
    + " FROM (" + _PATTERNS_SQL.format(fp=fingerprint_sql("message"), table="v_logs", times="") + ") p",
)
def log_insights(t):
    out = with_insight(logs.log_patterns(t.v_logs), "sample")
    return out.select("bundle_id", "level", "fingerprint", "count", "description", "severity", "action")


@query(
    "pattern_report",
    "SELECT bundle_id, level, fingerprint, count, sum(count) OVER (PARTITION BY bundle_id) :: BIGINT AS total_logs FROM ("
    + _PATTERNS_SQL.format(fp=fingerprint_sql("message"), table="v_logs", times="") + ") p",
)
def pattern_report(t):
    return logs.pattern_report(t.v_logs).select("bundle_id", "level", "fingerprint", "count", "total_logs")


def _search(name: str, search: str, where: str, table: str = "v_doc_logs", **kw):
    @query(name, f"SELECT bundle_id, id, level, node FROM (SELECT *, lower(message) AS m FROM {table}) t WHERE {where}")
    def run(t):
        return logs.filter_logs(getattr(t, table), search=search, **kw).select("bundle_id", "id", "level", "node")

    return run


_search("log_search_and", "the AND that AND tion", "contains(m, 'the') AND contains(m, 'that') AND contains(m, 'tion')")
_search("log_search_near", "the that on", "contains(m, 'the') AND contains(m, 'that')")
_search("log_search_or", 'ion OR "eau" OR zzz', "contains(m, 'ion') OR contains(m, 'eau') OR contains(m, 'zzz')")
_search("log_search_not", "the NOT tion", "contains(m, 'the') AND NOT contains(m, 'tion')")
_search("log_search_phrase", 'message:"the th" OR "ion de"', "contains(m, 'the th') OR contains(m, 'ion de')")
_search("log_search_groups", "(the OR eau) AND (tion OR ment) NOT copyright",
        "(contains(m, 'the') OR contains(m, 'eau')) AND (contains(m, 'tion') OR contains(m, 'ment')) AND NOT contains(m, 'copyright')")
_search("log_search_leading_not", "NOT the AND tion", "NOT (contains(m, 'the') AND contains(m, 'tion'))")
_search("log_search_ignore", "stalled OR leader", "(contains(m, 'stalled') OR contains(m, 'leader')) AND NOT contains(m, 'topic-3')",
        table="v_logs", ignore="NOT topic-3")
_search("log_filter", "connection OR segment",
        "(contains(m, 'connection') OR contains(m, 'segment')) AND level IN ('DEBUG', 'TRACE') AND node = 'node-1' "
        "AND component IN ('click', 'view') AND ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-20 12:30:00'",
        table="v_logs", level=["DEBUG", "TRACE"], node="node-1", component=["click", "view"],
        start="2024-01-05T00:00", end="2024-01-20T12:30:00")


@query(
    "log_page",
    "SELECT l.bundle_id, l.id, l.level, p.log_id IS NOT NULL AS is_pinned FROM v_doc_logs l "
    "LEFT JOIN (SELECT DISTINCT bundle_id, log_id FROM v_pins) p ON p.bundle_id = l.bundle_id AND p.log_id = l.id "
    "WHERE contains(lower(message), 'the') ORDER BY l.id DESC LIMIT 100 OFFSET 20",
)
def log_page(t):
    found = logs.filter_logs(t.v_doc_logs.withColumn("ts", F.timestamp_seconds("id")), search="the")
    page = logs.page_logs(found, t.v_pins, limit=100, offset=20, search="the")
    return page.select("bundle_id", "id", "level", "is_pinned")


@query("log_totals", "SELECT bundle_id, count(*) AS total FROM v_logs WHERE contains(lower(message), 'leader') GROUP BY bundle_id")
def log_totals(t):
    return logs.count_logs(logs.filter_logs(t.v_logs, search="leader"))


@query(
    "log_snippets",
    "SELECT id, substr(message, greatest(strpos(lower(message), 'the') - 50, 1), "
    "strpos(lower(message), 'the') - greatest(strpos(lower(message), 'the') - 50, 1) + 53) AS snippet "
    "FROM v_doc_logs WHERE strpos(lower(message), 'the') > 0",
)
def log_snippets(t):
    out = t.v_doc_logs.select("id", text.snippet(F.col("message"), "the").alias("snippet"))
    return out.filter(F.col("snippet").isNotNull())


@query(
    "log_highlights",
    "SELECT id, regexp_replace(replace(replace(replace(replace(replace(message, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), "
    "'\"', '&#34;'), '''', '&#39;'), '(?i)(stepping down|leader)', '<mark>\\1</mark>', 'g') AS shown FROM v_logs",
)
def log_highlights(t):
    return t.v_logs.select("id", text.highlight(F.col("message"), ["leader", "stepping down"]).alias("shown"))


@query("log_facets", "SELECT DISTINCT bundle_id, component FROM v_logs")
def log_facets(t):
    return logs.distinct_values(t.v_logs, "component")


@query("log_time_range", "SELECT bundle_id, epoch_us(min(ts)) AS first_ts, epoch_us(max(ts)) AS last_ts FROM v_logs GROUP BY bundle_id")
def log_time_range(t):
    return logs.time_range(t.v_logs).select("bundle_id", micros("first_ts"), micros("last_ts"))


_BUCKET = "(epoch_us({ts}) // ({n} * 1000000 :: BIGINT)) * ({n} * 1000000 :: BIGINT)"


@query(
    "log_counts_by_time",
    f"SELECT bundle_id, {_BUCKET.format(ts='ts', n=60)} AS bucket, count(*) AS count FROM v_logs "
    "WHERE level IN ('ERROR', 'WARN') GROUP BY 1, 2",
)
def log_counts_by_time(t):
    return logs.log_counts_by_time(t.v_logs, 0).withColumn("bucket", micros("bucket"))


@query(
    "k8s_counts_by_time",
    f"SELECT bundle_id, {_BUCKET.format(ts='last_timestamp', n=3600)} AS bucket, sum(count) :: BIGINT AS count FROM v_k8s_events "
    "WHERE type = 'Warning' GROUP BY 1, 2",
)
def k8s_counts_by_time(t):
    return logs.k8s_counts_by_time(t.v_k8s_events, 3600).withColumn("bucket", micros("bucket"))


@query(
    "timeline_buckets",
    f"SELECT bundle_id, bucket, sum(n) :: BIGINT AS count FROM (SELECT bundle_id, {_BUCKET.format(ts='ts', n=120)} AS bucket, 1 AS n "
    "FROM v_logs WHERE level IN ('ERROR', 'WARN') UNION ALL SELECT bundle_id, "
    f"{_BUCKET.format(ts='last_timestamp', n=120)}, count FROM v_k8s_events WHERE type = 'Warning') u GROUP BY 1, 2",
)
def timeline_buckets(t):
    return logs.timeline_buckets(t.v_logs, t.v_k8s_events).withColumn("bucket", micros("bucket"))


_EVENTS_SQL = """
SELECT bundle_id, id, epoch_us(ts) AS ts, node, TRY_CAST(regexp_extract(message, 'term (\\d+)', 1) AS BIGINT) AS term, type,
       nullif(regexp_extract(message, '([\\w._-]+/[\\w._-]+/\\d+)', 1), '') AS ntp,
       CASE WHEN type = 'Stepdown' THEN nullif(regexp_extract(message, '(?:reasoning: |\\[)([\\w_]+)(?:\\]\\s+Stepping down|\\z)', 1), '') END AS reason
FROM (SELECT *, CASE WHEN contains(m, 'became the leader') THEN 'Elected' WHEN contains(m, 'stepping down') THEN 'Stepdown'
        WHEN contains(m, 'timeout') OR contains(m, 'error code: 10') THEN 'Timeout'
        WHEN contains(m, 'moving') OR contains(m, 'reconfiguration') OR contains(m, 'transferring leadership') THEN 'Move'
        WHEN contains(m, 'is down') THEN 'Health' END AS type
      FROM (SELECT *, lower(message) AS m FROM v_logs) l
      WHERE contains(m, 'leader') OR contains(m, 'stepdown') OR contains(m, 'timeout') OR contains(m, 'term')
         OR contains(m, 'reconfiguration') OR contains(m, 'moving') OR contains(m, 'is down')) e
WHERE type IS NOT NULL"""


@query("raft_events", _EVENTS_SQL)
def raft_events(t):
    return events.raft_events(t.v_logs).drop("description").withColumn("ts", micros("ts"))


@query(
    "partition_raft_events",
    f"SELECT * FROM ({_EVENTS_SQL}) e WHERE type IN ('Elected', 'Stepdown', 'Timeout') AND ntp LIKE 'kafka/topic-3/%'",
)
def partition_raft_events(t):
    return events.raft_events(t.v_logs, ntp="kafka/topic-3/").drop("description").withColumn("ts", micros("ts"))


@query(
    "consensus_summary",
    "SELECT bundle_id, count(*) AS total, count(*) FILTER (type = 'Elected') AS elected, count(*) FILTER (type = 'Stepdown') AS stepdown, "
    "count(*) FILTER (type = 'Timeout') AS timeout, count(*) FILTER (type = 'Move') AS move, count(*) FILTER (type = 'Health') AS health, "
    f"min(ts) AS start_ts, max(ts) AS end_ts FROM ({_EVENTS_SQL}) e GROUP BY bundle_id",
)
def consensus_summary(t):
    out = events.consensus_summary(events.raft_events(t.v_logs))
    return out.withColumns({"start_ts": micros("start_ts"), "end_ts": micros("end_ts")})


_BY_NODE = (
    "SELECT bundle_id, node, count(*) AS total, count(*) FILTER (type = 'Elected') AS elections, "
    "count(*) FILTER (type = 'Stepdown') AS stepdowns, count(*) FILTER (type = 'Timeout') AS timeouts, "
    f"count(*) FILTER (type = 'Move') AS moves FROM ({_EVENTS_SQL}) e GROUP BY bundle_id, node"
)


@query("consensus_by_node", _BY_NODE)
def consensus_by_node(t):
    return events.consensus_by_node(events.raft_events(t.v_logs))


@query(
    "stepdown_reasons",
    f"SELECT bundle_id, reason, node, count(*) AS count FROM ({_EVENTS_SQL}) e WHERE type = 'Stepdown' AND reason IS NOT NULL GROUP BY 1, 2, 3",
)
def stepdown_reasons(t):
    return events.stepdown_reasons(events.raft_events(t.v_logs))


def _hotspot_sql(name: str) -> str:
    return (
        "SELECT bundle_id, name, count, CAST(row_number() OVER (PARTITION BY bundle_id ORDER BY count DESC, name) AS INT) AS rank FROM "
        f"(SELECT bundle_id, {name} AS name, count(*) AS count FROM ({_EVENTS_SQL}) e WHERE ntp IS NOT NULL GROUP BY 1, 2) c "
        "QUALIFY rank <= 10"
    )


@query("consensus_hotspots", _hotspot_sql("ntp"))
def consensus_hotspots(t):
    return events.hotspots(events.raft_events(t.v_logs))


@query("consensus_hot_topics", _hotspot_sql("split_part(ntp, '/', 2)"))
def consensus_hot_topics(t):
    return events.hotspots(events.raft_events(t.v_logs), by="topic")


@query(
    "consensus_insights",
    f"WITH n AS ({_BY_NODE}), s AS (SELECT bundle_id, sum(elections) :: BIGINT AS el, sum(stepdowns) :: BIGINT AS st, sum(timeouts) :: BIGINT AS ti FROM n GROUP BY 1) "
    "SELECT bundle_id, 'node hotspot' AS insight, node AS subject, total AS value FROM "
    "(SELECT *, row_number() OVER (PARTITION BY bundle_id ORDER BY total DESC, node) AS rn FROM n) r WHERE rn = 1 AND (timeouts > 5 OR elections > 10) "
    "UNION ALL SELECT bundle_id, 'election loop', 'cluster', el FROM s WHERE el > 10 AND st > 0 AND abs(el - st) < 5 "
    "UNION ALL SELECT bundle_id, 'raft timeouts', 'cluster', ti FROM s WHERE ti > 0",
)
def consensus_insights(t):
    return events.consensus_insights(events.raft_events(t.v_logs))


@query(
    "timeline",
    "SELECT bundle_id, epoch_us(ts) AS ts, 'Log' AS type, node AS source, message AS description, "
    "CASE level WHEN 'ERROR' THEN 'Critical' ELSE 'Warning' END AS severity, message AS details FROM "
    "v_logs WHERE level IN ('ERROR', 'WARN') "
    "UNION ALL SELECT bundle_id, epoch_us(last_timestamp), 'K8s', concat(involved_kind, '/', involved_name), concat(reason, ': ', message), "
    "CASE type WHEN 'Warning' THEN 'Warning' ELSE 'Normal' END, concat('Source: ', chr(10), 'Count: ', CAST(count AS STRING)) FROM v_k8s_events",
)
def timeline(t):
    return events.timeline(t.v_logs, t.v_k8s_events).withColumn("ts", micros("ts"))


@query(
    "pinned_logs",
    "SELECT l.bundle_id, l.id, l.level, p.note, p.created_at FROM v_doc_logs l JOIN v_pins p ON p.bundle_id = l.bundle_id AND p.log_id = l.id",
)
def pinned_logs(t):
    return logs.pinned_logs(t.v_doc_logs, t.v_pins).select("bundle_id", "id", "level", "note", "created_at")


@query(
    "unpinned_logs",
    "SELECT bundle_id, id, level FROM v_doc_logs l WHERE NOT EXISTS (SELECT 1 FROM v_pins p WHERE p.bundle_id = l.bundle_id AND p.log_id = l.id)",
)
def unpinned_logs(t):
    return logs.exclude_ids(t.v_doc_logs, t.v_pins).select("bundle_id", "id", "level")


@query(
    "log_context",
    "SELECT l.bundle_id, l.file_path, l.line_number, a.line_number AS anchor, l.line, l.line_number = a.line_number AS is_match "
    "FROM v_log_lines l JOIN (SELECT * FROM v_log_lines WHERE role = 'assistant') a ON a.bundle_id = l.bundle_id AND a.file_path = l.file_path "
    "AND l.line_number BETWEEN a.line_number - 2 AND a.line_number + 2",
)
def log_context(t):
    lines = t.v_log_lines
    return logs.log_context(lines.drop("role"), lines.filter("role = 'assistant'"), k=2)


@query(
    "connection_churn",
    "SELECT bundle_id, count(*) AS hits, epoch_us(min(ts)) AS first_ts, epoch_us(max(ts)) AS last_ts, "
    "round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 6) AS per_second FROM "
    "(SELECT * FROM v_logs WHERE contains(lower(message), 'accepted new connection') "
    "QUALIFY row_number() OVER (PARTITION BY bundle_id ORDER BY ts DESC, id DESC) <= 100) h GROUP BY 1 "
    "HAVING count(*) >= 50 AND epoch_us(max(ts)) > epoch_us(min(ts)) AND epoch_us(max(ts)) - epoch_us(min(ts)) < 1000000 :: BIGINT * 86400 * 10",
)
def connection_churn(t):
    out = logs.burst_rate(t.v_logs, '"accepted new connection"', within_seconds=86400 * 10)
    return out.select("bundle_id", "hits", micros("first_ts"), micros("last_ts"), F.round("per_second", 6).alias("per_second"))
