"""Leadership events, their summaries, and the merged timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import raft
from fleetlens.functions.text import topic_of
from fleetlens.operators.windows import top_per_key

EVENT_TYPES = ["Elected", "Stepdown", "Timeout", "Move", "Health"]
PARTITION_TYPES = EVENT_TYPES[:3]


def raft_events(logs: DataFrame, ntp: str | None = None) -> DataFrame:
    """(bundle_id, id, ts, node, term, type, ntp, reason, description).

    With ``ntp`` only that partition's lines and the first three types are taken.
    The cheap word filter runs before any pattern is tried.
    """
    message = F.col("message")
    lowered = F.lower(message)
    wanted = raft.contains_any(lowered, raft.PARTITION_WORDS if ntp else raft.CLUSTER_WORDS)
    if ntp:
        wanted = F.contains(lowered, F.lit(ntp.lower())) & wanted
    kind = raft.event_type(F.col("_lowered"), PARTITION_TYPES if ntp else EVENT_TYPES)
    named = raft.ntp(message)
    return (
        logs.filter(wanted)
        .withColumn("_lowered", lowered)
        .withColumn("type", kind)
        .filter(F.col("type").isNotNull())
        .select(
            "bundle_id", "id", "ts", "node",
            raft.term(message).alias("term"),
            "type",
            (F.coalesce(named, F.lit(ntp)) if ntp else named).alias("ntp"),
            F.when(F.col("type") == "Stepdown", raft.stepdown_reason(message)).alias("reason"),
            message.alias("description"),
        )
    )


def _count_of(kind: str) -> Column:
    return F.count_if(F.col("type") == kind)


def consensus_summary(events: DataFrame) -> DataFrame:
    """Totals by type and the time span, per bundle."""
    return events.groupBy("bundle_id").agg(
        F.count("*").alias("total"),
        *[_count_of(kind).alias(kind.lower()) for kind in EVENT_TYPES],
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
    )


def consensus_by_node(events: DataFrame) -> DataFrame:
    """Totals by type for each node; health reports count in the total only."""
    return events.groupBy("bundle_id", "node").agg(
        F.count("*").alias("total"),
        _count_of("Elected").alias("elections"),
        _count_of("Stepdown").alias("stepdowns"),
        _count_of("Timeout").alias("timeouts"),
        _count_of("Move").alias("moves"),
    )


def stepdown_reasons(events: DataFrame) -> DataFrame:
    """Stepdowns by reason and node; sum over nodes for the plain reasons."""
    known = events.filter((F.col("type") == "Stepdown") & F.col("reason").isNotNull())
    return known.groupBy("bundle_id", "reason", "node").agg(F.count("*").alias("count"))


def hotspots(events: DataFrame, by: str = "partition", n: int = 10) -> DataFrame:
    """The ``n`` busiest partitions or topics of each bundle; ties go by name."""
    name = F.col("ntp") if by == "partition" else topic_of(F.col("ntp"))
    counts = (
        events.filter(F.col("ntp").isNotNull())
        .groupBy("bundle_id", name.alias("name"))
        .agg(F.count("*").alias("count"))
    )
    return top_per_key(counts, ["bundle_id"], [F.col("count").desc(), F.col("name")], n, rank="rank")


# Thresholds of the three hints.
NODE_TIMEOUTS, NODE_ELECTIONS = 5, 10
LOOP_GAP, LOOP_ELECTIONS = 5, 10


def consensus_insights(events: DataFrame) -> DataFrame:
    """(bundle_id, insight, subject, value): busy node, election loop, timeouts. All three
    come from one row per bundle, so the events are computed once."""
    f = F.col
    busy_first = F.struct(-f("total"), "node")
    df = consensus_by_node(events).groupBy("bundle_id").agg(
        F.min_by(F.struct("node", "total", "timeouts", "elections"), busy_first).alias("top"),
        F.sum("elections").alias("elected"), F.sum("stepdowns").alias("stepdown"), F.sum("timeouts").alias("timeout"),
    )

    def row(insight: str, subject: Column, value: Column) -> Column:
        return F.struct(F.lit(insight).alias("insight"), subject.alias("subject"), value.alias("value"))

    hot = (f("top.timeouts") > NODE_TIMEOUTS) | (f("top.elections") > NODE_ELECTIONS)
    churn = (f("elected") > LOOP_ELECTIONS) & (f("stepdown") > 0) & (F.abs(f("elected") - f("stepdown")) < LOOP_GAP)
    found = F.array(
        F.when(hot, row("node hotspot", f("top.node"), f("top.total"))),
        F.when(churn, row("election loop", F.lit("cluster"), f("elected"))),
        F.when(f("timeout") > 0, row("raft timeouts", F.lit("cluster"), f("timeout"))),
    )
    return df.select("bundle_id", F.explode(F.array_compact(found)).alias("r")).select("bundle_id", "r.*")


def _container_states(pods: DataFrame) -> DataFrame:
    return pods.select(
        "bundle_id", F.col("metadata.name").alias("pod"), F.explode("status.containerStatuses").alias("c")
    )


def log_timeline(logs: DataFrame, max_logs: int | None = None) -> DataFrame:
    """ERROR and WARN lines: all, or the newest ``max_logs`` of each bundle."""
    hits = logs.filter(F.col("level").isin("ERROR", "WARN"))
    if max_logs:
        hits = top_per_key(hits, ["bundle_id"], [F.col("ts").desc(), F.col("id").desc()], max_logs, salt_by="id")
    raw = F.col("raw") if "raw" in logs.columns else F.col("message")
    return hits.select(
        "bundle_id", "ts", F.lit("Log").alias("type"), F.col("node").alias("source"),
        F.col("message").alias("description"),
        F.when(F.col("level") == "ERROR", "Critical").otherwise("Warning").alias("severity"),
        raw.alias("details"),
    )


def k8s_timeline(events: DataFrame) -> DataFrame:
    host = F.col("source_component") if "source_component" in events.columns else F.lit("")
    return events.select(
        "bundle_id", F.col("last_timestamp").alias("ts"), F.lit("K8s").alias("type"),
        F.concat_ws("/", "involved_kind", "involved_name").alias("source"),
        F.concat_ws(": ", "reason", "message").alias("description"),
        F.when(F.col("type") == "Warning", "Warning").otherwise("Normal").alias("severity"),
        F.concat(F.lit("Source: "), F.coalesce(host, F.lit("")), F.lit("\nCount: "), F.col("count").cast("string")).alias("details"),
    )


def pod_timeline(pods: DataFrame) -> DataFrame:
    """Starts and terminations of containers; one pass explodes both states."""
    states = _container_states(pods)
    running = F.col("c.state")["running"]
    ended = F.col("c.lastState")["terminated"]
    exit_code = F.coalesce(ended["exitCode"], F.lit(0))
    bad = ended["reason"].isin("OOMKilled", "Error") | (exit_code != 0)
    start = F.struct(
        running["startedAt"].alias("ts"), F.lit("K8s").alias("type"),
        F.lit("Pod Started (Running)").alias("description"), F.lit("Normal").alias("severity"),
        F.concat(F.lit("Container: "), F.col("c.name")).alias("details"),
    )
    stop = F.struct(
        ended["finishedAt"].alias("ts"), F.lit("Restart").alias("type"),
        F.concat(F.lit("Pod Terminated: "), F.coalesce(ended["reason"], F.lit(""))).alias("description"),
        F.when(bad, "Critical").otherwise("Warning").alias("severity"),
        F.concat(F.lit("Exit Code: "), exit_code.cast("string"), F.lit("\nContainer: "), F.col("c.name")).alias("details"),
    )
    rows = states.select("bundle_id", "pod", F.explode(F.array(start, stop)).alias("e"))
    return rows.filter(F.col("e.ts").isNotNull()).select(
        "bundle_id", "e.ts", "e.type", F.col("pod").alias("source"), "e.description", "e.severity", "e.details"
    )


def timeline(
    logs: DataFrame, k8s_events: DataFrame | None = None, pods: DataFrame | None = None,
    max_logs: int | None = None,
) -> DataFrame:
    """Logs, Kubernetes events and pod starts and ends in one schema. Unsorted:
    order by (bundle_id, ts) where the reader needs it."""
    out = log_timeline(logs, max_logs)
    if k8s_events is not None:
        out = out.unionByName(k8s_timeline(k8s_events))
    if pods is not None:
        out = out.unionByName(pod_timeline(pods))
    return out


def pod_restarts(pods: DataFrame) -> DataFrame:
    """Restart count of each pod, summed over its containers."""
    total = F.aggregate(
        F.coalesce("status.containerStatuses", F.array()), F.lit(0).cast("bigint"),
        lambda acc, c: acc + F.coalesce(c["restartCount"], F.lit(0)).cast("bigint"),
    )
    return pods.select("bundle_id", F.col("metadata.name").alias("pod"), total.alias("restarts"))
