"""Ordered rule tables and the expressions that apply them (first match wins)."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class InsightRule(NamedTuple):
    pattern: str
    severity: str
    description: str
    action: str


# Patterns, severities and their order. The texts are our own.
INSIGHT_RULES = [
    InsightRule(r"vote_stm\.cc.*error code: 10", "Warning", "Raft vote timed out", "Look for slow network, starved CPU or disk stalls on the voter."),
    InsightRule(r"raft::errc::timeout", "Warning", "Raft request timed out", "Check the network between nodes and their CPU and disk load."),
    InsightRule(r"bad_alloc", "Critical", "Memory allocation failed", "Check memory limits and look for a leak."),
    InsightRule(r"not_enough_free_space", "Critical", "Disk is full", "Add disk space or shorten retention."),
    InsightRule(r"filesystem error", "Critical", "The file system reported an error", "Check drive health, kernel log and mount options."),
    InsightRule(r"not_leader_for_partition", "Info", "A client asked a node that no longer leads", "Usual during elections; if it lasts, check client metadata refresh."),
    InsightRule(r"crc mismatch", "Critical", "A segment failed its checksum", "Find the segment and restore it from a replica or backup."),
    InsightRule(r"segment_not_found", "Critical", "A segment is missing on disk", "Check retention races and disk corruption."),
    InsightRule(r"connection refused", "Warning", "A peer refused the connection", "Check that the target runs and that no firewall blocks it."),
    InsightRule(r"broken pipe", "Warning", "The remote side closed a connection", "Look for peer restarts or an unstable network."),
    InsightRule(r"too many open files", "Critical", "File descriptors are used up", "Raise the open-file limit or find the descriptor leak."),
    InsightRule(r"reactor_stalled", "Warning", "A task blocked the reactor", "Find long CPU-bound loops; long stalls cause leader stepdowns."),
    InsightRule(r"authentication failed", "Warning", "Client authentication failed", "Check credentials, mechanism and permissions."),
    InsightRule(r"cloud_storage.*upload failed", "Warning", "Tiered-storage upload failed", "Check the object store's reachability, rights and bucket settings."),
    InsightRule(r"cloud_storage.*download failed", "Warning", "Tiered-storage download failed", "Check the object store and that the object exists."),
    InsightRule(r"schema_registry.*error", "Warning", "The schema registry reported an error", "Read the registry's own log for the cause."),
    InsightRule(r"reconfiguration_stm.*moving partition", "Info", "A partition is being moved", "See whether the balancer or an operator asked for it."),
    InsightRule(r"reconfiguration_stm.*finishing reconfiguration", "Info", "A partition move has finished", "Nothing to do."),
    InsightRule(r"leadership_balancer.*transferring leadership", "Info", "The balancer moves a leader", "Usual background work while leader balancing is on."),
    InsightRule(r"health_monitor.*detected node.*is down", "Critical", "A node is reported down", "Check that node for crash, memory or network trouble."),
    InsightRule(r"became the leader term", "Info", "A node won an election", "Useful to follow leadership stability."),
    InsightRule(r"Stepping down as leader in term.*reasoning: leadership_transfer", "Info", "A leader stepped down on request", "See whether balancing or a manual move asked for it."),
    InsightRule(r"Stepping down as leader in term.*reasoning: heartbeats_majority", "Warning", "A leader lost its majority", "Look for partitions of the network, busy CPU or stalled disks."),
    InsightRule(r"ghost_record_batch", "Info", "A gap in the log was filled", "Part of recovery; act only if frequent."),
    InsightRule(r"oversized_record_batch", "Warning", "A batch exceeds the allowed size", "Raise the batch limit or make producer batches smaller."),
    InsightRule(r"cluster_id_mismatch", "Critical", "The data directory is another cluster's", "Check the mounted volume before any forced start."),
    InsightRule(r"stored_wasm_binary", "Info", "A data transform was deployed", "Nothing to do."),
    InsightRule(r"datalake_throttle_manager.*Translation status updated.*throttling may be applied", "Warning", "Table translation falls behind", "Check the destination, the backlog ratio and disk space."),
    InsightRule(r"pandaproxy::schema_registry::build_file_with_refs", "Warning", "Schema references are costly to build", "Update past the version with the known problem."),
    InsightRule(r"raft::state_machine_manager::apply", "Warning", "State machine replays in a loop", "Check the broker version for the known recovery problem."),
    InsightRule(r"ssl_accept.*failed", "Warning", "TLS handshakes fail", "Look for clients that log in again and again."),
    InsightRule(r"unclean_abort_reconfiguration", "Critical", "A move was aborted uncleanly", "Data may be lost: verify the partition."),
    InsightRule(r"RPC timeout.*time since:", "Warning", "A call timed out, with timings", "The timings tell overload, backpressure, queueing and network apart."),
    InsightRule(r"Creating new segment", "Info", "A new segment is created", "If frequent, look for many small partitions."),
    InsightRule(r"controller_stm.*snapshot", "Info", "The controller takes a snapshot", "If calls time out at the same moment, allow longer timeouts."),
]

_META = re.compile(r"[.^$*+?{}\[\]|()\\]")


def matches_rule(message: Column, lowered: Column, pattern: str) -> Column:
    """Case-insensitive search; a plain phrase needs no regular expression."""
    if not _META.search(pattern):
        return F.contains(lowered, F.lit(pattern.lower()))
    return message.rlike(f"(?i){pattern}")


def insight_rule(message: Column, lowered: Column, rules: list[InsightRule] = INSIGHT_RULES) -> Column:
    """Number of the first matching rule, or NULL."""
    chain = F.when(F.lit(False), F.lit(None).cast("int"))
    for number, rule in enumerate(rules):
        chain = chain.when(matches_rule(message, lowered, rule.pattern), F.lit(number))
    return chain


def with_insight(df: DataFrame, column: str = "message", rules: list[InsightRule] = INSIGHT_RULES) -> DataFrame:
    """Adds description, severity and action of the first matching rule.

    Meant for patterns or a page of logs, where the rule chain runs once per template
    and not once per line. The texts come from the rule table, which is broadcast: its
    size is fixed by the code.
    """
    rows = [
        F.struct(F.lit(n).alias("_rule"), F.lit(r.description).alias("description"), F.lit(r.severity).alias("severity"), F.lit(r.action).alias("action"))
        for n, r in enumerate(rules)
    ]
    table = df.sparkSession.range(1).select(F.inline(F.array(*rows)))
    lowered = df.withColumn("_lowered", F.lower(column))
    numbered = lowered.withColumn("_rule", insight_rule(F.col(column), F.col("_lowered"), rules)).drop("_lowered")
    return numbered.join(F.broadcast(table), "_rule", "left").drop("_rule")


class ProfileRule(NamedTuple):
    words: tuple[str, ...]
    group: str | None
    text: str


# Words, group and order. The texts are our own.
PROFILE_RULES = [
    ProfileRule(("schema_registry", "build_file_with_refs"), None, "Schema registry: costly normalisation or reference building"),
    ProfileRule(("state_machine_manager::apply", "raft::state_machine"), None, "Raft state machine: recovery loop or high churn"),
    ProfileRule(("persistent_size",), "main", "Segments: size computation over many small files"),
    ProfileRule(("ssl_do_handshake", "ssl_accept"), None, "TLS: many handshakes, clients without pooling"),
    ProfileRule(("epoll_wait", "reactor::run"), None, "Reactor: polling; at 100% while idle it may be spinning"),
]


def profile_insight(backtrace: Column, group: Column, rules: list[ProfileRule] = PROFILE_RULES) -> Column:
    """Text of the first profile rule that holds, else an empty string."""
    lowered = F.lower(backtrace)
    chain = F.when(F.lit(False), F.lit(""))
    for rule in rules:
        test = F.lit(False)
        for word in rule.words:
            test = test | F.contains(lowered, F.lit(word))
        if rule.group:
            test = test & (group == rule.group)
        chain = chain.when(test, F.lit(rule.text))
    return chain.otherwise(F.lit(""))
