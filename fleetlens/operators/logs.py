"""Log search, patterns, facets, counts over time, context and bursts.

Tables carry ``bundle_id, id, ts, level, node, shard, component, message`` and, where
they come from files, ``raw, line_number, file_path``.
"""

from __future__ import annotations

import logging
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.rules import INSIGHT_RULES, with_insight
from fleetlens.functions.search import query_terms, search_predicate
from fleetlens.functions.text import fingerprint, highlight
from fleetlens.operators.windows import top_per_key

log = logging.getLogger(__name__)
TIME_FORMATS = ("%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M")


def _as_list(values) -> list:
    return [values] if isinstance(values, str) else list(values or [])


def parse_bound(text: str | datetime | None) -> datetime | None:
    """A time bound in one of two formats; anything else is ignored with a warning."""
    if not text or isinstance(text, datetime):
        return text or None
    for fmt in TIME_FORMATS:
        try:
            return datetime.strptime(text, fmt)
        except ValueError:
            continue
    log.warning("time bound %r ignored: use YYYY-MM-DDTHH:MM[:SS]", text)
    return None


def in_time_range(df: DataFrame, start=None, end=None, column: str = "ts") -> DataFrame:
    """Inclusive at both ends. The bounds reach the scan as pushed filters and, for a
    table partitioned by ``dt``, prune its days."""
    low, high = parse_bound(start), parse_bound(end)
    by_day = column == "ts" and "dt" in df.columns
    if low:
        df = df.filter(F.col(column) >= F.lit(low))
        df = df.filter(F.col("dt") >= F.lit(low.date())) if by_day else df
    if high:
        df = df.filter(F.col(column) <= F.lit(high))
        df = df.filter(F.col("dt") <= F.lit(high.date())) if by_day else df
    return df


def filter_logs(
    logs: DataFrame, level=(), node=(), component=(), search: str = "", ignore: str = "",
    start=None, end=None, min_term_len: int = 3,
) -> DataFrame:
    """Facets, time range and text search, all AND-ed; each part is optional."""
    for column, values in (("level", level), ("node", node), ("component", component)):
        wanted = _as_list(values)
        if wanted:
            logs = logs.filter(F.col(column).isin(wanted))
    logs = in_time_range(logs, start, end)
    predicate = search_predicate(search, F.col("message"), min_term_len, ignore)
    return logs if predicate is None else logs.filter(predicate)


def with_pins(logs: DataFrame, pins: DataFrame) -> DataFrame:
    """Adds ``is_pinned``. Pins are made by hand, but no hint claims that they are few:
    the planner broadcasts them when their size allows."""
    marks = pins.select("bundle_id", F.col("log_id").alias("id"), F.lit(True).alias("_pin")).distinct()
    joined = logs.join(marks, ["bundle_id", "id"], "left")
    return joined.withColumn("is_pinned", F.coalesce("_pin", F.lit(False))).drop("_pin")


def exclude_ids(logs: DataFrame, ids: DataFrame) -> DataFrame:
    """Logs whose id is not in a list from outside."""
    marks = ids.select("bundle_id", F.col("log_id").alias("id"))
    return logs.join(marks, ["bundle_id", "id"], "left_anti")


def page_logs(
    logs: DataFrame, pins: DataFrame | None = None, sort: str = "desc", limit: int = 100,
    offset: int = 0, search: str = "",
) -> DataFrame:
    """One page ordered by time and id, with insight, snippet and pin mark.

    Sorting with a limit keeps ``offset + limit`` rows per task; the rule chain and
    the join with pins see the page only.
    """
    limit = limit if limit > 0 else 100
    order = [F.col(c).asc() if sort.lower() == "asc" else F.col(c).desc() for c in ("ts", "id")]
    page = logs.orderBy(*order).offset(offset).limit(limit)
    if pins is not None:
        page = with_pins(page, pins)
    page = page.withColumn("snippet", highlight(F.col("message"), query_terms(search)) if search else F.lit(""))
    return with_insight(page).orderBy(*order)


def get_logs(logs: DataFrame, pins: DataFrame | None = None, sort="desc", limit=100, offset=0, **filters) -> tuple[DataFrame, int, bool]:
    """(page, total, has_more) of a filtered search; the total is counted at once."""
    found = filter_logs(logs, **filters)
    total = found.count()
    page = page_logs(found, pins, sort, limit, offset, filters.get("search", ""))
    return page, total, offset + (limit if limit > 0 else 100) < total


def count_logs(logs: DataFrame) -> DataFrame:
    """Total per bundle of the (filtered) logs."""
    return logs.groupBy("bundle_id").agg(F.count("*").alias("total"))


def with_fingerprint(logs: DataFrame) -> DataFrame:
    """Stored with the log table at ingest, so that patterns do not recompute it."""
    return logs.withColumn("fingerprint", fingerprint(F.col("message")))


def log_patterns(logs: DataFrame) -> DataFrame:
    """Templates per bundle and level: count, first and last time, sample message.

    The sample is the message with the smallest id. Partial aggregation runs before
    the shuffle, so a template that holds most lines arrives as one row per task.
    """
    source = logs if "fingerprint" in logs.columns else with_fingerprint(logs)
    return source.groupBy("bundle_id", "level", "fingerprint").agg(
        F.count("*").alias("count"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        F.min_by("message", "id").alias("sample"),
    )


def pattern_report(logs: DataFrame, rules=INSIGHT_RULES) -> DataFrame:
    """Patterns with insight and the bundle's total lines. The total is counted from the
    lines themselves: that scan reads one column and computes no fingerprint."""
    totals = logs.groupBy("bundle_id").agg(F.count("*").alias("total_logs"))
    return with_insight(log_patterns(logs), "sample", rules).join(totals, "bundle_id")


def bucket_start(ts: Column, seconds: int) -> Column:
    """Floor to a bucket of any whole number of seconds since the epoch."""
    size = seconds if seconds > 0 else 60
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / size) * size)


def log_counts_by_time(logs: DataFrame, bucket: int = 60) -> DataFrame:
    """ERROR and WARN lines per bucket of seconds."""
    hits = logs.filter(F.col("level").isin("ERROR", "WARN"))
    return hits.groupBy("bundle_id", bucket_start(F.col("ts"), bucket).alias("bucket")).agg(
        F.count("*").alias("count")
    )


def k8s_counts_by_time(events: DataFrame, bucket: int = 60) -> DataFrame:
    """Summed counts of Warning events per bucket of seconds."""
    hits = events.filter(F.col("type") == "Warning")
    return hits.groupBy("bundle_id", bucket_start(F.col("last_timestamp"), bucket).alias("bucket")).agg(
        F.sum("count").alias("count")
    )


def timeline_buckets(logs: DataFrame, events: DataFrame, bucket: int = 120) -> DataFrame:
    """Both counts added up: a union of partial counts, no outer join."""
    both = log_counts_by_time(logs, bucket).unionByName(k8s_counts_by_time(events, bucket))
    return both.groupBy("bundle_id", "bucket").agg(F.sum("count").alias("count"))


def time_range(logs: DataFrame) -> DataFrame:
    """First and last known time per bundle; lines without a time do not count."""
    return logs.groupBy("bundle_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select("bundle_id", column).distinct().orderBy("bundle_id", column)


def log_context(lines: DataFrame, anchors: DataFrame, k: int = 10) -> DataFrame:
    """Lines n-k to n+k around each anchor (``bundle_id, file_path, line_number``).

    The range is spelled out as 2k+1 line numbers per anchor, so this is a hash join
    on (file, line), spread evenly even if all anchors lie in one file.
    """
    wanted = anchors.select(
        "bundle_id", "file_path", F.col("line_number").alias("anchor"),
        F.explode(F.sequence(F.col("line_number") - k, F.col("line_number") + k)).alias("line_number"),
    )
    joined = lines.join(wanted, ["bundle_id", "file_path", "line_number"])
    return joined.withColumn("is_match", F.col("line_number") == F.col("anchor"))


def burst_rate(
    logs: DataFrame, phrase: str, n: int = 100, min_hits: int = 50, within_seconds: float = 10
) -> DataFrame:
    """Bundles whose newest ``n`` hits of a phrase are at least ``min_hits`` within a short time."""
    hits = filter_logs(logs, search=phrase).select("bundle_id", "ts", "id")
    newest = top_per_key(hits, ["bundle_id"], [F.col("ts").desc(), F.col("id").desc()], n, salt_by="id")
    span = (F.unix_micros("last_ts") - F.unix_micros("first_ts")) / 1e6
    out = newest.groupBy("bundle_id").agg(
        F.count("*").alias("hits"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
    out = out.withColumn("seconds", span)
    bursts = (F.col("hits") >= min_hits) & (F.col("seconds") > 0) & (F.col("seconds") < within_seconds)
    return out.filter(bursts).withColumn("per_second", F.col("hits") / F.col("seconds"))


def pinned_logs(logs: DataFrame, pins: DataFrame) -> DataFrame:
    """Pinned lines with their notes, in the order of pinning."""
    notes = pins.select("bundle_id", F.col("log_id").alias("id"), "note", "created_at")
    return logs.join(notes, ["bundle_id", "id"]).orderBy("bundle_id", "created_at", "id")


def detect_version(brokers: DataFrame, logs: DataFrame) -> DataFrame:
    """Broker version per bundle: from the brokers, else from the first welcome line."""
    # Fixed value: the greeting that a broker logs at start.
    greeting = r"Welcome to Redpanda v([0-9]+\.[0-9]+\.[0-9]+)"
    told = brokers.filter(F.col("version") != "").groupBy("bundle_id").agg(
        F.min_by("version", "node_id").alias("_told")
    )
    lines = filter_logs(logs, search='"welcome to redpanda v"')
    found = F.nullif(F.regexp_extract("message", greeting, 1), F.lit(""))
    logged = lines.groupBy("bundle_id").agg(F.min_by(found, F.struct("ts", "id")).alias("_logged"))
    both = told.join(logged, "bundle_id", "full")
    return both.select("bundle_id", F.coalesce("_told", "_logged").alias("version"))
