"""Leadership events out of log messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and phrases.
TERM = r"term (\d+)"
REASON = r"(?:reasoning: |\[)([\w_]+)(?:\]\s+Stepping down|\z)"
NTP = r"([\w._-]+/[\w._-]+/\d+)"
CLUSTER_WORDS = ["leader", "stepdown", "timeout", "term", "reconfiguration", "moving", "is down", "transferring leadership"]
PARTITION_WORDS = ["leader", "stepdown", "timeout", "term"]
TYPE_PHRASES = {
    "Elected": ["became the leader"],
    "Stepdown": ["stepping down"],
    "Timeout": ["timeout", "error code: 10"],
    "Move": ["moving", "reconfiguration", "transferring leadership"],
    "Health": ["is down"],
}


def contains_any(lowered: Column, words: list[str]) -> Column:
    test = F.contains(lowered, F.lit(words[0]))
    for word in words[1:]:
        test = test | F.contains(lowered, F.lit(word))
    return test


def event_type(lowered: Column, types: list[str] | None = None) -> Column:
    """First type whose phrase occurs in the lower-case message, in table order; else NULL."""
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for name in types or list(TYPE_PHRASES):
        chain = chain.when(contains_any(lowered, TYPE_PHRASES[name]), F.lit(name))
    return chain


def _group(message: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(message, pattern, 1), F.lit(""))


def term(message: Column) -> Column:
    return _group(message, TERM).try_cast("bigint")


def stepdown_reason(message: Column) -> Column:
    return _group(message, REASON)


def ntp(message: Column) -> Column:
    """``namespace/topic/partition`` named in the message."""
    return _group(message, NTP)
