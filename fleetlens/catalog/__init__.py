"""Named queries over the driver tables, each with its SQL check."""

from fleetlens.catalog import audit_queries, branch_queries, cluster_queries, file_queries, log_queries, performance_queries, rule_queries, source_queries  # noqa: F401
from fleetlens.catalog.registry import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
