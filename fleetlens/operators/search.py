"""One search over logs, files, Kubernetes names and partitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.search import query_terms
from fleetlens.functions.text import highlight, snippet
from fleetlens.operators.logs import filter_logs
from fleetlens.operators.windows import top_per_key


def search_logs(query: str, logs: DataFrame, n: int | None = None) -> DataFrame:
    """The matching lines; with ``n`` the newest of each bundle."""
    hits = filter_logs(logs, search=query)
    if n:
        hits = top_per_key(hits, ["bundle_id"], [F.col("ts").desc(), F.col("id").desc()], n, salt_by="id")
    title = F.concat(F.date_format("ts", "HH:mm:ss"), F.lit(" ["), "level", F.lit("]"))
    return hits.select(
        "bundle_id", F.lit("Logs").alias("category"), F.coalesce(title, F.concat(F.lit("["), "level", F.lit("]"))).alias("title"),
        highlight(F.col("message"), query_terms(query)).alias("preview"),
    )


def search_files(query: str, corpus: DataFrame, width: int = 50) -> DataFrame:
    """Files that contain the query as written, with the first hit in its context."""
    hits = corpus.filter(F.contains(F.lower("text"), F.lit(query.lower())))
    return hits.select(
        "bundle_id", F.concat(F.lit("File: "), "group").alias("category"), F.col("file_name").alias("title"),
        highlight(snippet(F.col("text"), query, width), [query]).alias("preview"),
    )


def search_k8s(query: str, resources: DataFrame) -> DataFrame:
    """Pods and services by name."""
    named = resources.filter(F.col("kind").isin("pods", "services")).select("bundle_id", "kind", F.col("metadata.name").alias("name"))
    kind = F.when(F.col("kind") == "pods", "Pod").otherwise("Service")
    return named.filter(F.contains(F.lower("name"), F.lit(query.lower()))).select(
        "bundle_id", F.lit("Kubernetes").alias("category"), F.concat_ws(": ", kind, "name").alias("title"), highlight(F.col("name"), [query]).alias("preview")
    )


def search_partitions(query: str, partitions: DataFrame, n: int | None = None) -> DataFrame:
    """Partitions by name; with ``n`` the first of each bundle in name order."""
    name = F.concat_ws("/", "ns", "topic", F.col("partition_id").cast("string"))
    hits = partitions.withColumn("title", name).filter(F.contains(F.lower("title"), F.lit(query.lower())))
    first = top_per_key(hits, ["bundle_id"], [F.col("title")], n, salt_by="title") if n else hits
    shown = F.concat(F.lit("Status: "), "status", F.lit(", Leader: "), F.col("leader_id").cast("string"))
    return first.select("bundle_id", F.lit("Partition").alias("category"), "title", shown.alias("preview"))


def global_search(
    query: str, logs: DataFrame | None = None, corpus: DataFrame | None = None, k8s: DataFrame | None = None, partitions: DataFrame | None = None
) -> DataFrame:
    """(bundle_id, category, title, preview) of all hits in the tables that are given; the caller pages."""
    parts = []
    for find, table in ((search_logs, logs), (search_files, corpus), (search_k8s, k8s), (search_partitions, partitions)):
        if table is not None:
            parts.append(find(query, table))
    return reduce(DataFrame.unionByName, parts)
