"""Writing: partitioned tables, the Markdown notebook, JSON result sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.session import stage


def write_table(df: DataFrame, path: str, ts: str | None = "ts", mode: str = "append") -> None:
    """Parquet by bundle and day. Rows go to their partition's files through one shuffle
    keyed by (bundle, day, salt), so that one big bundle is written by many tasks."""
    keys = ["bundle_id"]
    if ts and ts in df.columns:
        df = df.withColumn("dt", F.to_date(ts))
        keys.append("dt")
    # REBALANCE splits large and merges small partitions by size at run time.
    df.hint("rebalance", *keys).write.mode(mode).partitionBy(*keys).parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per row."""
    df.write.mode(mode).json(path)


def to_json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def numbered_in_order(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Adds ``number``: 1, 2, ... per key, in order, whatever share of the rows a key has.

    Rows are range-partitioned by (key, order) once and staged. A row's number is its place among the rows
    of its key in the partition, and the rows of the key in the partitions before, from a table of counts with a row per
    key and partition.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, key, *order).sortWithinPartitions(key, *order)
    place = F.monotonically_increasing_id()
    ranged = stage(ranged.withColumns({"_part": F.spark_partition_id(), "_place": place}), "in-order")
    counts = ranged.groupBy(key, "_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_part")) - F.col("_n")
    joined = ranged.join(counts.select(key, "_part", "_first", before.alias("_before")), [key, "_part"])
    return joined.withColumn("number", F.col("_before") + F.col("_place") - F.col("_first") + 1).drop("_part", "_place", "_first", "_before")


def notebook_sections(pinned: DataFrame) -> DataFrame:
    """(bundle_id, number, section): a Markdown section per pinned line, in pin order."""
    numbered = numbered_in_order(pinned.filter("bundle_id IS NOT NULL"), "bundle_id", "created_at", "id")
    when = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS")
    note = F.when(F.coalesce("note", F.lit("")) != "", F.concat(F.lit("### Engineer Notes\n"), "note", F.lit("\n\n"))).otherwise("")
    section = F.concat(
        F.lit("## "), F.col("number").cast("string"), F.lit(". "), F.coalesce(when, F.lit("unknown time")), F.lit(" ["), F.coalesce("level", F.lit("")), F.lit("]\n"),
        F.lit("**Node:** "), F.coalesce("node", F.lit("")), F.lit(" | **Component:** "), F.coalesce("component", F.lit("")),
        F.lit(" | **File:** "), F.substring_index("file_path", "/", -1), F.lit(":"), F.col("line_number").cast("string"), F.lit("\n\n"),
        F.lit("### Log Message\n```\n"), "message", F.lit("\n```\n\n"), note, F.lit("---\n"),
    )
    return numbered.select("bundle_id", "number", section.alias("section"))


#: Sections in a file of a notebook, about.
FILE_SECTIONS = 2000


def export_notebook(pinned: DataFrame, path: str, title: str = "Debug Notebook") -> None:
    """A Markdown text per bundle, in files whose order by name is the order of the sections: a large notebook is
    written by many tasks, none of which holds more than a stretch of it."""
    sections = notebook_sections(pinned)
    head = F.concat(F.lit(f"# {title}\n\nBundle: "), "bundle_id", F.lit("\n"))
    heads = pinned.filter("bundle_id IS NOT NULL").select("bundle_id").distinct().select("bundle_id", F.lit(0).cast("bigint").alias("number"), head.alias("section"))
    n = -(-(sections.count() + heads.count()) // FILE_SECTIONS) or 1
    rows = heads.unionByName(sections).repartitionByRange(n, "bundle_id", "number").sortWithinPartitions("bundle_id", "number")
    rows.select("bundle_id", F.col("section").alias("value")).write.mode("overwrite").partitionBy("bundle_id").text(path)
