"""Queries over the readers: lines derived from the driver tables are parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.catalog.log_queries import micros
from fleetlens.catalog.registry import query
from fleetlens.functions.text import series_label
from fleetlens.sources.logs import entries_by_block, stitch, with_head
from fleetlens.sources.metrics import parse_samples


def _stamp(pattern: str):
    return F.date_format("ts", pattern)


def formatted_lines(logs):
    """Log entries written out in the four formats, by level."""
    standard = F.concat("level", F.lit("  "), _stamp("yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" [shard "), "shard", F.lit(":main] "), "component", F.lit(" - "), "message")
    k8s = F.concat(_stamp("yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(' level="'), F.lower("level"), F.lit('" '), "message")
    doc = F.to_json(F.struct(F.lower("level").alias("level"), _stamp("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("ts"), F.col("component").alias("logger"), F.col("message").alias("msg")))
    csv = F.concat("level", F.lit(","), _stamp("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit(',"'), F.replace("message", F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.when(F.col("level") == "ERROR", k8s).when(F.col("level") == "WARN", doc).when(F.col("level") == "INFO", csv).otherwise(standard)
    return logs.select("bundle_id", "id", (F.col("level") == "INFO").alias("is_csv"), line.alias("line"))


@query(
    "parse_log_lines",
    "SELECT bundle_id, id, level, CASE WHEN level = 'ERROR' THEN (epoch_us(ts) // 1000000) * 1000000 ELSE (epoch_us(ts) // 1000) * 1000 END AS ts, "
    "CASE WHEN level IN ('DEBUG', 'TRACE') THEN shard END AS shard, CASE level WHEN 'ERROR' THEN 'k8s-sidecar' WHEN 'INFO' THEN 'csv-export' ELSE component END AS component, "
    "CASE WHEN level = 'ERROR' THEN concat('level=\"error\" ', message) ELSE message END AS message FROM v_logs",
)
def parse_log_lines(t):
    rows = formatted_lines(t.v_logs)
    parsed = with_head(rows.filter("NOT is_csv")).unionByName(with_head(rows.filter("is_csv"), csv=True))
    return parsed.select("bundle_id", "id", "head.level", "head.ts", "head.shard", "head.component", "head.message").withColumn("ts", micros("ts"))


@query(
    "stitched_entries",
    "WITH x AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY bundle_id, file_path ORDER BY line_number) AS entry FROM v_log_lines), "
    "p AS (SELECT *, row_number() OVER (PARTITION BY bundle_id, file_path ORDER BY line_number) AS n, replace(replace(line, chr(10), ' '), chr(13), ' ') AS one FROM x) "
    "SELECT bundle_id, file_path, min(n) AS line_number, CASE WHEN entry = 0 THEN 'stdout' ELSE 'chat' END AS component, CASE WHEN entry = 0 THEN 'INFO' ELSE 'WARN' END AS level, "
    "string_agg(CASE WHEN role = 'user' THEN trim(one, ' ') ELSE concat('  ', one) END, chr(10) ORDER BY n) AS message FROM p GROUP BY bundle_id, file_path, entry",
)
def stitched_entries(t):
    """Turns as lines: a user's turn opens an entry, any other continues it, three lines to a block."""
    one = F.replace(F.replace("line", F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(" "))
    line = F.when(F.col("role") == "user", F.concat(F.lit("WARN  2024-01-01 00:00:00,000 [shard 0:main] chat - "), one)).otherwise(F.concat(F.lit("  "), one))
    path = F.concat_ws("/", "bundle_id", "file_path")
    lines = t.v_log_lines.select(
        path.alias("file_path"), F.floor(F.col("line_number") / 3).cast("bigint").alias("block"), F.col("line_number").alias("pos"), line.alias("line")
    )

    def name(files):
        return files.withColumns({"bundle_id": F.substring_index("file_path", "/", 1), "node": F.lit("n")})

    out = stitch(entries_by_block(lines), name)
    return out.select("bundle_id", F.substring_index("file_path", "/", -1).alias("file_path"), "line_number", "component", "level", "message")


@query(
    "prometheus_lines",
    "SELECT bundle_id, id, name, concat('class=', class, ', path=a,b=\"c\", shard=', shard) AS series, value FROM v_metrics",
)
def prometheus_lines(t):
    m = t.v_metrics
    text = F.concat("name", F.lit('{shard="'), "shard", F.lit('",class="'), "class", F.lit('",path="a,b=\\"c\\""} '), F.col("value").cast("string"))
    return parse_samples(m.select("bundle_id", "id", text.alias("value"))).select("bundle_id", "id", "name", series_label(F.col("labels")).alias("series"), "value")
