"""Prometheus text dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.text import to_number
from fleetlens.sources.fleet import Fleet

# Where the dumps lie.
NESTED, FLAT = "metrics/*/*_metrics.txt", "metrics/*_metrics.txt"
METRIC_FILES = (NESTED, FLAT)

# Label pairs; a comma or an escaped quote inside the quotes belongs to the value.
_PAIR = r'([^\s,={}"]+)\s*=\s*"((?:[^"\\]|\\.)*)"'


def parse_samples(lines: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """Adds name, labels and value to lines in ``value``; comments, NaN and infinity go.

    The optional list of names is applied before labels are taken apart.
    """
    line = F.col("value")
    keep = [c for c in lines.columns if c != "value"]
    rows = lines.filter((line != "") & ~line.startswith("#") & (F.instr(line, " ") > 0))
    rest = F.regexp_replace(line, r"(?s) [^ ]*\z", "")
    inner = F.regexp_extract(rest, r"(?s)\A[^{]*\{(.*)\}", 1)
    rows = rows.select(
        *keep, to_number(F.substring_index(line, " ", -1)).alias("value"),
        F.trim(F.regexp_extract(rest, r"\A([^{]*)", 1)).alias("name"), inner.alias("inner"),
    ).filter(F.col("value").isNotNull())
    if allowed is not None:
        rows = rows.filter(F.col("name").isin(list(allowed)))
    pairs = F.regexp_extract_all("inner", F.lit(_PAIR), F.lit(0))
    labels = F.map_from_entries(F.transform(pairs, _label_entry))
    return rows.select(*keep, "name", labels.alias("labels"), "value")


def _label_entry(pair: Column) -> Column:
    value = F.regexp_extract(pair, _PAIR, 2)
    for written, meant in (('\\"', '"'), ("\\n", "\n"), ("\\\\", "\\")):
        value = F.replace(value, F.lit(written), F.lit(meant))
    return F.struct(F.regexp_extract(pair, _PAIR, 1).alias("key"), value.alias("value"))


def scan_prometheus(fleet: Fleet, patterns=METRIC_FILES, allowed: list[str] | None = None) -> DataFrame:
    """(bundle_id, node, id, name, labels, ts, value, file_path); the time is the file's.

    The node is the folder below ``metrics``. Files without such a folder count only in bundles that
    have none with one, since they repeat the same samples.
    """
    node = F.regexp_extract("file_path", r"/metrics/([^/]+)/[^/]+\z", 1)
    raw = fleet.lines(*patterns).select("bundle_id", "file_path", F.col("modified").alias("ts"), F.col("pos").alias("id"), "value")
    if FLAT in patterns and NESTED in patterns:
        nested = fleet.binary(NESTED, content=False).select("bundle_id").distinct()
        flat = raw.filter(node == "").join(nested, "bundle_id", "left_anti")
        raw = raw.filter(node != "").unionByName(flat)
    return parse_samples(raw, allowed).select("bundle_id", node.alias("node"), "id", "name", "labels", "ts", "value", "file_path")


def scan_metric_help(fleet: Fleet, patterns=METRIC_FILES) -> DataFrame:
    """(bundle_id, name, help) of ``# HELP`` lines; the last one of a name wins."""
    # Fixed value: the help line.
    pattern = r"\A# HELP ([a-zA-Z0-9_:]+) (.*)"
    lines = fleet.lines(*patterns).filter(F.ltrim("value").startswith("# HELP"))
    text = F.btrim("value", F.lit(" \t\r\n"))
    found = lines.select(
        "bundle_id", "file_path", "block", "pos", F.regexp_extract(text, pattern, 1).alias("name"), F.regexp_extract(text, pattern, 2).alias("help")
    )
    order = F.struct("file_path", "block", "pos")
    return found.filter("name != ''").groupBy("bundle_id", "name").agg(F.max_by("help", order).alias("help"))
