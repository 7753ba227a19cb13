"""Disk usage, data directory, segment and snapshot files."""

from __future__ import annotations

import struct
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.text import size_to_bytes
from fleetlens.sources.fleet import Fleet


def scan_du(fleet: Fleet) -> DataFrame:
    """(bundle_id, path, size_bytes) of the disk-usage listing; its error lines are skipped."""
    line = F.btrim("value", F.lit(" \t\r\n"))
    rows = fleet.lines("utils/du.txt").select("bundle_id", line.alias("line")).filter("line != '' and not startswith(line, 'du:')")
    parts = F.split("line", r"\s+")
    rows = rows.select("bundle_id", F.get(parts, F.lit(1)).alias("path"), size_to_bytes(parts[0]).alias("size_bytes"))
    return rows.filter("path is not null and size_bytes is not null")


def scan_data_dir(fleet: Fleet) -> DataFrame:
    """(bundle_id, path, size_bytes) of the data-directory listing, a JSON object from paths to flat objects.

    The listing of a large node is one document of gigabytes, often on one line. It is read as records, each the
    text up to a closing brace, in which one path and its object end; so it is split over tasks and never parsed
    as a whole. Paths with a brace in them are not found.
    """
    entry = r'"((?:[^"\\]|\\.)*)"\s*:\s*\{([^{]*)\z'
    rows = fleet.records("data-dir.txt").filter(F.col("value").rlike(entry))
    path, fields = F.regexp_extract("value", entry, 1), F.regexp_extract("value", entry, 2)
    plain = F.when(F.contains(path, F.lit("\\")), F.from_json(F.concat(F.lit('{"p":"'), path, F.lit('"}')), "p string")["p"]).otherwise(path)
    size = F.regexp_extract(fields, r'"size_bytes"\s*:\s*(-?\d+)', 1).try_cast("bigint")
    return rows.select("bundle_id", plain.alias("path"), F.coalesce(size, F.lit(0).cast("bigint")).alias("size_bytes"))


# Layout of the batch header (little endian) and its codes.
HEADER = struct.Struct("<Iiqbihiqqqhii")
FIELDS = [
    "header_crc", "batch_length", "base_offset", "type", "crc", "attributes", "last_offset_delta", "first_timestamp",
    "max_timestamp", "producer_id", "producer_epoch", "base_sequence", "record_count",
]
MAX_BATCH = 100 * 1024 * 1024
COMPRESSION = {0: "None", 1: "Gzip", 2: "Snappy", 3: "LZ4", 4: "Zstd"}
BATCH_TYPES = {1: "Raft Data", 2: "Raft Config", 3: "Controller", 4: "KVStore", 5: "Checkpoint", 6: "Topic Mgmt"}
BATCH_SCHEMA = (
    "bundle_id string, file_path string, batch_no bigint, "
    + ", ".join(f"{name} bigint" for name in FIELDS)
    + ", error string"
)


def walk_headers(read, length: int):
    """(fields, error) of the batches of one segment of ``length`` bytes. ``read(at, n)`` gives bytes of it: only
    headers are asked for, each header tells where the next one is."""
    at, size = 0, HEADER.size
    while at < length:
        if at + size > length:
            yield None, f"short header at {at}"
            return
        fields = HEADER.unpack(read(at, size))
        batch = fields[1]
        if batch == 0:  # zero padding ends the file
            return
        if not size <= batch <= MAX_BATCH:
            yield None, f"invalid batch length {batch} at {at}"
            return
        yield fields, None
        at += batch


# Schemes of stores whose files can be read in ranges from a task, by their name there.
RANGE_STORES = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs"}


def open_ranges(path: str):
    """``read(at, n)`` over a file of such a store, and a function that closes it."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    store, inside = fs.FileSystem.from_uri(f"{RANGE_STORES[scheme]}://{rest.removeprefix('//')}")
    file = store.open_input_file(inside)
    return (lambda at, n: file.read_at(n, at)), file.close


def scan_segments(fleet: Fleet, *patterns: str, ranges: bool | None = None) -> DataFrame:
    """A row per batch header of segment files, or per error.

    A file is walked by one task, in reads of 61 bytes: a segment's payload is never loaded. In stores
    that tasks cannot open themselves (or with ``ranges`` off) Spark reads the files whole.
    """
    ranges = fleet.scheme() in RANGE_STORES if ranges is None else ranges

    def rows_of(batch):
        for bundle, path, length, content in zip(batch["bundle_id"], batch["file_path"], batch["length"], batch["content"], strict=True):
            read, close = open_ranges(path) if content is None else ((lambda at, n, content=content: content[at : at + n]), lambda: None)
            try:
                for number, (fields, error) in enumerate(walk_headers(read, int(length))):
                    yield (bundle, path, number, *(fields or [None] * len(FIELDS)), error)
            finally:
                close()

    def walk(batches):
        for batch in batches:
            rows = iter(rows_of(batch))
            while some := list(islice(rows, 50_000)):
                yield pd.DataFrame(some, columns=["bundle_id", "file_path", "batch_no", *FIELDS, "error"]).convert_dtypes()

    names = patterns or ("*/*/*/*.log", "data/*/*/*/*.log")
    files = fleet.binary(*names, content=False).withColumn("content", F.lit(None).cast("binary")) if ranges else fleet.binary(*names)
    files = files.select("bundle_id", "file_path", "length", "content")
    # Names are small and their walks are long, so they are dealt out anew.
    raw = (files.repartition("file_path") if ranges else files).mapInPandas(walk, BATCH_SCHEMA)
    code = F.col("attributes").bitwiseAND(7)
    known = lambda table, column, other: F.coalesce(
        F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), column.cast("int")), other
    )
    return raw.withColumns(
        {
            "max_offset": F.col("base_offset") + F.col("record_count") - 1,
            "compression": known(COMPRESSION, code, F.concat(F.lit("Unknown("), code.cast("string"), F.lit(")"))),
            "type_name": known(BATCH_TYPES, F.col("type"), F.col("type").cast("string")),
            "timestamp": F.when(F.col("max_timestamp") > 0, F.timestamp_millis("max_timestamp")),
        }
    )


def _little_endian(content, at: int, size: int, signed: bool = False):
    """Unsigned (or two's complement 64-bit) number from bytes, built in."""
    digits = F.concat(*[F.hex(F.substring(content, at + 1 + i, 1)) for i in reversed(range(size))])
    return F.conv(digits, 16, -10 if signed else 10).cast("bigint")


def scan_snapshots(fleet: Fleet, *patterns: str) -> DataFrame:
    """The 29-byte header of snapshot files; a shorter file gives an error."""
    files = fleet.binary(*(patterns or ("*/*/*/snapshot", "data/*/*/*/snapshot")))
    content = F.substring("content", 1, 29)
    whole = F.octet_length(content) == 29
    columns = {
        "header_crc": (0, 4, False), "header_data_crc": (4, 4, False), "header_version": (8, 1, False),
        "metadata_size": (9, 4, False), "last_included_index": (13, 8, True), "last_included_term": (21, 8, True),
    }
    return files.select(
        "bundle_id", "file_path", F.col("length").alias("size_bytes"),
        *[F.when(whole, _little_endian(content, *spec)).alias(name) for name, spec in columns.items()],
        F.when(~whole, F.lit("short header")).alias("error"),
    )
