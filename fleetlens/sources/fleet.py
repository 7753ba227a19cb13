"""Where the bundles lie, and plain reads over the same file of every bundle.

A fleet is one or more root folders whose direct children are bundles:
``<root>/<bundle>/admin/brokers.json``. Every read is one job over all bundles, and
``bundle_id`` comes from the path.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def glob_pattern(glob: str) -> str:
    """Regular expression of a file glob: ``*`` and ``?`` stay inside a folder, ``[!a]`` and ``{a,b}`` as in shells."""
    out, depth = "", 0
    for part in re.findall(r"\[!?[^\]]*\]|[*?{},]|[^\[*?{},]+", glob):
        if part in "*?":
            out += {"*": "[^/]*", "?": "[^/]"}[part]
        elif part[0] == "[":
            out += part.replace("[!", "[^", 1)
        elif part == "{":
            out, depth = out + "(?:", depth + 1
        elif part == "}" and depth:
            out, depth = out + ")", depth - 1
        elif part == "," and depth:
            out += "|"
        else:
            out += re.escape(part)
    return out


class Fleet:
    """All bundles below some roots.

    The files are listed once per fleet and kind of read (as lines, as bytes, as records), with all their names, by Spark's own
    listing, which is a job where there are many folders. Every reader is a filter on the paths of one
    of these tables: the filter is applied to the listing, so only matching files are opened. Files
    that appear later belong to a new ``Fleet``.
    """

    def __init__(self, spark: SparkSession, *roots: str):
        self.spark = spark
        self.roots = [r.rstrip("/") for r in roots]
        self._root_paths = [self._path(r).toUri().getRawPath() for r in self.roots]

    def _path(self, text: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(text)

    @cached_property
    def _lines(self) -> DataFrame:
        """(file_path, block, modified, value)."""
        m = "_metadata"
        rows = self.spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(self.roots)
        return rows.select(F.col(f"{m}.file_path").alias("file_path"), F.col(f"{m}.file_block_start").alias("block"), F.col(f"{m}.file_modification_time").alias("modified"), "value")

    @cached_property
    def _records(self) -> DataFrame:
        """(file_path, value): text up to each closing brace."""
        rows = self.spark.read.option("lineSep", "}").option("recursiveFileLookup", "true").text(self.roots)
        return rows.select(F.col("_metadata.file_path").alias("file_path"), "value")

    @cached_property
    def _bytes(self) -> DataFrame:
        """(file_path, length, modified, content)."""
        rows = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.roots)
        return rows.select(F.col("_metadata.file_path").alias("file_path"), "length", F.col("modificationTime").alias("modified"), "content")

    def matches(self, *relative: str, below: bool = False, name_glob: str | None = None) -> Column:
        """Whether a file is one of the patterns below its bundle, or lies anywhere below one."""
        roots = "|".join(re.escape(p) for p in self._root_paths)
        kinds = "|".join(glob_pattern(r) for r in relative)
        tail = (r"/(?:.*/)?" + glob_pattern(name_glob or "*")) if below else ""
        return F.col("file_path").rlike(rf"(?:\A|:/*)(?:{roots})/[^/]+/(?:{kinds}){tail}\z")

    def scheme(self) -> str:
        """The kind of store that all roots lie in, as in their URIs; empty if there are several."""
        conf = self.spark._jsc.hadoopConfiguration()
        kinds = {self._path(r).getFileSystem(conf).getUri().getScheme() for r in self.roots}
        return kinds.pop() if len(kinds) == 1 else ""

    def manifest(self) -> DataFrame:
        """(bundle_id, node, kind, file_path, file_name, length, modified) of every file: ``kind`` is the folder in the
        bundle (empty: its top), ``node`` the folder below that, if there is one."""
        path = F.col("file_path")
        inside = F.regexp_replace(path, rf"\A.*?(?:{'|'.join(re.escape(p) for p in self._root_paths)})/[^/]+/", "")
        parts = F.split(inside, "/")
        return self._bytes.select(
            self.bundle_of(path).alias("bundle_id"), F.when(F.size(parts) > 2, parts[1]).otherwise("").alias("node"),
            F.when(F.size(parts) > 1, parts[0]).otherwise("").alias("kind"), path, F.element_at(parts, -1).alias("file_name"), "length", "modified",
        )

    def bundle_of(self, path: Column) -> Column:
        roots = "|".join(re.escape(p) for p in self._root_paths)
        return F.regexp_extract(path, rf"(?:{roots})/([^/]+)/", 1)

    def _with_file(self, df: DataFrame, *columns: str) -> DataFrame:
        path = F.col("file_path")
        return df.select(self.bundle_of(path).alias("bundle_id"), path, F.substring_index(path, "/", -1).alias("file_name"), *columns)

    def lines(self, *relative: str, **options) -> DataFrame:
        """(bundle_id, file_path, file_name, block, pos, modified, value): a row per line."""
        return self._with_file(self.raw_lines(*relative, **options), "block", "pos", "modified", "value")

    def raw_lines(self, *relative: str, recursive: bool = False, name_glob: str | None = None) -> DataFrame:
        """(file_path, block, pos, modified, value), without anything derived from the path per line.

        ``pos`` orders the lines of one block of one file. Only LF ends a line. ``recursive`` takes all files below
        the folders that the patterns name, whose own names match ``name_glob``.
        """
        return self._lines.filter(self.matches(*relative, below=recursive, name_glob=name_glob)).select(
            "file_path", "block", F.monotonically_increasing_id().alias("pos"), "modified", "value")

    def records(self, *relative: str) -> DataFrame:
        """(bundle_id, file_path, file_name, value): a row per closing brace of JSON files, with the text since the last
        one. A document of any length, on one line or many, is split over tasks like a text file."""
        return self._with_file(self._records.filter(self.matches(*relative)), "value")

    def documents(self, *relative: str) -> DataFrame:
        """(bundle_id, file_path, file_name, value): a row per small file, read whole."""
        return self._with_file(self._bytes.filter(self.matches(*relative)), F.col("content").cast("string").alias("value"))

    def json(self, schema: str | StructType, *relative: str) -> DataFrame:
        """Documents decoded with a fixed schema into ``doc``; unknown keys are ignored, and
        a top-level array gives a row per item. The file name stays at hand."""
        kind = schema if isinstance(schema, str) else schema.simpleString()
        docs = self.documents(*relative)
        is_list = F.ltrim("value").startswith("[")
        items = F.when(is_list, F.from_json("value", f"array<{kind}>")).otherwise(F.array(F.from_json("value", kind)))
        out = docs.select("bundle_id", "file_path", "file_name", F.explode(items).alias("doc"))
        # Text that is no such document decodes to a struct without any value.
        return out.filter(F.col("doc").isNotNull() & (F.to_json("doc") != "{}"))

    def binary(self, *relative: str, content: bool = True) -> DataFrame:
        """Files as bytes; without ``content`` only names and lengths are read."""
        return self._with_file(self._bytes.filter(self.matches(*relative)), "length", *(["content"] if content else []))


class TableFleet(Fleet):
    """Bundles whose files are rows of a table: (bundle_id, path below the bundle, content as text), such as
    an archive that was unpacked into one. All readers work on it as on files."""

    def __init__(self, files: DataFrame):
        self.spark, self.roots, self._root_paths = files.sparkSession, ["/table"], ["/table"]
        path = F.concat_ws("/", F.lit("/table"), "bundle_id", "path")
        # The bundle is kept as it is given, so that Spark still knows how the rows are dealt.
        self._files = files.select("bundle_id", path.alias("file_path"), F.lit(None).cast("timestamp").alias("modified"), F.col("content").alias("text"))

    def scheme(self) -> str:
        return "table"

    def texts(self, *relative: str) -> DataFrame:
        """(bundle_id, file_path, lines): a row per file, in the partition of the table's row. Steps by bundle need no shuffle
        where the table is dealt by bundle."""
        return self._files.filter(self.matches(*relative)).select("bundle_id", "file_path", self._split().alias("lines"))

    @staticmethod
    def _split() -> Column:
        # Text ends with a line end or not; either way its last line is the last row.
        return F.split(F.regexp_replace("text", r"\n\z", ""), "\n")

    @cached_property
    def _lines(self) -> DataFrame:
        return self._files.select("file_path", F.lit(0).cast("bigint").alias("block"), "modified", F.explode(self._split()).alias("value"))

    @cached_property
    def _records(self) -> DataFrame:
        return self._files.select("file_path", F.explode(F.split("text", "[}]")).alias("value"))

    @cached_property
    def _bytes(self) -> DataFrame:
        content = F.col("text").cast("binary")
        return self._files.select("file_path", F.octet_length(content).cast("bigint").alias("length"), "modified", content.alias("content"))


def list_files(fleet: Fleet, *relative: str) -> DataFrame:
    """Names and sizes only, such as core dumps (``core.*``) or segment files."""
    return fleet.binary(*relative, content=False)


def scan_corpus(fleet: Fleet) -> DataFrame:
    """Every plain file as (bundle_id, group, file_name, text, error)."""
    groups = {"Root": ["*.json", "*.txt", "*.yaml"], "Admin": ["admin/*.json"], "Proc": ["proc/*"], "Utils": ["utils/*.txt", "utils/*.json"]}
    parts = [
        fleet.documents(*patterns).withColumn("group", F.lit(group)) for group, patterns in groups.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    bad = F.col("file_name").endswith(".json") & F.try_parse_json("value").isNull()
    return out.select(
        "bundle_id", "group", "file_name", "file_path", F.col("value").alias("text"),
        F.when(bad, F.lit("not valid JSON")).alias("error"),
    )
