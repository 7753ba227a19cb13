"""Removal of repeated lines, with levelled sorted runs of line hashes.

``LineRuns`` is a store of line keys in the cluster's shared folder. Every batch of documents
adds one sorted run of (hash, number of documents, largest doc_id); when a level holds
``fanout`` runs they are merged into one run of the next level, so a key is rewritten once
per level and a lookup meets few runs. Lines of a batch are matched with the runs by a merge
join on the hash, and those that repeat are anti-joined away.

A key is the line with ASCII white space stripped and A-Z in lower case. Two 64-bit hashes
stand for it, so texts are shuffled once only, to put the kept lines together.

Edge cases: a null or empty text is one empty line; a line of under ``min_chars`` code points
is always kept; documents are counted by doc_id, so rows that repeat one count once (a batch has to hold all
of its rows) and every row with the largest doc_id keeps its lines; null doc_ids are one id, smaller than any; an empty
table gives an empty result; other columns are passed through, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.registry import query, table
from fleetlens.session import staged_folder

BLANK = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_DOC = -(2**63)
HASHES = ["_h1", "_h2"]


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _doc_id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_DOC))


def _doc(docs: DataFrame) -> DataFrame:
    """Only what the lines need: the id, the text, and a hash that tells rows of one id apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(_doc_id().alias("_doc"), F.xxhash64(text).alias("_row"), text.alias("_text"))


def _hashed(df: DataFrame) -> DataFrame:
    return df.withColumns({"_h1": F.xxhash64("_key"), "_h2": F.xxhash64(F.lit(1), "_key")}).drop("_key")


class LineRuns:
    """Levelled sorted runs under ``folder`` (default: a new one in the shared folder)."""

    def __init__(self, spark: SparkSession, min_chars: int = 20, min_docs: int = 3, fanout: int = 4, folder: str | None = None):
        self.spark, self.min_chars, self.min_docs, self.fanout = spark, min_chars, min_docs, fanout
        self.folder = folder or staged_folder(spark, "line-runs")
        self.levels: list[list[str]] = []

    def _write(self, rows: DataFrame, level: int) -> None:
        merged = rows.groupBy(*HASHES).agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))
        path = f"{self.folder}/level{level}-{uuid.uuid4().hex}"
        merged.sortWithinPartitions(*HASHES).write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema("_h1 long, _h2 long, n_docs long, last_doc long").parquet(*paths)

    def add(self, docs: DataFrame) -> None:
        """One run of this batch; then levels that are full are compacted."""
        keys = F.array_distinct(F.filter(F.transform(lines_of(F.col("_text")), line_key), lambda k: F.length(k) >= self.min_chars))
        lines = _hashed(_doc(docs).select("_doc", F.explode(keys).alias("_key")))
        once = lines.groupBy(*HASHES, "_doc").agg(F.lit(1).cast("long").alias("n_docs"))
        self._write(once.select(*HASHES, "n_docs", F.col("_doc").alias("last_doc")), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._write(self._read(full), level + 1)
            level += 1

    def repeated(self) -> DataFrame:
        """Keys in ``min_docs`` documents or more: hash, number of documents, largest doc_id."""
        paths = [p for level in self.levels for p in level]
        merged = self._read(paths)
        if len(paths) > 1:
            merged = merged.groupBy(*HASHES).agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))
        return merged.filter(F.col("n_docs") >= self.min_docs)

    def strip(self, docs: DataFrame) -> DataFrame:
        """``docs`` with the kept lines as ``text``, and ``n_lines``, ``n_dropped``.

        A column of ``docs`` that has one of these two names gives way to the new one.
        """
        at = F.posexplode(F.transform(lines_of(F.col("_text")), line_key)).alias("_at", "_key")
        places = _hashed(_doc(docs).select("_doc", "_row", at).filter(F.length("_key") >= self.min_chars))
        gone = (
            places.join(self.repeated(), HASHES).filter(F.col("_doc") != F.col("last_doc"))
            .groupBy("_doc", "_row").agg(F.collect_set("_at").alias("_gone"))
        )
        text = F.coalesce(F.col("text"), F.lit(""))
        rows = docs.withColumns({"_doc": _doc_id(), "_row": F.xxhash64(text)})
        rows = rows.join(gone, ["_doc", "_row"], "left").withColumns({"_lines": lines_of(F.col("text")), "_gone": F.coalesce("_gone", F.array().cast("array<int>"))})
        every = F.sequence(F.lit(0), F.size("_lines") - 1)
        kept = F.transform(F.array_except(every, F.col("_gone")), lambda i: F.get("_lines", i))
        rows = rows.withColumns({"n_lines": F.size("_lines").cast("long"), "n_dropped": F.size("_gone").cast("long"), "text": F.array_join(kept, "\n")})
        names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
        return rows.select(*names, "n_lines", "n_dropped")


def dedup_lines(docs: DataFrame, batches: int = 4, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """All ``docs`` in ``batches`` parts through the runs, then stripped of repeated lines.

    The result reads the runs in the shared folder when it is executed.
    """
    runs = LineRuns(docs.sparkSession, min_chars, min_docs, fanout=max(2, batches))
    for k in range(batches):
        runs.add(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k))
    return runs.strip(docs)


@query("op8_line_dedup", f"""
WITH lines AS (
  SELECT doc_id, i AS place, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents) t
), keyed AS (
  SELECT doc_id, place, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.doc_id, k.place, k.line, r.key IS NOT NULL AND k.doc_id <> r.last_doc AS gone FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""")
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
