"""Token ids of a corpus in files of range-coded blocks, in ascending doc_id order.

The corpus is range-partitioned by doc_id and sorted, so part k of the output holds smaller ids
than part k + 1. A part is a Parquet file whose rows are segments: the documents of the segment
with their numbers of ids, and blocks of 1024 ids, each coded by itself with its own checksum
(``range_coder``). Parquet is only the container: it gives atomic commits on any store, so a lost
executor leaves no half file, and readers split by segment.

Edge cases: a null or empty text is its end id alone; null doc_ids come first; rows that repeat a
doc_id follow each other, ordered by text; an empty table writes an empty file; other columns of
the input are not read; a damaged block raises instead of giving other ids.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetlens.llm.packing import word_bpe
from fleetlens.llm.range_coder import BLOCK, LANES, decode_blocks, encode_blocks
from fleetlens.llm.registry import query, table
from fleetlens.llm.token_ids import token_slices
from fleetlens.session import shared_folder

SEGMENT = "part int, segment int, n_ids long, doc_ids array<long>, doc_sizes array<long>, block_sizes array<int>, block_crcs array<long>, blocks array<binary>"


def _segment(part: int, number: int, docs: list, sizes: list[int], ids: list[np.ndarray]) -> pa.RecordBatch:
    coded = encode_blocks(np.concatenate([*ids, np.empty(0, np.uint32)]))
    one = lambda values, kind: pa.array([values], pa.list_(kind))
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([sum(sizes)], pa.int64()), one(docs, pa.int64()), one(sizes, pa.int64()),
         one([c[0] for c in coded], pa.int32()), one([c[1] for c in coded], pa.int64()), one([c[2] for c in coded], pa.binary())],
        names=["part", "segment", "n_ids", "doc_ids", "doc_sizes", "block_sizes", "block_crcs", "blocks"],
    )


def _encode(batches, path: str, end_id: int):
    """One partition in order; a segment closes at a document's end once it has enough ids for all lanes."""
    part, number = TaskContext.get().partitionId(), 0
    docs, sizes, ids, held = [], [], [], 0
    for batch in batches:
        for rows, found, bounds in token_slices(batch, path):
            for doc, a, b in zip(rows.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                docs.append(doc)
                sizes.append(b - a + 1)
                ids.append(np.append(found[a:b], np.uint32(end_id)))
                held += b - a + 1
                if held >= BLOCK * LANES:
                    yield _segment(part, number, docs, sizes, ids)
                    number, docs, sizes, ids, held = number + 1, [], [], [], 0
    if docs:
        yield _segment(part, number, docs, sizes, ids)


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2) -> None:
    """Writes the ids of all ``docs`` below ``folder``."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(lambda it: _encode(it, tokenizer, end_id), SEGMENT).write.parquet(folder)


def _decode(batches):
    for batch in batches:
        for row in batch.to_pylist():
            ids = decode_blocks(list(zip(row["block_sizes"], row["block_crcs"], row["blocks"], strict=True))).astype("<u4")
            ends = np.cumsum(row["doc_sizes"])
            n = len(ends)
            crcs = [zlib.crc32(ids[e - k : e].tobytes()) for e, k in zip(ends, row["doc_sizes"], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["part"]] * n, pa.int32()), pa.array([row["segment"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(ends - row["doc_sizes"]), pa.array(row["doc_sizes"], pa.int64()), pa.array(crcs, pa.int64())],
                names=["part", "segment", "doc_id", "inside", "n_tokens", "ids_crc32"],
            )


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, ids): the ids of every document, as an array."""

    def arrays(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_blocks(list(zip(row["block_sizes"], row["block_crcs"], row["blocks"], strict=True)))
                offsets = np.concatenate([[0], np.cumsum(row["doc_sizes"])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])

    return spark.read.schema(SEGMENT).parquet(folder).mapInArrow(arrays, "doc_id long, ids array<int>")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    segments = spark.read.schema(SEGMENT).parquet(folder)
    # A row per segment of eight million ids; the running sum is taken over parts, then inside a part.
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    before = parts.select("part", (F.sum("n_ids").over(W.orderBy("part")) - F.col("n_ids")).alias("part_start"))
    inside = F.sum("n_ids").over(W.partitionBy("part").orderBy("segment")) - F.col("n_ids")
    starts = segments.select("part", "segment", inside.alias("segment_start")).join(before, "part")
    docs = segments.mapInArrow(_decode, "part int, segment int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["part", "segment"]).select("doc_id", (F.col("part_start") + F.col("segment_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


@query("op9_token_files")
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/token-ids-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), word_bpe(), folder)
    return read_token_files(spark, folder)
