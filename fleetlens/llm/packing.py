"""Best-fit packing of token ids into sequences of fixed length, by hierarchical residuals.

Each task packs the pieces it has cut, best fit and longest first per batch. Bins that are nearly full are
done; underfull ones go on as single items with their load. Rounds merge them as a tree: few
partitions, each best-fitting the underfull bins of several below, until no partition can place
one bin in another. An item is a narrow row (bin, load), so the token ids never move, and a
piece finds its place by joining its bin with the few bins that were merged.

Edge cases: a null or empty text is its end id alone; a text longer than a sequence is cut into
pieces of full length, the last may be shorter; rows that repeat a doc_id are packed each; a null
doc_id is kept; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.registry import query, table
from fleetlens.llm.token_ids import token_slices
from fleetlens.session import stage

NEARLY_FULL = 0.995
FAN_IN = 8
ITEMS_PER_TASK = 50_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, place long"


class BestFit:
    """Open bins of one task, found by free space: a set bit tells that a bin with that much room is open."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0
        self.bins = 0
        self.base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40

    def place(self, size: int, bin_id: int | None = None) -> tuple[int, int]:
        """(bin, offset) in the fullest open bin that has room; else in a new one."""
        fitting = self.mask >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            chosen = self.open[free].pop()
            if not self.open[free]:
                self.mask &= ~(1 << free)
        else:
            free, chosen = self.capacity, self.base + self.bins if bin_id is None else bin_id
            self.bins += 1
        left = free - size
        if left:
            self.open[left].append(chosen)
            self.mask |= 1 << left
        return chosen, self.capacity - free

    def place_all(self, sizes: np.ndarray, ids: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        out = np.empty((len(sizes), 2), np.int64)
        for i in np.argsort(-sizes, kind="stable").tolist():
            out[i] = self.place(int(sizes[i]), None if ids is None else int(ids[i]))
        return out[:, 0], out[:, 1]


def _cut(batches, path: str, capacity: int, end_id: int, with_ids: bool):
    fit = BestFit(capacity)
    for batch in batches:
        rows: list[list] = [[] for _ in range(6)]
        for part, ids, bounds in token_slices(batch, path):
            for doc, a, b in zip(part.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                for k, start in enumerate(range(0, len(own), capacity)):
                    piece = own[start : start + capacity].tobytes()
                    for column, value in zip(rows, (doc, k, start, len(piece) // 4, zlib.crc32(piece), piece if with_ids else None), strict=True):
                        column.append(value)
        bins, places = fit.place_all(np.array(rows[3], np.int64))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        columns = [pa.array(c, k) for c, k in zip(rows, kinds, strict=True)]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
        if not with_ids:
            columns, names = columns[:5], names[:5]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(bins), pa.array(places)], names=[*names, "bin", "place"])


def _merge(batches, capacity: int):
    fit = BestFit(capacity)
    for batch in batches:
        bins = batch.column(0).to_numpy()
        parents, shifts = fit.place_all(batch.column(1).to_numpy(), bins)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(parents), pa.array(shifts)], names=["bin", "load", "parent", "shift"])


def merge_rounds(loads: DataFrame, capacity: int, partitions: int) -> DataFrame | None:
    """(bin, root, shift) of the bins that a round has moved into another one."""
    moved = None
    items = stage(loads.filter(F.col("load") < int(NEARLY_FULL * capacity)), "bins")
    while True:
        smallest, count = items.agg(F.min("load"), F.count("*")).first()
        # A bin with less room than the smallest load can neither take nor be taken.
        if not count or 2 * smallest > capacity:
            return moved
        last = partitions == 1
        partitions = max(-(-partitions // FAN_IN), -(-count // ITEMS_PER_TASK))
        dealt = items.filter(F.col("load") <= capacity - smallest).repartition(partitions, F.xxhash64("bin", F.lit(partitions))).sortWithinPartitions(F.desc("load"), "bin")
        step = stage(dealt.mapInArrow(lambda it: _merge(it, capacity), "bin long, load long, parent long, shift long"), "merged")
        went = step.filter("bin <> parent").select("bin", "parent", "shift")
        if went.isEmpty():
            if last or partitions == 1:
                return moved
        else:
            found = went.withColumnRenamed("parent", "root")
            if moved is not None:
                onward = went.select(F.col("bin").alias("root"), "parent", F.col("shift").alias("more"))
                found = found.union(moved.join(onward, "root", "left").select("bin", F.coalesce("parent", "root").alias("root"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")))
            moved = stage(found, "moved")
            if partitions == 1:
                return moved
        items = stage(step.groupBy(F.col("parent").alias("bin")).agg(F.sum("load").alias("load")).filter(F.col("load") < int(NEARLY_FULL * capacity)), "bins")


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Per piece of each document: doc_id, piece, start, length, ids_crc32, sequence_id, offset
    (and ``ids``, little-endian unsigned 32-bit numbers, if ``with_ids``)."""
    schema = PIECES.replace("bin long", "ids binary, bin long") if with_ids else PIECES
    cut = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: _cut(it, path, capacity, end_id, with_ids), schema)
    pieces = stage(cut, "pieces")
    loads = pieces.groupBy("bin").agg(F.sum("length").alias("load"))
    moved = merge_rounds(loads, capacity, pieces.rdd.getNumPartitions())
    out = pieces.withColumns({"sequence_id": F.col("bin"), "offset": F.col("place")})
    if moved is not None:
        out = pieces.join(moved, "bin", "left").withColumns({"sequence_id": F.coalesce("root", "bin"), "offset": F.col("place") + F.coalesce("shift", F.lit(0))})
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids
    return out.select(*names)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences (of ``pack(..., with_ids=True)``): sequence_id, length, ids as bytes."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda whole, p: F.concat(whole, p["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op3_best_fit_packing")
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), word_bpe())
