"""Ordered computations that hold when one key owns a large share of all rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.session import stage


def _with_previous(batches, keys: list[str], carry: list[str], part: int):
    """Rows of one partition in order: ``prev`` is the row before of the same key; the first and the last row carry
    the partition's number as ``_first`` and ``_last``."""

    def numbered(n: int, at: int | None) -> pa.Array:
        return pa.array(np.full(n, part, np.int32), mask=np.arange(n) != (-1 if at is None else at % n))

    before, held = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            yield held.append_column("_last", numbered(held.num_rows, None))
        rows = pa.Table.from_batches([batch])
        whole = rows if before is None else pa.concat_tables([before, rows])
        n = whole.num_rows - 1
        same = pa.chunked_array([np.ones(n, bool)])
        for key in keys:
            same = pc.and_(same, pc.equal(whole[key].slice(1), whole[key].slice(0, n)))
        other = pa.array(~same.to_numpy().astype(bool))
        prev = pa.StructArray.from_arrays([whole[c].slice(0, n).combine_chunks() for c in carry], names=carry, mask=other)
        if before is None:
            prev = pa.concat_arrays([pa.nulls(1, prev.type), prev])
        held = pa.record_batch([*batch.columns, prev, numbered(batch.num_rows, 0 if before is None else None)], names=[*batch.schema.names, "prev", "_first"])
        before = rows.slice(batch.num_rows - 1)
    if held is not None:
        yield held.append_column("_last", numbered(held.num_rows, -1))


def previous_in_order(df: DataFrame, keys: list[str], ts: str, id_: str, carry: list[str], partitions: int | None = None) -> DataFrame:
    """Adds ``prev``: a struct of the row before, per key, in (ts, id) order.

    A plain ``lag`` per key sorts a whole key in one task. Here all rows are range-partitioned by
    (key, ts, id), in the only shuffle of the rows, so a key of any size is cut where its rows lie, also if they share one time.
    Tasks walk their rows in order and the result is staged. The first row of a partition then takes the last row of the
    partition before, from a table with a row per partition, which is why that table can be broadcast.
    Keys must not be NULL.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*keys, ts, id_]
    kind = T.StructType([df.schema[c] for c in carry])
    shape = T.StructType([*df.schema.fields, T.StructField("prev", kind), *[T.StructField(c, T.IntegerType()) for c in ("_first", "_last")]])

    def walk(batches):
        yield from _with_previous(batches, keys, carry, TaskContext.get().partitionId())

    walked = stage(df.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(walk, shape), "in-order")
    ends = walked.filter("_last IS NOT NULL").select("_last", F.struct(*dict.fromkeys([*keys, *carry])).alias("_row"))
    # Partitions without rows have no end, so the next end is that of the partition whose first row follows.
    across = ends.select("_row", F.lead("_last").over(Window.orderBy("_last")).alias("_first")).filter("_first IS NOT NULL")
    joined = walked.join(F.broadcast(across), "_first", "left")
    same_key = F.col("_row").isNotNull()
    for key in keys:
        same_key = same_key & (F.col(f"_row.{key}") == F.col(key))
    border = F.when(same_key, F.struct(*[F.col(f"_row.{c}").alias(c) for c in carry]))
    return joined.withColumn("prev", F.when(F.col("_first").isNull(), F.col("prev")).otherwise(border)).drop("_first", "_last", "_row")


SALTS = 64


def top_per_key(
    df: DataFrame, keys: list[str], order: list, n: int, rank: str | None = None, salt_by: str | None = None
) -> DataFrame:
    """The first ``n`` rows per key.

    The limit is pushed below the shuffle, so a task sends at most ``n`` rows of a key.
    For raw rows that is not enough: a hot key still sends ``n`` rows from every task to
    one. ``salt_by`` names a column that spreads them over ``SALTS`` tasks, which limit
    again; only ``SALTS * n`` rows of a key meet in the end.
    """
    if salt_by:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(SALTS)))
        df = _first_rows(salted, [*keys, "_salt"], order, n, "_rank").drop("_rank", "_salt")
    out = _first_rows(df, keys, order, n, rank or "_rank")
    return out if rank else out.drop("_rank")


def _first_rows(df: DataFrame, keys: list[str], order: list, n: int, name: str) -> DataFrame:
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(name) <= n)


def share_of_total(df: DataFrame, keys: list[str], value: str, name: str, total: str = "_total") -> DataFrame:
    """Adds percent of the key's sum. ``df`` is already aggregated below ``keys``, so a key has a row
    per group; they meet in a window, and the aggregation below runs once."""
    joined = df.withColumn(total, F.sum(value).over(Window.partitionBy(*keys)))
    joined = joined.withColumn(name, F.when(F.col(total) > 0, F.col(value) / F.col(total) * 100).otherwise(F.lit(0.0)))
    return joined.drop(total) if total == "_total" else joined
