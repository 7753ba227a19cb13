"""Whitened embeddings, from a covariance over distinct vectors weighted by their multiplicity.

1. Entries become the steps they lie in, floor(64 * c); a vector of steps keeps the type of the column,
   which holds such whole numbers exactly. Equal vectors of steps are one row with a count, so
   a vector that makes up a third of the table is read once by all that follows.
2. The exact sum of each dimension is taken over the distinct vectors, weighted by the counts.
3. Each task centres its distinct vectors and multiplies them by themselves, rows weighted by the
   counts: a matrix of d x d per task. The matrices are added row by row in a shuffle, so the
   driver only sees one of d x d, whatever the number of rows. Its eigenvectors are the components.
4. Every distinct vector is whitened once and the result is joined back to the rows. The join is on the
   vectors themselves, the side of the distinct ones is unique, and so adaptive execution can split
   a hot vector's rows.

Centring is done in whole numbers: n * x - S is exact, also where it leaves 64 bits, and is rounded
once, when it is divided by n.

Edge cases: rows whose vector is null, or that hold a null or non-finite entry, or one so large
that its steps do not fit in 62 bits, are dropped. Vectors of another length than the most frequent one (of several such,
the longest) are dropped too, as are empty ones. Rows that repeat count as often as they occur; a null
vec_id is kept. A deviation of more than 38 digits is null. Directions without variance (eigenvalues within rounding of zero) have no component, so fewer than
``components`` are returned for tables of few or dependent vectors, and none where all are equal. An
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.registry import query, table
from fleetlens.session import stage

SCALE, SHIFT = 64, 1_000_000
#: Numbers of a batch that are worked on at once.
CELLS = 2_000_000


def steps(rows: DataFrame, vector: str, scale: int) -> DataFrame:
    """``rows`` with the column ``steps``, for rows whose ``vector`` is whole and finite."""
    kind = rows.schema[vector].dataType.elementType.simpleString()
    kind = kind if kind in ("float", "double") else "bigint"
    c = lambda x: x.cast("double") * scale
    fits = lambda x: x.isNotNull() & (F.abs(c(x)) < float(2**62))  # noqa: E731  a NaN is larger than any number
    # The test stands inside the conversion too, since the optimizer may compute it before the filter.
    floors = F.transform(vector, lambda x: F.when(fits(x), F.floor(c(x)).cast("long").cast(kind)))
    return rows.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, fits)).withColumn("steps", floors)


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """Vectors of one length as rows of whole numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)


def slices(batch: pa.RecordBatch, d: int):
    rows = max(1, CELLS // d)
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


@dataclass
class Fit:
    """What whitening needs: number of vectors, sums per dimension of x (exact), projection (d x components), shares of the variance."""

    n: int
    sums: list[int]
    projection: np.ndarray
    explained: np.ndarray
    values: np.ndarray

    def scattered(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, in 64 bits where that is exact, else as Python's whole numbers."""
        most = max(int(x.max()), -int(x.min()), 1) if x.size else 1
        if self.n * most + max(map(abs, self.sums)) < 2**62:
            return self.n * x - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.scattered(x).astype(np.float64) / float(self.n)


def deviations(scattered: np.ndarray) -> list[int]:
    """Sum over the dimensions of the squares, exact."""
    if not scattered.size:
        return [0] * len(scattered)
    if scattered.dtype != object:
        most = max(int(scattered.max()), -int(scattered.min()))
        if most * most * scattered.shape[1] < 2**63:
            return (scattered * scattered).sum(1).tolist()
    return (scattered.astype(object) ** 2).sum(1).tolist()


def _sums(batches, d: int):
    total = [0] * d
    for batch in batches:
        for part in slices(batch, d):
            x, weight = matrix(part.column(0), d) + SHIFT, part.column(1).to_numpy()
            most = max(int(x.max()), -int(x.min()), 1)
            exact = most * int(weight.sum()) < 2**62
            found = weight @ x if exact else weight.astype(object) @ x.astype(object)
            total = [a + int(b) for a, b in zip(total, found, strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], names=["dim", "total"])


def weighted_gram(vectors: DataFrame, columns: list[str], centred, d: int) -> np.ndarray:
    """Sum of weight * v v' over the rows, v = centred(batch): the first of ``columns`` is the vector, the second the weight.

    Each task adds up its own matrix; rows of the matrices are added in a shuffle.
    """

    def products(batches):
        total = np.zeros((d, d))
        for batch in batches:
            for part in slices(batch, d):
                v = centred(part.column(0))
                total += (v * part.column(1).to_numpy().astype(np.float64)[:, None]).T @ v
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], names=["dim", "line"])

    def added(batches):
        lines: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lines[dim] = lines.get(dim, 0.0) + np.frombuffer(line)
        yield pa.RecordBatch.from_arrays([pa.array(lines.keys(), pa.int32()), pa.array([x.tobytes() for x in lines.values()], pa.binary())], names=["dim", "line"])

    shape = "dim int, line binary"
    lines = vectors.select(*columns).mapInArrow(products, shape).repartition("dim").mapInArrow(added, shape)
    found = {r["dim"]: np.frombuffer(r["line"]) for r in lines.collect()}
    return np.stack([found[i] for i in range(d)]) if found else np.zeros((d, d))


def fit(distinct: DataFrame, d: int, components: int) -> Fit:
    """Means, covariance and its leading components over (steps, copies)."""
    totals = distinct.select("steps", "copies").mapInArrow(lambda it: _sums(it, d), "dim int, total decimal(38,0)")
    sums = {r["dim"]: int(r["total"]) for r in totals.groupBy("dim").agg(F.sum("total").cast("decimal(38,0)").alias("total")).collect()}
    n = distinct.agg(F.sum("copies")).first()[0]
    base = Fit(n, [sums[i] for i in range(d)], np.zeros((d, 0)), np.zeros(0), np.zeros(0))
    covariance = weighted_gram(distinct, ["steps", "copies"], lambda c: base.centred(matrix(c, d) + SHIFT), d) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    held = min(components, int((values > max(values[0], 0) * d * 1e-13).sum()))
    return Fit(n, base.sums, vectors[:, :held] / np.sqrt(values[:held]), values[:held] / np.trace(covariance), values[:held])


def _whitened(batches, found: Fit, d: int):
    for batch in batches:
        for part in slices(batch, d):
            scattered = found.scattered(matrix(part.column(0), d) + SHIFT)
            z = (scattered.astype(np.float64) / float(found.n)) @ found.projection
            offsets = np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]
            exact = pa.array([Decimal(v) if v < 10**38 else None for v in deviations(scattered)], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), exact, pa.ListArray.from_arrays(pa.array(offsets), pa.array(z.ravel()))], names=["steps", "copies", "deviation", "whitened"])


def whiten(rows: DataFrame, vector: str = "embedding", components: int = 32) -> DataFrame:
    """Per whole row of ``rows``: vec_id, n, deviation (decimal, exact), whitened (array by component), explained (array),
    identity_error (largest entry by which the covariance of the whitened vectors differs from the identity)."""
    spark = rows.sparkSession
    known = steps(rows, vector, SCALE).select("vec_id", "steps")
    kind = known.schema["steps"].dataType.simpleString()
    distinct = stage(known.groupBy("steps").agg(F.count("*").alias("copies")), "distinct-vectors")
    lengths = distinct.groupBy(F.size("steps").alias("d")).agg(F.sum("copies").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    out = "vec_id long, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    if lengths is None:
        return spark.createDataFrame([], out)
    d = lengths["d"]
    distinct = distinct.filter(F.size("steps") == d)
    found = fit(distinct, d, components)
    shape = f"steps {kind}, copies long, deviation decimal(38,0), whitened array<double>"
    whitened = stage(distinct.select("steps", "copies").mapInArrow(lambda it: _whitened(it, found, d), shape), "whitened")
    held = len(found.values)
    error = 0.0
    if held:
        # Projections of centred vectors are centred already.
        again = weighted_gram(whitened, ["whitened", "copies"], lambda c: c.flatten().to_numpy().reshape(-1, held), held) / found.n
        error = float(np.abs(again - np.eye(held)).max())
    joined = known.join(whitened.select("steps", "deviation", "whitened"), "steps")
    return joined.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.lit(found.n).cast("long").alias("n"), "deviation", "whitened",
        F.array(*[F.lit(float(e)) for e in found.explained]).cast("array<double>").alias("explained"), F.lit(error).alias("identity_error"))


@query("op11_embedding_whitening")
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per vector and component; ``deviation`` is null where the sum does not fit in 64 bits (``deviation_exact`` has it)."""
    found = whiten(table(spark, sf_dir, "embeddings"))
    each = found.select("*", F.posexplode("whitened").alias("place", "value"))
    return each.select(
        "vec_id", (F.col("place") + 1).alias("component"), "n", F.col("deviation").try_cast("long").alias("deviation"), F.col("value").alias("whitened"),
        F.get("explained", F.col("place")).alias("explained"), "identity_error", F.col("deviation").alias("deviation_exact"))
