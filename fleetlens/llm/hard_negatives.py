"""Hard negatives for contrastive training: exact integer scores by a residue-number-system product.

A score is the inner product of two vectors of whole numbers. The product of all anchors with all rows runs in
single precision and is still exact: both sides are reduced modulo several primes, so small that
no sum of a product leaves the 24 bits which a float holds; the residue products give the score
modulo each prime, and Chinese remaindering (mixed radix with balanced digits, which carries the sign)
gives the score itself. As many primes are used as the largest entries of a block ask for.

1. Valid rows are packed into blocks of bounded size, a row per block, and staged; anchors are staged as
   rows. Groups of some blocks are the columns of the product, blocks of anchors its rows. Every group meets
   every block of anchors: candidates of a group come first in its partition and are held, the
   anchors stream past them. Nothing is dealt by label or id, so no key is hot.
2. First pass: each group gives, per anchor, its best rows of the same label; a window over (anchor) takes the first.
3. Second pass: the anchors carry their positives' scores; each group gives, per anchor and positive, its
   best rows of other labels with scores in the positive's range; a window over (anchor, positive) takes the first.

Edge cases: rows with a null label or vector, with a null or non-finite entry or with entries so large that
a score could leave 63 bits take no part; neither do empty vectors, nor those of another length
than the most frequent (of several such, the longest). Equal scores go by vec_id, null ids last. Rows that repeat a vec_id are rows
of their own, but not positives or negatives of an anchor with that id; a null id is no anchor. Anchors
without positives, and positives without negatives in range, give no row; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.llm.registry import query, table
from fleetlens.session import stage

SCALE = 256
#: Entries of a packed block, of the candidates that a task holds, and of the scores it works on at once.
BLOCK_CELLS, HELD_CELLS, SCORE_CELLS = 32_768, 2_000_000, 2_000_000
#: Dimensions that are added up before they are reduced again.
CHUNK = 256
BLOCK = "ids long, block binary"


@lru_cache(maxsize=None)
def primes(width: int) -> list[int]:
    """The largest primes whose balanced residues, ``width`` products of two added, stay within 23 bits, with room for a step in a float of 24."""
    top = 2 * int((2**23 / width) ** 0.5) + 1
    out = [p for p in range(3, top + 1, 2) if all(p % q for q in range(3, int(p**0.5) + 1, 2))]
    return out[::-1]


def balanced(x: np.ndarray, p: int) -> np.ndarray:
    """x modulo p, nearest to zero, as whole numbers in single precision."""
    return x - np.float32(p) * np.rint(x * np.float32(1 / p))


class Residues:
    """One side of the product: its rows modulo each prime, computed when first asked for."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.most = max(int(x.max()), -int(x.min())) if x.size else 0
        self.by_prime: dict[int, np.ndarray] = {}

    def modulo(self, p: int) -> np.ndarray:
        if p not in self.by_prime:
            r = np.mod(self.x, p)
            self.by_prime[p] = np.where(r > p // 2, r - p, r).astype(np.float32)
        return self.by_prime[p]


def products(left: Residues, right: Residues) -> np.ndarray:
    """Exact inner products of all rows of both sides, as 64-bit whole numbers."""
    d = left.x.shape[1]
    bound, chosen, span = d * left.most * right.most, [], 1
    for p in primes(min(d, CHUNK)):
        # Four times the bound, so that digits may stand a step beside their range.
        if span > 4 * bound and chosen:
            break
        chosen.append(p)
        span *= p
    digits: list[np.ndarray] = []
    for p in chosen:
        a, b = left.modulo(p), right.modulo(p)
        rest = np.zeros((len(a), len(b)), np.float32)
        for k in range(0, d, CHUNK):
            rest = balanced(rest + balanced(a[:, k : k + CHUNK] @ b[:, k : k + CHUNK].T, p), p)
        for q, digit in zip(chosen, digits, strict=False):
            inverse = pow(q, -1, p)
            rest = balanced(balanced(rest - digit, p) * np.float32(inverse if inverse <= p // 2 else inverse - p), p)
        digits.append(rest)
    out = digits[-1].astype(np.int64)
    for p, digit in zip(chosen[-2::-1], digits[-2::-1], strict=True):
        out = out * p + digit.astype(np.int64)
    return out


def packed(rows: dict[str, np.ndarray]) -> bytes:
    """Columns of a block as bytes; ``unpacked`` gives them back."""
    whole = pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in rows.values()] + [pa.array([len(rows["id"])])], names=[*rows, "n"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, whole.schema) as writer:
        writer.write_batch(whole)
    return sink.getvalue().to_pybytes()


def unpacked(block: bytes) -> dict[str, np.ndarray]:
    kinds = {"id": np.int64, "named": np.bool_, "label": np.int64, "x": np.int32, "number": np.int64, "limits": np.int64, "n_limits": np.int64}
    row = pa.ipc.open_stream(block).read_all().to_pylist()[0]
    n = row.pop("n")
    out = {k: np.frombuffer(v, kinds[k]) for k, v in row.items()}
    return out | {k: out[k].reshape(n, -1) for k in ("x", "limits") if k in out}


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.fill_null(0).to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)


def _blocks(batches, d: int, columns: list[str]):
    """Rows (vec_id, label, steps, ...) as packed blocks: those of a task in order, each of bounded size."""
    for batch in batches:
        for at in range(0, batch.num_rows, max(1, BLOCK_CELLS // d)):
            part = batch.slice(at, max(1, BLOCK_CELLS // d))
            ids, named = _ids(part.column(0))
            rows = {"id": ids, "named": named, "label": part.column(1).to_numpy(), "x": part.column(2).flatten().to_numpy()}
            if "number" in columns:
                limits = part.column(4)
                sizes = np.diff(limits.offsets.to_numpy())
                wide = np.zeros((part.num_rows, int(sizes.max(initial=1))), np.int64)
                wide[np.arange(wide.shape[1])[None, :] < sizes[:, None]] = limits.flatten().to_numpy()
                rows |= {"number": part.column(3).to_numpy(), "limits": wide.ravel(), "n_limits": sizes.astype(np.int64)}
            yield pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int64()), pa.array([packed(rows)], pa.binary())], names=["ids", "block"])


def first_of(scores: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores; of equal ones the smaller place. ``scores`` belong to ascending ``places``."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores >= least)
        scores, places = scores[above], places[above]
    return places[np.argsort(-scores, kind="stable")[:k]]


class Candidates:
    """The rows a task holds, ordered by id (null ids last)."""

    def __init__(self, blocks: list[dict[str, np.ndarray]]):
        whole = {k: np.concatenate([b[k] for b in blocks]) for k in ("id", "named", "label", "x")}
        order = np.lexsort((whole["id"], ~whole["named"]))
        self.id, self.named, self.label, x = (whole[k][order] for k in ("id", "named", "label", "x"))
        self.side = Residues(x)

    def scores(self, anchors: dict[str, np.ndarray]):
        """(anchor's place, its scores) one by one."""
        step = max(1, SCORE_CELLS // max(1, len(self.id)))
        for a in range(0, len(anchors["id"]), step):
            found = products(Residues(anchors["x"][a : a + step]), self.side)
            yield from zip(range(a, a + len(found)), found, strict=True)


def _positives(held: Candidates, anchors: dict, k: int):
    for i, scores in held.scores(anchors):
        same = np.flatnonzero((held.label == anchors["label"][i]) & ~(held.named & (held.id == anchors["id"][i])))
        for j in first_of(scores[same], same, k):
            yield anchors["number"][i], int(held.id[j]) if held.named[j] else None, scores[j], 0


def _negatives(held: Candidates, anchors: dict, k: int, low: int):
    for i, scores in held.scores(anchors):
        other = np.flatnonzero((held.label != anchors["label"][i]) & ~(held.named & (held.id == anchors["id"][i])))
        among = scores[other]
        for rank, limit in enumerate(anchors["limits"][i, : anchors["n_limits"][i]].tolist(), 1):
            # low * limit <= 100 * score <= 100 * limit, in whole numbers.
            within = np.flatnonzero((among <= limit) & (among >= -(-low * limit // 100)))
            for j in first_of(among[within], other[within], k):
                yield anchors["number"][i], int(held.id[j]) if held.named[j] else None, scores[j], rank


def _meet(batches, choose):
    """Rows (g, kind, block) by group: candidates (kind 0) are held, blocks of anchors (kind 1) are scored against them."""
    group, blocks, held = None, [], None
    for batch in batches:
        for g, kind, block in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            if g != group:
                group, blocks, held = g, [], None
            if kind == 0:
                blocks.append(unpacked(block))
            elif blocks:
                held = held or Candidates(blocks)
                found = list(zip(*choose(held, unpacked(block)), strict=True))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["number", "found_id", "score", "slot"])


def scored(candidates: DataFrame, anchors: DataFrame, groups: int, choose) -> DataFrame:
    """(number, found_id, score, slot): what ``choose`` takes of each group for each anchor."""
    own = candidates.select("g", F.lit(0).alias("kind"), "block")
    each = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(1).alias("kind"), "block")
    dealt = own.union(each).repartitionById(groups, F.col("g")).sortWithinPartitions("g", "kind")
    return dealt.mapInArrow(lambda it: _meet(it, choose), "number long, found_id long, score long, slot int")


def mine(rows: DataFrame, anchor, vector: str = "embedding", positives: int = 5, negatives: int = 5, low: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows of ``rows`` (vec_id, label, ``vector``) where the condition ``anchor`` holds are the anchors. Negatives
    score between ``low`` per cent of the positive's score and that score.
    """
    spark = rows.sparkSession
    c = lambda x: x.cast("double") * SCALE
    # d products of two entries stay below 2**62.
    fits = lambda x: x.isNotNull() & (F.abs(c(x)) < F.lit(2.0**31) / F.sqrt(F.size(vector)))
    whole = rows.filter(F.col("label").isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, fits))
    whole = whole.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform(vector, lambda x: F.when(fits(x), F.floor(c(x))).cast("int")).alias("steps"))
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    lengths = whole.groupBy(F.size("steps").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], out)
    d, n = lengths["d"], lengths["count"]
    whole = whole.filter(F.size("steps") == d)
    groups = max(-(-n * d // HELD_CELLS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = whole.mapInArrow(lambda it: _blocks(it, d, []), BLOCK).withColumn("number", F.monotonically_increasing_id())
    candidates = stage(parts, "candidate-blocks")
    # Blocks go to groups in turn within their task, so groups differ by few blocks.
    candidates = candidates.withColumn("g", F.pmod(F.xxhash64(F.shiftright("number", 33)) + F.col("number"), F.lit(groups)).cast("int"))
    anchors = stage(whole.filter(anchor).withColumn("number", F.monotonically_increasing_id()), "anchors")

    def blocks(limits):
        columns = ["vec_id", "label", "steps", "number", "limits"]
        return limits.select(*columns).mapInArrow(lambda it: _blocks(it, d, columns), BLOCK)

    def first(found, keys, k):
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("found_id"))
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    plain = blocks(anchors.withColumn("limits", F.array().cast("array<long>")))
    best = first(scored(candidates, plain, groups, lambda held, a: _positives(held, a, positives)), ["number"], positives)
    best = stage(best.select("number", F.col("rank").alias("slot"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # At most ``positives`` scores per anchor.
    limits = best.groupBy("number").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "positive_score"))), lambda s: s["positive_score"]).alias("limits"))
    found = scored(candidates, blocks(anchors.join(limits, "number")), groups, lambda held, a: _negatives(held, a, negatives, low))
    hard = first(found, ["number", "slot"], negatives).withColumnsRenamed({"found_id": "negative_id", "score": "negative_score"})
    named = hard.join(best, ["number", "slot"]).join(anchors.select("number", F.col("vec_id").alias("anchor_id")), "number")
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


MINE_SQL = """
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS found_id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
  FROM whole a JOIN whole b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, found_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, found_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.found_id) AS INTEGER) AS rank,
  s.found_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
QUALIFY rank <= 5
"""


@query("op12_hard_negatives", MINE_SQL)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)
