"""Text quality by an interpolated modified Kneser-Ney model of character 5-grams.

Counts come from all of the trusted text. A gram is a string of up to five characters of any script; its context and
its suffix are parts of it. The count tables of the orders are Spark tables hashed over all tasks, and the model is made by
joining them: continuation counts from the table above, discounts from the counts of counts, a gram's
probability from its count, its context's mass and its suffix's probability. Nothing is left out and no table is held
by the driver or by every task, so the model grows with the trusted text.

Scoring is a join too. The log probability of a character depends on the gram that ends with it alone, so each partition
of the documents first gives its *distinct* grams, far fewer than its characters. These are joined with the tables, by
order: what an order does not hold goes on, as suffix and context, to the next lower one. The scores then go to
the texts of their partition, which travel once, compressed in blocks of documents; there they are looked up by 64-bit hashes.

Perplexity is per character, end of text included. A text is kept if its perplexity is at most the
``quantile`` of the trusted texts of its language, times ``margin``. For this the trusted texts are scored by models
that have not seen them, like all others: each of ``FOLDS`` parts, dealt by a hash of the text so that exact copies stay together, by
a model of the other parts. These models are further columns of the same tables, whose counts leave a part out. Such a model has less text
than the final one, so thresholds are rather a little high.

Edge cases: a null or empty text has null perplexity and is not kept; a language with under
``LEAST_TRUSTED`` trusted texts uses the threshold of all trusted texts; where there are fewer in all, they cannot be spared for
another model and thresholds are those under the model of them; without any trusted text, thresholds are null and nothing is
kept; rows that repeat are scored each; null lang is a language of its own; repeated labels count once;
characters U+0000 and U+0001 count as U+0002; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.codes import mix, text_slices
from fleetlens.llm.registry import query, table
from fleetlens.session import drop_staged, release_shuffles, stage, staging_scope

ORDER = 5
#: An unseen character has this share of the mass that is left to such.
UNSEEN = 1 / 4096
PAD, END = 0, 1
FOLDS, LEAST_TRUSTED = 2, 20
#: The model of all trusted text, then those without one part.
MODELS = range(FOLDS + 1)
HELD_GRAMS, PACKED_ROWS, SLOT_BITS = 2_000_000, 500_000, 20
#: Of staged tables, which lie on the disk beside the texts' shuffle.
CODEC = "zstd"


def chars_of(points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters of the texts, each after four pads and before an end mark; and where each text starts."""
    lengths = np.diff(bounds)
    starts = np.concatenate([[0], np.cumsum(lengths + ORDER)])
    out = np.full(int(starts[-1]), PAD, np.uint32)
    out[np.arange(len(points)) + np.repeat(starts[:-1] + ORDER - 1 - bounds[:-1], lengths)] = np.maximum(points, 2)
    out[starts[1:] - 1] = END
    return out, starts


def hash_of(columns: list[np.ndarray]) -> np.ndarray:
    """64-bit hashes of grams, given their characters by place (21 bits each)."""
    a, b, c, d, e = (x.astype(np.uint64) for x in columns)
    return mix(mix(a | b << np.uint64(21) | c << np.uint64(42)) ^ ((d | e << np.uint64(21)) * np.uint64(0x9E3779B97F4A7C15)))


def gram_places(chars: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place of the first character) of the gram that ends at each character or end mark."""
    n = len(chars) - ORDER + 1
    hashes = hash_of([chars[k : k + n] for k in range(ORDER)])
    inner = np.ones(len(hashes), bool)
    # Grams that begin in one text and end in the next.
    inner[(starts[1:-1][:, None] - np.arange(1, ORDER)).ravel()] = False
    at = np.flatnonzero(inner)
    return hashes[at], at


class Distinct:
    """Distinct grams with counts: merged as they come, so memory follows the distinct ones."""

    def __init__(self):
        self.hashes, self.grams, self.counts = np.empty(0, np.uint64), np.empty((0, ORDER), np.uint32), np.empty(0, np.int64)

    def add(self, points: np.ndarray, bounds: np.ndarray) -> None:
        chars, starts = chars_of(points, bounds)
        self.merge(chars, *gram_places(chars, starts))

    def merge(self, chars: np.ndarray, hashes: np.ndarray, places: np.ndarray) -> None:
        found, first, times = np.unique(hashes, return_index=True, return_counts=True)
        grams = chars[places[first][:, None] + np.arange(ORDER)]
        self.hashes, kept, back = np.unique(np.concatenate([self.hashes, found]), return_index=True, return_inverse=True)
        self.counts = np.bincount(back, np.concatenate([self.counts, times]), len(self.hashes)).astype(np.int64)
        self.grams = np.concatenate([self.grams, grams])[kept]

    def strings(self) -> pa.Array:
        return pa.array(np.ascontiguousarray(self.grams).view(f"<U{ORDER}").ravel().tolist(), pa.string())


def _counted(batches):
    """(gram, part of the trusted text, n) of a task."""
    held = [Distinct() for _ in range(FOLDS)]

    def rows(k):
        return pa.RecordBatch.from_arrays([held[k].strings(), pa.array(np.full(len(held[k].hashes), k, np.int32)), pa.array(held[k].counts)], names=["gram", "fold", "n"])

    for batch in batches:
        for k in range(FOLDS):
            for _, points, bounds in text_slices(batch.filter(pc.equal(batch.column(1), k)), "text"):
                held[k].add(points, bounds)
            if len(held[k].hashes) > HELD_GRAMS:
                yield rows(k)
                held[k] = Distinct()
    for k in range(FOLDS):
        yield rows(k)


def fold_of(text: str = "text") -> Column:
    return F.pmod(F.xxhash64(text), F.lit(FOLDS)).cast("int")


def _discounts(counts: DataFrame) -> list[list[float]]:
    """Per model D1, D2, D3+ of modified Kneser-Ney, from the numbers of grams seen once to four times."""
    seen = counts.agg(*[F.count_if(F.col(f"n{m}") == k).alias(f"s{m}_{k}") for m in MODELS for k in range(1, 5)]).first()
    out = []
    for m in MODELS:
        n1, n2, n3, n4 = (seen[f"s{m}_{k}"] for k in range(1, 5))
        y = n1 / (n1 + 2 * n2) if n1 and n2 and n3 else 0.0
        given = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3] if y else [0.5, 0.75, 0.9]
        out.append([min(max(d, 0.05), k + 0.95) if y else d for k, d in enumerate(given)])
    return out


def train(texts: DataFrame) -> dict[int, DataFrame]:
    """Tables per order: (gram, p0.., mass0..), for each model the interpolated probability of a gram, and the mass that it leaves as a
    context to the next lower order (1 if it is no context there). Order 0 has the empty gram. What only leads to these tables is deleted."""
    spark, scope = texts.sparkSession, f"counts-{uuid.uuid4().hex}"
    folds = texts.select("text", fold_of().alias("fold")).mapInArrow(_counted, "gram string, fold int, n long")
    with staging_scope(spark, scope):
        tables = _tables(folds)
    tables = {order: stage(rows, "model", CODEC) for order, rows in tables.items()}
    drop_staged(spark, scope)
    return tables


def _tables(folds: DataFrame) -> dict[int, DataFrame]:
    """The tables of ``train``, not staged; their plans read what is staged here."""
    # Model 0 sees all parts, model k + 1 all but part k.
    every = [F.sum("n").alias("n0"), *[F.sum(F.when(F.col("fold") != k, F.col("n")).otherwise(0)).alias(f"n{k + 1}") for k in range(FOLDS)]]
    counts = {ORDER: stage(folds.groupBy("gram").agg(*every), "grams", CODEC)}
    for order in range(ORDER - 1, 0, -1):
        # Continuations: how many characters are seen before the gram.
        seen = [F.count_if(F.col(f"n{m}") > 0).alias(f"n{m}") for m in MODELS]
        above = counts[order + 1].groupBy(F.substring("gram", 2, order).alias("gram")).agg(*seen)
        counts[order] = stage(above, "grams", CODEC)
    tables: dict[int, DataFrame] = {}
    lower = None
    for order in range(1, ORDER + 1):
        rows = counts[order].withColumn("context", F.substring("gram", 1, order - 1))
        for m, (d1, d2, d3) in zip(MODELS, _discounts(counts[order]), strict=True):
            n = F.col(f"n{m}")
            rows = rows.withColumn(f"d{m}", F.when(n == 0, 0.0).when(n == 1, d1).when(n == 2, d2).otherwise(d3))
        contexts = rows.groupBy("context").agg(*[F.sum(c).alias(f"sum_{c}") for m in MODELS for c in (f"n{m}", f"d{m}")])
        mass = lambda m: F.when(F.col(f"sum_n{m}") > 0, F.col(f"sum_d{m}") / F.col(f"sum_n{m}")).otherwise(1.0)
        own = lambda m: F.when(F.col(f"sum_n{m}") > 0, (F.col(f"n{m}") - F.col(f"d{m}")) / F.col(f"sum_n{m}")).otherwise(0.0)
        rows = rows.join(contexts, "context")
        if lower is None:
            below = lambda m: F.lit(UNSEEN)
        else:
            suffixes = lower.select(F.col("gram").alias("suffix"), *[F.col(f"p{m}").alias(f"below{m}") for m in MODELS])
            rows = rows.withColumn("suffix", F.substring("gram", 2, order - 1)).join(suffixes, "suffix")
            below = lambda m: F.col(f"below{m}")
        made = rows.select("gram", *[(own(m) + mass(m) * below(m)).alias(f"p{m}") for m in MODELS])
        masses = contexts.select(F.col("context").alias("gram"), *[mass(m).alias(f"mass{m}") for m in MODELS])
        # Contexts of this order are grams of the order below; those that are only a text's beginning have no probability.
        tables[order - 1] = masses if lower is None else lower.join(masses, "gram", "full")
        lower = stage(made, "probabilities", CODEC) if order < ORDER else made
    tables[ORDER] = lower
    return tables


def scored_grams(grams: DataFrame, model: dict[int, DataFrame], m: int, order: int = ORDER) -> DataFrame:
    """(gram, p) of distinct grams of one order under model ``m``, known to it or not."""
    known = model[order].filter(F.col(f"p{m}").isNotNull()).select("gram", F.col(f"p{m}").alias("p"))
    found = stage(grams.join(known, "gram", "left"), "found", CODEC)
    rest = found.filter("p IS NULL").select("gram", F.substring("gram", 1, order - 1).alias("context"))
    contexts = model[order - 1].select(F.col("gram").alias("context"), F.col(f"mass{m}").alias("mass"))
    rest = rest.join(contexts, "context", "left")
    mass = F.coalesce("mass", F.lit(1.0))
    if order == 1:
        lower = rest.select("gram", (mass * UNSEEN).alias("p"))
    else:
        rest = rest.withColumn("suffix", F.substring("gram", 2, order - 1))
        below = scored_grams(found.filter("p IS NULL").select(F.substring("gram", 2, order - 1).alias("gram")).distinct(), model, m, order - 1)
        lower = rest.join(below.select(F.col("gram").alias("suffix"), F.col("p").alias("below")), "suffix").select("gram", (mass * F.col("below")).alias("p"))
    return found.filter("p IS NOT NULL").unionByName(lower)


def _grams(batches):
    """(part, gram): distinct grams of a partition of the documents."""
    part, held = TaskContext.get().partitionId(), Distinct()
    # Grams seen lately, by slot: most of a text's grams need no further look. What is forgotten only comes again.
    lately = np.zeros(1 << SLOT_BITS, np.uint64)

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(held.hashes), part, np.int32)), held.strings()], names=["part", "gram"])

    for batch in batches:
        for _, points, bounds in text_slices(batch, "text"):
            chars, starts = chars_of(points, bounds)
            hashes, places = gram_places(chars, starts)
            slot = (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
            new = np.flatnonzero(lately[slot] != hashes)
            lately[slot[new]] = hashes[new]
            held.merge(chars, hashes[new], places[new])
        if len(held.hashes) > HELD_GRAMS:
            yield rows()
            held = Distinct()
            lately[:] = 0
    yield rows()


def _texts(batches):
    """(part, kind 1, a block of its documents, compressed)."""
    part = TaskContext.get().partitionId()
    for batch in batches:
        for rows, _, _ in text_slices(batch, "text"):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as writer:
                writer.write_batch(rows)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([1], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["part", "kind", "block"])


def _planes(values: np.ndarray) -> bytes:
    """The bytes of numbers, by their place in the number: like ones lie together."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _numbers(data: bytes, kind: type, n: int, at: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T).view(kind).ravel()


def packed_block(hashes: np.ndarray, logs: np.ndarray) -> bytes:
    """Hashes (as differences of the sorted ones) and log probabilities, compressed."""
    order = np.argsort(hashes)
    data = _planes(np.diff(hashes[order], prepend=np.uint64(0))) + _planes(logs[order])
    return len(hashes).to_bytes(4, "little") + pa.Codec("zstd", compression_level=3).compress(data, asbytes=True)


def unpacked_block(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(block[:4], "little")
    data = pa.Codec("zstd").decompress(block[4:], 12 * n, asbytes=True)
    return np.cumsum(_numbers(data, np.uint64, n, 0), dtype=np.uint64), _numbers(data, np.float32, n, 8 * n)


def _packed(batches):
    """Rows (part, gram, p) as blocks (part, kind 0, hashes and log probabilities)."""
    held, rows = [], 0

    def blocks():
        part, hashes, logs = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(part, kind="stable")
        parts, first = np.unique(part[order], return_index=True)
        for number, at in zip(parts.tolist(), np.split(order, first[1:]), strict=True):
            block = packed_block(hashes[at], logs[at])
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([0], pa.int32()), pa.array([block], pa.binary())], names=["part", "kind", "block"])

    for batch in batches:
        if batch.num_rows:
            points = np.frombuffer("".join(batch.column(1).to_pylist()).encode("utf-32-le"), np.uint32)
            hashes = hash_of(list(points.reshape(-1, ORDER).T))
            held.append((batch.column(0).to_numpy(), hashes, np.log(batch.column(2).to_numpy()).astype(np.float32)))
            rows += batch.num_rows
        if rows > PACKED_ROWS:
            yield from blocks()
            held, rows = [], 0
    if rows:
        yield from blocks()


MOVED = "the partitions of the documents differ between two reads of their plan: stage them before they are scored"
SCORES = "doc_id long, perplexity double, lang string"


def _looked_up(batches):
    """Blocks by part: scores of its grams (kind 0), which are held, then its documents (kind 1)."""
    part, held, known = None, [], None
    for batch in batches:
        for number, kind, block in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            if number != part:
                part, held, known = number, [], None
            if kind == 0:
                held.append(unpacked_block(block))
                continue
            if known is None and not held:
                raise RuntimeError(MOVED)
            if known is None:
                known, held = Lookup(*(np.concatenate(x) for x in zip(*held, strict=True))), []
            for rows in pa.ipc.open_stream(block):
                for docs, points, bounds in text_slices(rows, "text"):
                    yield _scores(docs, points, bounds, known)


class Lookup:
    """Log probabilities by hash: sorted hashes, and where those of each slot (their first bits) begin."""

    def __init__(self, hashes: np.ndarray, logs: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.logs = np.append(hashes[order], np.uint64(0)), np.append(logs[order], np.float32(0))
        slots = np.arange((1 << SLOT_BITS), dtype=np.uint64) << np.uint64(64 - SLOT_BITS)
        self.first = np.searchsorted(self.hashes[:-1], slots).astype(np.int32)

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        at = self.first[(wanted >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
        rest = np.flatnonzero(self.hashes[at] < wanted)
        last = len(self.hashes) - 1
        while len(rest):
            at[rest] += 1
            rest = rest[(at[rest] < last) & (self.hashes[at[rest]] < wanted[rest])]
        at = np.minimum(at, last)
        if not (self.hashes[at] == wanted).all():
            raise RuntimeError(MOVED)
        return self.logs[at]


def _scores(docs: pa.RecordBatch, points: np.ndarray, bounds: np.ndarray, known: Lookup) -> pa.RecordBatch:
    chars, starts = chars_of(points, bounds)
    wanted, _ = gram_places(chars, starts)
    n = np.diff(bounds)
    total = np.concatenate([[0.0], np.cumsum(known(wanted), dtype=np.float64)])
    ends = np.cumsum(n + 1)
    mean = -(total[ends] - total[ends - n - 1]) / (n + 1)
    value = pa.array(np.exp(np.minimum(mean, 700.0)), mask=n == 0)
    return pa.RecordBatch.from_arrays([docs.column(0), value, docs.column(2)], names=["doc_id", "perplexity", "lang"])


def _gram_scores(docs: DataFrame, model: dict[int, DataFrame], m: int) -> DataFrame:
    found = stage(docs.mapInArrow(_grams, "part int, gram string"), "part-grams", CODEC)
    scores = scored_grams(found.select("gram").distinct(), model, m)
    return found.join(scores, "gram").select("part", "gram", "p").mapInArrow(_packed, "part int, kind int, block binary")


def gram_scores(docs: DataFrame, model: dict[int, DataFrame], m: int) -> DataFrame:
    """(part, kind 0, block): the scores of all grams of each partition; what was staged on the way is deleted."""
    spark, scope = docs.sparkSession, f"grams-{uuid.uuid4().hex}"
    with staging_scope(spark, scope):
        blocks = _gram_scores(docs, model, m)
    blocks = stage(blocks, "gram-scores", CODEC)
    drop_staged(spark, scope)
    release_shuffles(spark)
    return blocks


def perplexities(docs: DataFrame, model: dict[int, DataFrame], m: int = 0) -> DataFrame:
    """(doc_id, perplexity, lang) per row of ``docs``, under model ``m`` of the tables. The plan of ``docs`` has to give the same partitions when it
    is read again, as scans of files do."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    blocks = gram_scores(docs, model, m)
    texts = docs.mapInArrow(_texts, "part int, kind int, block binary")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The texts come first, so that their partitions have the numbers that they have alone.
    return texts.union(blocks).repartitionById(n, F.col("part")).sortWithinPartitions("part", "kind").mapInArrow(_looked_up, SCORES)


def finished(docs: DataFrame, model: dict[int, DataFrame], m: int, name: str) -> DataFrame:
    """``perplexities``, staged; what was staged on the way is deleted."""
    spark, scope = docs.sparkSession, f"scores-{uuid.uuid4().hex}"
    with staging_scope(spark, scope):
        rows = perplexities(docs, model, m)
    out = stage(rows, name)
    drop_staged(spark, scope)
    release_shuffles(spark)
    return out


def quality(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, margin: float = 1.1) -> DataFrame:
    """doc_id, lang, perplexity, threshold and keep, per row of ``docs``; labels with quality 1 and toxic 0 are trusted."""
    spark = docs.sparkSession
    trusted = labels.filter("quality = 1 AND toxic = 0").select("doc_id")
    # As a semi join, the trusted ids reach the scan of the texts as a Bloom filter (of fixed size), so that
    # hardly more than trusted texts is shuffled.
    names = ["spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "spark.sql.optimizer.runtime.bloomFilter.enabled"]
    before = {n: spark.conf.get(n, None) for n in names}
    spark.conf.set(names[0], "0")
    spark.conf.set(names[1], "true")
    try:
        texts = stage(docs.select("doc_id", "text", "lang").join(trusted, "doc_id", "left_semi"), "trusted", CODEC)
    finally:
        for n, value in before.items():
            spark.conf.unset(n) if value is None else spark.conf.set(n, value)
    texts = texts.filter("text <> ''")
    model = train(texts)
    release_shuffles(spark)
    scores = finished(docs, model, 0, "perplexities")
    if texts.count() >= LEAST_TRUSTED:
        marks = reduce(DataFrame.unionAll, [finished(texts.filter(fold_of() == k), model, k + 1, "held-out") for k in range(FOLDS)])
    else:
        marks = finished(texts, model, 0, "held-out")
    limit = F.percentile_approx("perplexity", quantile, 10_000) * margin
    by_lang = marks.groupBy("lang").agg(limit.alias("own"), F.count("*").alias("n")).filter(F.col("n") >= LEAST_TRUSTED)
    overall = F.lit(marks.agg(limit).first()[0]).cast("double")
    keyed = lambda df: df.withColumn("_lang", F.coalesce("lang", F.lit("\0null")))
    threshold = F.coalesce("own", overall)
    return keyed(scores).join(keyed(by_lang).select("_lang", "own"), "_lang", "left").select(
        "doc_id", "lang", "perplexity", threshold.alias("threshold"), F.coalesce(F.col("perplexity") <= threshold, F.lit(False)).alias("keep"))


@query("op10_quality_classifier")
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
