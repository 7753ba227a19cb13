"""Benchmark passages in documents, by windows over template-canonical words.

Numbers, units that follow a number, and names (a capital inside a sentence) become typed
placeholders; other words are lower-cased. Windows of the canonical words are hashed and
hash-joined, so a question with other numbers or names has the windows of the original. Along
one alignment of an item with a document the values must correspond: a value of the item stands for
the value that most of its places have in the document, and windows in which it stands for another one are left out. Where
no value has most of the places, the item's equal values are taken as a coincidence, and each place
stands for itself. If the whole item is there word for word, nothing is left out.

Windows of the plain lower-cased words are joined beside these. They need no literals and show no placeholders, so copies
in upper or lower case, and copies of arithmetic and of lists, are found by them.

Before the join, windows are tested against a bitmap of the benchmark's windows (2**23 bits,
whatever the benchmark's size); it lets all true ones through, and the join is exact.

Alignments whose shifts differ by at most a window (words put in or left out between them) make a chain, with one
correspondence of values over all of it: the larger alignments come first, one that breaks it is left out. An
item is found in a document if one chain holds ``min_words`` of its words in windows, or the share
``min_share`` of its windows; what lies elsewhere in the document does not add to it. Items of under four words are not searched.

Edge cases: null or empty texts have no windows, on either side; a canonical window needs half of its words
as literals, so tables of other numbers match nothing; repeated rows and items give their own pairs,
once per (doc_id, item_id); an empty table on either side gives an empty result; null ids are
kept as null; other columns are not read.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.llm.codes import doc_of, gram_hash, mix, runs, span_hash, text_slices
from fleetlens.llm.registry import query, table

WINDOW, LEAST = 8, 4
BITMAP = 23
# Units of measurement that are placeholders after a number.
UNITS = (
    "mm cm m km in inch inches ft feet foot yd yard yards mi mile miles mg g kg lb lbs oz ton tons ml l litre litres liter liters gallon gallons "
    "s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "usd eur gbp dollar dollars euro euros cent cents pound pounds percent degree degrees w kw kwh v a hz khz mhz ghz b kb mb gb tb"
).split()
NUMBER, NAME, UNIT = (np.uint64(x) for x in (11, 13, 17))
HIT = "id long, place int, hash long, plain boolean, slots array<long>, at array<int>"
PLAIN = np.uint64(1 << 32)


@lru_cache(maxsize=None)
def _tables():
    kinds = [unicodedata.category(chr(c)) for c in range(sys.maxunicode + 1)]
    low = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in range(sys.maxunicode + 1)], np.uint32)
    stops = np.zeros(sys.maxunicode + 1, bool)
    stops[[ord(c) for c in ".!?:;…\"“”„«»()[]*#-–—"]] = True
    return np.array([k[0] in "LM" for k in kinds]), np.array([k[0] == "N" for k in kinds]), np.array([k == "Lu" for k in kinds]), low, stops


@lru_cache(maxsize=None)
def _units() -> np.ndarray:
    points = np.frombuffer("".join(UNITS).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(u) for u in UNITS])
    return span_hash(points, ends - [len(u) for u in UNITS], ends)


def canonical(points: np.ndarray, bounds: np.ndarray):
    """(canonical hash, value hash, is a literal, text) of every word, in order."""
    letter, digit, upper, low, stops = _tables()
    blank = (points == 32) | ((points >= 9) & (points <= 13))
    starts, ends = runs(letter[points] | digit[points], bounds)
    text = doc_of(starts, bounds)
    many = lambda flag: np.concatenate([[0], np.cumsum(flag[points])])
    digits, capitals = many(digit), many(upper)
    number = digits[ends] > digits[starts]
    # 3.5, 1,000 and 12:30 are one number: later parts join the first.
    if len(starts):
        gap = np.concatenate([[False], (starts[1:] - ends[:-1] == 1) & number[1:] & number[:-1] & np.isin(points[np.minimum(ends[:-1], len(points) - 1)], [ord(c) for c in ".,:/-"])])
        head = np.flatnonzero(~gap)
        starts, text, number = starts[head], text[head], number[head]
        ends = ends[np.append(head[1:] - 1, len(ends) - 1)]
    value = span_hash(low[points], starts, ends)
    solid = np.maximum.accumulate(np.where(blank, -1, np.arange(len(points)))) if len(points) else np.empty(0, np.int64)
    before = np.where(starts > 0, solid[np.maximum(starts - 1, 0)], -1) if len(starts) else starts
    opens = (before < bounds[text]) | stops[points[np.maximum(before, 0)]] if len(starts) else np.empty(0, bool)
    name = ~number & ~opens & upper[points[starts]] & (capitals[ends] - capitals[starts] == 1) & (ends - starts > 1)
    unit = np.zeros(len(starts), bool)
    if len(starts) > 1:
        unit[1:] = number[:-1] & ~number[1:] & (text[1:] == text[:-1]) & np.isin(value[1:], _units())
    hashes = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, value)))
    return hashes, value, ~(number | unit | name), text


def _windows(batches, sizes: list[int], bitmap):
    """Windows of every text; with a bitmap only those that may be a benchmark's."""
    bits = None if bitmap is None else np.frombuffer(bitmap.value, np.uint8)
    for batch in batches:
        for part, points, bounds in text_slices(batch, "text"):
            hashes, value, literal, text = canonical(points, bounds)
            first = np.searchsorted(text, np.arange(len(bounds) - 1))
            count = np.bincount(text, minlength=len(bounds) - 1)
            literals = np.concatenate([[0], np.cumsum(literal)])
            slots = np.flatnonzero(~literal)
            found = []
            for size, plain in [(size, plain) for size in sizes or [None] for plain in (False, True)]:
                for n in range(LEAST, WINDOW + 1) if size is None else [size]:
                    grams = mix(gram_hash(value if plain else hashes, n) + np.uint64(n) + plain * PLAIN)
                    at = np.arange(len(grams))
                    ok = text[at] == text[at + n - 1]
                    if not plain:
                        ok &= 2 * (literals[at + n] - literals[at]) >= n
                    if size is None:
                        # An item has windows of one size: the full one, or its length if it is shorter.
                        ok &= np.minimum(count[text[at]], WINDOW) == n
                    if bits is not None:
                        slot = (grams >> np.uint64(64 - BITMAP)).astype(np.int64)
                        ok &= (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0
                    at = at[ok]
                    found.append((at, grams[ok], np.full(len(at), n), np.full(len(at), plain)))
            at, grams, size, plain = (np.concatenate(x) for x in zip(*found, strict=True))
            a, b = np.searchsorted(slots, at), np.where(plain, np.searchsorted(slots, at), np.searchsorted(slots, at + size))
            inside = [slots[i:j] for i, j in zip(a, b, strict=True)]
            inside = np.concatenate([*inside, np.empty(0, np.int64)]).astype(np.int64)
            offsets = pa.array(np.concatenate([[0], np.cumsum(b - a)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(text[at])), pa.array((at - first[text[at]]).astype(np.int32)), pa.array(grams.view(np.int64)), pa.array(plain),
                 pa.ListArray.from_arrays(offsets, pa.array(value[inside].view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array((inside - first[text[inside]]).astype(np.int32)))],
                names=["id", "place", "hash", "plain", "slots", "at"],
            )


def find_items(docs: DataFrame, benchmark: DataFrame, min_words: int = 13, min_share: float = 0.5) -> DataFrame:
    """(doc_id, item_id, words, share, changed): items found, how many of their words and windows, and how
    many of their values the document has replaced."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(lambda it: _windows(it, [], None), HIT)
    items = items.select(F.col("id").alias("item_id"), F.col("place").alias("item_place"), "hash", "plain", F.col("slots").alias("item_slots"), "at").distinct()
    counts = items.groupBy(F.coalesce("item_id", F.lit(-(2**63))).alias("item_key")).agg(
        F.countDistinct(F.when(~F.col("plain"), F.col("item_place"))).alias("windows"), F.countDistinct("item_place").alias("every"))
    # At most 2**23 numbers, and at most five sizes.
    bits = np.zeros(1 << (BITMAP - 3), np.uint8)
    used = items.select(F.shiftrightunsigned("hash", 64 - BITMAP).cast("int").alias("slot")).distinct().toPandas()["slot"].to_numpy()
    np.bitwise_or.at(bits, used >> 3, (1 << (used & 7)).astype(np.uint8))
    lengths = benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(_lengths, "size int").distinct()
    sizes = sorted(r["size"] for r in lengths.collect())
    bitmap = spark.sparkContext.broadcast(bits.tobytes())
    hits = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: _windows(it, sizes, bitmap) if sizes else iter(()), HIT)
    met = hits.drop("at").withColumnRenamed("id", "doc_id").join(items, ["hash", "plain"])
    met = met.withColumn("shift", F.col("place") - F.col("item_place"))
    values = F.arrays_zip(F.col("item_slots").alias("was"), F.col("slots").alias("now"), F.col("at").alias("at"))
    plain = F.col("plain")
    along = met.groupBy("doc_id", "item_id", "shift").agg(
        F.collect_set(F.when(plain, F.col("item_place"))).alias("same"), F.collect_set(F.when(~plain, F.struct(F.col("item_place").alias("place"), values.alias("values")))).alias("found"))
    along = along.withColumn("item_key", F.coalesce("item_id", F.lit(-(2**63)))).join(counts, "item_key")
    # Every place of a value has one vote.
    votes = along.withColumn("votes", F.array_distinct(F.flatten(F.transform("found", lambda w: w["values"]))))
    votes = votes.withColumn("kinds", F.array_distinct(F.transform("votes", lambda v: F.struct(v["was"].alias("was"), v["now"].alias("now")))))
    votes = votes.withColumn("kinds", F.transform("kinds", lambda k: F.struct(k["was"].alias("was"), k["now"].alias("now"), F.size(F.filter("votes", lambda v: (v["was"] == k["was"]) & (v["now"] == k["now"]))).alias("n"))))
    rivals = lambda k, test: F.size(F.filter("kinds", lambda o: (o["was"] == k["was"]) & (o["now"] != k["now"]) & test(o["n"], k["n"])))
    ranked = votes.withColumn("kinds", F.transform("kinds", lambda k: F.struct(k["was"].alias("was"), k["now"].alias("now"), k["n"].alias("n"), (rivals(k, lambda o, n: o > n) == 0).alias("top"), (rivals(k, lambda o, n: o == n) > 0).alias("tied"))))
    free = lambda k: F.exists("kinds", lambda o: (o["was"] == k["was"]) & o["top"] & o["tied"])
    pair = lambda k: F.struct(k["was"].alias("was"), k["now"].alias("now"))
    ranked = ranked.withColumns({
        "bound": F.transform(F.filter("kinds", lambda k: k["top"] & ~k["tied"]), pair), "loose": F.transform(F.filter("kinds", free), pair)})
    agrees = lambda w: F.forall(w["values"], lambda v: F.array_contains("bound", pair(v)) | F.array_contains("loose", pair(v)))
    # An item that is there word for word needs no correspondence, and its values are its own.
    whole = F.size("same") == F.col("every")
    none = F.array().cast("array<struct<was:long,now:long>>")
    good = ranked.select(
        "doc_id", "item_id", "shift", "windows", "every", "same", F.array_distinct(F.transform(F.filter("found", lambda w: whole | agrees(w)), lambda w: w["place"])).alias("places"),
        F.when(whole, none).otherwise(F.col("bound")).alias("pairs"), F.when(whole, none).otherwise(F.filter("loose", lambda k: k["was"] != k["now"])).alias("moved"))
    good = good.filter((F.size("places") > 0) | (F.size("same") > 0))
    # Shifts in order; one that is over a window from the last begins a chain.
    order = Window.partitionBy("doc_id", "item_id").orderBy("shift")
    begins = F.coalesce((F.col("shift") - F.lag("shift").over(order) > WINDOW).cast("int"), F.lit(0))
    chains = good.withColumn("begins", begins).withColumn("chain", F.sum("begins").over(order))
    part = F.struct((-F.size(F.array_union("places", "same"))).alias("order"), "shift", "places", "same", "pairs", "moved")
    chains = chains.groupBy("doc_id", "item_id", "chain").agg(
        F.sort_array(F.collect_list(part)).alias("parts"), F.max("windows").alias("windows"), F.max("every").alias("every"))

    def joined(s, p):
        pairs = F.array_union(s["pairs"], p["pairs"])
        both = F.struct(F.array_union(s["places"], p["places"]).alias("places"), F.array_union(s["same"], p["same"]).alias("same"), pairs.alias("pairs"), F.array_union(s["moved"], p["moved"]).alias("moved"))
        return F.when(_consistent(pairs), both).otherwise(s)

    first = F.get("parts", F.lit(0))
    united = F.aggregate(F.slice("parts", 2, F.size("parts")), F.struct(*[first[c].alias(c) for c in ("places", "same", "pairs", "moved")]), joined)
    chains = chains.withColumn("_u", united).select(
        "doc_id", "item_id", "windows", "every", F.size("_u.places").alias("n"), F.array_union("_u.places", "_u.same").alias("places"),
        F.size(F.array_union(F.filter("_u.pairs", lambda p: p["was"] != p["now"]), "_u.moved")).cast("long").alias("changed"))
    share = F.greatest(F.coalesce(F.try_divide("n", "windows"), F.lit(0.0)), F.size("places") / F.col("every"))
    # Neighbouring windows share all but one word.
    places = F.sort_array("places")
    words = F.aggregate(places, F.struct(F.lit(0).alias("sum"), F.lit(-(10**6)).alias("last")), lambda s, p: F.struct((s["sum"] + F.least(p - s["last"], F.lit(WINDOW))).alias("sum"), p.alias("last")), lambda s: s["sum"]).cast("long")
    out = chains.select("doc_id", "item_id", words.alias("words"), share.alias("share"), "changed")
    out = out.filter((F.col("words") >= min_words) | (F.col("share") >= min_share))
    return out.groupBy("doc_id", "item_id").agg(F.max(F.struct("words", "share", "changed")).alias("best")).select("doc_id", "item_id", "best.*")


def _consistent(pairs) -> Column:
    """Whether each value of the item stands for one value of the document."""
    return F.size(F.array_distinct(F.transform(pairs, lambda p: p["was"]))) == F.size(pairs)


def _lengths(batches):
    for batch in batches:
        for _, points, bounds in text_slices(batch, "text"):
            count = np.bincount(canonical(points, bounds)[3], minlength=len(bounds) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.minimum(count[count >= LEAST], WINDOW)).astype(np.int32))], names=["size"])


def without_items(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents in which an item is found; a row with a null doc_id stays."""
    found = find_items(docs, benchmark, **options).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


@query("op2_benchmark_decontamination")
def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
