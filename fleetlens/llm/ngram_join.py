"""Near-duplicate documents: a Jaccard self-join of word n-gram sets, as a blocked sparse product.

The document by n-gram incidence matrix is never multiplied as a whole. It is cut into blocks
that can hold a pair at all, and in each block the product accumulates overlap counts and
throws away every pair below the bound that the two sizes give.

1. Sizes fall into classes such that a pair lies in one class or in two neighbours; the class of the
   smaller set is the pair's level. On a level, two linked sets differ in at most D elements, so in at most
   D parts of the hash range. It is cut into some more parts than D, and each set emits, for the two
   levels it can be in, a key per part that holds something (level, part, hash of what lies in it): with more than D
   such parts, a set agrees on one of them wholly with every partner. The few sets with D or fewer also emit the
   prefix that the overlap bound asks for, a key per element; if both sets of a pair do, they meet there. No linked
   pair is lost. An element alone is a weak key: were all prefixes emitted, frequent n-grams would tie most sets of a level
   into one cluster.
2. Sets of a level that share a key form candidate clusters (components of the key graph). Keys that
   repeat in a batch are replaced there by one key of the batch's first holder, so a hot key has a
   row per batch. Equal sets become one row with a count.
3. A cluster is dealt to tiles of bounded size; every pair of tiles is one block, whatever the
   cluster's size. First the blocks hold coarse counts of the elements (a quarter of a byte each):
   sets differ in at least the sum of the count differences, so pairs beyond the bound go, most of them by
   sums of four counts already. What is left forms the clusters of the exact product, which are near-duplicates and little
   else: whole sets travel once for each tile of their cluster, so a cluster tied by chance would cost its square in disk.
4. In a task, n-grams of a block that few rows hold are expanded into pair counts; the others are
   multiplied as dense strips. Only links that pass the exact test leave the task, as a spanning
   forest with a link count per row.

Edge cases: null, empty or blank text has an empty set and no link; with fewer words than ``words``
the whole sequence is the one element; equal texts are linked; rows with a null doc_id get a null
component; rows that repeat a doc_id are one node with the links of all; an empty table gives an
empty result; other columns of the input are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.codes import gram_hash, mix, runs, span_hash, text_slices
from fleetlens.llm.components import components
from fleetlens.llm.registry import query, table
from fleetlens.session import release_shuffles, stage

TILE_ROWS, TILE_ELEMENTS, DENSE = 1024, 2_000_000, 24
#: Coarse counts take a thirtieth of the room of sets, so their tiles hold more rows and each row goes to fewer blocks.
COARSE_ROWS = 16384
#: So many neighbouring counts are summed for the first comparison.
SUMMED = 4
SKETCH = "doc_id long, n_shingles long, class int, h1 long, h2 long, own_counts binary, low_counts binary"
KEYS = "doc_id long, level int, keys array<long>"


@lru_cache(maxsize=None)
def size_bounds(pct: int) -> np.ndarray:
    """First size of each class: a partner of a set of class c has class c - 1, c or c + 1."""
    out = [1]
    while out[-1] < 2**40:
        out.append(out[-1] * 100 // pct + 1)
    return np.array(out)


def word_sets(batch: pa.RecordBatch, words: int):
    """(rows, their shingle sets as sorted unique hashes) for slices of the batch."""
    for part, points, bounds in text_slices(batch, "text"):
        blank = (points == 32) | ((points >= 9) & (points <= 13))
        low = points + np.where((points >= 65) & (points <= 90), np.uint32(32), np.uint32(0))
        starts, ends = runs(~blank, bounds)
        hashes = span_hash(low, starts, ends)
        grams = gram_hash(hashes, words)
        first = np.searchsorted(starts, bounds)
        sets = []
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= words:
                sets.append(np.unique(grams[a : b - words + 1]))
            else:
                sets.append(gram_hash(hashes[a:b], int(b - a)) if b > a else np.empty(0, np.uint64))
        yield part, sets


def part_keys(u: np.ndarray, level: int, pct: int) -> np.ndarray:
    """The keys of one set on a level."""
    n = len(u)
    inner = np.concatenate([[np.uint64(0)], np.cumsum(mix(u + np.uint64(7)))])
    most = int(size_bounds(pct)[level + 1] - 1) * (100 - pct) // pct
    parts = most + 1 + (most + 7) // 8
    counts = np.bincount((((u >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64), minlength=parts)
    ends = np.cumsum(counts)
    held = np.flatnonzero(counts)
    salt = np.uint64(level) << np.uint64(40)
    keys = mix((inner[ends[held]] - inner[ends[held] - counts[held]]) ^ mix(held.astype(np.uint64) + salt))
    if len(held) <= most:
        prefix = u[: n - -(-n * pct // 100) + 1]
        keys = np.append(keys, mix(prefix ^ mix(np.array([salt + np.uint64(1 << 39)]))))
    return keys


def coarse_counts(u: np.ndarray, level: int, pct: int) -> bytes:
    """How many elements lie in each of some fixed buckets of the level."""
    buckets = (int(size_bounds(pct)[level + 1]) // 16 + 4) * SUMMED
    counts = np.bincount((((u & np.uint64(0xFFFFFFFF)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64), minlength=buckets)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def local_stars(nodes: np.ndarray, keys: list[np.ndarray], level: np.ndarray) -> list[np.ndarray]:
    """Keys that rows of one batch share are kept by the first holder; the others point at it."""
    lengths = [len(k) for k in keys]
    flat = np.concatenate([*keys, np.empty(0, np.uint64)])
    owner = np.repeat(np.arange(len(keys)), lengths)
    _, at, back = np.unique(flat, return_index=True, return_inverse=True)
    holder = owner[at][back]
    star = mix(nodes.astype(np.int64).view(np.uint64) ^ mix(level.astype(np.uint64) + np.uint64(0x5BD1E995)))
    flat = np.where(holder == owner, flat, star[holder])
    ends = np.cumsum(lengths)
    # A holder carries its own star key as well, so that the others meet it.
    wanted = set(holder[holder != owner].tolist())
    out = []
    for i, (a, b) in enumerate(zip(ends - lengths, ends, strict=True)):
        own = np.unique(flat[a:b])
        out.append(np.append(own, star[i]) if i in wanted else own)
    return out


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(k) for k in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, np.empty(0, np.uint64)]).view(np.int64)))


def _classes(sets: list[np.ndarray], pct: int) -> np.ndarray:
    return np.array([int(np.searchsorted(size_bounds(pct), len(u), "right")) - 1 for u in sets], np.int32)


def _sketch(batches, words: int, pct: int):
    for batch in batches:
        for part, sets in word_sets(batch, words):
            own = _classes(sets, pct)
            counts = [
                pa.array([coarse_counts(u, c, pct) if len(u) and c >= 0 else None for u, c in zip(sets, level.tolist(), strict=True)], pa.binary()) for level in (own, own - 1)
            ]
            sums = np.array([(mix(u).sum(dtype=np.uint64), mix(u + np.uint64(3)).sum(dtype=np.uint64)) for u in sets], np.uint64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(u) for u in sets], pa.int64()), pa.array(own), pa.array(sums[:, 0].view(np.int64)), pa.array(sums[:, 1].view(np.int64)), *counts],
                names=["doc_id", "n_shingles", "class", "h1", "h2", "own_counts", "low_counts"],
            )


def _level_keys(batches, words: int, pct: int):
    """The candidate keys of every set with elements, a row for each of its two levels."""
    for batch in batches:
        for part, sets in word_sets(batch, words):
            at = np.flatnonzero([len(u) > 0 for u in sets])
            sets = [sets[i] for i in at]
            nodes, own = part.column(0).take(pa.array(at)), _classes(sets, pct)
            for level in (own, own - 1):
                live = np.flatnonzero(level >= 0)
                keys = [part_keys(sets[i], int(level[i]), pct) for i in live]
                ids = nodes.take(pa.array(live))
                yield pa.RecordBatch.from_arrays([ids, pa.array(level[live]), _lists(local_stars(ids.to_numpy(), keys, level[live]))], names=["doc_id", "level", "keys"])


def _stars(batches):
    """Rows sorted by key: an edge from the first node of a key to each other one."""
    key, first = None, None
    for batch in batches:
        keys, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(keys):
            continue
        new = np.concatenate([[keys[0] != key or key is None], keys[1:] != keys[:-1]])
        at = np.maximum.accumulate(np.where(new, np.arange(len(keys)), -1))
        head = np.where(at < 0, first if first is not None else 0, nodes[at])
        key, first = keys[-1], head[-1]
        pairs = np.unique(np.stack([head, nodes], 1)[head != nodes], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _packed(batches, words: int):
    """The set of every row as bytes, beside the columns of its tile."""
    for batch in batches:
        for part, sets in word_sets(batch, words):
            held = pa.array([u.tobytes() for u in sets], pa.binary())
            names = [c for c in part.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in names] + [held], names=[*names, "elements"])


def overlaps(block: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """The product of incidence and its transpose, for rows of the same block (others share nothing)."""
    n = len(sets)
    sizes = [len(s) for s in sets]
    column = mix(np.concatenate(sets) ^ mix(np.repeat(block, sizes).astype(np.uint64)))
    row = np.repeat(np.arange(n), sizes)
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    starts = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]])) if len(column) else np.empty(0, np.int64)
    held = np.diff(np.append(starts, len(column)))
    codes = []
    for r in range(2, DENSE + 1):
        rows = row[starts[held == r][:, None] + np.arange(r)]
        if len(rows):
            i, j = np.triu_indices(r, 1)
            codes.append((rows[:, i] * n + rows[:, j]).ravel())
    out = np.bincount(np.concatenate([*codes, np.empty(0, np.int64)]), minlength=n * n).reshape(n, n).astype(np.int32)
    wide = np.flatnonzero(held > DENSE)
    for k in range(0, len(wide), 2048):
        some = wide[k : k + 2048]
        strip = np.zeros((n, len(some)), np.float32)
        where = np.repeat(np.arange(len(some)), held[some])
        inside = np.arange(len(where)) - np.repeat(np.cumsum(held[some]) - held[some], held[some])
        strip[row[np.repeat(starts[some], held[some]) + inside], where] = 1
        # A strip's own counts are exact in single precision; their sum is kept in whole numbers.
        out += np.triu(strip @ strip.T, 1).astype(np.int32)
    return out


def _roots(node: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest node that each row reaches by the pairs (i, j)."""
    root = node.copy()
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        if (before == root).all():
            break
    return root


def _links(rows: list, pct: int):
    """Spanning forest and link counts of whole blocks."""
    numbers = {k: i for i, k in enumerate(dict.fromkeys(r[0] for r in rows))}
    block = np.array([numbers[r[0]] for r in rows])
    side, node, copies = (np.array([r[i] for r in rows], np.int64) for i in (1, 2, 3))
    sets = [np.frombuffer(r[4], np.uint64) for r in rows]
    size = np.array([len(s) for s in sets], np.int64)
    both = overlaps(block, sets)
    # 100 o >= pct (a + b - o), in 64 bits, and in a block of two tiles only pairs of one row from each.
    i, j = np.nonzero(both)
    paired = np.array([r[5] for r in rows])
    good = (both[i, j].astype(np.int64) * (100 + pct) >= pct * (size[i] + size[j])) & (~paired[i] | (side[i] != side[j]))
    i, j = i[good], j[good]
    count = np.zeros(len(rows), np.int64)
    np.add.at(count, i, copies[j])
    np.add.at(count, j, copies[i])
    root, at = _roots(node, i, j), np.flatnonzero(count)
    return pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(root[at]), pa.array(count[at])], names=["a", "b", "n_links"])


def _close(rows: list, pct: int):
    """Spanning forest of the pairs of one block whose coarse counts do not rule a link out."""
    side, node, size = (np.array([r[i] for r in rows], np.int64) for i in (1, 2, 3))
    counts = np.stack([np.frombuffer(r[4], np.uint8) for r in rows]).astype(np.int16)
    sums = counts.reshape(len(rows), -1, SUMMED).sum(2, dtype=np.int16)
    paired = rows[0][5]
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i in range(len(rows)):
        others = np.flatnonzero(side > side[i]) if paired else np.arange(i + 1, len(rows))
        for held in (sums, counts):
            apart = np.abs(held[others] - held[i]).sum(1, dtype=np.int64)
            others = others[apart * (100 + pct) <= (100 - pct) * (size[others] + size[i])]
        left.append(np.full(len(others), i))
        right.append(others)
    i, j = np.concatenate(left), np.concatenate(right)
    root = _roots(node, i, j)
    at = np.flatnonzero(root != node)
    return pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(root[at]), pa.array(np.zeros(len(at), np.int64))], names=["a", "b", "n_links"])


def _product(batches, pct: int, coarse: bool):
    """Rows sorted by block: blocks of coarse counts one by one; small blocks of whole sets together."""
    rows: list = []
    current: list = []
    elements = 0
    for batch in batches:
        for r in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            if current and r[0] != current[0][0]:
                if coarse:
                    yield _close(current, pct)
                else:
                    rows = rows + current
                current = []
                if len(rows) >= TILE_ROWS or elements >= 2 * TILE_ELEMENTS:
                    yield _links(rows, pct)
                    rows, elements = [], 0
            current.append(r)
            elements += len(r[4]) // 8
    if rows or current:
        yield _close(current, pct) if coarse else _links(rows + current, pct)


def tiles(rows: DataFrame, tile_rows: int) -> DataFrame:
    """Deals rows (cluster, level, upper, node, elements, ...) to blocks: column ``blocks`` of (block, side, paired).

    Rows with ``upper`` = 0 meet each other and those with 1; the latter do not meet each other. A
    tile has some ``tile_rows`` rows and ``TILE_ELEMENTS`` elements; rows alone in their level go.
    """
    many = lambda upper: F.greatest(
        F.ceil(F.sum((F.col("upper") == upper).cast("long")) / tile_rows), F.ceil(F.sum(F.when(F.col("upper") == upper, F.col("elements")).otherwise(0)) / TILE_ELEMENTS)).cast("int")
    sizes = rows.groupBy("cluster", "level").agg(many(0).alias("_t0"), many(1).alias("_t1"), F.count("*").alias("_all")).filter("_all > 1 AND _t0 > 0")
    # As a table of its own, so that a large cluster's rows can be split in the join.
    sizes = stage(sizes, "tiles")
    placed = rows.join(sizes, ["cluster", "level"]).withColumn("_tile", F.pmod(F.xxhash64("node"), F.when(F.col("upper") == 0, F.col("_t0")).otherwise(F.col("_t1"))).cast("int"))
    tile = F.col("_tile")

    def block(kind, low, high, side, paired):
        return F.struct(F.xxhash64("cluster", "level", F.lit(kind), low, high).alias("block"), side.alias("side"), F.lit(paired).alias("paired"))

    def each(count, fn):
        return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), fn)).otherwise(F.array())

    own = each(F.col("_t0"), lambda t: F.when(t == tile, block(0, tile, tile, F.lit(0), False)).otherwise(block(0, F.least(t, tile), F.greatest(t, tile), (t < tile).cast("int"), True)))
    up = each(F.col("_t1"), lambda t: block(1, tile, t, F.lit(0), True))
    down = each(F.col("_t0"), lambda t: block(1, t, tile, F.lit(1), True))
    return placed.withColumn("blocks", F.when(F.col("upper") == 0, F.concat(own, up)).otherwise(down)).drop("_t0", "_t1", "_all", "_tile")


def by_block(dealt: DataFrame, weight: str, payload: str, pct: int, coarse: bool) -> DataFrame:
    """The product of every block: (a, b, n_links)."""
    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    flat = dealt.select(F.explode("blocks").alias("_b"), "node", weight, payload).select("_b.block", "_b.side", "node", weight, payload, "_b.paired")
    return flat.repartition(n, "block").sortWithinPartitions("block").mapInArrow(lambda it: _product(it, pct, coarse), "a long, b long, n_links long")


def sketches(docs: DataFrame, words: int, pct: int) -> DataFrame:
    """Per document: size and 128-bit hash of its set, and coarse counts for its two levels."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: _sketch(it, words, pct), SKETCH)


def level_keys(docs: DataFrame, words: int, pct: int) -> DataFrame:
    """(key, node) of every named document. There are hundreds a document, so they go to the shuffle without being staged."""
    named = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    found = named.mapInArrow(lambda it: _level_keys(it, words, pct), KEYS)
    return found.select(F.explode("keys").alias("key"), F.xxhash64("doc_id", "level").alias("node"))


def ngram_join(docs: DataFrame, words: int = 5, pct: int = 80) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest linked doc_id, over links of
    links; its own without any), n_links (other documents it is linked with itself).

    Two documents are linked when 100 * intersection >= ``pct`` * union of their ``words``-word sets.
    """
    known = stage(sketches(docs, words, pct), "sketches")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    levels = [("own", 0), ("low", 1)]
    node = lambda below: F.xxhash64("doc_id", F.col("class") - below)
    sorted_keys = level_keys(docs, words, pct).repartition(n, "key").sortWithinPartitions("key", "node")
    clusters = components(sorted_keys.mapInArrow(_stars, "a long, b long").distinct())
    # The keys are the largest shuffle; they are not to lie beside that of the texts.
    release_shuffles(docs.sparkSession)

    # A row per set and level, for sets that share a key with another one there.
    slim = known.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    at_level = [
        slim.select("doc_id", "h1", "h2", "n_shingles", "class", (F.col("class") - below).alias("level"), F.lit(below).alias("upper"), node(below).alias("key_node"), F.col(f"{which}_counts").alias("counts"))
        for which, below in levels
    ]
    met = at_level[0].union(at_level[1]).join(clusters.select(F.col("node").alias("key_node"), F.col("root").alias("cluster")), "key_node")
    one = [F.min("doc_id").alias("node"), F.first("class").alias("class")]
    rows = met.groupBy("h1", "h2", "n_shingles", "level", "upper").agg(*one, F.min("cluster").alias("cluster"), F.first("counts").alias("counts"))
    rows = stage(rows.withColumn("elements", F.octet_length("counts").cast("long")), "level-sets")
    near = by_block(tiles(rows, COARSE_ROWS), "n_shingles", "counts", pct, True)
    refined = components(near.select("a", "b"))

    sets = slim.groupBy("h1", "h2", "n_shingles").agg(*one, F.countDistinct("doc_id").alias("copies"))
    classes = stage(sets, "sets")
    exact = classes.join(refined.select("node", F.col("root").alias("cluster")), "node")
    both = exact.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("upper")).withColumns({"level": F.col("class") - F.col("upper"), "elements": F.col("n_shingles")})
    placed = tiles(both, TILE_ROWS).groupBy("node", "copies").agg(F.flatten(F.collect_list("blocks")).alias("blocks"))
    texts = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("node"), "text").join(placed, "node")
    packed = texts.select("node", "copies", "blocks", "text").mapInArrow(
        lambda it: _packed(it, words), "node long, copies long, blocks array<struct<block:long,side:int,paired:boolean>>, elements binary")
    linked = stage(by_block(packed, "copies", "elements", pct, False), "links")
    members = slim.select("doc_id", "h1", "h2", "n_shingles")

    equal = members.join(classes.filter("copies > 1").select("h1", "h2", "n_shingles", "node", "copies"), ["h1", "h2", "n_shingles"])
    roots = components(linked.select("a", "b").union(equal.select(F.col("doc_id").alias("a"), F.col("node").alias("b"))))
    others = linked.groupBy("a").agg(F.sum("n_links").alias("others"))
    counts = members.join(classes.select("h1", "h2", "n_shingles", "node", "copies"), ["h1", "h2", "n_shingles"]).join(others, F.col("a") == F.col("node"), "left")
    counts = counts.groupBy("doc_id").agg(F.sum(F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = known.select("doc_id", "n_shingles").join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").join(counts, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


@query("op4_ngram_jaccard_join")
def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"), words=4, pct=85)
