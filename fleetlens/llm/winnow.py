"""Document fingerprints by winnowing.

Every ``k`` neighbouring code points are hashed by a rolling hash; of every window of ``w`` hashes the
smallest is chosen, the rightmost one if several are equal, and kept with its position. Two texts
that share ``w + k - 1`` code points in a row therefore share a fingerprint, and no match shorter
than ``k`` is seen. A text of fewer than ``k`` code points is one gram; with fewer than ``w`` grams
the smallest is chosen.

A fingerprint string is the number of chosen hashes, the hashes (32 bits each) and the gaps between their positions as
variable-length numbers, in base64. The likeness of two is twice the number of common hashes over the number
of both (1 for two empty ones).

Edge cases: a null or empty text has the empty fingerprint; equal texts have equal ones; null
doc_ids stand before all others, rows that repeat a doc_id are ordered by text; after the last
document comes the first; a single document is its own successor; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.codes import rolling_hash
from fleetlens.llm.registry import query, table

K, W = 16, 32
BUCKET_ROWS, MOST_BUCKETS = 5000, 4096
OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_prints long"


def winnow(points: np.ndarray, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit hashes, positions) of the chosen grams, by position."""
    n = len(points)
    if not n:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    k = min(k, n)
    grams = rolling_hash(points, k) >> np.uint64(32)
    places = np.arange(len(grams), dtype=np.uint64)
    # Smallest hash first; of equal ones the larger position, whose complement is smaller.
    lowest = (grams << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - places)
    width = 1
    w = min(w, len(grams))
    while width < w:
        step = min(width, w - width)
        lowest = np.minimum(lowest[:-step], lowest[step:])
        width += step
    chosen = lowest[np.concatenate([[True], lowest[1:] != lowest[:-1]])]
    return (chosen >> np.uint64(32)).astype(np.uint32), (np.uint64(0xFFFFFFFF) - (chosen & np.uint64(0xFFFFFFFF))).astype(np.int64)


def packed(hashes: np.ndarray, places: np.ndarray) -> str:
    if not len(hashes):
        return ""
    gaps = np.diff(places, prepend=0)
    out = bytearray(len(hashes).to_bytes(4, "little") + hashes.astype("<u4").tobytes())
    if gaps.max() < 128:
        out += gaps.astype(np.uint8).tobytes()
    else:
        for g in gaps.tolist():
            while g > 127:
                out.append(g & 127 | 128)
                g >>= 7
            out.append(g)
    return base64.b64encode(bytes(out)).decode()


def unpacked(text: str) -> tuple[list[int], list[int]]:
    """Hashes and positions of a fingerprint string."""
    raw = base64.b64decode(text)
    n = int.from_bytes(raw[:4], "little")
    hashes, tail = raw[4 : 4 * n + 4], raw[4 * n + 4 :]
    gaps, g, shift = [], 0, 0
    for b in tail:
        g |= (b & 127) << shift
        shift += 7
        if b < 128:
            gaps.append(g)
            g = shift = 0
    return np.frombuffer(hashes, "<u4").tolist(), np.cumsum(gaps).tolist()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets of hashes."""
    if not len(a) and not len(b):
        return 1.0
    both = np.sort(np.concatenate([a, b]))
    return 2.0 * int((both[1:] == both[:-1]).sum()) / (len(a) + len(b))


class _Text:
    def __init__(self, doc_id, text: str | None):
        self.doc_id, self.text = doc_id, text or ""
        self.points = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.hashes, self.places = winnow(self.points)
        self.found = np.unique(self.hashes)

    def row(self, after: _Text) -> tuple:
        n = len(self.points)
        half = n // 2
        edited = np.concatenate([self.points[: n - half], after.points[:half]])
        hashes, places = winnow(edited)
        sha = hashlib.sha256(edited.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest()
        return (
            self.doc_id, n, sha, packed(self.hashes, self.places), packed(hashes, places),
            likeness(self.found, np.unique(hashes)), likeness(self.found, after.found), len(self.hashes),
        )


def _pairs(batches):
    """Rows by (bucket, guest, doc_id, text): each row with the one after it; a guest, the first row of
    the next bucket, only serves the last row of its bucket."""
    previous, bucket, done = None, None, False
    names = [c.split()[0] for c in OUT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
    for batch in batches:
        rows = []
        for b, guest, doc_id, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if b != bucket:
                previous, bucket, done = None, b, False
            if done:
                continue
            current = _Text(doc_id, text)
            if previous is not None:
                rows.append(previous.row(current))
            previous, done = current, bool(guest)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and the likeness to this and to the next document.

    The last half of the edited text is taken from the next document by doc_id. Documents are cut into
    ranges of some ``BUCKET_ROWS`` by quantiles of doc_id; the first document of each range is sent to
    the range before it too, so no window runs over the whole table.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    rows = docs.count()
    # The driver sees one id per range. Beyond MOST_BUCKETS ranges they get longer instead of more; a
    # task streams its range and holds one batch.
    buckets = min(max(1, rows // BUCKET_ROWS), MOST_BUCKETS)
    cuts = sorted({int(c) for c in docs.approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 0.2 / buckets)}) if buckets > 1 else []
    # Bucket of an id: how many cuts are at or below it (null: none).
    def spread(low: int, high: int):
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col("doc_id") >= cuts[mid], spread(mid + 1, high)).otherwise(spread(low, mid))

    placed = docs.withColumn("bucket", spread(0, len(cuts)))
    heads = placed.groupBy("bucket").agg(F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull().cast("int")).alias("none")).orderBy("bucket").collect()
    before = {r["bucket"]: heads[i - 1]["bucket"] for i, r in enumerate(heads)}
    null_head = any(r["none"] for r in heads)
    # The head of the first range serves the last one; it is a null id if there is any.
    firsts = [(None if r["none"] else r["first"], before[r["bucket"]]) for r in heads]
    ids = [f for f, _ in firsts if f is not None]
    pick = F.col("doc_id").isin(ids) if ids else F.lit(False)
    goes = F.create_map(*[F.lit(x) for f in firsts if f[0] is not None for x in f]) if ids else None
    to = F.try_element_at(goes, F.col("doc_id")) if ids else F.lit(None).cast("int")
    if null_head:
        pick = pick | F.col("doc_id").isNull()
        to = F.when(F.col("doc_id").isNull(), F.lit(next(b for f, b in firsts if f is None))).otherwise(to)
    guests = docs.filter(pick).select(to.alias("bucket"), F.lit(True).alias("guest"), "doc_id", "text")
    own = placed.select("bucket", F.lit(False).alias("guest"), "doc_id", "text")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Ranges are dealt out in turn, so that no partition gets several while others get none.
    ordered = own.union(guests).repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "guest", "doc_id", "text")
    return ordered.mapInArrow(_pairs, OUT)


@query("op5_document_fingerprints")
def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
